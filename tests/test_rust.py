"""Rust module trees: the lexer, cfg conditions, and the fixpoint against a recursion over a small repository."""

import posixpath

from lodestar.sources import rust as R

LIB = '''
//! mod not_me;
#![allow(dead_code)]
pub mod a;
pub(crate) mod b;
#[path = "odd/place.rs"]
mod c;
#[cfg(test)] mod tests;
#[cfg(all(feature = "x, (y", test))]
mod more_tests;
#[cfg(any(test, unix))] mod unix;
mod missing;
#[path = "../../out.rs"] mod out;
/* mod no; /* nested mod no2; */ mod no3; */
const S: &str = "mod no4;"; const R: &str = r#"mod "no5"; "#; const C: char = '{'; fn f<'a>(x: &'a str) { mod_like(); }
fn g() { mod inside_function; }
mod inline { pub mod deep; mod again { mod deeper; } #[cfg(test)] mod t { mod never; } }
mod r#type;
'''
FILES = {
    "k/src/lib.rs": LIB,
    "k/src/a.rs": "mod x; mod y;",
    "k/src/a/x.rs": "",
    "k/src/a/y/mod.rs": "mod z;",
    "k/src/a/y/z.rs": "mod z;",  # asks for a/y/z/z.rs
    "k/src/b/mod.rs": '#[path = "../b/self.rs"] mod me;',
    "k/src/b/self.rs": '#[path = "../self.rs"] mod me;',  # its own file, once more
    "k/src/odd/place.rs": "mod q;",
    "k/src/odd/c/q.rs": "",
    "k/src/tests.rs": "mod helper;",
    "k/src/more_tests.rs": "",
    "k/src/unix.rs": "",
    "k/src/inline/deep.rs": "",
    "k/src/again/deeper.rs": "",
    "k/src/type.rs": "",
    "k/src/main.rs": "mod a;",
    "out.rs": "",
}


def walk(root, folder, tests):
    found, wrong, visited = set(), set(), set()

    def visit(module, file, trail=()):
        if (module, file) in visited:
            return
        visited.add((module, file))
        found.add((module, "file_module" if module else "crate", file))
        for inline, name, body, override, _, only, line in R.modules_of(FILES[file]):
            if only and not tests:
                continue
            child = (*module, *inline, name)
            if body:
                found.add((child, "inline_module", file))
                continue
            last = inline[-1] if inline else module[-1] if module else None
            here = posixpath.dirname(file)
            base = here if last is None or file.endswith("/mod.rs") else f"{here}/{last}"
            tries = [posixpath.normpath(f"{base}/{x}") for x in ([override] if override else [f"{name}.rs", f"{name}/mod.rs"])]
            inside = [t for t in tries if t.startswith(f"{folder}/")]
            hit = next((t for t in inside if t in FILES), None)
            if hit in (*trail, file):
                wrong.add((file, line, "circular", override or name))
            elif hit:
                visit(child, hit, (*trail, file))
            else:
                wrong.add((file, line, "path_escapes" if override and not inside else "source_missing", override or name))

    visit((), root)
    return found, wrong


def test_items():
    got = [(inline, name, body, override, only) for inline, name, body, override, _, only, _ in R.modules_of(LIB)]
    assert [x[1] for x in got] == ["a", "b", "c", "tests", "more_tests", "unix", "missing", "out", "inline", "deep", "again", "deeper", "t", "never", "type"]
    assert [x[1] for x in got if x[4]] == ["tests", "more_tests", "t", "never"] and got[2][3] == "odd/place.rs"
    assert [x[0] for x in got if x[1] in ("deep", "deeper", "never")] == [["inline"], ["inline", "again"], ["inline", "t"]]
    assert [R.modules_of(LIB)[i][6] for i in (0, 2, 4)] == [4, 7, 10]


def test_conditions():
    for c, want in {"test": True, " Test ": True, "not(test)": False, "any(test, unix)": False, "any(test, all(test, unix))": True, "all(unix, any(test))": True, "all()": False, 'feature = "test"': False}.items():
        assert R.test_only(c) is want, c


def test_tree(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string").repartition(3)
    roots = spark.createDataFrame([("k", "k", "k/src/lib.rs"), ("k-bin", "k", "k/src/main.rs"), ("gone", "k", "k/src/none.rs")], "crate string, folder string, file string")
    for tests in (False, True):
        got, bad = R.module_tree(files, roots, tests)
        got, bad = got.collect(), bad.collect()
        for crate, root in (("k", "k/src/lib.rs"), ("k-bin", "k/src/main.rs")):
            found, wrong = walk(root, "k", tests)
            assert {(tuple(r.module), r.kind, r.file) for r in got if r.crate == crate} == found
            assert {(r.file, r.line, r.code, r.subject) for r in bad if r.crate == crate} == wrong and found
        assert {r.crate for r in got} == {"k", "k-bin"}
    assert R.module_tree(files.limit(0), roots.limit(0))[0].count() == 0
