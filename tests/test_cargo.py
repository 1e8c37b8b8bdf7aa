"""Cargo manifests over a small repository."""

from lodestar.sources import cargo as C
from lodestar.sources import rust

ROOT = '''
[workspace]
members = ["crates/*", "tools/gen", "../out", "tools/none", "."]
exclude = ["crates/old"]
[workspace.dependencies]
serde = { version = "1", features = ["derive"] }
core = { path = "crates/core", registry = "own" }
[package]
name = "top"
'''
FILES = {
    "Cargo.toml": ROOT,
    "src/main.rs": "mod a;",
    "src/a.rs": "",
    "crates/core/Cargo.toml": '[package]\nname = "core"\n[lib]\nname = "core_lib"\npath = "lib/root.rs"\n[dependencies]\nserde.workspace = true\n[dev-dependencies]\nserde = "2"',
    "crates/core/lib/root.rs": "",
    "crates/core/src/bin/tool.rs": "",
    "crates/core/tests/one.rs": "",
    "crates/core/tests/deep/two.rs": "",
    "crates/app/Cargo.toml": '[package]\nname = "my_app"\n[[bin]]\nname = "my-app"\n[[bin]]\nname = "extra"\n[[bin]]\nname = "gone"\n[[bin]]\npath = "../core/lib/root.rs"\n[dependencies]\ncore = { workspace = true, optional = true, features = ["z", "a"] }\nserde = { workspace = true, features = ["rc"] }\nup = { path = "../core" }\naway = { path = "../../../x" }\n[target."cfg(unix)".dependencies]\nlibc = "0.2"',
    "crates/app/src/main.rs": "",
    "crates/app/src/lib.rs": "",
    "crates/app/src/bin/extra.rs": "",
    "crates/old/Cargo.toml": '[package]\nname = "old"',
    "crates/bare/Cargo.toml": "[lib]",
    "crates/broken/Cargo.toml": "[package\nname=",
    "crates/a/b/Cargo.toml": '[package]\nname = "deep"',
    "tools/gen/Cargo.toml": '[package]\nname = "gen"',
    "notes/Cargo.toml.txt": "",
}


def test_cargo(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string").repartition(3)
    found = C.manifests(files).cache()
    assert {r.folder: r.package for r in found.collect()} == {"": "top", "crates/core": "core", "crates/app": "my_app", "crates/old": "old", "crates/bare": None, "crates/broken": None, "crates/a/b": "deep", "tools/gen": "gen"}
    assert [r.folder for r in found.filter("problem is not null").collect()] == ["crates/broken"]
    members, wrong = C.workspace_members(found)
    assert {(r.workspace, r.member) for r in members.collect()} == {("", x) for x in ("", "crates/core", "crates/app", "tools/gen")}
    assert {(r.code, r.subject) for r in wrong.collect()} == {("member_escapes", "../out"), ("member_missing", "tools/none"), ("member_without_package", "crates/bare"), ("member_without_package", "crates/broken")}
    deps = {(r.folder, r.name, r.kind): (r.version, r.path, r.registry, r.optional, r.features, r.folder_used) for r in C.dependencies(found, members).collect()}
    assert deps == {
        ("crates/core", "serde", "normal"): ("1", None, None, False, ["derive"], None), ("crates/core", "serde", "dev"): ("2", None, None, False, [], None),
        ("crates/app", "core", "normal"): (None, "crates/core", "own", True, ["a", "z"], "crates/core"), ("crates/app", "serde", "normal"): ("1", None, None, False, ["derive", "rc"], None),
        ("crates/app", "up", "normal"): (None, "../core", None, False, [], "crates/core"), ("crates/app", "away", "normal"): (None, "../../../x", None, False, [], None), ("crates/app", "libc", "normal"): ("0.2", None, None, False, [], None),
    }
    for more in (False, True):
        got, bad = C.targets(found, files, more)
        want = {("", "top", "bin", "src/main.rs"), ("crates/core", "core_lib", "lib", "crates/core/lib/root.rs"), ("crates/core", "tool", "bin", "crates/core/src/bin/tool.rs"), ("crates/app", "my_app", "lib", "crates/app/src/lib.rs"), ("crates/app", "my-app", "bin", "crates/app/src/main.rs"), ("crates/app", "extra", "bin", "crates/app/src/bin/extra.rs")}
        assert {(r.folder, r.name, r.kind, r.file) for r in got.collect()} == want | ({("crates/core", "one", "test", "crates/core/tests/one.rs")} if more else set())
        assert {(r.folder, r.code, r.subject) for r in bad.collect()} == {("crates/app", "target_missing", "src/bin/gone.rs"), ("crates/app", "target_outside", "../core/lib/root.rs")}
    roots = C.targets(found, files)[0].filter("kind = 'bin' and folder = ''").select("package", "folder", "file").withColumnRenamed("package", "crate")
    assert {tuple(r.module) for r in rust.module_tree(files, roots)[0].collect()} == {(), ("a",)}
    assert C.targets(found.limit(0), files.limit(0))[0].count() == 0
