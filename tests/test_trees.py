"""Tree scans against os.walk: excluded directories are never opened, links never followed."""

import os

import pytest
from pyspark.sql import functions as F

from lodestar.functions.paths import EXCLUDED_DIRECTORIES
from lodestar.sources import files, trees


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for path in ("go.mod", "a/b/c/d/e.go", "a/node_modules/x/y.js", "a/b/Vendor/z.go", "a/b/.git/config", "sub/target.rs", "sub/target/t.rs", "empty/.keep", "ünï/日本.md", *(f"many/{i}/f{i}.py" for i in range(80))):
        os.makedirs(top / os.path.dirname(path), exist_ok=True)
        (top / path).write_bytes(path.encode() * (len(path) % 3))
    os.symlink(top / "a", top / "link")
    os.symlink(top / "go.mod", top / "a/copy.mod")
    os.mkfifo(top / "a/pipe")
    return str(top)


def walked(root):
    out, dirs = {}, set()
    for at, below, names in os.walk(root):
        below[:] = [d for d in below if d.lower() not in EXCLUDED_DIRECTORIES and not os.path.islink(f"{at}/{d}")]
        dirs.add(os.path.relpath(at, root).replace(".", "", 1) if at == root else os.path.relpath(at, root))
        out |= {os.path.relpath(f"{at}/{n}", root): open(f"{at}/{n}", "rb").read() for n in names if os.path.isfile(f"{at}/{n}") and not os.path.islink(f"{at}/{n}")}
    return out, dirs


@pytest.mark.parametrize("partitions", [1, 3, 64, 500])
def test_scan(spark, root, partitions):
    want, dirs = walked(root)
    got = trees.scan(spark, f"file://{root}", content=True, directories=True, partitions=partitions).collect()
    assert {r.path: bytes(r.content) for r in got if r.kind == "file"} == want
    seen = [r.path for r in got if r.kind == "directory"]
    assert sorted(seen) == sorted(dirs) and not any("node_modules" in d or "Vendor" in d for d in seen)  # each opened once, no other
    assert all(r.problem is None for r in got) and len(got) == len(want) + len(dirs)


def test_sizes_without_content_and_roots(spark, root):
    got = trees.scan(spark, root)
    assert {r.path: r.bytes for r in got.collect()} == {p: len(c) for p, c in walked(root)[0].items()}
    assert got.filter("content is not null").count() == 0
    assert [(r.root, r.markers) for r in files.root_candidates(got).collect()] == [(".", ["go.mod"])]
    with pytest.raises(Exception, match="nothing-here"):
        trees.scan(spark, f"{root}/nothing-here").collect()


def test_round_trip(spark, tmp_path):
    data = spark.createDataFrame([("x/a.md", "é\n"), ("x/y/b.md", None), ("dist/c.md", "gone")], "path string, content string")
    assert sorted(tuple(r) for r in trees.write_tree(data, f"file://{tmp_path}/t").collect()) == [("dist/c.md", 4), ("x/a.md", 3), ("x/y/b.md", 0)]
    back = trees.scan(spark, f"file://{tmp_path}/t", content=True).select("path", F.decode("content", "UTF-8").alias("c"))
    assert sorted(tuple(r) for r in back.collect()) == [("x/a.md", "é\n"), ("x/y/b.md", "")]
