"""The folder source: nested ignore files, excluded folders never entered, pushed filters, nothing read in vain."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.sources import folder

FILES = {
    ".gitignore": "build/\n!build/keep.txt\n*.log\nout/*\n!out/keep.md\n/top.txt\n", "build/keep.txt": "x", "a.log": "x", "out/keep.md": "kept", "out/other.md": "x", "top.txt": "x", "sub/top.txt": "kept",
    "sub/.gitignore": "!b.log\nlocal/\n*.tmp\n", "sub/b.log": "kept", "sub/c.log": "x", "sub/deep/b.log": "kept", "sub/local/x.py": "x", "local/x.py": "kept", "sub/deep/er/still/z.tmp": "x", "sub/deep/er/still/z.py": "kept",
    "target/x.rs": "x", "sub/target/x.rs": "kept", "p.png": "x", ".hidden/x.py": "x", "node_modules/a/b.js": "x", "Cargo.lock": "x", "plain": "kept", "w.tar.GZ": "kept",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bytes.txt").write_bytes(b"\xff\xfe\x00")
    return tmp_path


WANTED = {k for k, v in FILES.items() if v == "kept"}


@pytest.mark.parametrize("deep", [0, 1, 3])
def test_walk(spark, tree, monkeypatch, deep):
    monkeypatch.setattr(folder, "DEEP", deep)
    got = ingest.scan(spark, str(tree)).collect()
    assert sorted(r["file_path"] for r in got) == sorted(WANTED) and {r["content"] for r in got} == {"kept"}
    parts = folder.FolderReader({"path": str(tree)}).partitions()
    assert len(parts) == 1 if deep == 0 else len(parts) > 2


def test_ignored_bytes_are_not_read(spark, tree):
    for name in ("build/huge.txt", "sub/local/huge.py", "huge.log"):
        with open(tree / name, "wb") as f:
            os.truncate(f.fileno(), 1 << 42)  # no task could hold it
    assert ingest.scan(spark, str(tree)).count() == len(WANTED)
    (tree / "huge.txt").touch()
    os.truncate(tree / "huge.txt", 1 << 42)
    sizes = spark.read.format("folder").option("content", "false").load(str(tree))
    assert {r["file_path"]: r["size"] for r in sizes.collect()}["huge.txt"] == 1 << 42


def test_filters_keep_the_walk_to_their_folders(spark, tree, monkeypatch):
    reader = folder.FolderReader({"path": str(tree)})
    list(reader.pushFilters([folder.StringStartsWith(("file_path",), "sub/deep/")]))
    entered = []
    listed = folder.FolderReader._listed
    monkeypatch.setattr(folder.FolderReader, "_listed", lambda self, store, base, part: entered.append(part.folder) or listed(self, store, base, part))
    got = [path for part in reader.partitions() for path, _ in reader._walk(part)]
    assert sorted(got) == ["sub/deep/b.log", "sub/deep/er/still/z.py"] and set(entered) == {"", "sub", "sub/deep", "sub/deep/er", "sub/deep/er/still"}
    rows = ingest.scan(spark, str(tree)).where(F.col("file_path").startswith("sub/deep/"))
    assert sorted(r["file_path"] for r in rows.collect()) == sorted(got)
    assert [r["content"] for r in ingest.scan(spark, "file://" + str(tree)).where("file_path = 'plain'").collect()] == ["kept"]


def test_indexable_is_the_column_form(spark):
    paths = [*FILES, "a/b/vendor/c.py", "vendored/x", "x.PNG", "a/.b/c", "a.b/c.lock", "yarn.lock", "dist/x", "adist/x", "noext.", ".env"]
    got = {r["p"]: r["ok"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", ingest.indexable("p").alias("ok")).collect()}
    assert got == {p: folder.indexable(p) for p in paths}


def test_nothing_under_an_excluded_folder_comes_back(spark):
    df = spark.createDataFrame([(p,) for p in FILES], "p string")
    rules = {"": FILES[".gitignore"].splitlines(), "sub": FILES["sub/.gitignore"].splitlines()}
    got = {r["p"] for r in df.where(~ingest.ignored("p", rules)).collect()}
    assert "build/keep.txt" not in got and "out/keep.md" in got and "sub/b.log" in got and "sub/local/x.py" not in got


def test_empty_folder(spark, tmp_path):
    assert ingest.scan(spark, str(tmp_path)).count() == 0
