"""The folder source against a plain walk: every name, links, problems, splits; and its stream across restarts."""

import os

import pytest

from tarn.sources import files as fs
from tarn.sources import folder


def plain(root, hidden=False, skip=()):
    out = []
    for at, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in skip and (hidden or not d.startswith(".")) and not os.path.islink(os.path.join(at, d))]
        out += [os.path.relpath(os.path.join(at, n), root) for n in names if (hidden or not n.startswith(".")) and not os.path.islink(os.path.join(at, n))]
    return sorted(out)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """A thousand folders, a third of them below one, with names of all kinds."""
    root = tmp_path_factory.mktemp("tree")
    for i in range(1_000):
        at = root / ("hot" if i % 3 == 0 else f"d{i % 17}") / ("_" if i % 5 == 0 else "." if i % 7 == 0 else "") .__add__(f"x{i}")
        at.mkdir(parents=True)
        for name in ("a.md", "_b.md", ".c.md", "ü é.txt")[: i % 5]:
            (at / name).write_text("x" * (i % 9))
    (root / "node_modules" / "deep").mkdir(parents=True)
    (root / "node_modules" / "deep" / "n.md").write_text("n")
    (root / "top.md").write_text("t")
    (root / "loop").symlink_to(root)
    (root / "hot" / "link.md").symlink_to(root / "top.md")
    (root / "away").symlink_to("/etc")
    return root


@pytest.mark.parametrize("splits", [1, 8, 256, 5_000])
@pytest.mark.parametrize("hidden", [False, True])
def test_every_file_once(spark, tree, splits, hidden):
    folder.register(spark)
    rows = spark.read.format("folder").option("splits", splits).option("hidden", hidden).option("skip", '["node_modules"]').load(str(tree)).collect()
    assert sorted(r.display_path for r in rows) == plain(tree, hidden, ("node_modules",)) and not any(r.problem for r in rows)
    assert all(os.path.getsize(r.path) == r.size_bytes and abs(os.path.getmtime(r.path) - r.modified_at.timestamp()) < 1e-3 for r in rows)


def test_the_driver_plans_subtrees_and_no_files(tree):
    walk = folder.Walk.of({"path": str(tree), "hidden": "true", "splits": "64"})
    parts = walk.plan()
    places = [p for part in parts for p in part]
    assert len(parts) == 64 and len(places) < 1_100 and all(os.path.isdir(p) for p, _ in places) and len(set(places)) == len(places)
    # the folder with a third of all files is in all parts
    assert sum(any("/hot/" in d for d, _ in p) for p in parts) == 64 and max(map(len, parts)) - min(map(len, parts)) <= 1
    assert folder.Walk.of({"path": str(tree), "splits": "1"}).plan() == [[(str(tree), True)]]


def test_wide_folders_are_not_read_by_the_driver(tmp_path, monkeypatch):
    monkeypatch.setattr(folder, "PLAN_ENTRIES", 10)
    for i in range(30):
        (tmp_path / f"d{i}").mkdir()
    assert folder.Walk.of({"path": str(tmp_path)}).plan() == [[(str(tmp_path), True)]]


def test_links_within_the_folder(spark, tree):
    names = {r.display_path for r in fs.scan_folder(spark, str(tree), fs.ScanPolicy(hidden=True), follow_links=True).collect()}
    assert "hot/link.md" in names and not any(n.startswith(("away", "loop")) for n in names)


def test_what_cannot_be_listed_is_told(spark, tmp_path):
    (tmp_path / "a.md").write_text("a")
    rows = fs.listed_folder(spark, str(tmp_path / "missing")).collect()
    assert [(r.path, r.problem) for r in rows] == [(str(tmp_path / "missing"), "failed")]
    os.makedirs(os.fsencode(tmp_path) + b"/d")
    with open(os.fsencode(tmp_path) + b"/d/\xff.md", "w") as f:
        f.write("bad name")
    assert sorted((r.display_path, r.problem) for r in fs.listed_folder(spark, str(tmp_path)).collect()) == [("a.md", None), ("d/�.md", "failed")]
    assert [r.display_path for r in fs.scan_folder(spark, str(tmp_path)).collect()] == ["a.md"]


def test_stream_takes_each_change_once(spark, tmp_path):
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    (root / "s").mkdir(parents=True)

    def step():
        found = fs.listed_folder(spark, str(root), stream=True)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r.display_path for r in spark.read.schema(found.schema).parquet(out).collect())

    (root / "a.md").write_text("a")
    (root / "_b.md").write_text("b")
    assert step() == ["_b.md", "a.md"] and step() == ["_b.md", "a.md"]
    # an old file that is moved in, and one that is written again
    old = tmp_path / "old.md"
    old.write_text("o")
    os.utime(old, (1_000, 1_000))
    os.rename(old, root / "s" / "old.md")
    (root / "a.md").write_text("a2")
    assert step() == ["_b.md", "a.md", "a.md", "s/old.md"] and step() == ["_b.md", "a.md", "a.md", "s/old.md"]
