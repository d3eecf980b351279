"""Folder trees listed level by level (A3)."""

import os

from pagelane.sources.files import folder_names
from pagelane.sources.tree import list_tree


def walked(root):
    """Entries as the operating system's own walk gives them, links not followed."""
    out = set()
    for folder, folders, files in os.walk(root):
        depth = 0 if folder == root else len(os.path.relpath(folder, root).split(os.sep))
        out |= {(folder, n, True, None, depth) for n in folders} | {(folder, n, False, os.path.getsize(os.path.join(folder, n)), depth) for n in files}
    return out


def listing(spark, root, **settings):
    rows = list_tree(spark, root, **settings).collect()
    found = {(r.folder, r.name, r.is_folder, r.length, r.depth) for r in rows}
    assert len(found) == len(rows) and all(r.path == f"{r.folder}/{r.name}" for r in rows)
    return found


def test_many_nested_folders(spark, tmpdir_fresh):
    """20,000 folders, one branch of them twelve levels deep."""
    for a in range(100):
        for b in range(199):
            os.makedirs(f"{tmpdir_fresh}/a{a:02d}/b{b:03d}")
    deep = tmpdir_fresh
    for i in range(12):
        deep += f"/deep{i}"
    os.makedirs(deep)
    for path in (f"{tmpdir_fresh}/a07/b003/x.pdf", f"{tmpdir_fresh}/y z%20.pdf", f"{deep}/last.pdf"):
        with open(path, "wb") as f:
            f.write(b"%PDF")
    found = listing(spark, tmpdir_fresh)
    assert found == walked(tmpdir_fresh) and len(found) == 100 + 19_900 + 12 + 3
    assert all(r.modified is not None for r in list_tree(spark, tmpdir_fresh, max_depth=1).collect())


def test_links_that_lead_back_end(spark, tmpdir_fresh):
    os.makedirs(f"{tmpdir_fresh}/in/deeper")
    open(f"{tmpdir_fresh}/in/f.txt", "w").close()
    os.symlink(tmpdir_fresh, f"{tmpdir_fresh}/in/deeper/back")
    os.symlink(f"{tmpdir_fresh}/in", f"{tmpdir_fresh}/in/self")
    os.symlink(f"{tmpdir_fresh}/nowhere", f"{tmpdir_fresh}/broken")
    rows = sorted((r.path[len(tmpdir_fresh):], r.is_folder) for r in list_tree(spark, tmpdir_fresh).collect())
    assert rows == [("/in", True), ("/in/deeper", True), ("/in/deeper/back", True), ("/in/f.txt", False), ("/in/self", True)]


def test_depth_and_missing_roots(spark, tmpdir_fresh):
    os.makedirs(f"{tmpdir_fresh}/a/b/c")
    assert {r.name for r in list_tree(spark, tmpdir_fresh, max_depth=2).collect()} == {"a", "b"}
    assert list_tree(spark, f"{tmpdir_fresh}/none").count() == 0 and folder_names(spark, f"{tmpdir_fresh}/none").count() == 0
    assert [r.name for r in folder_names(spark, f"file:{tmpdir_fresh}").collect()] == ["a"]
