import shutil
import subprocess

import pytest

from archspan.operators import ranges, vcs
from archspan.sources import tree


@pytest.fixture
def repo(tmp_path):
    if shutil.which("git") is None:
        pytest.skip("no git here")

    def git(*args):
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True, text=True).stdout.strip()

    git("init", "-q", "-b", "main")
    shas = []
    for n in range(3):
        (tmp_path / "a.py").write_text("\n".join(f"line {i}" for i in range(n + 1)) + "\n")
        (tmp_path / ".gitignore").write_text("out/\n")
        git("add", ".")
        git("commit", "-q", "-m", f"step {n}")
        shas.append(git("rev-parse", "HEAD"))
    git("checkout", "-q", "-b", "side", shas[0])
    git("commit", "-q", "--allow-empty", "-m", "aside")
    side = git("rev-parse", "HEAD")
    git("checkout", "-q", "main")
    git("merge", "-q", "--no-ff", "-m", "join", "side")
    return tmp_path, shas, side, git("rev-parse", "HEAD")


def test_descendants_follow_first_parents(spark, repo):
    path, shas, side, merge = repo
    commits = tree.commits(spark, str(path))
    assert commits.count() == 5
    found = vcs.descendants(commits, shas[0])
    assert {(r["sha"], r["depth"]) for r in found.collect()} == {(shas[1], 1), (side, 1), (shas[2], 2), (merge, 3)}
    assert {r["sha"] for r in vcs.descendants(commits, side).collect()} == set()
    rows = vcs.listing(found, tree.subjects(spark, str(path))).collect()
    assert [r["sha"] for r in rows] == sorted(r["sha"] for r in rows)
    assert {r["subject"] for r in rows} == {"step 1", "step 2", "aside", "join"}


def test_diff_and_ignored(spark, repo):
    path, *_ = repo
    (path / "a.py").write_text("line 0\nchanged\nline 2\nmore\n")
    changed = ranges.hunks(tree.diff_lines(spark, str(path)))
    assert {(r["path"], r["start"], r["end"]) for r in changed.collect()} == {("a.py", 2, 2), ("a.py", 4, 4)}
    assert {r["path"] for r in tree.git_ignored(spark, str(path), ["a.py", "out/", "out/x.py"]).collect()} == {"out/", "out/x.py"}
