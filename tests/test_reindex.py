"""Incremental indexing against full rebuilds, and versions of tables."""


import pytest

from heddle.operators.resolve import build_graph
from heddle.sources.snapshots import Conflict, Snapshots
from heddle.streaming.reindex import CHANGES, Reindexer

FILE = "repo_id string, path string, source string"


def rows(df, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.select(*columns).collect())


def same_as_full(spark, index, files):
    full = build_graph(spark.createDataFrame([(r, p, s) for (r, p), s in files.items()], FILE))
    got = index.graph()
    for table, columns in (("edges", ["repo_id", "src", "dst", "relation", "confidence", "via", "line"]), ("nodes", ["repo_id", "node", "kind", "start_line", "end_line", "module"]), ("refs", ["repo_id", "outcome"]), ("files", ["repo_id", "path", "module", "n_lines"])):
        assert rows(getattr(got, table), columns) == rows(getattr(full, table), columns), table


def put(spark, index, files, number, changes):
    for (repo, path), source in changes.items():
        if source is None:
            files.pop((repo, path), None)
        else:
            files[repo, path] = source
    return index.apply(spark.createDataFrame([(r, p, s, number) for (r, p), s in changes.items()], CHANGES), number)


BASE = {
    ("r", "pkg/__init__.py"): "from .core import thing\n",
    ("r", "pkg/core.py"): "def thing():\n    helper()\ndef helper():\n    pass\n",
    ("r", "use.py"): "import pkg\nfrom pkg.core import helper\ndef go():\n    pkg.thing()\n    helper()\n    far()\n",
    ("r", "base.py"): "class A:\n    def m(self):\n        pass\nclass B:\n    def m(self):\n        pass\n",
    ("r", "mid.py"): "from base import A, B\nclass M(A):\n    pass\n",
    ("r", "leaf.py"): "from mid import M\nclass L(M):\n    def go(self):\n        self.m()\n",
    ("r", "alone.py"): "def quiet():\n    quiet()\n",
    ("q", "a.py"): "def thing():\n    pass\n",
}
STEPS = [
    # a re-exported name goes, and a name called by its short form comes
    ({("r", "pkg/core.py"): "def helper():\n    pass\n", ("r", "new.py"): "def far():\n    pass\n"}, {"pkg/core.py", "pkg/__init__.py", "use.py", "new.py"}),
    ({("r", "mid.py"): "from base import A, B\nclass M(B):\n    pass\n"}, {"mid.py", "leaf.py"}),  # another base
    # a folder is no package any more, and files go and come in two repositories
    ({("r", "pkg/__init__.py"): None, ("r", "alone.py"): None, ("q", "b.py"): "from a import thing\nthing()\n"}, {"pkg/core.py", "use.py", "b.py"}),
]


def test_every_step_equals_a_full_rebuild(spark, tmp_path):
    index, files = Reindexer(spark, f"file://{tmp_path}/index"), {}
    assert put(spark, index, files, 0, BASE)["parsed"] == len(BASE)
    for number, (changes, most) in enumerate(STEPS, 1):
        facts = put(spark, index, files, number, changes)
        assert facts["parsed"] == sum(s is not None for s in changes.values())
        assert facts["resolved"] <= len(most), (number, facts)
        if number == len(STEPS):  # what an earlier step left wrong would show here too
            same_as_full(spark, index, files)
    assert put(spark, index, dict(files), 3, {("r", "x.py"): "def lost():\n    pass\n"})["batches"] == [0, 1, 2, 3] and index.open().version == 4  # sent again: not applied
    edges = rows(index.table("edges"), ["repo_id", "src", "dst"])
    assert index.apply(spark.createDataFrame([("r", "use.py", "late = 1\n", -1)], CHANGES), 6)["changed"] == 0
    assert rows(index.table("edges"), ["repo_id", "src", "dst"]) == edges


def test_one_file_of_a_thousand(spark, tmp_path):
    index, files = Reindexer(spark, f"file://{tmp_path}/index"), {}
    many = {("r", f"m{i}.py"): f"def f{i}():\n    pass\n" for i in range(1000)} | {("r", "user.py"): "from m7 import f7\ndef go():\n    f7()\n"}
    put(spark, index, files, 0, many)
    facts = put(spark, index, files, 1, {("r", "m7.py"): "\n\ndef f7():\n    f8()\n"})
    assert (facts["changed"], facts["parsed"]) == (1, 1) and facts["resolved"] <= 2
    assert rows(index.table("edges").filter("relation = 'calls'"), ["src", "dst"]) == ["('m7.py::f7', 'm8.py::f8')", "('user.py::go', 'm7.py::f7')"]
    assert index.table("nodes").filter("node = 'm7.py::f7' AND start_line = 3").count() == 1


def test_readers_keep_their_version(spark, tmp_path, monkeypatch):
    index, files = Reindexer(spark, f"file://{tmp_path}/index"), {}
    put(spark, index, files, 0, BASE)
    reader = index.open()
    before = rows(reader.table("edges"), ["repo_id", "src", "dst"])
    written, plain = [], index.snapshots.write

    def failing(name, table, key):
        if written:
            raise RuntimeError("lost")
        written.append(name)
        return plain(name, table, key)

    monkeypatch.setattr(index.snapshots, "write", failing)
    with pytest.raises(RuntimeError, match="lost"):
        put(spark, index, dict(files), 1, STEPS[0][0])
    assert index.open().version == 1  # the first table is written, and in no version
    monkeypatch.setattr(index.snapshots, "write", plain)
    put(spark, index, files, 1, STEPS[0][0])
    assert index.open().version == 2 and reader.version == 1
    assert rows(reader.table("edges"), ["repo_id", "src", "dst"]) == before != rows(index.table("edges"), ["repo_id", "src", "dst"])
    assert rows(index.table("edges", 1), ["repo_id", "src", "dst"]) == before


def test_two_writers_and_what_is_cleared(spark, tmp_path):
    at = Snapshots(spark, f"file://{tmp_path}/t")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    base = at.open()
    first = at.commit(base, {"t": at.write("t", one, "k")}, list(range(64)), {})
    with pytest.raises(Conflict):
        at.commit(base, {"t": at.write("t", one, "k")}, [], {})
    at.commit(first, {"t": at.write("t", one.filter("v = 2"), "k")}, list(range(64)), {})
    assert rows(at.open().table("t"), ["k"]) == ["('b',)"] and rows(at.open(1).table("t"), ["k"]) == ["('a',)", "('b',)"]
    assert at.vacuum(1) == 2 and at.versions() == [2] and rows(at.open().table("t"), ["k"]) == ["('b',)"]
    with pytest.raises(KeyError):
        at.open(1)
