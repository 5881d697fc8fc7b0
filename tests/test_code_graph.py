"""Parsing and name resolution on tiny repositories, all built in one job."""

import pytest
from pyspark.sql import functions as F

from heddle.functions.python_source import analyse_python
from heddle.functions.text import resolve_relative
from heddle.operators import propagate, render
from heddle.operators.resolve import MODULE_SYMBOL, build_graph

REPOS = {
    "layouts": {"src/pkg/__init__.py": "", "src/pkg/sub/__init__.py": "", "src/pkg/sub/mod.py": "", "top.py": "", "src/loose/deep.py": ""},
    "direct": {"a.py": "from b import helper\ndef go():\n    helper()\n", "b.py": "def helper():\n    pass\n"},
    "external": {"a.py": "import os\ndef join():\n    pass\ndef go():\n    os.path.join('x')\n"},
    "attribute": {"pkg/__init__.py": "", "pkg/b.py": "def helper():\n    pass\n", "a.py": "import pkg.b\ndef go():\n    pkg.b.helper()\n"},
    "aliased": {"pkg/__init__.py": "", "pkg/b.py": "class C:\n    def m(self):\n        pass\n", "a.py": "import pkg.b as q\nfrom pkg.b import C as D\ndef go():\n    q.C()\n    D.m()\n    D.nothing()\n"},
    "reexport": {"pkg/__init__.py": "from .mid import helper\n", "pkg/mid.py": "from .deep import helper\n", "pkg/deep.py": "def helper():\n    pass\n", "a.py": "import pkg\ndef go():\n    pkg.helper()\n"},
    "mro": {"base.py": "class Base:\n    def helper(self):\n        pass\n", "a.py": "from base import Base\nclass Child(Base):\n    def go(self):\n        self.helper()\n        self.absent_name()\n"},
    "diamond": {"a.py": "class A:\n    def m(self):\n        pass\nclass B:\n    def m(self):\n        pass\nclass C(B, A):\n    def go(self):\n        self.m()\nclass D(D):\n    def go(self):\n        self.m()\n"},
    "names": {"one.py": "class X:\n    def lone(self):\n        pass\n    def two(self):\n        pass\n    def four(self):\n        pass\n", "two.py": "class Y:\n    def two(self):\n        pass\n    def four(self):\n        pass\n    def bad(self):\n        pass\n", "three.py": "class Z:\n    def four(self):\n        pass\nclass W:\n    def four(self):\n        pass\n", "go.py": "def go(obj):\n    obj.lone()\n    obj.two()\n    obj.four()\n    obj.none_such()\n"},
    "colliding": {"x/conftest.py": "def f():\n    pass\n", "y/conftest.py": "def f():\n    pass\n", "a.py": "import conftest\nfrom conftest import f\n"},
    "broken": {"bad.py": "def (:\n", "good.py": "def f():\n    pass\n", "deep.py": "x = " + "+".join(["1"] * 30000) + "\n"},
    "twice": {"a.py": "class P:\n    @property\n    def v(self):\n        return 1\n    @v.setter\n    def v(self, x):\n        g()\ndef g():\n    g()\n"},
    "hub": {"util.py": "def hub():\n    pass\ndef seed():\n    hub()\n    near()\ndef near():\n    pass\n", **{f"c{i}.py": f"from util import hub\ndef c{i}():\n    hub()\n" for i in range(30)}},
}


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(r, p, s) for r, files in REPOS.items() for p, s in files.items()]
    return build_graph(spark.createDataFrame(rows, "repo_id string, path string, source string").repartition(4))


@pytest.fixture(scope="module")
def edges(graph):
    found = {}
    for r in graph.edges.collect():
        found.setdefault(r.repo_id, {}).setdefault(r.relation, {})[(r.src, r.dst)] = (r.via, r.confidence)
    return found


@pytest.fixture(scope="module")
def stats(graph):
    found = {}
    for r in graph.stats().collect():
        found.setdefault(r.repo_id, {})[r.name] = r.n
    return found


def test_modules(graph):
    named = {(r.repo_id, r.path): r.module for r in graph.files.collect()}
    assert [named["layouts", p] for p in ("src/pkg/__init__.py", "src/pkg/sub/mod.py", "top.py", "src/loose/deep.py")] == ["pkg", "pkg.sub.mod", "top", "deep"]


@pytest.mark.parametrize(("importer", "package", "level", "target", "want"), [("pkg.mod", False, 0, "os.path", "os.path"), ("pkg.mod", False, 1, "x", "pkg.x"), ("pkg", True, 1, "x", "pkg.x"), ("pkg.sub.mod", False, 2, "x", "pkg.x"), ("pkg.sub.mod", False, 1, "", "pkg.sub"), ("mod", False, 3, "x", "x")])
def test_relative_imports(spark, importer, package, level, target, want):
    row = spark.range(1).select(resolve_relative(F.lit(importer), F.lit(package), F.lit(level), F.lit(target)).alias("m")).first()
    assert row.m == want


def test_calls_by_tier(edges):
    assert edges["direct"]["calls"] == {("a.py::go", "b.py::helper"): ("direct", 1.0)}
    assert edges["attribute"]["calls"] == {("a.py::go", "pkg/b.py::helper"): ("attribute", 0.9)}
    assert edges["reexport"]["calls"] == {("a.py::go", "pkg/deep.py::helper"): ("attribute", 0.9)}
    assert edges["mro"]["calls"] == {("a.py::Child.go", "base.py::Base.helper"): ("self_mro", 0.85)}
    assert edges["names"]["calls"] == {("go.py::go", "one.py::X.lone"): ("unique_name", 0.5), ("go.py::go", "one.py::X.two"): ("ambiguous", 0.25), ("go.py::go", "two.py::Y.two"): ("ambiguous", 0.25)}
    # an attribute that a class lacks falls back to the class
    assert edges["aliased"]["calls"] == {("a.py::go", "pkg/b.py::C"): ("attribute", 0.9), ("a.py::go", "pkg/b.py::C.m"): ("attribute", 0.9)}


def test_external_receivers_make_no_edge(edges, stats):
    assert "calls" not in edges["external"] and stats["external"]["call_external"] == 1


def test_base_order_and_cycles(edges):
    assert edges["diamond"]["inherits"].keys() == {("a.py::C", "a.py::B"), ("a.py::C", "a.py::A")}
    assert edges["diamond"]["calls"][("a.py::C.go", "a.py::B.m")] == ("self_mro", 0.85)
    assert ("a.py::D.go", "a.py::A.m") in edges["diamond"]["calls"]  # by name: two candidates


def test_outcomes(stats):
    assert {k: v for k, v in stats["names"].items() if k.startswith("call_")} == {"call_unique_name": 1, "call_ambiguous": 1, "call_too_ambiguous": 1, "call_unresolved": 1}
    assert stats["colliding"]["ambiguous_modules"] == 1 and stats["colliding"]["import_external"] == 2
    assert stats["broken"]["parse_errors"] == 2 and stats["broken"]["files"] == 3


def test_colliding_modules_own_nothing(edges):
    assert "imports" not in edges["colliding"]


def test_a_name_defined_twice_is_one_node(graph, edges):
    nodes = graph.nodes.filter("repo_id = 'twice'").collect()
    v = [n for n in nodes if n.qualname == "P.v"]
    assert len(v) == 1 and (v[0].start_line, v[0].end_line, v[0].decorators) == (5, 7, ["v.setter"])
    # a call to itself is no edge
    assert edges["twice"]["calls"] == {("a.py::P.v", "a.py::g"): ("direct", 1.0)}


def test_imports_go_to_the_module_named(edges):
    m = MODULE_SYMBOL
    assert edges["reexport"]["imports"].keys() == {(f"a.py::{m}", f"pkg/__init__.py::{m}"), (f"pkg/__init__.py::{m}", f"pkg/mid.py::{m}"), (f"pkg/mid.py::{m}", f"pkg/deep.py::{m}")}


def test_analyser_scopes():
    found = analyse_python("m.py", "import a.b as c\nfrom . import d, e as f\nif 1:\n    @mark.it(dec())\n    async def g(x=default()):\n        def inner():\n            class K(Base[0], m.Base):\n                y = in_class()\n                def meth(self):\n                    self.a.b(arg())\n        return inner\nf()[0].g()\n")
    kinds = {s["qualname"]: (s["kind"], s["start_line"], s["end_line"], s["parent"]) for s in found["symbols"]}
    assert kinds == {"g": ("function", 4, 11, None), "g.inner": ("function", 6, 10, "g"), "g.inner.K": ("class", 7, 10, "g.inner"), "g.inner.K.meth": ("method", 9, 10, "g.inner.K")}
    assert found["symbols"][0]["decorators"] == ["mark.it"]
    assert [(i["module"], i["name"], i["alias"], i["level"]) for i in found["imports"]] == [("a.b", None, "c", 0), ("", "d", None, 1), ("", "e", "f", 1)]
    # a call in a class body belongs to the function around it; defaults and bases are not walked
    assert [(c["caller"], c["callee"]) for c in found["calls"]] == [(None, "mark.it"), (None, "dec"), ("g.inner", "in_class"), ("g.inner.K.meth", "self.a.b"), ("g.inner.K.meth", "arg"), (None, "f")]
    assert [(b["cls"], b["base"]) for b in found["bases"]] == [("g.inner.K", "m.Base")]


@pytest.mark.parametrize("source", ["def (", "x = '\x00'", "x = " + "(" * 500, "\ud800"])
def test_analyser_never_raises(source):
    assert analyse_python("m.py", source)["symbols"] == [] and analyse_python("m.py", source)["errors"]


def test_a_hub_does_not_outrank_its_callers(spark, graph):
    edges = graph.edges.filter("repo_id = 'hub'")
    nodes = graph.nodes.filter("repo_id = 'hub'").select("node", (F.col("qualname") == MODULE_SYMBOL).alias("is_module"))
    seeds = spark.createDataFrame([("i", "util.py::hub", 1.0), ("i", "gone.py::x", 1.0)], "issue_id string, node string, weight double")
    settings = propagate.configs(spark, [("two", 2, 0.0, False), ("sure", 2, 1.1, False), ("none", 0, 0.0, False)])
    reached = propagate.spread(edges, nodes, seeds, settings)
    got = {(r.config, r.node): (r.rank, r.score, r.distance) for r in propagate.ranked(reached).collect()}
    assert got["two", "util.py::hub"] == (1, 1.0, 0) and got["none", "util.py::hub"][0] == 1
    share = 0.55 / 32  # thirty callers, the seed's caller and the module
    assert got["two", "c7.py::c7"][1] == pytest.approx(share, abs=1e-6) and got["two", "util.py::seed"][2] == 1
    assert got["two", "util.py::near"][2] == 2
    assert not any(c == "sure" and d for (c, _), (_, _, d) in got.items())
    assert not any(n.endswith(MODULE_SYMBOL) for _, n in got)
    stats = {r.config: r for r in propagate.spread_stats(reached, seeds).collect()}
    assert stats["two"].seeds_given == 2 and stats["two"].seeds_found == 1


def only(graph, repo):
    from dataclasses import replace

    return replace(graph, nodes=graph.nodes.filter(F.col("repo_id") == repo), edges=graph.edges.filter(F.col("repo_id") == repo), files=graph.files.filter(F.col("repo_id") == repo))


def test_render(graph):
    reexport = only(graph, "reexport")
    chart = render.to_mermaid(reexport)
    assert chart.startswith("flowchart LR\n") and '("pkg/")' in chart and '("mid")' in chart and ".py" not in chart and chart.count("-->") == 3
    assert '"mid"' not in render.to_mermaid(reexport, exclude=("mid",)) and '"deep"' in render.to_mermaid(reexport, exclude=("dee",))
    with pytest.raises(ValueError, match="max_nodes=2"):
        render.to_mermaid(reexport, max_nodes=2)
    assert "nothing is imported" in render.to_mermaid(only(graph, "external")) and render.to_dot(reexport).count("->") == 3
    top = render.module_summary(only(graph, "hub")).first()
    assert (top.path, top.fan_in, top.fan_out) == ("util.py", 30, 0)


def test_a_long_chain_of_re_exports(spark):
    n = 13
    files = [("r", f"m{i}.py", f"from m{i + 1} import thing\n") for i in range(n)] + [("r", f"m{n}.py", "def thing():\n    pass\n"), ("r", "other.py", "def thing():\n    pass\n"), ("r", "use.py", "import m0\ndef f():\n    m0.thing()\n")]
    calls = build_graph(spark.createDataFrame(files, "repo_id string, path string, source string")).edges.filter("relation = 'calls'").collect()
    assert [(c.src, c.dst, c.via) for c in calls] == [("use.py::f", f"m{n}.py::thing", "attribute")]


def test_reindexing_forgets_what_went(spark, tmp_path):
    from heddle.streaming.reindex import CHANGES, Reindexer

    index = Reindexer(spark, f"file://{tmp_path}/index")
    batch = lambda *rows: spark.createDataFrame(list(rows), CHANGES)
    index.apply(batch(("r", "a.py", "def f():\n    g()\ndef g():\n    pass\n", 1), ("s", "b.py", "def h():\n    pass\n", 1)), 0)
    count = lambda: {name: {r.repo_id: r["count"] for r in index.table(name).groupBy("repo_id").count().collect()} for name in ("files", "nodes", "edges")}
    assert count() == {"files": {"r": 1, "s": 1}, "nodes": {"r": 3, "s": 2}, "edges": {"r": 3, "s": 1}}
    index.apply(batch(("r", "a.py", None, 2)), 1)
    spark.catalog.clearCache()
    assert count() == {"files": {"s": 1}, "nodes": {"s": 2}, "edges": {"s": 1}}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"


def test_errors_and_symbols_of_a_file(spark):
    rows = [("r", f"bad{i:02}.py", "def (") for i in range(25)] + [("r", "good.py", "def f():\n    pass\n"), ("s", "bad.py", "x = ")]
    graph = build_graph(spark.createDataFrame(rows, "repo_id string, path string, source string"))
    told = graph.first_errors().collect()
    assert sorted(r.path for r in told if r.repo_id == "r") == [f"bad{i:02}.py" for i in range(20)] and [r.path for r in told if r.repo_id == "s"] == ["bad.py"]
    assert sorted(r.qualname for r in graph.symbols_in("good.py").collect()) == ["<module>", "f"]
