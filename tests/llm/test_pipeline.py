"""The pipeline's stages against the operators' plain versions, on a small corpus in files."""

import json

import corpus_pipeline
from heddle.llm import queries

from . import brute
from .test_text import GOOD, labelled, public_coder


def test_pipeline(spark, tmp_path):
    rows, marks = labelled(80)
    distinct = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    rows = [(i, f"{t}\n{distinct(i)}" if i % 4 else t) for i, t in rows]
    rows += [(500, rows[1][1]), (501, rows[1][1] + "\n" + GOOD[0])]
    passage = " ".join(f"bench{k}" for k in range(20))
    rows.append((600, f"{GOOD[1]}\n{passage}\n{GOOD[2]}"))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, passage), (2, "not there at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    bad = {i for i, q, _ in marks if not q}
    left = [(i, t) for i, t in rows if i not in bad]
    lined = brute.kept_lines(left)
    named = brute.simhash(list(lined.items()))
    kept = [(i, t) for i, t in lined.items() if named[i][1] == i]
    judged = brute.contamination(kept, items)
    kept = [(i, t) for i, t in kept if not judged[i][4]]
    _, _, coder = public_coder()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: coder.encode_ordinary(t) for i, t in kept}
    assert all(r.n_tokens == len(r.ids) and r.decoded_sha256 == brute.sha(dict(kept)[r.doc_id]) for r in got)
    assert 600 not in {r.doc_id for r in got} and 1 in {r.doc_id for r in got}
    assert {r.n_chars for r in got} == {len(t) for _, t in kept}


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names go through; an empty table gives an empty result."""
    rows, marks = labelled(40)
    rows = [(i, t, "en", "s", len(t), "clash", 1) for i, t in rows] + [(None, GOOD[0], None, None, None, None, None), (700, None, "en", "s", 0, None, 1), (701, "", "en", None, 0, "", 2), (702, GOOD[1] + " long" * 50_000, "en", "s", 1, "x", 3)]
    rows += [rows[0], rows[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lost string, rid long"
    for name, docs in (("full", rows), ("empty", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "not there"), (None, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at)
        assert got.columns == ["doc_id", "lang", "source", "n_chars", "lost", "rid", "ids", "n_tokens", "decoded_sha256"]
        found = got.collect()
        assert bool(found) == bool(docs)
        if docs:
            assert None in {r.doc_id for r in found}  # a row without doc_id is no copy of any other
            assert all(r.n_tokens == len(r.ids) for r in found)


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "decontamination", "tokens"]
    assert sorted({int(q[2:].split("_")[0]) for q in queries.queries()}) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries()) and json.dumps(queries.oracle_sql())
