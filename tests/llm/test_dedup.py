"""Suffix-array, substring and line deduplication and SimHash against brute force, with the edge cases of each."""

import random

import pytest

from heddle.llm import line_dedup, simhash, substring_dedup, suffix_dedup

from . import brute

DOCS = "doc_id long, text string, source string, spans string, lost string, fp long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash", "clash", 7) for i, t in rows], DOCS)


def corpus(seed, n=40, alphabet=("the", "of", "and", "stone", "river", "él", "straße", "漢字", "a", "zeta")):
    """Documents that share passages, whole texts, lines and runs of one word."""
    rnd = random.Random(seed)
    some = lambda k: " ".join(rnd.choice(alphabet) for _ in range(k))
    passages, line = [some(40) for _ in range(4)], "A line that very many documents share"
    rows = []
    for i in range(n):
        kind = i % 8
        text = {0: some(30), 1: f"{some(5)} {passages[i % 4]} {some(5)}", 2: f"{some(8)}\n{line}\n{some(4)}", 3: "la " * 60, 4: f"{passages[0]}\n  {line.upper()}\t\n{passages[1]}", 5: "", 6: f"{passages[2]} {passages[2]}", 7: None}[kind]
        rows.append((i * 3, text))
    rows.append((n * 3, rows[1][1]))
    rows.append((n * 3 + 1, some(3000)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"crowd": 2}, {"seed": 5}])
def test_suffix_dedup(spark, how):
    rows = corpus(1)
    got = suffix_dedup.suffix_dedup(frame(spark, rows), 30, **how).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in got} == (want := brute.byte_dedup(rows, 30))
    assert len(got) == len(rows) and sum(w[1] for w in want.values()) > 1000


@pytest.mark.parametrize("how", [{}, {"crowd": 2}, {"seed": 3}, {"seed": 3, "crowd": 0}])
def test_substring_dedup(spark, how):
    rows = corpus(2)
    got = substring_dedup.substring_dedup(frame(spark, rows), 12, **how).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept.encode())) for r in got} == (want := brute.word_dedup(rows, 12))
    assert len(got) == len(rows) and sum(w[1] for w in want.values()) > 300


@pytest.mark.parametrize("bits", [None, line_dedup.BLOCK_BITS])
def test_line_dedup(spark, bits):
    rows = corpus(3)
    got = line_dedup.line_dedup(frame(spark, rows), bits=bits).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == (want := brute.line_dedup(rows))
    assert sum(w[1] for w in want.values()) > 5
    kept = line_dedup.drop_common_lines(frame(spark, rows), bits=bits)
    assert kept.columns == ["doc_id", "text", "source", "spans", "lost", "fp"]
    texts = brute.kept_lines(rows)
    assert all((r.text or "") == texts[r.doc_id] for r in kept.collect())


def test_a_full_filter_changes_nothing(spark):
    """Every bit set: all keys are suspects, and the exact step alone decides."""
    import numpy as np

    bits = line_dedup.BLOCK_BITS
    assert line_dedup._holds(np.full(bits // 8, 255, np.uint8), np.arange(50, dtype=np.uint64) << np.uint64(33), bits).all()
    assert line_dedup.filter_bits(1 << 60) == line_dedup.FILTER_BITS_AT_MOST


@pytest.mark.parametrize(("radius", "crowd"), [(2, 4096), (6, 4096), (6, 2)])
def test_simhash(spark, radius, crowd):
    rows = corpus(4)
    got = simhash.simhash_components(frame(spark, rows), radius=radius, crowd=crowd).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute.simhash(rows, radius)


def test_simhash_keeps_one_of_a_group(spark):
    rows = corpus(4)
    named = brute.simhash(rows)
    kept = simhash.keep_first_of_group(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "spans", "lost", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in named.items() if i == c)


def test_xxh64_is_the_public_one():
    import numpy as np
    import xxhash

    rnd = np.random.default_rng(0)
    data = rnd.integers(0, 256, 3000).astype(np.uint8)
    start, size = rnd.integers(0, 2500, 400), rnd.integers(0, 300, 400)
    assert [int(h) for h in simhash.xxh64(data, start, size)] == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(start, size, strict=True)]


def test_one_text_in_many_documents(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in range(50)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == {i: 60 * (i > 0) for i in range(50)}
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert got == {i: len(text) * (i > 0) for i in range(50)}
    assert {r.component_id for r in simhash.simhash_components(frame(spark, rows)).collect()} == {0}


OPERATORS = [lambda d: suffix_dedup.suffix_dedup(d, 30), lambda d: substring_dedup.substring_dedup(d, 12), line_dedup.line_dedup, simhash.simhash_components]


@pytest.mark.parametrize("operator", OPERATORS)
def test_empty_null_repeated(spark, operator):
    assert operator(frame(spark, [])).collect() == []
    assert len(operator(frame(spark, [(None, None), (None, "x y z"), (1, None)])).collect()) == 3
    twice = operator(frame(spark, [(5, "many words " * 30), (5, "many words " * 30), (9, "other")])).collect()
    assert len(twice) == 3
    assert len({tuple(r) for r in twice if r.doc_id == 5}) == 1


def test_very_long_text(spark):
    rows = [(1, "ab cd " * 200_000), (2, "z" * 1_500_000), (3, "z" * 400)]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert (got[1].n_bytes, got[2].n_bytes) == (1_200_000, 1_500_000)
    assert got[2].n_removed == 1_500_000 - 1 and got[3].n_removed == 400
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got[1].n_words == 400_000 and got[1].n_removed == 0


def test_long_shards_hold_each_text_once():
    """A shard that goes over many batches: repeated texts leave at once, the rest meets in one search."""
    import numpy as np
    import pyarrow as pa

    from heddle.llm import seeds

    def batch(rows):
        return pa.RecordBatch.from_pylist([dict(zip(seeds.ROWS.names, r, strict=True)) for r in rows], schema=seeds.ROWS)

    rows = [(1, 1, d, 0, 4, 0, b"same") for d in range(100)] + [(1, 2, d, 5, 5, 0, b"other") for d in range(50, 60)] + [(2, 1, 7, 0, 3, 0, b"two"), (3, 0, 9, 2, 6, 0, None)]
    met = []

    def solve(table):
        met.append(table["body"].to_pylist())
        return (np.zeros(0, np.int64),) * 3

    read = seeds.shard_reader(solve, own_document=False, shard_bytes=16)
    spans = [tuple(r.values()) for b in read(batch(rows[i : i + 7]) for i in range(0, len(rows), 7)) for r in b.to_pylist()]
    assert [x for m in met for x in m] == [b"same", b"other", b"two"]
    assert sorted(spans) == sorted([(d, 0, 4) for d in range(1, 100)] + [(d, 5, 10) for d in range(51, 60)] + [(9, 2, 8)])


def test_equal_hashes_of_different_bytes():
    """Neither a content hash nor a word's hash decides: bytes are compared."""
    import numpy as np

    from heddle.llm import seeds
    from heddle.llm.arrays import Words

    text = np.frombuffer(b"abcabdabc", np.uint8)
    kept, gone = seeds.fold((text, np.array([0, 3, 6, 9])), np.zeros(3, np.int64), np.zeros(3, np.int64), np.array([1, 2, 3]), np.zeros(3, np.int64), False)
    assert kept.all() and not gone.any()
    data = np.frombuffer(b"ab cd ab ef cd", np.uint8)
    words = Words(data, np.array([0, len(data)]))
    words.hash = np.zeros(5, np.uint64)
    a = substring_dedup.word_numbers(data, words)
    assert a[0] == a[2] and a[1] == a[4] and len(set(a.tolist())) == 3


def test_the_substring_query_and_its_sql(spark, tmp_path):
    """Every kind of white space that parts words, and some that do not, in the query, its SQL and brute force."""
    duckdb = pytest.importorskip("duckdb")
    rnd = random.Random(8)
    spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\r\n", "  "]
    passage = [f"w{rnd.randrange(40)} x\x1f" for _ in range(70)]
    joined = lambda words: "".join(w + rnd.choice(spaces) for w in words)
    rows = [(i, joined([f"p{i}"] * (i % 3) + passage[i % 5 : 60 + i % 7] + [f"q{i}"])) for i in range(12)] + [(20, None), (21, ""), (22, " \r\x0b"), (23, joined(["la"] * 120)), (24, joined(["la"] * 70))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op5_substring_dedup(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = {r[0]: tuple(r[1:]) for r in con.execute(substring_dedup.ORACLES["op5_substring_dedup"]).fetchall()}
    assert got == sql == brute.word_dedup(rows, 50) and sum(w[1] for w in got.values()) > 500
