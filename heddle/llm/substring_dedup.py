"""Seed-and-extend removal of word windows that an earlier document also holds.

Words are runs without ASCII white space, unchanged. A word is removed if a window of ``window`` consecutive words that
covers it also starts in a document with a smaller doc_id; windows are judged on the input.

Documents are joined on winnowed anchors (see ``seeds``): of each window's runs of ``seed`` words, the one of least
hash. All blocks around the same anchor are extended together, word by word to the right and then to the left: blocks
that go on with the same word stay in one class, and a class of one block is done. Where a class that reaches so far
right and one that reaches so far left span ``window`` words or more, the blocks in both share that stretch, and all but
those of the smallest document lose it. The stretches of all lengths join to the maximal repeats over the threshold.
This takes time in proportion to the blocks of an anchor, not to their pairs. Words are compared byte by byte.

Nulls and empty texts have no words. A row without doc_id is returned as it is and matches nothing. Rows that repeat a
doc_id are one document given twice: neither is smaller than the other, and what is removed from one is removed from
all. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, runs, string_buffers
from .seeds import chunked, repeated_spans, span_mask, with_spans

WINDOW = 50
SEED = 16
#: A seed with more different blocks than this is cut again by seeds of one word less than the window.
CROWD = 2_000
RESULT = "doc_id long, n_words long, n_removed long, kept string"


def word_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, offs)
    return words.hash, words.offsets


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words joined by one space, and the byte at which the text of each row begins; rows end before word ``upto``."""
    size = end - start + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    padded = np.append(data, np.uint8(0x20))
    text = padded[np.repeat(start, size) + runs(size)]
    text[ends[1:] - 1] = 0x20
    # no space after a row's last word
    words = np.diff(upto)
    text = np.delete(text, ends[upto[1:][words > 0]] - 1)
    return text, ends[upto] - np.concatenate([[0], np.cumsum(words > 0)])


def word_bodies(data, offs, doc, pos, size) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, offs, hashed=False)
    at = np.repeat(words.offsets[doc] + pos, size) + runs(size)
    return spaced(data, words.start[at], words.end[at], np.concatenate([[0], np.cumsum(size)]))


def word_numbers(data: np.ndarray, words: Words) -> np.ndarray:
    """A number for each word of a slice: equal just for words of equal bytes."""
    order = np.argsort(words.hash, kind="stable")
    size = words.end - words.start
    same = np.zeros(len(order), dtype=bool)
    same[1:] = words.hash[order][1:] == words.hash[order][:-1]
    rows, before = order[1:][same[1:]], order[:-1][same[1:]]
    unlike = size[rows] != size[before]
    length = np.where(unlike, 0, size[rows])
    inner = runs(length)
    wrong = np.concatenate([[0], np.cumsum(data[np.repeat(words.start[rows], length) + inner] != data[np.repeat(words.start[before], length) + inner])])
    ends = np.cumsum(length)
    unlike |= wrong[ends] != wrong[ends - length]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(~same)
    if unlike.any():  # words of one hash and different bytes: number them by their bytes
        for h in np.unique(words.hash[rows[unlike]]):
            known: dict[bytes, int] = {}
            for i in np.flatnonzero(words.hash == h).tolist():
                out[i] = known.setdefault(data[words.start[i] : words.end[i]].tobytes(), len(order) + len(known) + 1 + int(out[i]) * len(order))
    return np.unique(out, return_inverse=True)[1]


def classes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for pairs (a, b), equal just for equal pairs, and how many rows have each row's pair."""
    _, which, count = np.unique(a << 32 | b, return_inverse=True, return_counts=True)
    return which, count[which]


def extensions(value: np.ndarray, at: np.ndarray, most: np.ndarray, group: np.ndarray, steps: int, way: int) -> list[np.ndarray]:
    """For 0 to ``steps`` words on from place ``at``, ``way`` 1 or -1: each row's class, -1 if it is alone or ended."""
    out = [group]
    for far in range(steps):
        now = np.full(len(at), -1, dtype=np.int64)
        live = np.flatnonzero((out[-1] >= 0) & (most > far))
        if len(live):
            number, many = classes(out[-1][live], value[at[live] + way * far])
            now[live[many > 1]] = number[many > 1]
        out.append(now)
    return out


def repeats_in_shard(window: int, seed: int):
    """solve() for ``seeds.shard_reader``."""

    def solve(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offs = string_buffers(table["body"])
        words = Words(data, offs)
        value, begin, size = word_numbers(data, words), words.offsets[:-1], words.counts
        doc, at, shard = (table[k].to_numpy() for k in ("doc_id", "at", "shard"))
        group = np.cumsum(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
        right = extensions(value, begin + at, size - at, group, window, 1)
        left = extensions(value, begin + at - 1, at.astype(np.int64), group, window - seed, -1)
        found = [(np.zeros(0, np.int64),) * 3]
        for back in range(window - seed + 1):
            both = np.flatnonzero((left[back] >= 0) & (right[window - back] >= 0))
            if not len(both):
                continue
            number, _ = classes(left[back][both], right[window - back][both])
            smallest = np.full(number.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, number, doc[both])
            later = both[doc[both] > smallest[number]]
            start = at[later].astype(np.int64) - back
            found.append((later, start, start + window))
        row, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
        return row, s, e

    return solve


def cut_words(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, spans: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    words = Words(data, offs, hashed=False)
    gone = span_mask(rows.column(1).to_numpy(), spans, words.offsets)
    sums = np.concatenate([[0], np.cumsum(~gone)])[words.offsets]
    text, ends = spaced(data, words.start[~gone], words.end[~gone], sums)
    kept = pa.Array.from_buffers(pa.string(), len(words.counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
    return pa.RecordBatch.from_arrays([rows.column(1), pa.array(words.counts.astype(np.int64)), pa.array(words.counts - np.diff(sums)), kept], names=["doc_id", "n_words", "n_removed", "kept"])


def _parts(documents: DataFrame, window: int, seed: int | None, crowd: int) -> tuple[DataFrame, int, DataFrame]:
    seed = seed or max(1, min(SEED, window // 3))
    docs, chunks, bits = chunked(documents)
    spans = repeated_spans(docs, chunks, bits, word_units, word_bodies, repeats_in_shard(window, seed), window=window, seed=seed, longer_seed=max(seed, window - 1), crowd=crowd, own_document=True)
    return docs, chunks, spans


def removal_spans(documents: DataFrame, window: int = WINDOW, *, seed: int | None = None, crowd: int = CROWD) -> DataFrame:
    """doc_id, s, e: the spans of words to remove (they may overlap), for documents that have any."""
    return _parts(documents, window, seed, crowd)[2]


def substring_dedup(documents: DataFrame, window: int = WINDOW, *, seed: int | None = None, crowd: int = CROWD) -> DataFrame:
    """One row per document, with the words that stay, joined by spaces: RESULT. See the module's docstring."""
    docs, chunks, spans = _parts(documents, window, seed, crowd)
    return with_spans(docs, chunks, spans, cut_words, RESULT)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES = {
    "op5_substring_dedup": r"""
WITH doc AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS t
  FROM doc, LATERAL (SELECT unnest(range(1, greatest(len(w) - 48, 1))) AS i)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS earliest FROM win) WHERE doc_id > earliest
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM late) GROUP BY doc_id
), word AS (
  SELECT doc_id, w, i FROM doc, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w[i], ' ' ORDER BY i) AS t
  FROM word WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS d, unnest(g) AS p FROM gone) x WHERE x.d = word.doc_id AND x.p = word.i)
  GROUP BY doc_id
)
SELECT doc.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""
}
