"""Which texts contain which literals: an index of grams, with each literal looked up by its rarest one.

A gram is ``GRAMS[i]`` bytes in a row, as a number; a literal uses the longest kind that fits into it. Three passes:

1. The grams of all literals make a filter of bits. Texts are read once, and grams that pass the filter are counted.
2. Each literal takes the gram that the fewest texts have. A literal with a gram that no text has is in none.
3. The anchors make a second, sparser filter. Texts are read again, and their grams that pass are joined with the anchors;
   only these few pairs of text and literal are compared in full.

Literals stay in Spark; what goes to tasks is a filter of at most ``FILTER_BITS`` bits, built by Spark from the numbers of
its words. Beyond about a tenth as many grams it lets more through, which costs work and no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import few, materialise

GRAMS = (8, 3, 1)
#: 8 MB of bits at most, 2**20 words to the driver.
FILTER_BITS = 26
BITS_EACH = 16
#: Bytes of text handled at once.
PIECE = 1 << 20
USEFUL_FILES = 8


def _numbers(data: np.ndarray, q: int) -> np.ndarray:
    """The run of q bytes at each place, as a number."""
    n = max(len(data) - q + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(q):
        out |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return out


def _spot(numbers: np.ndarray, q: int, bits: int) -> np.ndarray:
    """Where in a filter of 2**bits bits a gram's bit is."""
    x = (numbers ^ np.uint64(q * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def _kind(size: int) -> int:
    return next(q for q in GRAMS if size >= q)


def _literal_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (literal_id, literal) to every gram of it: (literal_id, literal, q, gram)."""
    for batch in batches:
        for key, literal in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = np.frombuffer(literal.encode(), dtype=np.uint8)
            q = _kind(len(raw))
            grams = np.unique(_numbers(raw, q)).view(np.int64)
            n = len(grams)
            yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), pa.array([literal] * n, pa.string()), pa.array(np.full(n, q, np.int32)), pa.array(grams)], names=["literal_id", "literal", "q", "gram"])


def _gram_filter(grams: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """bits, the kinds of grams, and the words of the filter, of a table (q, gram)."""
    number = grams.count()
    bits = min(FILTER_BITS, max(13, (number * BITS_EACH).bit_length()))

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, gram = (c.to_numpy() for c in batch.columns)
            for kind in np.unique(q):
                spot = _spot(gram[q == kind].view(np.uint64), int(kind), bits)
                word, bit = (spot >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), spot & np.uint64(63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], names=["word", "bits"])

    rows = grams.select("q", "gram").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    kinds = sorted(r.q for r in grams.select("q").distinct().collect())
    return bits, kinds, table


def _text_grams(bits: int, kinds: list[int], table: np.ndarray):
    """mapInArrow: (file, text) to the different grams of a text that pass a filter: (file, q, gram)."""
    def found(raw: np.ndarray, q: int, held: np.ndarray) -> np.ndarray:
        got = []
        for a in range(0, len(raw), PIECE):  # pieces overlap, so that each run of bytes lies in one
            numbers = _numbers(raw[a : a + PIECE + q - 1], q)
            got.append(np.unique(numbers[held[_spot(numbers, q, bits).astype(np.int64)] > 0]))
        return np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(table.view(np.uint8), bitorder="little")
        for batch in batches:
            for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
                for q in kinds:
                    grams = found(raw, q, held)
                    if len(grams):
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(grams), pa.string()), pa.array(np.full(len(grams), q, np.int32)), pa.array(grams.view(np.int64))], names=["file", "q", "gram"])

    return run


def anchors(files: DataFrame, literals: DataFrame) -> DataFrame:
    """literal_id, literal, q, gram: the gram of each literal that the fewest texts have, for literals that may be in some."""
    grams = materialise(literals.mapInArrow(_literal_grams, "literal_id string, literal string, q int, gram long"), "literal-grams")
    seen = files.mapInArrow(_text_grams(*_gram_filter(grams.select("q", "gram").distinct())), "file string, q int, gram long")
    common = materialise(seen.groupBy("q", "gram").agg(F.count("*").alias("texts")), "gram-texts")
    told = grams.join(few(common), ["q", "gram"], "left").groupBy("literal_id", "literal", "q").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("least"))
    return materialise(told.filter("least.texts > 0").select("literal_id", "literal", "q", "least.gram"), "anchors")


def contains(files: DataFrame, literals: DataFrame) -> DataFrame:
    """file, literal_id, each pair once, for every text that contains a literal. ``files``: file, text. ``literals``:
    literal_id, literal. Null texts contain nothing; empty and null literals are in no text."""
    files = files.select(F.col("file").cast("string"), F.col("text").cast("string"))
    literals = literals.filter("literal <> ''").select(F.col("literal_id").cast("string"), "literal").distinct()
    known = anchors(files, literals)
    seen = files.mapInArrow(_text_grams(*_gram_filter(known.select("q", "gram").distinct())), "file string, q int, gram long")
    likely = materialise(seen.join(few(known), ["q", "gram"]).select("file", "literal_id", "literal").distinct(), "candidates")
    return files.join(few(likely), "file").filter(F.contains("text", F.col("literal"))).select("file", "literal_id").distinct()


def selective(hits: DataFrame, at_most: int = USEFUL_FILES) -> DataFrame:
    """literal_id, files: literals found in some files, but not in more than ``at_most``."""
    return hits.groupBy("literal_id").agg(F.countDistinct("file").alias("files")).filter(F.col("files") <= at_most)
