"""Benchmark decontamination by a prefix-filtered join, in DataFrame operations only.

Words are the runs outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased. An item's windows are its runs of
``window`` words, or all of its words if it has fewer. A document word inside any occurrence of a window is hit.

A window can only occur where all of its words do, so one word is a sufficient prefix: words are ordered by rarity, by
their count over all documents, and each window is looked up by its rarest. Documents' words that are such a prefix give
candidate places: a window must begin at or after the document's start (position bound) and end by its end (length
bound). What is left is compared word by word with the window.

Texts are normalised once and kept as a table in the shared folder. The words to look for are broadcast if they are
few, by a check of their number and size; if not, the join is a shuffle.

Nulls and empty texts have no words. Repeated item_ids are one item, and an item without an id hits words but is not
named. A null doc_id is a document like any other; repeated rows give repeated rows. Extra columns are ignored. With an
empty benchmark nothing is hit; an empty table of documents gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise

WINDOW = 13
#: A document is contaminated if one word in so many is hit.
SHARE = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What is broadcast at most: rows, and bytes of words.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def normalised(text: Column) -> Column:
    """The words of a text, joined by spaces."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _BREAKS, " "))


def words_of(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " ", -1))


def broadcast_if_small(words: DataFrame, column: str) -> DataFrame:
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(words) if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES else words


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, win, len): every window of every item."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(normalised(F.col("text"))).alias("words"))
    n = F.size("words")
    begins = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))
    pieces = words.filter(n > 0).select("item_id", F.explode(F.transform(begins, lambda i: F.slice("words", i + 1, F.least(n, F.lit(window))))).alias("piece"))
    return pieces.select("item_id", F.array_join("piece", " ").alias("win"), F.size("piece").alias("len")).distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _judged(documents.select(F.col("doc_id").cast("long"), "text"), benchmark, window, share)[0].drop("rid")


def _judged(documents: DataFrame, benchmark: DataFrame, window: int, share: int) -> tuple[DataFrame, DataFrame]:
    """The result with row numbers, and the table of normalised texts that they number."""
    texts = documents.select(F.monotonically_increasing_id().alias("rid"), *documents.columns, normalised(F.col("text")).alias("norm"))
    texts = materialise(texts.withColumn("n_words", F.size(words_of(F.col("norm"))).cast("long")), "normalised")
    owners = materialise(item_windows(benchmark, window), "item-windows")
    windows = owners.select("win", "len").distinct()

    # rarity: how often each word of a window is found in all documents
    spread = windows.select("win", "len", F.posexplode(F.split("win", " ", -1)).alias("off", "word"))
    wanted = broadcast_if_small(spread.select("word").distinct(), "word")
    said = texts.select(F.explode(F.split("norm", " ", -1)).alias("word"))
    often = materialise(said.join(wanted, "word").groupBy("word").agg(F.count("*").alias("often")), "word-counts")
    often = broadcast_if_small(often, "word")
    prefix = spread.join(often, "word", "left").groupBy("win", "len").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word", "off")).alias("rarest"))
    # a window with a word that no document has can't occur
    prefix = materialise(prefix.filter("rarest.often > 0").select(F.col("rarest.word").alias("word"), F.col("rarest.off").alias("off"), "win", "len"), "prefixes")

    # candidates: places of prefix words, within the position and length bounds
    rare = broadcast_if_small(prefix.select("word").distinct(), "word")
    places = texts.select("rid", "n_words", F.posexplode(F.split("norm", " ", -1)).alias("pos", "word")).join(rare, "word")
    begun = places.join(prefix, "word").select("rid", "n_words", (F.col("pos") - F.col("off")).alias("start"), "len", "win").filter("start >= 0 AND start + len <= n_words")
    by_doc = begun.groupBy("rid").agg(F.collect_list(F.struct("start", "len", "win")).alias("maybe"))

    # verification, word by word; ``words`` is named twice, which keeps it from being split anew for each candidate
    sure = by_doc.hint("shuffle_hash").join(texts.select("rid", "norm"), "rid").select("rid", "maybe", F.split("norm", " ", -1).alias("words"))
    sure = sure.select("rid", F.size("words").alias("size"), F.filter("maybe", lambda c: F.array_join(F.slice("words", c["start"] + 1, c["len"]), " ") == c["win"]).alias("hits"))
    sure = materialise(sure.filter(F.size("hits") > 0), "hits")
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))).cast("long")
    named = sure.select("rid", F.explode(F.array_distinct(F.transform("hits", lambda h: h["win"]))).alias("win")).join(owners.select("win", "item_id").filter("item_id IS NOT NULL"), "win")
    items = named.groupBy("rid").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = sure.select("rid", n_hit.alias("n_hit")).join(items, "rid", "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    out = texts.select("rid", "doc_id", "n_words").join(found.hint("shuffle_hash"), "rid", "left").select(
        "rid",
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
    return out, texts


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    # other columns travel in one, so that none of their names can clash
    whole = documents.select("doc_id", "text", F.struct(*documents.columns).alias("row"))
    judged, texts = _judged(whole, benchmark, window, share)
    dirty = judged.filter("contaminated").select("rid")
    return texts.join(dirty, "rid", "left_anti").select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_WORDS = r"""list_filter(string_split_regex(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES = {
    "op9_decontaminate": f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS.format(t="text")} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') AS win, least(len(w), 13) AS n
  FROM item, LATERAL (SELECT unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, {_SQL_WORDS.format(t="text")} AS w FROM documents
), occ AS (
  SELECT d.doc_id, d.i, win.n, win.item_id
  FROM (SELECT doc_id, i, k.n, array_to_string(w[i + 1 : i + k.n], ' ') AS win
        FROM doc, (SELECT DISTINCT n FROM win) k, LATERAL (SELECT unnest(range(0, greatest(len(w) - k.n + 1, 0))) AS i)) d
  JOIN win ON win.win = d.win AND win.n = d.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id
)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
}
