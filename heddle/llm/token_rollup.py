"""Token totals by source, language and tokenizer version, kept up by signed changes.

A change says that a document's count came, went or was revised: (kind, source, lang, tokenizer, old_tokens,
new_tokens). It is worth +1 document and its new count, -1 and its old count, or no document and the difference.
Changes of a batch are summed by key and written as the batch's deltas; totals are the sums of all deltas, so the order
of batches does not matter and documents are never read again.

A batch counts once however often it is sent: its deltas are written to a folder of its own, over whatever an attempt
that failed left there, and its name is recorded last; only recorded batches are summed, and a recorded one is not
written again. ``compact`` sums what is recorded into one base, whose record names the batches that it holds.

Nulls in source, lang or tokenizer are a key of their own. A null count is zero. An empty batch is recorded and changes
nothing. A key whose documents and tokens are both zero is left out of the totals. Repeated rows count as often as they
are given. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, new_path

KEY = ("source", "lang", "tokenizer")
INSERT, DELETE, REVISE = "insert", "delete", "revise"
_DELTAS = "batch string, source string, lang string, tokenizer string, docs long, tokens long"
_RECORDS = "batch string, holds array<string>"


class TokenRollup:
    """Totals kept under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch: str) -> str:
        return f"{self.path}/deltas/{batch.encode().hex()}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _record(self, batch: str) -> str:
        return f"{self.path}/records/{batch.encode().hex()}"

    def recorded(self, batch: str) -> bool:
        """Whether the batch was committed, itself or in a base."""
        return self._exists(self._record(batch) + "/_SUCCESS")

    def _write(self, batch: str, sums: DataFrame, holds: list[str]) -> None:
        sums.select(F.lit(batch).alias("batch"), *KEY, "docs", "tokens").write.mode("overwrite").parquet(self._folder(batch))
        self.spark.createDataFrame([(batch, holds)], _RECORDS).coalesce(1).write.mode("overwrite").parquet(self._record(batch))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Record a batch of changes; False if it had been recorded before."""
        if self.recorded(batch):
            return False
        kind = F.col("kind")
        old, new = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("old_tokens", "new_tokens"))
        signed = changes.select(
            *(F.col(k).cast("string").alias(k) for k in KEY),
            F.when(kind == INSERT, 1).when(kind == DELETE, -1).when(kind == REVISE, 0).otherwise(F.raise_error(F.concat(F.lit("not a kind of change: "), F.coalesce(kind, F.lit("null"))))).cast("long").alias("docs"),
            F.when(kind == INSERT, new).when(kind == DELETE, -old).otherwise(new - old).alias("tokens"),
        )
        self._write(batch, signed.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), [])
        return True

    def _live(self) -> DataFrame:
        """Deltas of recorded batches that no recorded base holds."""
        if not self._exists(f"{self.path}/records"):
            return self.spark.createDataFrame([], _DELTAS)
        records = self.spark.read.schema(_RECORDS).parquet(f"{self.path}/records/*")
        held = records.select(F.explode("holds").alias("batch"))
        live = records.select("batch").join(held, "batch", "left_anti")
        return self.spark.read.schema(_DELTAS).parquet(f"{self.path}/deltas/*").join(live, "batch")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens."""
        sums = self._live().groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 OR tokens <> 0")

    def compact(self, base: str) -> bool:
        """Sum all recorded batches into one base; False if that base had been recorded before."""
        if self.recorded(base):
            return False
        live = self._live()
        holds = sorted(r.batch for r in live.select("batch").distinct().collect())
        self._write(base, live.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), holds)
        return True


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(pattern)).cast("long")


# What a token is for each tokenizer version that the query counts.
VERSIONS = {"spaces-1": r"[^\x20\x09-\x0D]+", "letters-1": r"\p{L}+"}


def changes(kind: str, rows: DataFrame, tokenizer: str, old: Column, new: Column) -> DataFrame:
    """Changes of one kind and tokenizer version for rows with source and lang."""
    return rows.select(F.lit(kind).alias("kind"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), old.cast("long").alias("old_tokens"), new.cast("long").alias("new_tokens"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over whole tables: every document comes, under two tokenizer versions; the counts of
    those labelled poor are revised; those labelled toxic go; the first batch is sent again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = materialise(docs.select("doc_id", "source", "lang", *(count_matches(F.col("text"), p).alias(v) for v, p in VERSIONS.items())), "token-counts")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    spaces, letters, none = F.col("spaces-1"), F.col("letters-1"), F.lit(None)
    marked = counted.join(labels, "doc_id")
    rollup = TokenRollup(spark, new_path(spark, "token-rollup"))
    came = changes(INSERT, counted, "spaces-1", none, spaces).unionByName(changes(INSERT, counted, "letters-1", none, letters))
    poor = F.coalesce(F.col("quality") == 0, F.lit(False))
    gone = marked.filter("toxic = 1")
    rollup.commit("load", came)
    rollup.commit("revise", changes(REVISE, marked.filter(poor), "spaces-1", spaces, letters))
    rollup.commit("delete", changes(DELETE, gone, "spaces-1", F.when(poor, letters).otherwise(spaces), none).unionByName(changes(DELETE, gone, "letters-1", letters, none)))
    rollup.commit("load", came)
    return rollup.totals()


QUERIES = {"op2_token_rollup": op2_token_rollup}
ORACLES = {
    "op2_token_rollup": r"""
WITH mark AS (
  SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT d.source, d.lang, coalesce(m.quality = 0, FALSE) AS poor, coalesce(m.toxic = 1, FALSE) AS toxic,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS spaces,
         len(regexp_extract_all(coalesce(text, ''), '\p{L}+')) AS letters
  FROM documents d LEFT JOIN mark m USING (doc_id)
), kept AS (
  SELECT source, lang, 'spaces-1' AS tokenizer, CASE WHEN poor THEN letters ELSE spaces END AS n FROM counted WHERE NOT toxic
  UNION ALL SELECT source, lang, 'letters-1', letters FROM counted WHERE NOT toxic
)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM kept GROUP BY ALL
"""
}
