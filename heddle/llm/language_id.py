"""Language of texts by character models: interpolated Kneser-Ney, one model for each language, lowest cross-entropy wins.

A text is lower-cased; characters other than letters and marks become a space, runs of spaces one, and a text begins and
ends with one. Models look at ``ORDER`` characters. Runs of ``ORDER`` are counted by language over every text to learn from:
tasks add up what they see and Spark adds up the tasks. The lower orders count the different characters that come before a
run, as Kneser-Ney does, from the table of the order above. Discounts come from how many runs are seen once and twice.

Every run that was seen counts in every score. What a task holds is bounded all the same: where each order has ``RUNS``
runs at most, tasks hold all of them, an order as one sorted array of 64-bit hashes, with the languages that have a run and
its weight beside it; contexts and what they leave to shorter runs are another. Where an order has more, the tables of
weights stay with Spark, and tasks hold the log-probabilities of the runs that make up at least the share ``languages / RUNS``
of all. A text's other runs leave the task as rows; their log-probabilities come from the whole tables by joins and are
added to the text's. A text's different runs are looked up once for each slice of texts, by binary search.
``Models.predict`` over a list, without Spark, has bounded tables only: of orders with more than ``RUNS`` runs it takes the most
frequent, and the weight of the others goes to the shorter runs.

A text's cross-entropy is the mean of its characters' negative log-probabilities. The language with the lowest one is
predicted, ties to the first by name. ``score`` is a logistic curve of its lead over the next best (the uniform model is
always one of the others), times the square root of the number of characters; the curve is fitted on the first ``SAMPLE``
texts to learn from, by the hash of doc_id. The same texts give each language the usual range of its own cross-entropy:
``rejected`` says that a text is above this range or its score is below one half. The prediction stands either way.

Null texts, and those without a letter, are ``und`` with score 0, as is every text if there is nothing to learn from. Rows
with null lang or doc_id are not learned from, but predicted. Repeated rows count as often as they are there. Extra columns
are ignored; an empty table gives an empty result. Very long texts are read in blocks of ``BLOCK`` characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from .arrays import bounded_batches, mix, runs, slices

ORDER = 4
RUNS = 1 << 19
BLOCK = 1 << 20
#: Different runs that a task adds up before it puts them out.
HELD = 400_000
UNKNOWN = "und"
#: Deviations from a language's mean beyond which a text is not taken for it.
FAR = 4.0
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For every code point: 1 a letter, 2 a mark, 0 anything else."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], dtype=np.uint8)


@dataclass
class Characters:
    """Normalised texts one after another: code points, the text of each, its place in the text, and which have a letter."""

    code: np.ndarray
    text: np.ndarray
    place: np.ndarray
    lettered: np.ndarray

    @staticmethod
    def of(texts: list[str | None]) -> Characters:
        lower = [f" {(t or '').lower()} " for t in texts]
        size = np.array([len(t) for t in lower], dtype=np.int64)
        code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        text = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        kind = _kinds()[code]
        lettered = np.bincount(text[kind == 1], minlength=len(texts)) > 0
        code = np.where(kind > 0, code, np.uint32(32))
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (text[1:] != text[:-1])
        code, text = code[keep], text[keep]
        count = np.bincount(text, minlength=len(texts))
        return Characters(code, text, runs(count), lettered)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(runs by ORDER characters, text of each) for every character but a text's first; before a text are spaces."""
        for a in range(0, len(self.code), BLOCK):
            b = min(a + BLOCK, len(self.code))
            at = np.flatnonzero(self.place[a:b] > 0) + a
            grams = np.empty((len(at), ORDER), dtype=np.uint32)
            for back in range(ORDER):
                grams[:, ORDER - 1 - back] = np.where(self.place[at] >= back, self.code[np.maximum(at - back, 0)], 32)
            yield grams, self.text[at]


def hashed(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of characters."""
    h = np.full(len(grams), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for i in range(grams.shape[1]):
        h ^= grams[:, i].astype(np.uint64)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix(h)


def _strings(grams: np.ndarray) -> list[str]:
    k = grams.shape[1]
    whole = grams.astype("<u4").tobytes().decode("utf-32-le", "replace")
    return [whole[i : i + k] for i in range(0, len(whole), k)]


def _codes(strings: list[str], k: int) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32).reshape(-1, k)


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (lang, text) to (lang, gram, n), added up as far as a task can hold."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        key, lang, gram, n = (np.concatenate(c) for c in zip(*held, strict=True))
        group, unique = pd.factorize(key)
        first = np.empty(len(unique), dtype=np.int64)
        first[group[::-1]] = np.arange(len(key))[::-1]
        return unique, lang[first], gram[first], np.bincount(group, weights=n, minlength=len(unique)).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        _, lang, gram, n = held.pop()
        by_number = list(names)
        for a in range(0, len(n), 50_000):
            part = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array([by_number[i] for i in lang[part]], pa.string()), pa.array(_strings(gram[part]), pa.string()), pa.array(n[part])], names=["lang", "gram", "n"])

    for rows, _, _ in slices(batches):
        langs = np.array([names.setdefault(x, len(names)) for x in rows.column(0).to_pylist()], dtype=np.int64)
        for grams, text in Characters.of(rows.column(1).to_pylist()).blocks():
            lang = langs[text]
            key = mix(hashed(grams) + lang.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            group, unique = pd.factorize(key)
            first = np.empty(len(unique), dtype=np.int64)
            first[group[::-1]] = np.arange(len(key))[::-1]
            held.append((unique, lang[first], grams[first], np.bincount(group, minlength=len(unique)).astype(np.int64)))
        if sum(len(h[0]) for h in held) > HELD:
            held[:] = [together()]
            if len(held[0][0]) > HELD:
                yield from out()
    if held:
        held[:] = [together()]
        yield from out()


def count_runs(texts: DataFrame) -> list[DataFrame]:
    """Tables (lang, gram, n) of runs of 1 to ORDER characters: counts for the longest, different left neighbours below."""
    longest = texts.mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    tables = [materialise(longest, "runs")]
    for k in range(ORDER - 1, 0, -1):
        shorter = tables[0].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        tables.insert(0, materialise(shorter, "runs"))
    return tables


def weights(table: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """All runs of an order (lang, gram, context, n, all, weight: the discounted share of its context), and all contexts
    (lang, context, rest: the share that is left to shorter runs)."""
    facts = table.groupBy("lang").agg(F.sum("n").alias("all"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
    # a row for each language
    facts = F.broadcast(facts.select("lang", "all", F.coalesce(F.col("once") / F.nullif(F.col("once") + 2 * F.col("twice"), F.lit(0)), F.lit(0.5)).alias("discount")))
    context = F.substring("gram", 1, k - 1) if k > 1 else F.lit("")
    totals = table.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    found = table.join(facts, "lang").withColumn("context", context).join(totals.drop("kinds"), ["lang", "context"])
    found = found.select("lang", "gram", "context", "n", "all", ((F.col("n") - F.col("discount")) / F.col("total")).alias("weight"))
    return found, totals.join(facts, "lang").select("lang", "context", (F.col("discount") * F.col("kinds") / F.col("total")).alias("rest"))


@dataclass
class Lookup:
    """Sorted hashes, and beside each the languages and values that it has."""

    hashes: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, lang: np.ndarray, value: np.ndarray) -> Lookup:
        order = np.argsort(keys, kind="stable")
        unique, starts = np.unique(keys[order], return_index=True)
        return Lookup(unique, np.append(starts, len(keys)), lang[order].astype(np.int16), value[order].astype(np.float32))

    def into(self, keys: np.ndarray, table: np.ndarray) -> None:
        """Write the values of keys[i] into table[i], a column for each language."""
        if not len(self.hashes):
            return
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == keys)
        at = at[hit]
        size = self.starts[at + 1] - self.starts[at]
        source = np.repeat(self.starts[at], size) + runs(size)
        table[np.repeat(hit, size), self.lang[source]] = self.value[source]


@dataclass
class Models:
    """What texts are scored with. curve: of the score. usual: mean and deviation of each language's own texts.

    Where an order has too many runs for a task, ``whole`` are the tables of ``weights`` of each order and ``frequent`` the
    log-probabilities of the most frequent runs of ``ORDER``.
    """

    languages: list[str]
    runs: list[Lookup]
    contexts: list[Lookup]
    alphabet: int
    curve: tuple[float, float] = (1.0, 0.0)
    usual: np.ndarray | None = None
    whole: list[tuple[DataFrame, DataFrame]] | None = None
    frequent: Lookup | None = None

    def shared(self, spark: SparkSession):
        """What tasks need, broadcast."""
        of_tasks = self if self.whole is None else replace(self, runs=[], contexts=[], whole=None)
        return spark.sparkContext.broadcast(of_tasks)

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """For each run of characters and language: log of the last one's probability after the others."""
        n = len(self.languages)
        p = np.full((len(grams), n), 1 / (self.alphabet + 1))
        for k in range(1, ORDER + 1):
            seen, rest = np.zeros((len(grams), n), dtype=np.float32), np.ones((len(grams), n), dtype=np.float32)
            self.runs[k - 1].into(hashed(grams[:, ORDER - k :]), seen)
            self.contexts[k - 1].into(hashed(grams[:, ORDER - k : ORDER - 1]), rest)
            p = seen + rest * p
        return np.log(p)

    def summed(self, texts: list[str | None], known: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Of each text: negative log-probability under each language, number of characters, whether it has a letter. Runs
        for which ``known`` gives no numbers add nothing and come last, by block: (text, run, how often)."""
        chars = Characters.of(texts)
        total, count, rare = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), []
        for grams, text in chars.blocks():
            group, unique = pd.factorize(hashed(grams))
            first = np.empty(len(unique), dtype=np.int64)
            first[group[::-1]] = np.arange(len(group))[::-1]
            logs = known(grams[first])
            missing = np.isnan(logs[:, 0])
            if missing.any():
                logs[missing] = 0
                pair, often = np.unique((text.astype(np.int64) * len(unique) + group)[missing[group]], return_counts=True)
                rare.append((pair // len(unique), grams[first[pair % len(unique)]], often))
            count += np.bincount(text, minlength=len(texts))
            for lang in range(len(self.languages)):
                total[:, lang] -= np.bincount(text, weights=logs[:, lang][group], minlength=len(texts))
        return total, count, chars.lettered, rare

    def frequent_only(self, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities of the frequent runs, no numbers for others."""
        logs = np.full((len(grams), len(self.languages)), np.nan)
        self.frequent.into(hashed(grams), logs)
        return logs

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: cross-entropy under each language, number of characters, whether it has a letter."""
        total, count, lettered, _ = self.summed(texts, self.log_probability)
        return total / np.maximum(count, 1)[:, None], count, lettered

    def best(self, entropy: np.ndarray, count: np.ndarray, lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: none), its cross-entropy, its lead, number of characters."""
        if not self.languages:
            return np.full(len(count), -1), np.zeros(len(count)), np.zeros(len(count)), np.zeros(len(count))
        lead = entropy.argmin(axis=1)
        row = np.arange(len(count))
        low = entropy[row, lead]
        others = np.append(entropy, np.full((len(count), 1), np.log(self.alphabet + 1)), axis=1)
        others[row, lead] = np.inf
        return np.where(lettered, lead, -1), low, (others.min(axis=1) - low) * np.sqrt(count), count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether it is rejected."""
        return self.judged(*self.best(*self.cross_entropies(texts)))

    def judged(self, lead: np.ndarray, low: np.ndarray, margin: np.ndarray, count: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        score = np.where(lead >= 0, 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -50, 50))), 0.0)
        rejected = score < 0.5
        if self.usual is not None:
            mean, deviation = self.usual[lead, 0], self.usual[lead, 1]
            rejected |= (low - mean) * np.sqrt(np.maximum(count, 1)) > FAR * deviation
        return [self.languages[i] if i >= 0 else UNKNOWN for i in lead], score, np.where(lead >= 0, low, 0.0), rejected


def log_probabilities(grams: DataFrame, models: Models) -> DataFrame:
    """gram, logs: of each run of ORDER characters the log-probability under each language, from the whole tables."""
    spark = grams.sparkSession
    number = F.broadcast(spark.createDataFrame(list(enumerate(models.languages)), "number int, lang string"))
    rows = grams.crossJoin(number).withColumn("p", F.lit(1 / (models.alphabet + 1)))
    for k, (found, contexts) in enumerate(models.whole, 1):
        rows = rows.withColumn("run", F.substring("gram", ORDER - k + 1, k)).withColumn("context", F.substring("gram", ORDER - k + 1, k - 1) if k > 1 else F.lit(""))
        rows = rows.join(found.select("lang", F.col("gram").alias("run"), "weight"), ["lang", "run"], "left").join(contexts, ["lang", "context"], "left")
        rows = rows.select("gram", "number", "lang", (F.coalesce("weight", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("p")).alias("p"))
    return rows.groupBy("gram").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", F.ln("p").alias("log")))), lambda x: x["log"]).alias("logs"))


def measured(rows: DataFrame, models: Models) -> DataFrame:
    """The columns of ``rows`` with entropy (of each language, null without any), count and lettered in place of the last, text."""
    shared = models.shared(rows.sparkSession)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema][:-1]
    names = [*rows.columns[:-1], "entropy", "count", "lettered", "rare"]
    none = models.whole is None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, _, _ in slices(batches):
            texts = part.column(part.num_columns - 1).to_pylist()
            if m.languages:
                total, count, lettered, rare = m.summed(texts, m.log_probability if none else m.frequent_only)
            else:
                total, count, lettered, rare = np.zeros((len(texts), 0)), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool), []
            at = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * total.shape[1])
            entropy = pa.ListArray.from_arrays(at, pa.array((total / np.maximum(count, 1)[:, None]).ravel()))
            text, gram, n = (np.concatenate(c) for c in zip(*rare, strict=True)) if rare else (np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64))
            order = np.argsort(text, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]).astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(_strings(gram[order]), pa.string()), pa.array(n[order].astype(np.int64))], names=["gram", "n"]))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], entropy, pa.array(count), pa.array(lettered), left], names=names)

    first = rows.mapInArrow(run, ", ".join([*kept, "entropy array<double>, count double, lettered boolean, rare array<struct<gram string, n long>>"]))
    if none:
        return first.drop("rare")
    first = materialise(first.withColumn("_row", F.monotonically_increasing_id()), "measured")
    asked = first.select("_row", "count", F.explode("rare").alias("r")).select("_row", "count", "r.gram", "r.n")
    found = asked.join(log_probabilities(asked.select("gram").distinct(), models), "gram")
    more = found.groupBy("_row").agg(F.array(*(F.sum(-F.col("n") * F.col("logs")[i] / F.col("count")) for i in range(len(models.languages)))).alias("_more"))
    both = F.zip_with("entropy", "_more", lambda a, b: a + b)
    return first.join(more, "_row", "left").withColumn("entropy", F.when(F.col("_more").isNull(), F.col("entropy")).otherwise(both)).drop("rare", "_row", "_more")


def _numbers(batch: pa.RecordBatch, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last three columns of ``measured``."""
    entropy, count, lettered = batch.columns[-3:]
    return entropy.flatten().to_numpy().reshape(batch.num_rows, languages), count.to_numpy(), lettered.to_numpy(zero_copy_only=False)


def build(tables: list[DataFrame], most: int = RUNS) -> Models:
    """The models of counted runs. At most ``most`` runs of an order come to the driver, and as many contexts."""
    languages = sorted(r.lang for r in tables[0].select("lang").distinct().collect())
    number = {x: i for i, x in enumerate(languages)}
    found, contexts, whole, fits = [], [], [], True
    for k in range(1, ORDER + 1):
        of_order, rests = weights(tables[k - 1], k)
        whole.append((of_order, rests))
        if tables[k - 1].count() > most:
            fits = False
            of_order = of_order.filter(F.col("n") * most >= F.col("all") * len(languages))
        rows = of_order.select("lang", "gram", "context", "weight").toPandas()
        lang = rows["lang"].map(number).to_numpy(dtype=np.int64)
        found.append(Lookup.of(hashed(_codes(rows["gram"].tolist(), k)), lang, rows["weight"].to_numpy()))
        left = 1 - rows.groupby(["lang", "context"], sort=False)["weight"].sum()
        at = left.index.to_frame(index=False)
        codes = _codes(at["context"].tolist(), k - 1) if k > 1 else np.zeros((len(at), 0), np.uint32)
        contexts.append(Lookup.of(hashed(codes), at["lang"].map(number).to_numpy(dtype=np.int64), left.to_numpy()))
    alphabet = max(1, tables[0].select("gram").distinct().count())
    models = Models(languages, found, contexts, alphabet)
    if not fits:
        models.whole = [(materialise(a.select("lang", "gram", "weight"), "weights"), materialise(b, "rests")) for a, b in whole]
        all_n = tables[-1].agg(F.sum("n")).first()[0]
        often = tables[-1].groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") * most >= F.lit(all_n) * len(languages)).select("gram")
        rows = log_probabilities(often, models).toPandas()
        keys = np.repeat(hashed(_codes(rows["gram"].tolist(), ORDER)), len(languages))
        logs = np.concatenate([np.zeros(0), *rows["logs"]])
        models.frequent = Lookup.of(keys, np.tile(np.arange(len(languages)), len(rows)), logs)
    return models


def _settled(x: float) -> float:
    """x to nine digits, so that the order in which Spark adds up does not show."""
    return float(f"{x:.9g}")


def _curve(led: DataFrame) -> tuple[float, float]:
    """A logistic curve of kept rows (margin, right) by Newton's steps; targets are drawn in by one text of each kind, so that it stays finite."""
    facts = led.agg(F.count_if("right").alias("good"), F.count("*").alias("n"), F.stddev_pop("margin").alias("scale")).first()
    if not facts["n"]:
        return 1.0, 0.0
    good, bad = facts["good"], facts["n"] - facts["good"]
    scale = max(_settled(facts["scale"]), 1e-6)
    target = F.when(F.col("right"), (good + 1) / (good + 2)).otherwise(1 / (bad + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        z = F.col("x") * float(w[0]) + float(w[1])
        rows = led.select((F.col("margin") / scale).alias("x"), target.alias("target")).withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))
        rows = rows.select("x", (F.col("target") - F.col("p")).alias("off"), (F.col("p") * (1 - F.col("p"))).alias("bend"))
        sums = rows.agg(*(F.sum(c) for c in (F.col("off") * F.col("x"), F.col("off"), F.col("bend") * F.col("x") * F.col("x"), F.col("bend") * F.col("x"), F.col("bend")))).first()
        slope = np.array(sums[:2]) - 1e-3 * w
        bend = np.array([[sums[2], sums[3]], [sums[3], sums[4]]]) + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(bend, slope), -2, 2)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return max(_settled(w[0]), 0.0) / scale, _settled(w[1])


def _usual(led: DataFrame, languages: list[str]) -> np.ndarray:
    """Mean and deviation of each language's cross-entropy over its own texts, of kept rows (lead, low, n, right)."""
    own = led.filter("right").groupBy("lead")
    mean = {r.lead: _settled(r.mean) for r in own.agg((F.sum(F.col("low") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
    usual = np.array([[mean.get(i, 0.0), np.inf] for i in range(len(languages))])
    far = F.col("low") - F.element_at(F.array(*(F.lit(float(m)) for m in usual[:, 0])), F.col("lead").cast("int") + 1)
    for r in own.agg(F.sqrt(F.avg(far * far * F.col("n"))).alias("deviation")).collect():
        usual[r.lead, 1] = max(_settled(r.deviation), 1.0)
    return usual


def calibrated(models: Models, seen: DataFrame) -> Models:
    """The models with their curve and usual ranges: of lang and the last three columns of ``measured`` of all texts to learn from."""
    if not models.languages:
        return models
    languages = len(models.languages)
    of_tasks = seen.sparkSession.sparkContext.broadcast(Models(models.languages, [], [], models.alphabet))

    def led(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            m = of_tasks.value
            lead, low, margin, count = m.best(*_numbers(rows, languages))
            right = np.array([i >= 0 and m.languages[i] == x for i, x in zip(lead, rows.column(0).to_pylist(), strict=True)], dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(lead, pa.int64()), pa.array(low), pa.array(margin), pa.array(count), pa.array(right)], names=["lead", "low", "margin", "n", "right"])

    rows = seen.mapInArrow(led, "lead long, low double, margin double, n double, right boolean").filter("lead >= 0")
    kept = materialise(rows, "led")
    return replace(models, curve=_curve(kept), usual=_usual(kept, models.languages))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _to_learn(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held_out(F.col("doc_id"))).select("lang", "text")


def _counted_models(documents: DataFrame, most: int) -> Models:
    bounded_batches(documents.sparkSession)
    return build(count_runs(_to_learn(documents)), most)


def train(documents: DataFrame, most: int = RUNS) -> Models:
    """Models of documents (doc_id, text, lang) that are not held out."""
    models = _counted_models(documents, most)
    return calibrated(models, measured(_to_learn(documents), models))


def _judged(seen: DataFrame, models: Models) -> DataFrame:
    """RESULT of rows of doc_id, held_out and the last three columns of ``measured``."""
    of_tasks = seen.sparkSession.sparkContext.broadcast(Models(models.languages, [], [], models.alphabet, models.curve, models.usual))
    languages = len(models.languages)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            m = of_tasks.value
            lang, score, low, rejected = m.judged(*m.best(*_numbers(rows, languages)))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return seen.mapInArrow(run, RESULT)


def predict(documents: DataFrame, models: Models) -> DataFrame:
    """RESULT for every row."""
    docs = documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return _judged(measured(docs, models), models)


def identify(documents: DataFrame, most: int = RUNS) -> DataFrame:
    """RESULT for every row of documents (doc_id, text, lang), by models of those that are not held out: ``train`` and
    ``predict`` with each text measured once."""
    models = _counted_models(documents, most)
    doc_id = F.col("doc_id").cast("long")
    docs = documents.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("lang").cast("string"), F.col("text").cast("string"))
    seen = materialise(measured(docs, models), "seen")
    last = ["entropy", "count", "lettered"]
    # rows without a text have no letter and are left out there
    models = calibrated(models, seen.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND NOT held_out").select("lang", *last))
    return _judged(seen.select("doc_id", "held_out", *last), models)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_language_id": op13_language_id}
ORACLES: dict[str, str] = {}
