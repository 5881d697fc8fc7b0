"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its emission score is linear in its own surface features and in those of the lines before and
after it (shares of capitals, digits, symbols, words ended by a symbol, repeated words, length and so on); a transition
score links neighbouring labels. Forward and backward passes give each line's marginal probability of being good; the
document's quality is their mean weighted by line length, passed through a logistic curve fitted with the model.

Labels are of documents. The model is fitted on a bounded sample of labelled documents (``SAMPLE``, the least hashes of
doc_id, so that every run takes the same; the sample ends where its lines would number over ``LINES``, and of a first
document that is longer alone, so many lines are read): lines first take their document's label, an emission-only fit then finds the
lines of bad documents that look good, which are relabelled, and the field is fitted to these labels. Sentences, words and
ids themselves are no features, nor are lang and source.

Nulls and empty texts are one empty line. Without labels of both kinds every score is the share of good labels (0.5 if
there are none). A row without doc_id is scored but never learned from. Repeated rows give repeated rows; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .arrays import Words, bounded_batches, mix, runs, slices

#: Labelled documents that a fit reads at most, and lines of all of them together.
SAMPLE, LINES = 4000, 300_000
ROUNDS = 150
#: Lines whose features are made at once, and lines of a document that are walked one after another.
PIECE, SEGMENT = 1 << 15, 256
RESULT = "doc_id long, held_out boolean, score double, predicted int, n_lines long, bad_share double"


def _class(text: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(text, dtype=np.uint8)] = True
    return table


_CAPITAL = _class(bytes(range(0x41, 0x5B)))
_SMALL = _class(bytes(range(0x61, 0x7B)))
_DIGIT = _class(bytes(range(0x30, 0x3A)))
_STOP = _class(b".,;:'\"()?-")
_SYMBOL = _class(b"#$%&*|!<>=@^_~+/\\{}[]`")
_BLANK = _class(b"\t\n\v\f\r ")
_HIGH = np.arange(256) >= 0x80
FEATURES = ("length", "capitals", "digits", "stops", "symbols", "others", "words", "word_length", "symbol_ends", "capital_words", "repeats", "empty", "starts_capital", "ends_stop")


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of every line, and the offsets of documents in lines."""
    breaks = np.flatnonzero(data == 0x0A)
    lines = np.bincount(np.searchsorted(offs, breaks, side="right") - 1, minlength=len(offs) - 1) + 1
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
    return start, end, np.concatenate([[0], np.cumsum(lines)])


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Features of lines that follow one another in ``data``."""
    data, start, end = data[start[0] : end[-1]], start - start[0], end - start[0]
    size = end - start

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return sums[end] - sums[start]

    capital, small, digit, stop, symbol, blank, high = (count(t) for t in (_CAPITAL, _SMALL, _DIGIT, _STOP, _SYMBOL, _BLANK, _HIGH))
    words = Words(data, np.append(start, len(data)))
    at = words.doc
    n_words = np.bincount(at, minlength=len(start))
    last, head = data[words.end - 1], data[words.start]
    ends = np.bincount(at[_SYMBOL[last]], minlength=len(start))
    caps = np.bincount(at[_CAPITAL[head]], minlength=len(start))
    key = mix(words.hash ^ (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    by = np.argsort(key)
    key = key[by]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount(at[by[fresh]], minlength=len(start))
    solid = np.maximum(size - blank, 1)
    w = np.maximum(n_words, 1)
    body = size > 0
    first = np.zeros(len(start), dtype=bool)
    first[body] = _CAPITAL[data[start[body]]]
    final = np.zeros(len(start), dtype=bool)
    final[body] = _STOP[data[end[body] - 1]]
    other = np.maximum(size - blank - capital - small - digit - stop - symbol - high, 0)
    columns = [np.log1p(size), capital / np.maximum(capital + small, 1), digit / solid, stop / solid, symbol / solid, other / solid, np.log1p(n_words), np.log1p((size - blank) / w), ends / w, caps / w, 1 - distinct / w, ~body, first, final]
    return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)


def feature_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, features) for runs of ``PIECE`` lines at most, so that temporary arrays are bounded."""
    for a in range(0, len(start), PIECE):
        b = min(a + PIECE, len(start))
        yield a, b, _features(data, start[a:b], end[a:b])


def line_features(data: np.ndarray, offs: np.ndarray, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes, and the offsets of documents in lines."""
    start, end, line_offs = line_spans(data, offs)
    x = np.empty((len(start), len(FEATURES)), dtype=kind)
    for a, b, piece in feature_pieces(data, start, end):
        x[a:b] = piece
    return x, end - start, line_offs


def with_neighbours(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the lines before and after it (zero at a document's edge) and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[offs[:-1]] = 0
    after[offs[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def _segments(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents cut into runs of ``SEGMENT`` lines at most: first line and size of each, and documents' offsets in them."""
    count = -(-np.diff(offs) // SEGMENT)
    start = np.repeat(offs[:-1], count) + runs(count) * SEGMENT
    return start, np.minimum(start + SEGMENT, np.repeat(offs[1:], count)) - start, np.concatenate([[0], np.cumsum(count)])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / v.sum(axis=-1, keepdims=True)


def marginals(score: np.ndarray, transition: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of being good, and the expected number of each transition. score: good less bad.

    Documents are cut into segments, all of which are walked at once, a line of each in a step. A segment's effect on
    what comes in is a product of 2 x 2 matrices; with these the segments of a document are walked, and with what then
    comes into each segment its lines. The number of steps is bounded by ``SEGMENT`` and the segments of a document.
    """
    n = len(score)
    emit = np.empty((n, 2))
    emit[:, 1] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    emit[:, 0] = 1 - emit[:, 1]
    emit = np.maximum(emit, 1e-13)
    move = np.exp(transition - transition.max())
    start, size, of_docs = _segments(offs)
    order = np.argsort(-size, kind="stable")
    lines, sizes = start[order], size[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # segments with more than t lines
    heads = np.zeros(n, dtype=bool)
    heads[offs[:-1][np.diff(offs) > 0]] = True
    # a step into a line; nothing comes into a document's first one
    into = np.where(heads[:, None, None], np.full((2, 2), 0.5), move)
    through = np.tile(np.eye(2), (len(start), 1, 1))
    for t in range(longest):
        at = lines[: live[t]] + t
        m = through[order[: live[t]]] @ (into[at] * emit[at][:, None, :])
        through[order[: live[t]]] = m / m.sum(axis=(1, 2), keepdims=True)
    entering, leaving = np.full((len(start), 2), 0.5), np.full((len(start), 2), 0.5)
    many = np.diff(of_docs)
    by = np.argsort(-many, kind="stable")
    docs, deep = of_docs[:-1][by], int(many.max()) if len(many) else 0
    open_ = np.searchsorted(-many[by], -np.arange(deep), side="left")
    for k in range(1, deep):
        here = docs[: open_[k]] + k
        entering[here] = _unit(np.einsum("si,sij->sj", entering[here - 1], through[here - 1]))
    for k in range(deep - 2, -1, -1):
        here = docs[: open_[k + 1]] + k
        leaving[here] = _unit(np.einsum("sij,sj->si", through[here + 1], leaving[here + 1]))
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    for t in range(longest):
        at = lines[: live[t]] + t
        before = entering[order[: live[t]]] if t == 0 else forward[at - 1]
        forward[at] = _unit(np.einsum("si,sij->sj", before, into[at]) * emit[at])
    for t in range(longest - 1, -1, -1):
        at = lines[: live[t]] + t
        last = sizes[: live[t]] == t + 1
        ahead = np.minimum(at + 1, n - 1)
        back = _unit(np.einsum("sij,sj->si", into[ahead], emit[ahead] * backward[ahead]))
        backward[at] = np.where(last[:, None], leaving[order[: live[t]]], back)
    after = np.flatnonzero(~heads)
    joint = forward[after - 1][:, :, None] * move[None] * (emit[after] * backward[after])[:, None, :]
    pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(after) else np.zeros((2, 2))
    p = forward * backward
    return p[:, 1] / p.sum(axis=1), pairs


def line_weighted(p: np.ndarray, size: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The mean of a document's lines, weighted by length."""
    weight = size + 1.0
    return np.add.reduceat(p * weight, offs[:-1]) / np.add.reduceat(weight, offs[:-1])


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass(frozen=True)
class LineField:
    """A fitted field. constant: the score of every document where nothing could be learned."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    curve: tuple[float, float]
    constant: float | None = None

    def lines(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end, line_offs = line_spans(data, offs)
        k = len(FEATURES)
        parts = np.stack([self.weights[i * k : (i + 1) * k] for i in range(3)], axis=1)
        # what a line gives to its own score, to that of the line after it, and to that of the line before it
        own = np.empty((len(start), 3))
        for a, b, x in feature_pieces(data, start, end):
            own[a:b] = ((x - self.centre) / self.scale) @ parts
        score = own[:, 0] + self.weights[-1]
        inner = np.ones(len(start), dtype=bool)
        inner[line_offs[:-1]] = False
        second = np.flatnonzero(inner)
        score[second] += own[second - 1, 1]
        score[second - 1] += own[second, 2]
        return marginals(score, self.transition, line_offs)[0], end - start, line_offs

    def documents(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, number of lines and length-weighted share of bad lines."""
        if self.constant is not None:
            line_offs = line_spans(data, offs)[2]
            n = len(offs) - 1
            return np.full(n, self.constant), np.diff(line_offs), np.full(n, 1 - self.constant)
        p, size, line_offs = self.lines(data, offs)
        mean = line_weighted(p, size, line_offs)
        return 1 / (1 + np.exp(-(self.curve[0] * logit(mean) + self.curve[1]))), np.diff(line_offs), 1 - mean


class _Ascent:
    """Adam's steps uphill."""

    def __init__(self, *shapes: tuple[int, ...]):
        self.m, self.v, self.t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0

    def step(self, values: list[np.ndarray], slopes: list[np.ndarray], rate: float) -> list[np.ndarray]:
        self.t += 1
        out = []
        for i, (x, g) in enumerate(zip(values, slopes, strict=True)):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            out.append(x + rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8))
        return out


def fit(texts: list[str], quality: np.ndarray, rounds: int = ROUNDS) -> LineField:
    """Fit the field to documents and their labels (0 or 1)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return fit_lines(*line_features(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)), quality, rounds)


def fit_lines(x: np.ndarray, size: np.ndarray, line_offs: np.ndarray, quality: np.ndarray, rounds: int = ROUNDS, decay: float = 1e-3) -> LineField:
    """The same from lines' features and lengths, and the offsets of documents in lines."""
    width = len(FEATURES)
    flat = np.zeros(width), np.ones(width), np.zeros(3 * width + 1), np.zeros((2, 2)), (1.0, 0.0)
    if len(quality) == 0 or quality.min() == quality.max():
        return LineField(*flat, constant=float(quality.mean()) if len(quality) else 0.5)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = with_neighbours((x - centre) / scale, line_offs)
    y = np.repeat(quality, np.diff(line_offs)).astype(np.float64)
    n = len(y)
    # lines alone, then relabel what looks good in bad documents
    w, climb = np.zeros(x.shape[1]), _Ascent((x.shape[1],))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        (w,) = climb.step([w], [x.T @ (y - p) / n - decay * w], 0.05)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    y = np.where((y == 0) & (p > 0.8), 1.0, y)
    label = y.astype(np.int64)
    inner = np.ones(n, dtype=bool)
    inner[line_offs[:-1]] = False
    follow = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[follow - 1], label[follow]), 1)
    a, climb = np.zeros((2, 2)), _Ascent((x.shape[1],), (2, 2))
    for _ in range(rounds):
        p, pairs = marginals(x @ w, a, line_offs)
        w, a = climb.step([w, a], [x.T @ (y - p) / n - decay * w, (seen - pairs) / n - decay * a], 0.05)
    p, _ = marginals(x @ w, a, line_offs)
    z = logit(line_weighted(p, size, line_offs))
    curve, climb = [np.array(1.0), np.array(0.0)], _Ascent((), ())
    for _ in range(4 * rounds):
        miss = quality - 1 / (1 + np.exp(-(curve[0] * z + curve[1])))
        curve = climb.step(curve, [(miss * z).mean() - 1e-3 * curve[0], miss.mean()], 0.05)
    return LineField(centre, scale, w, a, (float(curve[0]), float(curve[1])))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, text, quality) to the features and lengths of each document's lines, and their number."""
    for rows, data, offs in slices(batches):
        x, size, at = line_features(data, offs, np.float32)
        packed = [x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        sizes = [size[a:b].astype(np.int64).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(packed, pa.binary()), pa.array(sizes, pa.binary()), pa.array(np.diff(at).astype(np.int64))], names=["doc_id", "quality", "features", "sizes", "n_lines"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> LineField:
    """Fit on ``sample`` labelled documents at most, of ``lines`` lines at most together, none of them held out."""
    bounded_batches(documents.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = marks.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # ``sample`` ids and labels at most are broadcast; the features of their lines are kept as a table
    kept = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(feature_rows, "doc_id long, quality int, features binary, sizes binary, n_lines long")
    kept = materialise(kept.groupBy("doc_id").agg(F.min(F.struct("features", "sizes", "quality", "n_lines")).alias("r")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "r.*"), "line-features")
    so_far = F.sum("n_lines").over(Window.orderBy("h", "doc_id"))  # of ``sample`` rows at most
    within = kept.select("h", "doc_id", "n_lines").withColumn("so_far", so_far).filter((F.col("so_far") <= lines) | (F.col("so_far") == F.col("n_lines"))).select("doc_id")
    row = 4 * len(FEATURES)
    rows = kept.join(F.broadcast(within), "doc_id").select("h", "doc_id", "quality", F.substring("features", 1, lines * row).alias("features"), F.substring("sizes", 1, lines * 8).alias("sizes")).collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.concatenate([np.zeros((0, len(FEATURES)), np.float32), *(np.frombuffer(r.features, dtype=np.float32).reshape(-1, len(FEATURES)) for r in rows)])
    sizes = [np.frombuffer(r.sizes, dtype=np.int64) for r in rows]
    offs = np.concatenate([[0], np.cumsum([len(s) for s in sizes])]).astype(np.int64)
    return fit_lines(x.astype(np.float64), np.concatenate([np.zeros(0, np.int64), *sizes]), offs, np.array([r.quality for r in rows], dtype=np.int64))


def score_rows(model: LineField):
    """mapInArrow: (doc_id, held_out, text) to RESULT."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            score, lines, bad = model.documents(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(lines.astype(np.int64)), pa.array(bad)], names=["doc_id", "held_out", "score", "predicted", "n_lines", "bad_share"])

    return run


def quality_scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: RESULT."""
    model = train(documents, labels, sample)
    docs = documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return docs.mapInArrow(score_rows(model), RESULT)


def keep_good(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents predicted good, with all their columns."""
    model = train(documents, labels, sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            yield rows.filter(pa.array(model.documents(data, offs)[0] >= 0.5))

    return documents.mapInArrow(run, documents.schema)


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op8_quality_crf": op8_quality_crf}
ORACLES: dict[str, str] = {}
