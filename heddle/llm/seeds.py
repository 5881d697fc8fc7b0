"""Seeds shared by the two operators that look for long repeats: suffix-array and substring deduplication.

Every window of W units (bytes or words) has one seed: the run of k units in it with the least hash, leftmost on ties.
Neighbouring windows with the same seed form a block. Equal windows have equal seeds at the same place, so windows can
only repeat in different blocks that share a seed. The steps:

1. Documents are dealt to chunks by doc_id. A chunk names its distinct seeds, six bytes each, in order and cut by range
   into buckets; a bucket answers with one bit a seed: is it in another chunk too? Seeds met once end here, before any
   block moves, and a seed is named once by a chunk however many of its rows hold it.
2. A chunk cuts its blocks again, and of blocks with equal text keeps those of the first document; the others repeat an
   earlier place and go whole. The rest of the blocks of repeated seeds are sent, with their text, to the seed's shard.
3. A shard drops text that an earlier row of the same shard has byte for byte, so that it holds each different text once,
   and hands the rest to the operator's own search for repeats.
4. The spans that go return to the chunks of their documents.

A seed with more than ``crowd`` different blocks is cut again by seeds nearly as long as the window, which spreads it
over many shards. Chunks and buckets have a bounded size and their number follows the input's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import PrefixHash, bounded_batches, runs, slices, string_buffers, window_min

#: Units handled at once; longer documents are cut, with W - 1 units of overlap.
PIECE = 1 << 19
#: Lengths and places in a block are kept in 16 bits.
WINDOW_AT_MOST = 1 << 15
_LOW = np.uint64((1 << 22) - 1)
#: Bytes of text of a chunk on average, and of the text whose seeds a bucket counts.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
LEAST_BUCKETS = 16
#: Bytes of a chunk's text, and of blocks copied, handled by one vector operation.
SLICE = 1 << 19
#: Bytes of block text that one pass of a shard holds.
SHARD_BYTES = 1 << 19
#: Stands for a null doc_id inside the jobs.
NO_ID = -(1 << 63)
_SEED_BYTES = 6

ASKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("seeds", pa.binary()), ("blocks", pa.binary())])
TOLD = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("met", pa.binary()), ("crowded", pa.binary())])
ROWS = pa.schema([("shard", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("at", pa.int32()), ("body", pa.binary())])
SPANS = pa.schema([("doc_id", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.asarray(c).astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def chunk_of(doc_id, chunks: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(chunks))


def chunked(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """chunk, doc_id and text of documents (null ids as NO_ID, spread by text), the number of chunks and bits of a bucket."""
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    chunks = int(size) // chunk_bytes + 1
    buckets = max(LEAST_BUCKETS, int(size) // BUCKET_BYTES)
    own = F.when(F.col("doc_id") == NO_ID, chunk_of("text", chunks)).otherwise(chunk_of("doc_id", chunks))
    return docs.select(own.alias("chunk"), "doc_id", "text"), chunks, (buckets - 1).bit_length()


def anchored_blocks(values: np.ndarray, offsets: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Blocks of a slice of documents: seed hash, content hash, document (row in the slice), start, length, seed's place."""
    parts: list[tuple[np.ndarray, ...]] = []
    for a in range(0, max(len(values) - window + 1, 0), PIECE):
        piece = PrefixHash(values[a : a + PIECE + window - 1])
        grams = piece.grams(seed)
        least = window_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), window - seed + 1)
        least &= _LOW
        start = np.arange(len(least), dtype=np.int64)
        doc = np.searchsorted(offsets, start + a, side="right") - 1
        live = np.flatnonzero(start + a + window <= offsets[doc + 1])
        if not len(live):
            continue
        at = least[live].astype(np.int64)
        new = np.ones(len(live), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (live[1:] != live[:-1] + 1)
        b = np.flatnonzero(new)
        s, e, at, d = live[b], live[np.append(b[1:], len(live)) - 1] + window, at[b], doc[live[b]]
        parts.append((grams[at] >> np.uint64(64 - 8 * _SEED_BYTES), piece.slices(s, e).view(np.int64), d, s + a - offsets[d], e - s, at - s))
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _slices(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a chunk's documents that have an id."""
    for rows, data, offs in slices(table.to_batches(), limit=SLICE):
        if NO_ID in (ids := rows.column(1).to_numpy()):
            rows = rows.filter(pa.array(ids != NO_ID))
            yield from slices([rows], limit=SLICE)
        else:
            yield rows, data, offs


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the row before."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def asker(units: Callable, window: int, seed: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """applyInArrow on a chunk: its distinct seeds by bucket, with the number of different blocks of each (16 bits)."""

    def ask(table: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        parts += [anchored_blocks(*units(data, offs), window, seed)[:2] for _, data, offs in _slices(table)]
        anchor, content = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((content, anchor))
        anchor, content = anchor[order], content[order]
        kept = _firsts(anchor, content)
        anchor = anchor[kept]
        new = np.flatnonzero(_firsts(anchor))
        blocks = np.minimum(np.diff(np.append(new, len(anchor))), 0xFFFF).astype("<u2")
        anchor = anchor[new]
        shift = np.uint64(8 * _SEED_BYTES - bits)
        bucket = (anchor >> shift).astype(np.int64)
        edge = np.flatnonzero(_firsts(bucket)) if len(bucket) else np.zeros(0, np.int64)
        raw = anchor.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SEED_BYTES]
        ends = np.append(edge[1:], len(bucket))[: len(edge)]
        chunk = table["chunk"][0].as_py()
        packed = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge, ends, strict=True)], pa.binary())
        return pa.Table.from_batches([batch_of(ASKED, bucket[edge], np.full(len(edge), chunk), packed(raw), packed(blocks))])

    return ask


def teller(crowd: int) -> Callable[[pa.Table], pa.Table]:
    """applyInArrow on a bucket: for each chunk, which of its seeds another chunk has, and which are crowded."""

    def tell(table: pa.Table) -> pa.Table:
        data, offs = string_buffers(table["seeds"])
        wide = np.zeros((len(data) // _SEED_BYTES, 8), dtype=np.uint8)
        wide[:, :_SEED_BYTES] = data.reshape(-1, _SEED_BYTES)
        seeds = wide.reshape(-1).view("<u8")
        blocks = np.frombuffer(string_buffers(table["blocks"])[0].tobytes(), dtype="<u2").astype(np.int64)
        _, which, times = np.unique(seeds, return_inverse=True, return_counts=True)
        met = times[which] > 1
        crowded = np.bincount(which, weights=blocks)[which] > crowd
        offs = offs // _SEED_BYTES
        bits = lambda x: pa.array([np.packbits(x[a:b]).tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary())
        return pa.Table.from_batches([batch_of(TOLD, table["chunk"].to_numpy(), table["bucket"].to_numpy(), bits(met), bits(crowded))])

    return tell


def _answers(told: pa.Table, anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two answers for a chunk's sorted distinct seeds."""
    bucket = (anchors >> np.uint64(8 * _SEED_BYTES - bits)).astype(np.int64)
    out = np.zeros((2, len(anchors)), dtype=bool)
    for b, *packed in zip(told["bucket"].to_pylist(), told["met"].to_pylist(), told["crowded"].to_pylist(), strict=True):
        a, e = np.searchsorted(bucket, [b, b + 1])
        for row, raw in zip(out, packed, strict=True):
            row[a:e] = np.unpackbits(np.frombuffer(raw, np.uint8), count=e - a)
    return out[0], out[1]


def same_as_before(bodies: tuple[np.ndarray, np.ndarray], *keys: np.ndarray) -> np.ndarray:
    """True where a row has the keys and, byte for byte, the body of the row before."""
    data, offs = bodies
    size = np.diff(offs)
    same = ~_firsts(*keys, size)
    at = np.flatnonzero(same)
    if len(at):
        step = 4096
        for a in range(0, len(at), step):
            rows = at[a : a + step]
            length = size[rows]
            inner = runs(length)
            equal = data[np.repeat(offs[rows], length) + inner] == data[np.repeat(offs[rows - 1], length) + inner]
            ends = np.cumsum(length)
            wrong = np.concatenate([[0], np.cumsum(~equal)])
            same[rows] = wrong[ends] == wrong[ends - length]
    return same


def fold(bodies: tuple[np.ndarray, np.ndarray], shard: np.ndarray, content: np.ndarray, doc: np.ndarray, pos: np.ndarray, own_document: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by these keys, to (kept, gone): gone rows have the text of an earlier document or, unless
    ``own_document``, of an earlier place; a row given twice is in neither the second time."""
    head = np.maximum.accumulate(np.where(same_as_before(bodies, shard, content), 0, np.arange(len(shard))))
    other = doc != doc[head]
    gone = other if own_document else other | (pos != pos[head])
    twice = np.zeros(len(shard), dtype=bool)
    twice[1:] = (head[1:] == head[:-1]) & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
    return ~gone & ~twice, gone


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans joined where they touch: (document, from, to)."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    turn = np.cumsum(_firsts(doc)) << 40
    far = np.maximum.accumulate(turn + end)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = turn[1:] + start[1:] > far[:-1]
    b = np.flatnonzero(new)
    last = np.append(b[1:], len(doc)) - 1
    return doc[b], start[b], far[last] - turn[last]


def picked(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[first : last] of all pairs, one after another, and the offsets of each."""
    size = last - first
    offs = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(offs[-1]), dtype=data.dtype)
    a = 0
    while a < len(size):
        b = min(max(a + 1, int(np.searchsorted(offs, offs[a] + SLICE))), len(size))
        out[offs[a] : offs[b]] = data[np.repeat(first[a:b], size[a:b]) + runs(size[a:b])]
        a = b
    return out, offs


def sender(units: Callable, bodies: Callable, window: int, seed: int, longer_seed: int, bits: int, own_document: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Cogrouped chunk and answers to ROWS. Rows without a body are spans that go whole.

    bodies(data, offs, doc, pos, size) gives the text of blocks, one spelling for equal units, as (bytes, offsets).
    """

    def send(table: pa.Table, told: pa.Table) -> pa.Table:
        parts = []
        for rows, data, offs in _slices(table):
            parts.append((anchored_blocks(*units(data, offs), window, seed), rows.column(1).to_numpy(), data, offs))
        if not parts:
            return ROWS.empty_table()
        every = np.sort(np.concatenate([p[0][0] for p in parts]))
        new = np.flatnonzero(_firsts(every)) if len(every) else np.zeros(0, np.int64)
        anchors, here = every[new], np.diff(np.append(new, len(every)))
        met, crowded = _answers(told, anchors, bits)
        wanted = met | (here > 1)
        out = [[np.zeros(0, np.int64)] * 6 + [np.zeros(0, np.uint8), np.zeros(0, np.int64)]]
        for blocks, ids, data, offs in parts:
            known = np.searchsorted(anchors, blocks[0])
            take, hot = wanted[known] & ~crowded[known], wanted[known] & crowded[known]
            shard, content, of, pos, size, at = (x[take] for x in (blocks[0].view(np.int64), *blocks[1:]))
            if hot.any():
                more = recut(units(data, offs), *(x[hot] for x in blocks), window, longer_seed)
                shard, content, of, pos, size, at = (np.concatenate(x) for x in zip((shard, content, of, pos, size, at), more, strict=True))
            text, ends = bodies(data, offs, of, pos, size)
            out.append([shard, content, ids[of], pos, size, at, text, np.diff(ends)])
        shard, content, doc, pos, size, at, text, length = (np.concatenate(x) for x in zip(*out, strict=True))
        begin = np.cumsum(length) - length
        order = np.lexsort((pos, doc, content, shard))
        shard, content, doc, pos, size, at, begin, length = (x[order] for x in (shard, content, doc, pos, size, at, begin, length))
        bytes_, offs = picked(text, begin, begin + length)
        kept, gone = fold((bytes_, offs), shard, content, doc, pos, own_document)
        # a text that is alone under its seed, here and elsewhere, has nothing to be compared with
        left = np.flatnonzero(kept)
        first = _firsts(shard[left]) if len(left) else np.zeros(0, bool)
        alone = first & np.append(first[1:], True)
        place = np.searchsorted(anchors, shard[left].view(np.uint64))
        place = np.minimum(place, max(len(anchors) - 1, 0))
        alone &= (anchors[place] == shard[left].view(np.uint64)) & ~met[place] if len(left) else alone
        left = left[~alone]
        text, ends = picked(bytes_, offs[left], offs[left + 1])
        rows = batch_of(ROWS, shard[left], content[left], doc[left], pos[left], size[left], at[left], pa.Array.from_buffers(pa.binary(), len(left), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())]))
        d, s, e = merged(doc[gone], pos[gone], pos[gone] + size[gone])
        none = np.zeros(len(d), np.int64)
        whole = batch_of(ROWS, d, none, d, s, e - s, none, pa.nulls(len(d), pa.binary()))
        return pa.Table.from_batches([rows, whole])

    return send


def recut(values_offsets, anchor, _, of, pos, size, __, window: int, longer_seed: int) -> tuple[np.ndarray, ...]:
    """Blocks of crowded seeds cut again by longer ones: shard, content, document, place, length and the seed's place.

    Every window is in one block with the longer seed too, and equal windows meet there; the old seed is part of the new key.
    """
    values, starts = values_offsets
    text, own = picked(values, starts[of] + pos, starts[of] + pos + size)
    key, inner, row, rel, length, seed_at = anchored_blocks(text, own, window, longer_seed)
    shard = (anchor[row] ^ (key << np.uint64(13)) ^ np.uint64(1 << 63)).view(np.int64)
    return shard, inner, of[row], pos[row] + rel, length, seed_at


def shard_reader(solve: Callable, own_document: bool, shard_bytes: int = SHARD_BYTES) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function over ROWS sorted by (shard, content, doc_id, pos), to SPANS.

    Whole shards, about ``shard_bytes`` at once, are handed to ``solve`` without the rows whose text an earlier row has;
    of a longer shard only the different texts are held. solve(table) returns (row, start, end) arrays, in units from
    the start of the row's block.
    """

    def folded(table: pa.Table) -> tuple[pa.Table, pa.RecordBatch]:
        shard, content, doc, pos, size = (table[k].to_numpy() for k in ("shard", "content", "doc_id", "pos", "size"))
        kept, gone = fold(string_buffers(table["body"]), shard, content, doc, pos, own_document)
        spans = batch_of(SPANS, doc[gone], pos[gone], pos[gone] + size[gone])
        return (table if kept.all() else table.filter(pa.array(kept)).combine_chunks()), spans

    def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table, spans = folded(table)
        yield spans
        row, s, e = solve(table)
        doc, pos = table["doc_id"].to_numpy()[row], table["pos"].to_numpy()[row].astype(np.int64)
        yield batch_of(SPANS, *merged(doc, pos + s, pos + e))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            body = batch.column(6)
            if body.null_count:
                whole = batch.filter(body.is_null())
                yield batch_of(SPANS, whole.column(2), whole.column(3), whole.column(3).to_numpy() + whole.column(4).to_numpy())
                batch = batch.filter(body.is_valid())
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch]).combine_chunks()
            keys = held["shard"].to_numpy()
            ends = string_buffers(held["body"])[1]
            edges = np.flatnonzero(_firsts(keys))
            at = 0
            while at < edges[-1]:  # whole shards up to the last one, which may go on
                to = int(edges[min(np.searchsorted(edges, np.searchsorted(ends, ends[at] + shard_bytes)), len(edges) - 1)])
                if to == edges[-1] and ends[to] - ends[at] < shard_bytes // 4:
                    break  # too little for a pass of its own
                yield from answer(held.slice(at, to - at).combine_chunks())
                at = to
            held = held.slice(at).combine_chunks()
            if ends[-1] - ends[edges[-1]] > shard_bytes:
                held, spans = folded(held)
                yield spans
        if held is not None and held.num_rows:
            yield from answer(held)

    return read


def repeated_spans(docs: DataFrame, chunks: int, bits: int, units: Callable, bodies: Callable, solve: Callable, *, window: int, seed: int, longer_seed: int, crowd: int, own_document: bool) -> DataFrame:
    """SPANS of ``chunked`` documents, in units; they may overlap. own_document: places in the first document stay."""
    if not 2 <= window < WINDOW_AT_MOST:
        raise ValueError(f"a window has 2 to {WINDOW_AT_MOST - 1} units")
    bounded_batches(docs.sparkSession)
    asked = docs.groupBy("chunk").applyInArrow(asker(units, window, seed, bits), ddl(ASKED))
    told = asked.groupBy("bucket").applyInArrow(teller(crowd), ddl(TOLD))
    rows = docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(sender(units, bodies, window, seed, longer_seed, bits, own_document), ddl(ROWS))
    by_shard = rows.repartition("shard").sortWithinPartitions("shard", "content", "doc_id", "pos")
    return by_shard.mapInArrow(shard_reader(solve, own_document), ddl(SPANS))


def with_spans(docs: DataFrame, chunks: int, spans: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """``chunked`` documents with their spans, through cut(rows, data, offs, spans); null ids come back."""

    def run(table: pa.Table, spans: pa.Table) -> pa.Table:
        doc, s, e = merged(*(spans[k].to_numpy() for k in ("doc_id", "s", "e")))
        return pa.Table.from_batches([cut(rows, data, offs, (doc, s, e)) for rows, data, offs in slices(table.to_batches())])

    placed = spans.withColumn("chunk", chunk_of("doc_id", chunks))
    done = docs.groupBy("chunk").cogroup(placed.groupBy("chunk")).applyInArrow(run, schema)
    return done.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))


def span_mask(ids: np.ndarray, spans: tuple[np.ndarray, ...], offsets: np.ndarray) -> np.ndarray:
    """True for every unit of a slice that a span of its document covers; ``offsets`` are in units, spans sorted."""
    doc, s, e = spans
    n = int(offsets[-1])
    edge = np.zeros(n + 1, dtype=np.int32)
    a, b = np.searchsorted(doc, ids, side="left"), np.searchsorted(doc, ids, side="right")
    count = np.where(ids == NO_ID, 0, b - a)
    if count.sum():
        row = np.repeat(np.arange(len(ids)), count)
        at = np.repeat(a, count) + runs(count)
        size = np.diff(offsets)[row]
        np.add.at(edge, np.minimum(s[at], size) + offsets[row], 1)
        np.add.at(edge, np.minimum(e[at], size) + offsets[row], -1)
    return np.cumsum(edge[:n]) > 0
