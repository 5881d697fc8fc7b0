"""Conversations damaged by rule, their faults counted, and the cheapest edits that give them a lawful structure.

A repaired conversation has the role initials ``(s?(ua)+)?``. Its rows, in order, are kept (cost 0), given the role user
or assistant (3), deleted (4; blank and duplicate rows must be), and rows without text may be inserted anywhere (3); a
truncated row that stays adds 3. Edits are letters, D, I, K, R; of the cheapest sequences the ASCII-least counts.

The edit lattice has a place for each row border and each state of the pattern (nothing yet, after s, after u, after a).
In any state just one of the roles that edits can give is lawful, so that letters alone lead from place to place. The
search goes from both ends, with a heap for each direction (bidirectional Dijkstra), until the two tops together exceed
the best crossing found: every cheapest path then goes over a crossing of that cost. The least of the concatenated
letters is read off along the places that lie on such paths.

No conversation comes together in one task. Rows, without their texts, are sorted by conversation and place over range
partitions and packed into pieces of ``PIECE`` rows of one byte each. A piece that is a whole conversation is solved at
once. Of longer ones, each piece gives the cost from each of its four entry states to each exit state; these small tables
are folded from the end, so that every piece knows what each exit will cost, and is then solved for each entry; the last
step picks along the states. Only the digest of a repaired conversation is one stream by its nature: a task reads the rows
in order, one at a time, and holds none.

Rows are in the order of turn (nulls first), then role, then the SHA-256 of the text, which the contract leaves open. Null
roles and texts, and null ids in the checksum's string, are one space. conv_id null is a conversation. Repeated rows
count as often as they are there; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from .arrays import bounded_batches

#: Rows of a piece: what one search holds.
PIECE = 4096
KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a.
START, S, U, A = range(4)
STATES = range(4)
NEXT = (U, U, A, U)  # by the one role that an edit may give
#: Insertions after the last row, by state.
TAIL, TAIL_COST = ("", "II", "I", ""), (0, 2 * INSERT, INSERT, 0)
#: A row as a byte: the class of its initial, faults.
CLASSES = "sua"
OTHER, BLANK, DUPLICATE, TRUNCATED = 3, 4, 8, 16
LAWFUL = {(0, 1), (1, 2), (2, 1)}
NONE = float("inf")

_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
ROW = "conv_id long, part int, seq long, whole boolean, codes binary, rows long, blank long, duplicate long, truncated long, illegal long, first_class int, last_class int, least_turn long, most_turn long, turns long"


def _edges(code: int, state: int) -> list[tuple[str, int, int]]:
    """Edges from a row's place (4 * rows before it + state), letters in order: (letter, cost, how far the next place is)."""
    to = lambda q: 4 + q - state
    out = [("D", DELETE, to(state)), ("I", INSERT, NEXT[state] - state)]
    if not code & (BLANK | DUPLICATE):
        mend, kind = (MEND if code & TRUNCATED else 0), code & 3
        if kind == 0 and state == START:
            out.append(("K", KEEP + mend, to(S)))
        elif kind in (1, 2) and NEXT[state] == kind + 1:
            out.append(("K", KEEP + mend, to(NEXT[state])))
        out.append(("R", REROLE + mend, to(NEXT[state])))
    return out


EDGES = [[_edges(code, state) for state in STATES] for code in range(32)]
#: Into a place: edges over the row before it, by the row's code, and insertions at the place.
OVER = [[[(cost, far) for q in STATES for letter, cost, far in EDGES[code][q] if letter != "I" and q + far == 4 + state] for state in STATES] for code in range(32)]
INSERTED = [[(INSERT, state - q) for q in STATES if NEXT[q] == state] for state in STATES]


def _ahead(codes: bytes, place: int) -> list[tuple[str, int, int]]:
    """Insertions stand before a row, in its piece; after a piece's last row there are none."""
    return EDGES[codes[place >> 2]][place & 3] if place >> 2 < len(codes) else []


def _behind(codes: bytes, place: int) -> list[tuple[int, int]]:
    at, state = place >> 2, place & 3
    over = OVER[codes[at - 1]][state] if at else []
    return over + INSERTED[state] if at < len(codes) else over


def costs_from(codes: bytes, enter: int) -> list[float]:
    """The least cost from a state before the piece to each state after it, by a plain heap."""
    n, done, heap = len(codes), {}, [(0, enter)]
    while heap:
        cost, place = heapq.heappop(heap)
        if place in done:
            continue
        done[place] = cost
        for _, more, far in _ahead(codes, place):
            if place + far not in done:
                heapq.heappush(heap, (cost + more, place + far))
    return [done.get(4 * n + q, NONE) for q in STATES]


def cheapest(codes: bytes, enter: int, leave: tuple[float, ...] = TAIL_COST) -> tuple[float, str, int]:
    """Cost, least letters and last state of the cheapest edits of a piece, where leaving in state q costs ``leave[q]`` more."""
    n = len(codes)
    forth, back = {}, {}
    seen_forth, seen_back = {enter: 0}, {}
    ahead, behind = [(0, enter)], []
    for q in STATES:
        if leave[q] != NONE:
            seen_back[4 * n + q] = leave[q]
            behind.append((leave[q], 4 * n + q))
    heapq.heapify(behind)
    best = seen_back.get(enter, NONE) if n == 0 else NONE
    while (ahead or behind) and (ahead[0][0] if ahead else 0) + (behind[0][0] if behind else 0) <= best:
        if ahead and (not behind or ahead[0][0] <= behind[0][0]):
            cost, place = heapq.heappop(ahead)
            if place in forth:
                continue
            forth[place] = cost
            for _, more, far in _ahead(codes, place):
                to = place + far
                if cost + more < seen_forth.get(to, NONE):
                    seen_forth[to] = cost + more
                    heapq.heappush(ahead, (cost + more, to))
                best = min(best, cost + more + seen_back.get(to, NONE))
        else:
            cost, place = heapq.heappop(behind)
            if place in back:
                continue
            back[place] = cost
            for more, far in _behind(codes, place):
                to = place - far
                if cost + more < seen_back.get(to, NONE):
                    seen_back[to] = cost + more
                    heapq.heappush(behind, (cost + more, to))
                best = min(best, cost + more + seen_forth.get(to, NONE))
    # places of the forward search on cheapest paths, walked back from every crossing of the least cost; leaving the
    # piece is one too
    open_ = [place for place, cost in forth.items() if (place >= 4 * n and cost + leave[place - 4 * n] == best) or any(cost + more + back.get(place + far, NONE) == best for _, more, far in _ahead(codes, place))]
    useful = set(open_)
    while open_:
        place = open_.pop()
        for more, far in _behind(codes, place):
            before = place - far
            if before not in useful and before in forth and forth[before] + more == forth[place]:
                useful.add(before)
                open_.append(before)
    letters, place, spent = [], enter, 0
    while place < 4 * n:
        for letter, more, far in _ahead(codes, place):
            to = place + far
            if back.get(to, NONE) + spent + more == best or (to in useful and forth[to] == spent + more):
                letters.append(letter)
                place, spent = to, spent + more
                break
        else:
            raise AssertionError("no edge of the lattice is on a cheapest path")
    return best, "".join(letters), place - 4 * n


@lru_cache(maxsize=1 << 16)
def _short(codes: bytes) -> tuple[int, str]:
    cost, letters, state = cheapest(codes, START)
    return int(cost), letters + TAIL[state]


def solve(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return (_short if len(codes) <= 24 else _short.__wrapped__)(codes)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by each row's checksum."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), (F.crc32(key) % 20).alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    left = rows.filter("way <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("way") == 3, 2).otherwise(1).alias("times"))
    return left.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Rows without their text: conv_id, turn, role, digest, salt, and the byte that the search reads."""
    last = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    kind: Column = F.lit(OTHER)
    for i, initial in enumerate(CLASSES):
        kind = F.when(F.startswith("role", F.lit(initial)), i).otherwise(kind)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.monotonically_increasing_id().alias("salt"), kind.alias("kind"), fault.alias("fault"))


def _with_duplicates(rows: DataFrame) -> DataFrame:
    """The same with ``code``: of rows of one role and text in a conversation all but the first are duplicates."""
    key = ["conv_id", "role", "digest"]
    groups = rows.filter(F.col("fault") != BLANK).groupBy(*key).agg(F.min(F.struct("turn", "salt")).alias("first"), F.count("*").alias("n")).filter("n > 1").select(*(F.col(c).alias(f"k_{c}") for c in key), "first")
    same = F.col("conv_id").eqNullSafe(F.col("k_conv_id")) & (F.col("role") == F.col("k_role")) & (F.col("digest") == F.col("k_digest"))
    again = F.col("first").isNotNull() & (F.col("fault") != BLANK) & (F.struct("turn", "salt") != F.col("first"))
    code = F.col("kind") + F.when(again, DUPLICATE).otherwise(F.col("fault"))
    return rows.join(groups, same, "left").select("conv_id", "turn", "role", "digest", "salt", code.cast("int").alias("code"))


class _Piece:
    """Rows of one conversation while they come in."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.turns, self.least, self.most = conv_id, bytearray(), 0, None, None

    def add(self, turn: int | None, code: int) -> None:
        self.codes.append(code)
        if turn is not None and turn != self.most:  # turns come in order
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn

    def row(self, part: int, seq: int, whole: bool) -> tuple:
        c = self.codes
        illegal = sum((a & 3, b & 3) not in LAWFUL for a, b in zip(c, c[1:], strict=False))
        count = lambda bit: sum(1 for x in c if x & bit)
        return (self.conv_id, part, seq, whole, bytes(c), len(c), count(BLANK), count(DUPLICATE), count(TRUNCATED), illegal, c[0] & 3, c[-1] & 3, self.least, self.most, self.turns)


_NAMES = [field.split()[0] for field in ROW.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def pack(size: int):
    """mapInArrow over sorted (conv_id, turn, code): ROW. A conversation that begins and ends inside is whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, seq, out, cut = TaskContext.get().partitionId(), None, 0, [], True
        for batch in batches:
            for conv_id, turn, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece is None or conv_id != piece.conv_id or len(piece.codes) == size:
                    same = piece is not None and conv_id == piece.conv_id
                    if piece is not None:
                        out.append(piece.row(part, seq, not (cut or same)))
                        seq += 1
                    # a partition's first conversation may have begun before it, and a full piece's goes on
                    cut = piece is None or same
                    piece = _Piece(conv_id)
                piece.add(turn, code)
            if len(out) >= 1000:
                yield _batch(out, ROW)
                out = []
        if piece is not None:
            out.append(piece.row(part, seq, False))
        yield _batch(out, ROW)

    return run


def solve_whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (conv_id, codes) to (conv_id, cost, audit)."""
    for batch in batches:
        rows = [(conv_id, *solve(codes)) for conv_id, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield _batch(rows, "conv_id long, cost long, audit string")


def _tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (conv_id, part, seq, codes) to the costs of each piece by entry and exit."""
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        costs = [[float(x) for q in STATES for x in costs_from(codes, q)] for *_, codes in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(costs, pa.list_(pa.float64()))], names=["conv_id", "part", "seq", "costs"])


def _exits(key: tuple, table: pa.Table) -> pa.Table:
    """The pieces of one conversation (one row for 4096 of its rows): what leaving each costs from each state on."""
    table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
    leave, out = list(map(float, TAIL_COST)), []
    for costs in reversed(table.column("costs").to_pylist()):
        out.append(leave)
        leave = [min(costs[4 * q + to] + leave[to] for to in STATES) for q in STATES]
    return table.drop_columns(["costs"]).append_column("leave", pa.array(out[::-1], pa.list_(pa.float64())))


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (conv_id, part, seq, codes, leave) to cost, letters and last state for each entry state."""
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = [[cheapest(codes, q, tuple(leave)) for q in STATES] for *_, codes, leave in rows]
        columns = [pa.array([[int(f[q][0]) for q in STATES] for f in found], pa.list_(pa.int64())), pa.array([[f[q][1] for q in STATES] for f in found], pa.list_(pa.string())), pa.array([[f[q][2] for q in STATES] for f in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["conv_id", "part", "seq", "costs", "letters", "states"])


def _solve_long(pieces: DataFrame) -> DataFrame:
    """conv_id, cost, audit of conversations in pieces."""
    place = ["conv_id", "part", "seq"]
    tables = pieces.select(*place, "codes").mapInArrow(_tables, "conv_id long, part int, seq long, costs array<double>")
    leave = tables.groupBy("conv_id").applyInArrow(_exits, "conv_id long, part int, seq long, leave array<double>")
    # part and seq name a piece by themselves
    known = pieces.select(*place, "codes").join(leave.select("part", "seq", "leave"), ["part", "seq"]).select(*place, "codes", "leave")
    solved = known.mapInArrow(_entries, "conv_id long, part int, seq long, costs array<long>, letters array<string>, states array<int>")
    ordered = F.sort_array(F.collect_list(F.struct("part", "seq", "costs", "letters", "states")))
    start = F.struct(F.lit(START).alias("state"), F.array().cast("array<string>").alias("audit"))
    walk = F.aggregate(F.col("pieces"), start, lambda at, p: F.struct(F.get(p["states"], at["state"]).alias("state"), F.array_append(at["audit"], F.get(p["letters"], at["state"])).alias("audit")))
    tails = F.array(*map(F.lit, TAIL))
    joined = solved.groupBy("conv_id").agg(ordered.alias("pieces")).select("conv_id", F.get(F.get("pieces", F.lit(0))["costs"], F.lit(START)).alias("cost"), walk.alias("w"))
    return joined.select("conv_id", "cost", F.concat(F.array_join("w.audit", ""), F.get(tails, F.col("w.state"))).alias("audit"))


def _facts(pieces: DataFrame) -> DataFrame:
    """conv_id and counts of faults, of pieces put together; borders between pieces count as inside."""
    each = F.sort_array(F.collect_list(F.struct("part", "seq", "first_class", "last_class", "least_turn", "most_turn")))
    borders = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: F.struct((~(4 * a["last_class"] + b["first_class"]).isin(*(4 * x + y for x, y in LAWFUL))).cast("long").alias("bad"), F.coalesce((a["most_turn"] == b["least_turn"]).cast("long"), F.lit(0)).alias("same")))
    total = lambda field: F.aggregate(F.col("b"), F.lit(0).cast("long"), lambda n, x: n + x[field])
    sums = pieces.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("rows", "blank", "duplicate", "truncated", "illegal", "turns")), F.min("least_turn").alias("least_turn"), F.max("most_turn").alias("most_turn"), each.alias("p"))
    sums = sums.withColumn("b", borders)
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - (F.col("turns") - total("same")), F.lit(0))
    return sums.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + total("bad")).alias("illegal"))


class _Digest:
    """The digest of one conversation as its audit leaves it, a row at a time."""

    def __init__(self, conv_id: int | None, audit: str):
        self.conv_id, self._audit, self._at, self._state, self._hash, self._lines = conv_id, audit, 0, START, hashlib.sha256(), 0

    def _put(self, role: str, text: str) -> None:
        self._hash.update(("\n" if self._lines else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self._lines += 1

    def _given(self) -> str:
        self._state = NEXT[self._state]
        return "user" if self._state == U else "assistant"

    def _insert(self) -> None:
        while self._audit[self._at : self._at + 1] == "I":
            self._at += 1
            self._put(self._given(), "")

    def add(self, role: str, text: str) -> None:
        self._insert()
        letter, self._at = self._audit[self._at], self._at + 1
        if letter == "R":
            self._put(self._given(), text)
        elif letter == "K":
            self._state = S if role.startswith("s") else NEXT[self._state]
            self._put(role, text)

    def row(self) -> tuple[int | None, str]:
        self._insert()
        return self.conv_id, self._hash.hexdigest()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (conv_id, audit, role, text), each conversation's audit first, then its rows: the digests."""
    schema, now = "conv_id long, repaired_sha256 string", None
    for batch in batches:
        out = []
        for conv_id, audit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if audit is None:
                now.add(role, text)
                continue
            if now is not None:
                out.append(now.row())
            now = _Digest(conv_id, audit)
        yield _batch(out, schema)
    if now is not None:
        yield _batch([now.row()], schema)


def repair_damaged(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, faults, cost, audit and digest of conversations (conv_id, turn, role, text) as they stand, one row for each conv_id."""
    blank = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")))
    return _repair(conversations.select("conv_id"), rows, piece)


def _repair(ids: DataFrame, rows: DataFrame, piece: int = PIECE) -> DataFrame:
    bounded_batches(rows.sparkSession)
    faults = materialise(_with_duplicates(materialise(_faults(rows), "rows")), "faults")
    order = ["conv_id", "turn", "role", "digest"]
    dealt = faults.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt")
    pieces = materialise(dealt.select("conv_id", "turn", "code").mapInArrow(pack(piece), ROW), "pieces")
    # a conversation at the edge of a partition may have no other piece after all; it is solved in the same way
    whole = pieces.filter("whole").select("conv_id", "codes").mapInArrow(solve_whole, "conv_id long, cost long, audit string")
    edits = whole.unionByName(_solve_long(pieces.filter("NOT whole")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    named = ids.select(F.col("conv_id").cast("long")).distinct()
    known = _facts(pieces).withColumnRenamed("conv_id", "f_id")
    solved = edits.withColumnRenamed("conv_id", "e_id")
    table = named.join(known, F.col("conv_id").eqNullSafe(F.col("f_id")), "left").join(solved, F.col("conv_id").eqNullSafe(F.col("e_id")), "left")
    table = materialise(table.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit")), "repairs")
    none = F.lit(None).cast("string")
    texts = rows.select("conv_id", none.alias("audit"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    plans = table.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), none.alias("role"), F.lit(None).cast("binary").alias("digest"), none.alias("text"))
    stream = plans.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *order[1:])
    digests = stream.select("conv_id", "audit", "role", "text").mapInArrow(_hashed, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "d_id")
    return table.join(digests, F.col("conv_id").eqNullSafe(F.col("d_id"))).drop("d_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return _repair(conversations.select("conv_id"), damage(conversations))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES: dict[str, str] = {}
