"""Byte-level byte-pair encoding by a lazily determinised transducer, and streaming decoding.

The merges are read as a transducer over the bytes of one piece (a match of the splitting pattern). Its
nondeterministic paths are the ways to cut the bytes read so far into tokens, plus a walk in the trie of tokens for the
token under way. Two facts keep it small: a cut is what merging by rank yields exactly if every two neighbours of it
stay apart when merged alone, and for each prefix there is one such cut. So after each byte one path ends at that byte,
and the others are walks in the trie that began at an earlier byte. A determinised state is that set of paths, each
with the tokens it has over the common ones; tokens that all paths share are final and are put out. A walk ends at the
longest token, so a token is put out after a bounded lookahead. States and moves are made when first met and forgotten
together once they number ``MOVES``; up to ``PIECES`` pieces, of those last met, are remembered.

Decoding takes ids a chunk at a time. A UTF-8 state machine, moved by whole tokens, says after each chunk how many bytes
at its end belong to an unfinished character; these wait for the next chunk and the rest is given out, so that every part
given out is text. The decoded bytes of the query come out of this stream.

Null texts count as empty and give no tokens. A null doc_id is kept. Repeated rows give repeated rows; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import bounded_batches, runs, slices

MOVES = 400_000
APART = 200_000
PIECES = 300_000
#: Longer pieces are encoded anew each time.
PIECE_REMEMBERED = 64
#: Ids decoded at once.
CHUNK = 1 << 14
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean"


class Merges:
    """Ranks of tokens, and what follows from them: how each token is merged, and which neighbours stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, piece: bytes, until: int = 1) -> list[bytes]:
        """Merge by rank, leftmost first, until no merge is left or ``until`` parts are."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            best, where = None, 0
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, where = rank, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for bytes and for tokens that merging never makes."""
        if token not in self._halves:
            text = self.token[token]
            parts = self.merge(text, until=2) if len(text) > 1 else []
            made = len(parts) == 2 and b"".join(parts) in self.ranks
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if made else None
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.token[token]) == 1 or self.halves(token) is not None

    def apart(self, a: int, b: int) -> bool:
        """True if tokens a and b, side by side, are not merged across their border.

        The merges that made them are undone, the latest first; a merge across the border that would come before the
        one undone last joins them.
        """
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= APART:
                self.pairs.clear()
            known = self.pairs[key] = self._stay(a, b)
        return known

    def _stay(self, a: int, b: int) -> bool:
        bound = len(self.ranks) + 1
        while True:
            across = self.ranks.get(self.token[a] + self.token[b])
            if across is not None and across < bound:
                return False
            parts_a, parts_b = self.halves(a), self.halves(b)
            if parts_a is None and parts_b is None:
                return True
            if parts_b is None or (parts_a is not None and a > b):
                bound, a = a, parts_a[1]
            else:
                bound, b = b + 1, parts_b[0]


class Transducer:
    """The lazily determinised transducer of a set of merges."""

    def __init__(self, merges: Merges, moves: int = MOVES):
        self.merges, self.limit = merges, moves
        # the trie of tokens: node and byte to node, the token that ends at a node, and whether a node has children
        self._next: dict[int, int] = {}
        self._ends: list[int] = [-1]
        parents: set[int] = set()
        for text, rank in merges.ranks.items():
            if not merges.reachable(rank):
                continue
            node = 0
            for byte in text:
                key = node << 8 | byte
                to = self._next.get(key)
                if to is None:
                    to = self._next[key] = len(self._ends)
                    self._ends.append(-1)
                    parents.add(node)
                node = to
            self._ends[node] = rank
        self._goes_on = bytes(i in parents for i in range(len(self._ends)))
        self.clear()

    def clear(self) -> None:
        start = ((0, -1),)
        self._states, self._numbers, self._moves = [start], {start: 0}, {}

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after one more byte, and the tokens that became final. A path is (trie node, last token, *tokens held)."""
        paths, cut = [], None
        child, ends, goes_on, known, apart = self._next.get, self._ends, self._goes_on, self.merges.pairs.get, self.merges.apart
        for path in self._states[state]:
            node = child(path[0] << 8 | byte)
            if node is None:
                continue
            last = path[1]
            if cut is None:
                token = ends[node]
                if token >= 0:
                    fits = last < 0 or known(last << 32 | token)
                    if apart(last, token) if fits is None else fits:
                        cut = (0, token, token) if len(path) == 2 else (0, token, *path[2:], token)
            if goes_on[node]:
                paths.append((node, last) if len(path) == 2 else (node, last, *path[2:]))
        shared = min([len(path) for path in paths], default=len(cut)) - 2
        shared = min(shared, len(cut) - 2)
        for path in paths if shared else ():  # the start that all paths share
            while shared and path[2 : 2 + shared] != cut[2 : 2 + shared]:
                shared -= 1
        paths.append(cut)
        final = cut[2 : 2 + shared]
        key = tuple([path[:2] + path[2 + shared :] for path in paths]) if shared else tuple(paths)
        number = self._numbers.get(key)
        if number is None:
            number = self._numbers[key] = len(self._states)
            self._states.append(key)
        return number, final

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        if len(self._moves) > self.limit:
            self.clear()
        out: list[int] = []
        state, moves = 0, self._moves
        for byte in piece:
            key = state << 8 | byte
            to = moves.get(key)
            if to is None:
                to = moves[key] = self._move(state, byte)
            state, final = to
            if final:
                out += final
        if piece:
            out += self._states[state][-1][2:]
        return out


class _Pieces(dict):
    """Piece to its ids as little-endian bytes; filled when asked. Once full, pieces not asked for since the last time
    that it was full are forgotten."""

    def __init__(self, coder: Transducer):
        self.coder, self.ranks, self.older = coder, coder.merges.ranks, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            raw = piece.encode("utf-8")
            whole = self.ranks.get(raw)
            ids = [whole] if whole is not None else self.coder.encode(raw)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= PIECE_REMEMBERED:
            if len(self) >= PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


def _utf8_table() -> np.ndarray:
    """State and byte to state. States: 0 between characters, 1-3 plain continuation bytes to come, 4-7 after a lead
    byte that narrows the next one (E0, ED, F0, F4), 8 not UTF-8."""
    table = np.full((9, 256), 8, dtype=np.uint8)
    table[0, 0x00:0x80] = 0
    table[0, 0xC2:0xE0] = 1
    table[0, 0xE1:0xF0] = 2
    table[0, 0xF1:0xF4] = 3
    table[0, [0xE0, 0xED, 0xF0, 0xF4]] = [4, 5, 6, 7]
    for state, to in ((1, 0), (2, 1), (3, 2)):
        table[state, 0x80:0xC0] = to
    table[4, 0xA0:0xC0] = 1
    table[5, 0x80:0xA0] = 1
    table[6, 0x90:0xC0] = 2
    table[7, 0x80:0x90] = 2
    return table


_UTF8 = _utf8_table()
_PENDING_AT_MOST = 3


class Decoder:
    """Ids to bytes, and to text as it becomes whole."""

    def __init__(self, token: dict[int, bytes]):
        size = max(token, default=-1) + 1
        texts = [token.get(i, b"") for i in range(size)]
        self.known = np.array([i in token for i in range(size)], dtype=bool)
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.texts = texts
        self._moves: dict[tuple[int, int], int] = {}
        self.whole = np.array([self.move(0, i) == 0 for i in range(size)], dtype=bool)
        self._moves.clear()

    def move(self, state: int, token: int) -> int:
        key = (state, token)
        if key not in self._moves:
            for byte in self.texts[token]:
                state = int(_UTF8[state, byte])
            self._moves[key] = state
        return self._moves[key]

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (int(ids.max()) >= len(self.size) or not self.known[ids].all()):
            raise ValueError("an id has no token")
        size = self.size[ids]
        return self.pool[np.repeat(self.start[ids], size) + runs(size)]

    def state(self, ids: np.ndarray, state: int = 0) -> int:
        """The state after these tokens; only those that do not hold whole characters are walked."""
        odd = np.flatnonzero(~self.whole[ids])
        if state:
            odd = np.append(np.arange(min(1, len(ids))), odd[odd > 0])
        before = -1
        for i in odd.tolist():
            if i != before + 1 and before >= 0 and state:
                return 8  # a whole character where one was unfinished
            state = self.move(state, int(ids[i]))
            if state == 8:
                return 8
            before = i
        if state and before >= 0 and before != len(ids) - 1:
            return 8
        return state

    def stream(self, chunks: Iterable[np.ndarray], errors: str = "replace") -> Iterator[str]:
        """The text of each chunk of ids as far as its characters are whole; the rest comes with a later one."""
        stream = Utf8Stream(self)
        for ids in chunks:
            yield stream.feed(np.asarray(ids, dtype=np.int64)).decode("utf-8", errors)
        if rest := stream.end():
            yield rest.decode("utf-8", errors)


class Utf8Stream:
    """Incremental decoding: the state of the UTF-8 machine, and the bytes of the character under way."""

    def __init__(self, decoder: Decoder):
        self.decoder, self.state, self.held = decoder, 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        raw = self.held + self.decoder.bytes(ids).tobytes()
        self.state = self.decoder.state(ids, self.state)
        cut = len(raw)
        if self.state == 8:  # no UTF-8: what ends like an unfinished character still waits
            cut -= self._unfinished(raw)
        elif self.state:
            cut -= next(back for back in range(1, _PENDING_AT_MOST + 1) if raw[cut - back] >= 0xC0)
        self.held = raw[cut:]
        return raw[:cut]

    @staticmethod
    def _unfinished(raw: bytes) -> int:
        for back in range(1, min(_PENDING_AT_MOST, len(raw)) + 1):
            if raw[-back] >= 0xC0:
                state = 0
                for byte in raw[-back:]:
                    state = int(_UTF8[state, byte])
                return back if 0 < state < 8 else 0
        return 0

    def end(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> tuple[Callable, _Pieces, Decoder]:
    merges = Merges(read_ranks(path))
    return regex.compile(pattern).findall, _Pieces(Transducer(merges)), Decoder(merges.token)


def encode_text(text: str, path: str, pattern: str) -> np.ndarray:
    split, pieces, _ = _coder(path, pattern)
    return np.frombuffer(b"".join(map(pieces.__getitem__, split(text))), dtype="<u4")


def decoded_digest(decoder: Decoder, ids: np.ndarray) -> tuple[str, bool]:
    """The digest of the bytes that come out of the stream, and whether they are UTF-8."""
    digest, stream = hashlib.sha256(), Utf8Stream(decoder)
    for a in range(0, len(ids), CHUNK):
        digest.update(stream.feed(ids[a : a + CHUNK]))
    digest.update(stream.end())
    return digest.hexdigest(), stream.state == 0


def digest_rows(path: str, pattern: str):
    """mapInArrow: documents to RESULT."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, decoder = _coder(path, pattern)
        for rows, _, _ in slices(batches):
            n, digests, decoded, valid = [], [], [], []
            for text in rows.column(1).to_pylist():
                raw = b"".join(map(pieces.__getitem__, split(text or "")))
                ids = np.frombuffer(raw, dtype="<u4").astype(np.int64)
                n.append(len(ids))
                digests.append(hashlib.sha256(raw).hexdigest())
                digest, whole = decoded_digest(decoder, ids)
                decoded.append(digest)
                valid.append(whole)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(valid, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "valid_utf8"])

    return run


def encode_rows(path: str, pattern: str, keep: list[str]):
    """mapInArrow: rows with ``text`` to their columns ``keep``, ids, their number and the digest of the bytes decoded from them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, decoder = _coder(path, pattern)
        for rows, _, _ in slices(batches):
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            ids = [np.frombuffer(b"".join(map(pieces.__getitem__, split(t or ""))), dtype="<u4").astype(np.int32) for t in texts]
            sizes = [len(x) for x in ids]
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            decoded = [decoded_digest(decoder, x)[0] for x in ids]
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(k)) for k in keep), lists, pa.array(sizes, pa.int64()), pa.array(decoded, pa.string())], names=[*keep, "ids", "n_tokens", "decoded_sha256"])

    return run


def default_vocabulary() -> tuple[str, str]:
    """The installed public vocabulary and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_encode(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with ids (the tokens of ``text``), n_tokens and decoded_sha256 in place of ``text`` and of columns so named.

    The rank file at ``path`` is read on each executor.
    """
    default = default_vocabulary() if path is None or pattern is None else ("", "")
    path, pattern = path or default[0], pattern or default[1]
    bounded_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in ("text", "ids", "n_tokens", "decoded_sha256")]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(encode_rows(path, pattern, keep), schema)


def bpe_digests(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode each text; one row per document: RESULT."""
    bounded_batches(documents.sparkSession)
    default = default_vocabulary() if path is None or pattern is None else ("", "")
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(digest_rows(path or default[0], pattern or default[1]), RESULT)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_bpe": op10_bpe}
ORACLES: dict[str, str] = {}
