"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation is a finite-state scan. Each code point has a class, each class
is a function from states to states, and these functions compose associatively:
a blocked prefix scan over the ids of the composed functions gives every
position's state, and from that the places where pieces begin. The pieces then
go through pair merging, with a bounded cache in each worker.

Cases: a null text counts as empty, an empty text has no tokens, repeated rows
give repeated rows, an empty table an empty result. Only the two named columns
are read, so further columns never clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.llm import common

#: Pieces that a worker's cache holds at most (then it starts anew), and bytes of one.
CACHE_PIECES, CACHE_BYTES = 250_000, 64

# States after a code point.
FRESH, IN_LETTERS, IN_DIGITS, IN_OTHER, IN_SPACE, PENDING, ONE_MORE, TWO_MORE = range(8)
# Classes of code points, once their right neighbours are known.
LETTER, DIGIT, OTHER, SPACE_MID, SPACE_LAST, BLANK_LAST, SHORT, LONG = range(8)


def _step(state: int, cls: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at this code point."""
    if state == ONE_MORE:
        return FRESH, False
    if state == TWO_MORE:
        return ONE_MORE, False
    if cls in (SHORT, LONG) and state in (IN_OTHER, PENDING):
        cls = OTHER
    if cls in (SHORT, LONG):
        return (ONE_MORE if cls == SHORT else TWO_MORE), True
    if cls in (LETTER, DIGIT, OTHER):
        own = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, OTHER: IN_OTHER}[cls]
        return own, state not in (own, PENDING)
    if cls == SPACE_MID:
        return IN_SPACE, state != IN_SPACE
    return (PENDING if cls == BLANK_LAST else FRESH), True


class Scanner:
    """The monoid of transition functions, as tables of ids."""

    def __init__(self) -> None:
        self.next = np.array([[_step(s, c)[0] for c in range(8)] for s in range(8)])
        self.starts = np.array([[_step(s, c)[1] for c in range(8)] for s in range(8)])
        identity = tuple(range(8))
        plain = [tuple(int(self.next[s, c]) for s in range(8)) for c in range(8)]
        # A class at the start of a text: whatever came before, the state is FRESH.
        generators = plain + [tuple(f[FRESH] for _ in range(8)) for f in plain]
        ids = {identity: 0}
        found = [identity]
        for f in found:
            for g in generators:
                h = tuple(g[x] for x in f)
                if h not in ids:
                    ids[h] = len(found)
                    found.append(h)
        for g in generators:
            if g not in ids:
                ids[g] = len(found)
                found.append(g)
        self.size = m = len(found)
        self.generator = np.array([ids[g] for g in generators], dtype=np.int32)
        table = np.zeros((m, m), dtype=np.int32)
        for a, f in enumerate(found):
            for b, g in enumerate(found):
                table[a, b] = ids.setdefault(tuple(g[x] for x in f), -1)
        #: Ids times m, to address the flat table without a product at each step.
        self.compose = (table * m).ravel()
        self.act = np.array(found, dtype=np.int8)

    def states(self, elements: np.ndarray, block: int = 256) -> np.ndarray:
        """The state after each element, from FRESH, by a blocked prefix scan."""
        n, m = len(elements), self.size
        width = -(-n // block)
        if width <= 1:
            out, state = np.empty(n, dtype=np.int8), FRESH
            for i, e in enumerate(elements.tolist()):
                out[i] = state = int(self.act[e, state])
            return out
        grid = np.zeros(width * block, dtype=np.int32)
        grid[:n] = elements
        grid = np.ascontiguousarray(grid.reshape(width, block).T)
        acc = grid[0] * m
        grid[0] = acc
        for j in range(1, block):
            acc = self.compose.take(acc + grid[j])
            grid[j] = acc
        carry = np.empty(width, dtype=np.int8)
        carry[0] = FRESH
        carry[1:] = self.states(acc[:-1] // m, block)
        flat = self.act.ravel().take(grid // m * 8 + carry[None, :])
        return np.ascontiguousarray(flat.T).ravel()[:n]


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


#: White space, as the pattern's \s has it. Fixed values.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point on its own: letter, digit, other, or white space (SPACE_MID)."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = DIGIT
    out[WHITE_SPACE] = SPACE_MID
    return out


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start in joined texts. cp: code points; first: indexes at which texts begin."""
    n, cls = len(cp), classes()[cp]
    begins = np.zeros(n + 2, dtype=bool)
    begins[first] = True
    begins[n:] = True
    ended = begins[1 : n + 1]  # the next code point belongs to another text
    white = cls == SPACE_MID
    after = np.append(~white[1:], False)
    last = white & after & ~ended
    cls[last] = SPACE_LAST
    cls[last & (cp == 0x20)] = BLANK_LAST
    at = np.flatnonzero((cp == 0x27) & ~ended)
    if len(at):
        one = cp[at + 1]
        cls[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        two = at[(at + 2 < n) & ~begins[np.minimum(at + 2, n)]]
        pair = cp[two + 1].astype(np.int64) << 32 | cp[two + 2]
        cls[two[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
    scan = scanner()
    elements = scan.generator[cls + np.uint8(8) * begins[:n]]
    after_each = scan.states(elements)
    before = np.empty(n, dtype=np.int8)
    before[0] = FRESH
    before[1:] = after_each[:-1]
    before[first] = FRESH
    return np.flatnonzero(scan.starts[before, cls] | begins[:n])


class Vocabulary:
    """Ranks of a byte-level BPE, with a bounded cache of merged pieces."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the pair of the lowest rank, leftmost first, is joined until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.bytes_of)
        pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over linked parts, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = bytearray(b"\x01" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or end[j] != stop:
                continue
            end[i], after[i], alive[j] = stop, after[j], 0
            if after[i] >= 0:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian unsigned 32-bit integers."""
        got = list(map(self.cache.get, pieces))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    piece = pieces[i]
                    if (x := self.cache.get(piece)) is None:
                        x = array("I", self.merge(piece)).tobytes()
                        if len(piece) <= CACHE_BYTES:
                            if len(self.cache) >= CACHE_PIECES:
                                self.cache.clear()
                            self.cache[piece] = x
                    got[i] = x
        return got

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """Of each text: its packed ids, and the byte offset at which each piece begins."""
        joined = "".join(texts)
        if not joined:
            return [(b"", np.zeros(0, dtype=np.int64)) for _ in texts]
        cp = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum([len(t) for t in texts])
        firsts = ends - [len(t) for t in texts]
        starts = piece_starts(cp, np.unique(firsts[firsts < len(cp)]))
        at = np.zeros(len(cp) + 1, dtype=np.int64)
        np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), out=at[1:])
        raw, byte_starts = joined.encode(), at[starts]
        cuts = [*byte_starts.tolist(), len(raw)]
        pieces = self.packed([raw[a:b] for a, b in zip(cuts, cuts[1:])])
        of = np.searchsorted(starts, firsts).tolist() + [len(starts)]
        out = []
        for k in range(len(texts)):
            a, b = of[k], of[k + 1]
            out.append((b"".join(pieces[a:b]), byte_starts[a:b] - at[firsts[k]]))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns in keep, ids (array of int) and piece_offsets (array of int: the byte at which each piece begins)."""
    path = path or default_path()

    def run(batches):
        vocab = vocabulary(path)
        for part in common.rows(batches):
            found = vocab.encode([x or "" for x in part.column(0).to_pylist()])
            ids = [np.frombuffer(x, dtype="<i4") for x, _ in found]
            offsets = [o.astype(np.int32) for _, o in found]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], _lists(ids), _lists(offsets)], names=[*keep, "ids", "piece_offsets"])

    kept = df.select(F.col(text_col).alias("_text"), *keep)
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return common.map_arrow(kept, run, f"{schema}, ids array<int>, piece_offsets array<int>")


def decode(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns in keep and decoded (binary), from the column ids. Null ids decode to no bytes."""
    path = path or default_path()

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.binary())], names=[*keep, "decoded"])

    kept = df.select("ids", *keep)
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return common.map_arrow(kept, run, f"{schema}, decoded binary")


def digest(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Encode, decode the ids again, and return counts and digests of both, without shipping the arrays."""
    path = path or default_path()

    def run(batches):
        vocab = vocabulary(path)
        for part in common.rows(batches):
            n, ids_hex, text_hex = [], [], []
            for ids, _ in vocab.encode([x or "" for x in part.column(0).to_pylist()]):
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = df.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"))
    return common.map_arrow(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    assert sys.byteorder == "little"
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), pa.int32()))
