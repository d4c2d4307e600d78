"""Byte-level BPE encoding and decoding on padded numpy matrices.

Pieces of similar length fill one matrix of token ids. In every round each row
merges its leftmost pair of lowest rank; only the two neighbouring ranks are
looked up again, in an open-addressed hash table of pairs, and finished rows
leave the matrix. Pieces too long for a matrix follow the same merge order with
a heap.

Null and empty texts encode to no ids. Texts may be of any length: a batch holds
whole texts, and memory follows the longest one. Repeated rows give repeated
results; extra columns are not carried.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, map_batches

#: Bytes of the longest piece that goes through a matrix.
MATRIX_BYTES = 256
#: Distinct pieces a worker remembers before it forgets them all.
MEMORY_PIECES = 200_000
#: Ranks are kept times POSITIONS; a matrix position is added below.
POSITIONS = 512
NO_RANK = np.int32(1 << 30)


class PairTable:
    """(left id, right id) -> (rank, merged id), linear probing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NO_RANK, np.int32)
        self.merged = np.full(1 << bits, -1, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots, rest = self._home(keys), np.arange(len(keys))
        while rest.size:
            at = slots[rest]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[rest[free]]
            placed = self.keys[at] == keys[rest]
            self.rank[at[placed]], self.merged[at[placed]] = rank[rest[placed]], merged[rest[placed]]
            rest = rest[~placed]
            slots[rest] = (slots[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def plain(self) -> dict[int, tuple[int, int]]:
        """packed pair -> (rank, merged id), for one pair at a time."""
        used = np.flatnonzero(self.keys != -1)
        return dict(zip(self.keys[used].tolist(), zip(self.rank[used].tolist(), self.merged[used].tolist())))

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slots of pairs; an empty slot (rank NO_RANK) where there is no such pair."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        slots = self._home(keys)
        found = self.keys[slots]
        missed = np.flatnonzero((found != keys) & (found != -1))
        while missed.size:
            slots[missed] = (slots[missed] + 1) & self.mask
            found = self.keys[slots[missed]]
            missed = missed[(found != keys[missed]) & (found != -1)]
        return slots


class Bpe:
    """A byte-level vocabulary: token bytes by id, byte ids, and ranked pairs."""

    def __init__(self, tokens: dict[int, bytes], pairs: list[tuple[int, int, int, int]], whole_first: bool):
        self.tokens = tokens
        ids = {t: i for i, t in tokens.items()}
        self.byte_ids = np.array([ids.get(bytes([b]), -1) for b in range(256)], np.int32)
        columns = np.array(pairs, np.int64).reshape(-1, 4).T
        self.pairs = PairTable(columns[0], columns[1], (columns[2] * POSITIONS).astype(np.int32), columns[3].astype(np.int32))
        self.whole = ids if whole_first else {}
        self.plain: dict[int, tuple[int, int]] | None = None

    @classmethod
    def from_rank_lines(cls, data: bytes) -> Bpe:
        """Lines of base64 token and rank. A pair's rank is that of its joined bytes; a piece that is a token stays whole."""
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        pairs = [(ranks[t[:k]], ranks[t[k:]], r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        return cls({r: t for t, r in ranks.items()}, pairs, True)

    @classmethod
    def from_merges(cls, vocab: dict[str, int], merges: Iterable) -> Bpe:
        """A printable vocabulary with an ordered list of merges; pieces are always merged from bytes."""
        shown = {c: b for b, c in enumerate(printable_bytes())}
        tokens = {i: bytes(shown[c] for c in t) for t, i in vocab.items() if all(c in shown for c in t)}
        split = (m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges)
        pairs = [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(split)]
        return cls(tokens, pairs, False)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece, packed as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if piece in self.whole:
                out[k] = self.whole[piece].to_bytes(4, "little")
            elif len(piece) > MATRIX_BYTES:
                out[k] = self._merge_long(piece).astype("<u4").tobytes()
            else:
                buckets.setdefault(max(2, len(piece) if len(piece) < 16 else (len(piece) + 7) & ~7), []).append(k)
        for width, rows in buckets.items():
            step = max(1, (1 << 18) // width)
            for at in range(0, len(rows), step):
                self._merge_bucket(pieces, rows[at : at + step], width, out)
        return out

    def _merge_bucket(self, pieces: list[bytes], rows: list[int], width: int, out: list) -> None:
        """One matrix, a piece in each column; ranks are shifted so that a position fits below them."""
        pairs, order = self.pairs, np.array(rows)
        n = np.array([len(pieces[k]) for k in rows], np.int32)
        raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in rows), np.uint8).reshape(len(rows), width).T
        ids = np.where(np.arange(width, dtype=np.int32)[:, None] < n, self.byte_ids[raw], np.int32(-1))
        ranks = np.full((width, len(rows)), NO_RANK, np.int32)
        ranks[:-1] = pairs.rank[pairs.find(ids[:-1].ravel(), ids[1:].ravel())].reshape(width - 1, -1)
        while True:
            rows_at = np.arange(len(ids), dtype=np.int32)[:, None]
            best = (ranks + rows_at).min(axis=0)
            live = best < NO_RANK
            if not live.all():
                done = np.flatnonzero(~live)
                packed, stride = ids[:, done].T.astype("<u4").tobytes(), 4 * len(ids)
                for at, k, size in zip(range(0, len(packed), stride), order[done].tolist(), (4 * n[done]).tolist()):
                    out[k] = packed[at : at + size]
                keep = np.flatnonzero(live)
                if not keep.size:
                    return
                order, n, best = order[keep], n[keep], best[keep]
                width = int(n.max())
                ids, ranks, rows_at = ids[:width, keep], ranks[:width, keep], rows_at[:width]
            each, at = np.arange(len(order)), best & (POSITIONS - 1)
            merged = pairs.merged[pairs.find(ids[at, each], ids[at + 1, each])]
            moved = rows_at[:-1] > at
            ids = np.where(moved, ids[1:], ids[:-1])
            ids[at, each] = merged
            ranks = np.where(moved | (rows_at[:-1] == at), ranks[1:], ranks[:-1])
            n = n - 1
            ranks[at, each] = NO_RANK
            for shift in (0, 1):
                ok = np.flatnonzero((at >= shift) & (at - shift + 1 < n))
                where = at[ok] - shift
                ranks[where, ok] = pairs.rank[pairs.find(ids[where, ok], ids[where + 1, ok])]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same order over a linked list: the heap yields the lowest rank, leftmost first."""
        self.plain = self.plain or self.pairs.plain()
        find, ids = self.plain.get, self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found[0], k, a, b, found[1]) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (found := find(a << 32 | b))]
        heapq.heapify(heap)
        while heap:
            _, k, left, right, merged = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != left or nxt < 0 or ids[nxt] != right:
                continue
            ids[k], ids[nxt], after[k] = merged, -1, after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (found := find(ids[a] << 32 | ids[b])):
                    heapq.heappush(heap, (found[0], a, ids[a], ids[b], found[1]))
        return np.array([i for i in ids if i >= 0], np.int32)


def printable_bytes() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Encodes texts with one vocabulary, remembering the pieces it has merged."""

    def __init__(self, bpe: Bpe, pattern: str):
        self.bpe, self.pattern, self.seen = bpe, regex.compile(pattern), {}

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; new pieces of all texts are merged together."""
        split = [self.pattern.findall(text) for text in texts]
        needed = set().union(*split)
        if len(self.seen) > MEMORY_PIECES:
            self.seen = {}
        if new := [*(needed - self.seen.keys())]:
            merged = self.bpe.merge([p.encode() for p in new])
            self.seen.update(zip(new, merged))
        for pieces in split:
            yield b"".join(map(self.seen.__getitem__, pieces))


def read_file(df: DataFrame, path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids[, decoded]): ids packed as little-endian uint32, and the bytes they decode to.

    The vocabulary file is read on the driver and shipped once to each executor.
    """
    shipped = df.sparkSession.sparkContext.broadcast(read_file(df, ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Bpe.from_rank_lines(shipped.value), pattern)
            ids = [*encoder(batch.column(1).to_pylist())]
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([decode_ids(x, encoder.bpe.tokens) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    texts = keyed_text(df, id_col, text_col)
    return map_batches(texts, run, f"doc_id {texts.dtypes[0][1]}, ids binary" + ", decoded binary" * decoded)


def decode_ids(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes that packed ids stand for; null ids are empty. An id outside the vocabulary is an error."""
    shipped = df.sparkSession.sparkContext.broadcast(read_file(df, ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or Bpe.from_rank_lines(shipped.value).tokens
            texts = [decode_ids(x or b"", tokens) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    packed = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_batches(packed, run, f"doc_id {packed.dtypes[0][1]}, decoded binary")


def token_digests(encoded: DataFrame) -> DataFrame:
    """Token count and digests of encode(..., decoded=True)."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
