"""Benchmark decontamination by a prefix-filtered join over item-sized windows.

A window is n consecutive words of a benchmark item, or a whole shorter item.
Words are ordered by how rarely the documents use them; as a window must occur
whole, its prefix is its single rarest word. A document word that is some
window's prefix proposes the window at the position that lines the two up; the
proposal must fit between the document's first and last word (length and
position bounds), and then every word is compared. Words covered by a confirmed
window are hit.

Windows go to the documents in blocks of BLOCK_WINDOWS, so what is broadcast is
bounded however large the benchmark is; each block is one more pass and no
document is shuffled.

Null and empty texts and items have no words, no windows and no hits. Texts may
be of any length. Repeated items each count under their own id; all items
without an id count as one, a null that digests leave out. Repeated documents give repeated results; extra columns are not
carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed_text, map_batches
from .textkernel import ALPHANUMERIC, hash_words, steps

WINDOW_WORDS, BLOCK_WINDOWS = 10, 200_000
#: Bits of the filter that most document words fail at.
FILTER_BITS = 20


def item_windows(items: DataFrame, n: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item_ids): the distinct windows, as word hashes, with the items that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in steps(batch):
                words, offsets = hash_words(texts, ALPHANUMERIC)
                words = words.view(np.int64)
                rows = [
                    (ids[first + k], words[at : at + n].tolist() if at + n <= end else words[at:end].tolist())
                    for k, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
                    for at in range(start, max(start + (end > start), end - n + 1))
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["item_id", "window"])

    texts = keyed_text(items, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("string"))
    return map_batches(texts, run, "item_id string, window array<bigint>").groupBy("window").agg(
        F.concat(F.sort_array(F.collect_set("item_id")), F.when(F.count("item_id") < F.count("*"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))).alias("item_ids")
    )


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often documents use each word of a bounded, sorted vocabulary of hashes."""
    shipped = docs.sparkSession.sparkContext.broadcast(Lookup(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = shipped.value, np.zeros(len(shipped.value.keys), np.int64)
        for batch in batches:
            for _, texts in steps(batch, 0):
                words, _ = hash_words(texts, ALPHANUMERIC)
                _, found = lookup(words)
                total += np.bincount(found, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lookup.keys[used].view(np.int64)), pa.array(total[used])], ["word", "n"])

    counts = map_batches(keyed_text(docs, docs.columns[0]).select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}


class Lookup:
    """Positions of words among sorted hashes; a bit filter turns most words away."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[self.low(self.keys)] = True

    @staticmethod
    def low(words: np.ndarray) -> np.ndarray:
        return (words & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in words, positions in keys) of the words that are keys."""
        maybe = np.flatnonzero(self.bits[self.low(words)])
        if not len(self.keys) or not maybe.size:
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, words[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == words[maybe]
        return maybe[hit], at[hit]


class Block:
    """Windows of one block, indexed by their rarest word."""

    def __init__(self, windows: list[list[int]], items: list[list[str]], counts: dict[int, int]):
        self.items = items
        self.sizes = np.array([len(w) for w in windows], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.array([h for w in windows for h in w], np.int64).view(np.uint64)
        offset = np.array([min(range(len(w)), key=lambda k: (counts.get(w[k], 0), w[k], k)) for w in windows], np.int64)
        prefix = self.words[self.starts[:-1] + offset] if len(windows) else self.words
        order = np.argsort(prefix, kind="stable")
        self.lookup = Lookup(np.unique(prefix))
        self.window, self.offset = order, offset[order]
        self.first = np.searchsorted(prefix[order], self.lookup.keys)
        self.many = np.diff(np.concatenate([self.first, [len(order)]]))

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, size, window) of every occurrence, and the texts' word offsets."""
        words, offsets = hash_words(texts, ALPHANUMERIC)
        at, key = self.lookup(words)
        many = self.many[key]
        ends = np.cumsum(many)
        row = np.repeat(self.first[key], many) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
        window, start = self.window[row], np.repeat(at, many) - self.offset[row]
        text = np.searchsorted(offsets, np.repeat(at, many), side="right") - 1
        fits = (start >= offsets[text]) & (start + self.sizes[window] <= offsets[text + 1])
        window, start, text = window[fits], start[fits], text[fits]
        for k in range(int(self.sizes.max(initial=0))):
            inside = k < self.sizes[window]
            same = np.ones(len(window), bool)
            same[inside] = words[start[inside] + k] == self.words[self.starts[window[inside]] + k]
            window, start, text = window[same], start[same], text[same]
        return text, start - offsets[text], window, offsets


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def find_windows(docs: DataFrame, items: DataFrame, n: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hit_spans, item_ids): covered words of each document, as disjoint (start, until) word positions."""
    windows = item_windows(items, n)
    total = windows.count()
    blocks = max(1, -(-total // BLOCK_WINDOWS))
    if blocks > 1:
        windows = cut(windows)
    texts = keyed_text(docs, id_col, text_col)
    kind = texts.dtypes[0][1]
    rows = texts.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:bigint,until:bigint>>").alias("hit_spans"), F.array().cast("array<string>").alias("item_ids"))
    for b in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).collect() if blocks > 1 else windows.collect()
        listed = [list(r["window"]) for r in part]
        counts = word_counts(texts, np.array(sorted({h for w in listed for h in w}), np.int64).view(np.uint64))
        shipped = docs.sparkSession.sparkContext.broadcast(Block(listed, [list(r["item_ids"]) for r in part], counts))
        rows = map_batches(rows, search(shipped), f"doc_id {kind}, text string, n_words long, hit_spans array<struct<start:bigint,until:bigint>>, item_ids array<string>")
    return rows.drop("text")


def search(shipped):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shipped.value
        for batch in batches:
            old_spans, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for first, texts in steps(batch):
                text, start, window, offsets = block.hits(texts)
                spans = [[(s["start"], s["until"]) for s in x] for x in old_spans[first : first + len(texts)]]
                found = [{*x} for x in old_items[first : first + len(texts)]]
                for k, s, w in zip(text.tolist(), start.tolist(), window.tolist()):
                    spans[k].append((s, s + int(block.sizes[w])))
                    found[k].update(block.items[w])
                columns = [
                    batch.column(0).slice(first, len(texts)),
                    batch.column(1).slice(first, len(texts)),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([[{"start": s, "until": e} for s, e in merge_spans(x)] for x in spans], spans_type),
                    pa.array([sorted(x, key=lambda i: (i is None, i or "")) for x in found], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_words", "hit_spans", "item_ids"])

    return run


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    found = find_windows(docs, items, n)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s["until"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )
