"""Toxicity by class-conditional interpolated Kneser-Ney models of words and of letters.

Two models, of toxic and of ordinary labelled texts, give each text a
log-likelihood; their difference, normalised by length, is turned into a
probability by a logistic curve fitted on labelled texts that neither model
counted. There is one pair of models over words and one over the bytes of words,
so that a word never seen is judged by how it is spelled. In each, with D = DISCOUNT,

    P(v | u) = (max(n(u, v) - D, 0) + D kinds(u) P1(v)) / n(u),    P1(v) where u is new,
    P1(v)    = (max(left(v) - D, 0) + D kinds P0(v)) / all left,
    P0(v)    = (max(left of both(v) - D, 0) + D kinds of both / units) / all left of both.

n counts within the class, left(v) is the number of different u before v in the
class, and left of both the number of those that both classes show, so that P0 is
shared and a word of one class alone gets no more from it than a new word. Every
pair counts, and each line is a distribution.

Words are runs of ASCII letters, digits and characters outside ASCII, lower-cased;
u is the word before. Of a word's bytes, closed by an end, u is the CONTEXT bytes
before inside the word. Words and contexts live in hashed slots of fixed number;
the pairs are those of the sample. Learning reads at most
SAMPLE_DOCS labelled texts of each class, those with the smallest hashes of their
id; the held-out rows, languages, sources and ids are never inputs of a score.

Null and empty texts, and texts without words, get the curve's value for a
difference of zero. Without labelled rows of both classes every score is 0.
Repeated rows give repeated results; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_bucket, cut, give_back, keyed_text, map_batches
from .textkernel import ALPHANUMERIC, ASCII_LOWER, hash_words, mix, steps

#: The most labelled texts read of each class; one in CURVE_SHARE of them fits the curve, the rest the models.
SAMPLE_DOCS, CURVE_SHARE = 6000, 4
#: Slots of words, and as many of byte contexts after them; the bytes that a byte is told by; the end of a word.
SLOT_BITS, CONTEXT, END = 18, 7, 256
WORD_SLOTS = 1 << SLOT_BITS
#: Bytes of text worked on at once; a byte makes many numbers when it is told by those before it.
SPELLED_BYTES = 1 << 19
#: Pairs worked on at once by the driver.
STEP_PAIRS = 1 << 18
#: A word tells more from each of these differences of log-likelihoods on; past MOST it tells no more.
TELLING, MOST = (2.0, 4.0, 6.0), 12.0
#: Taken off every count of each order and given to the next.
DISCOUNT = 0.75
THRESHOLD = 0.7


@dataclass
class Model:
    """Logarithms by class (0 ordinary, 1 toxic): of seen pairs, of the weight of a context's back-off, and of units alone; and the curve's weights.

    Units are words, then bytes; contexts are words, then byte contexts.
    """

    keys: np.ndarray
    pair: np.ndarray
    backoff: np.ndarray
    single: np.ndarray
    curve: np.ndarray

    def gain(self, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log P(own | before) of the toxic class less that of the ordinary one."""
        logs = self.log_probability(before, own)
        return logs[1] - logs[0]

    def log_probability(self, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = self.backoff[:, before] + self.single[:, own]
        if len(self.keys):
            key = packed(before, own)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            seen = self.keys[at] == key
            out[:, seen] = self.pair[:, at[seen]]
        return out


def packed(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    return before << (SLOT_BITS + 1) | own


def slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot of the word before, slot of the word, hash of the word, offsets): slot 0 stands before a text's first word."""
    words, offsets = hash_words(texts, ALPHANUMERIC)
    own = (words & np.uint64(WORD_SLOTS - 1)).astype(np.int64)
    before = np.concatenate([[0], own[:-1]])[: len(own)]
    before[offsets[:-1][np.diff(offsets) > 0]] = 0
    return before, own, words, offsets


def spelled(texts: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context slot, unit, offsets) of the bytes and the end of the words at positions `which` of texts joined."""
    raw = ASCII_LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    edge = np.diff(ALPHANUMERIC[raw].view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1)[which], np.flatnonzero(edge == -1)[which]
    offsets = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
    unit = raw[np.repeat(starts, np.diff(offsets)) + place].astype(np.int64)
    unit[offsets[1:] - 1] = END
    context = np.zeros(len(unit), np.uint64)
    for k in range(1, CONTEXT + 1):
        context[k:] |= np.where(place[k:] >= k, unit[: max(0, len(unit) - k)] + 1, 0).astype(np.uint64) << np.uint64(9 * (k - 1))
    return (mix(context) & np.uint64(WORD_SLOTS - 1)).astype(np.int64) + WORD_SLOTS, unit + WORD_SLOTS, offsets


def count_pairs(labelled: DataFrame) -> DataFrame:
    """(pair, ordinary, toxic): in how many texts of (doc_id, text, toxic) a pair of words occurs, and in how many of their different words a byte after its context.

    A text counts once however often it repeats a line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(2).to_pylist(), np.int64)
            for first, texts in steps(batch, 1, SPELLED_BYTES):
                before, own, words, offsets = slots(texts)
                text = np.repeat(np.arange(len(texts)), np.diff(offsets))
                # A text's words, each once: the first of its hash within the text.
                order = np.lexsort((words, text))
                new = np.ones(len(words), bool)
                new[1:] = (np.diff(text[order]) != 0) | (words[order][1:] != words[order][:-1])
                which = order[new]
                context, unit, ends = spelled(texts, which)
                pairs = np.unique(text << (2 * SLOT_BITS + 2) | packed(before, own))
                shown = np.concatenate([pairs & ((1 << (2 * SLOT_BITS + 2)) - 1), packed(context, unit)])
                kind = toxic[first + np.concatenate([pairs >> (2 * SLOT_BITS + 2), np.repeat(text[which], np.diff(ends))])]
                keys, counts = np.unique(shown * 2 + kind, return_counts=True)
                columns = [keys // 2, np.where(keys & 1, 0, counts), np.where(keys & 1, counts, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["pair", "ordinary", "toxic"])

    counted = map_batches(labelled, run, "pair long, ordinary long, toxic long")
    return counted.groupBy("pair").agg(F.sum("ordinary").cast("int").alias("ordinary"), F.sum("toxic").cast("int").alias("toxic"))


def fit_models(labelled: DataFrame) -> Model:
    """All pairs of the sample come to the driver in order, 16 bytes each."""
    counts = cut(count_pairs(labelled)).orderBy("pair").toArrow()
    keys, n = counts["pair"].to_numpy(), np.empty((2, counts.num_rows), np.int32)
    for k, c in enumerate(("ordinary", "toxic")):
        n[k] = counts[c].to_numpy()
    del counts
    give_back()
    return kneser_ney(keys, n)


def kneser_ney(keys: np.ndarray, n: np.ndarray) -> Model:
    """The models of sorted packed pairs with their counts by class. Pairs are worked on STEP_PAIRS at a time."""
    size, words = 2 * WORD_SLOTS, np.arange(2 * WORD_SLOTS) < WORD_SLOTS
    units = np.where(words, WORD_SLOTS, END + 1)
    steps_of = [slice(at, at + STEP_PAIRS) for at in range(0, len(keys), STEP_PAIRS)]
    parts = lambda here: (keys[here] >> (SLOT_BITS + 1), keys[here] & (2 * WORD_SLOTS - 1))

    def lower(left: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Continuation counts, discounted and completed from the shorter order, for words and bytes apart."""
        out = shorter.copy()
        for part in (words, ~words):
            if total := left[part].sum():
                out[part] = (np.maximum(left[part] - DISCOUNT, 0) + DISCOUNT * (left[part] > 0).sum() * shorter[part]) / total
        return out

    totals, kinds, left, left_of_both = np.zeros((2, size)), np.zeros((2, size)), np.zeros((2, size)), np.zeros(size)
    for here in steps_of:
        before, own = parts(here)
        left_of_both += np.bincount(own[(n[:, here] > 0).all(axis=0)], minlength=size)
        for c in (0, 1):
            seen = n[c, here] > 0
            totals[c] += np.bincount(before, n[c, here], size)
            kinds[c] += np.bincount(before[seen], minlength=size)
            left[c] += np.bincount(own[seen], minlength=size)
    shared = lower(left_of_both, 1 / units)
    single, backoff, pair = np.zeros((2, size), np.float32), np.zeros((2, size), np.float32), np.zeros((2, len(keys)), np.float32)
    for c in (0, 1):
        alone = lower(left[c], shared)
        spare = np.where(totals[c] > 0, DISCOUNT * kinds[c] / np.maximum(totals[c], 1), 1.0)
        single[c], backoff[c] = np.log(alone), np.log(spare)
        for here in steps_of:
            before, own = parts(here)
            pair[c, here] = np.log(np.maximum(n[c, here] - DISCOUNT, 0) / np.maximum(totals[c][before], 1) + spare[before] * alone[own])
    return Model(keys, pair, backoff, single, np.zeros(FEATURES))


#: Columns of features().
FEATURES = 1 + 2 * (2 + len(TELLING))


def features(model: Model, texts: list[bytes]) -> np.ndarray:
    """A row for each text: 1; and of words, then of their spelling, the difference of log-likelihoods a word, that a root of words, and the log of what telling words add."""
    before, own, words, offsets = slots(texts)
    size = np.maximum(np.diff(offsets), 1)
    _, which, again = np.unique(words, return_index=True, return_inverse=True)
    context, unit, ends = spelled(texts, which)
    spelling = np.concatenate([[0], np.cumsum(model.gain(context, unit), dtype=np.float64)])
    columns = [np.ones(len(texts))]
    for gain in (model.gain(before, own), (spelling[ends[1:]] - spelling[ends[:-1]])[again]):
        gain = np.clip(gain, -MOST, MOST)
        difference, *many = (np.diff(np.concatenate([[0], np.cumsum(part, dtype=np.float64)])[offsets]) for part in (gain, *(np.maximum(gain - least, 0) for least in TELLING)))
        columns += [difference / size, difference / np.sqrt(size), *np.log1p(many)]
    return np.stack(columns, axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, lightly regularised."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, learn_from=None, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fit on docs (doc_id, text) with labels (doc_id, toxic); learn_from is a condition on the label rows."""
    own = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    own = (own.where(learn_from) if learn_from is not None else own).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    picked = [own.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample_docs) for c in (0, 1)]
    part = (F.shiftrightunsigned(order, 7) % CURVE_SHARE == 0).alias("for_curve")
    # At most 2 * sample_docs rows, so the broadcast is bounded.
    joined = keyed_text(docs).join(F.broadcast(picked[0].unionByName(picked[1]).select("doc_id", "toxic", part)), "doc_id")
    # Of equal texts with one label the first by that order is learned from, in whatever order rows come.
    first = F.row_number().over(Window.partitionBy("toxic", F.sha2(F.col("text").cast("binary"), 256)).orderBy(order, "doc_id"))
    sample = cut(joined.withColumn("place", first).where("place = 1").drop("place"))
    model = fit_models(sample.where("not for_curve").select("doc_id", "text", "toxic"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in steps(batch, 1, SPELLED_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(list(features(shipped.value, texts))), batch.column(2).slice(first, len(texts)).cast(pa.int32())], ["x", "toxic"])

    seen = map_batches(sample.where("for_curve").select("doc_id", "text", "toxic"), run, "x array<double>, toxic int").toPandas()
    y = seen["toxic"].to_numpy(np.float64)
    if 0 < y.sum() < len(y):
        share = sizes[1] / (sizes[0] + sizes[1])
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        model.curve = fit_curve(np.stack(seen["x"]), y, weight)
    else:
        model.curve = np.array([0.0, 1.0, 1.0] + [0.0] * (FEATURES - 3))
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted): the probability that a text is toxic, and whether it reaches THRESHOLD."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for first, texts in steps(batch, 1, SPELLED_BYTES):
                p = 1 / (1 + np.exp(-np.clip(features(model, texts) @ model.curve, -30, 30))) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(p)], ["doc_id", "score"])

    texts = keyed_text(docs, id_col, text_col)
    scored = map_batches(texts, run, f"doc_id {texts.dtypes[0][1]}, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def not_held_out(id_col: str = "doc_id"):
    return crc_bucket(id_col, 3) != 1
