"""Near-duplicate content: shingle similarity of every published text with every other of its workspace."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.tables import few_at_once, give_back, shared_table, spread

SHINGLE, LEAST_WORDS, THRESHOLD_PERCENT = 3, 40, 30
#: A shingle of more classes than this is common.
OFTEN = 64
#: Runs in a block of classes; two blocks are what a task holds.
BLOCK = 1 << 21
#: Runs that a task looks at together for those that one class has.
BUCKET = 1 << 21
#: A run of more than one in so many classes of a block is counted by rows of bytes, not by lists.
WIDE = 32
#: Tasks that cells are dealt over at most.
MOST_TASKS = 4000
#: Accents that folding takes off.
ACCENTS = re.compile("[\u0300-\u036f]+")


@F.pandas_udf(StringType())
def extract_text(documents: pd.Series) -> pd.Series:
    """The strings of a JSON document, object keys in order, within the bounds of depth, nodes and characters."""

    def one(text):
        try:
            root = json.loads(text)
        except (TypeError, ValueError):
            return None
        out, stack, nodes = [], [(root, 0)], 0
        while stack and nodes < 10_000:
            x, depth = stack.pop()
            nodes += 1
            if isinstance(x, str):
                out.append(x)
            elif depth < 32 and isinstance(x, dict):
                stack += [(x[k], depth + 1) for k in sorted(x, reverse=True)]
            elif depth < 32 and isinstance(x, list):
                stack += [(v, depth + 1) for v in reversed(x)]
        return " ".join(out)[:200_000]

    return documents.map(one, na_action=None)


@F.pandas_udf(StringType())
def fold_text(texts: pd.Series) -> pd.Series:
    """Compatibility forms without combining accents, lower-cased."""

    def one(text):
        return text.lower() if text.isascii() else unicodedata.normalize("NFKC", ACCENTS.sub("", unicodedata.normalize("NFKD", text))).lower()

    return texts.map(one, na_action="ignore")


def spaced_words(text: Column, fold: bool = True) -> Column:
    """The words of a text with a blank between them, and perhaps before and after them."""
    return F.regexp_replace(fold_text(text) if fold else F.lower(text), r"[^\p{L}\p{N}]+", " ")


def to_words(text: Column, fold: bool = True) -> Column:
    """The words of a text: runs of letters and digits."""
    return F.filter(F.split(spaced_words(text, fold), " "), lambda w: w != "")


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """The set of runs of n words; fewer words are one run, none are the empty set."""
    many = F.size(words)
    # Shifted copies are zipped, so that no lambda evaluates the words again for every element.
    runs = words
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(words, F.lit(k + 1), F.greatest(many - k, F.lit(0))), lambda run, word: F.concat(run, F.lit(" "), word))
    whole = F.array_distinct(F.filter(runs, lambda run: run.isNotNull()))
    return F.when(many == 0, F.array().cast("array<string>")).when(many < n, F.array(F.array_join(words, " "))).otherwise(whole)


def comparable(outputs: DataFrame, fold: bool = True) -> DataFrame:
    """T4: (workspace_id, id, n_words, shingles) of published texts long enough to compare."""
    texts = spread(outputs.where("published").select("workspace_id", "id", "text"))
    worded = texts.select("workspace_id", "id", to_words(F.coalesce("text", F.lit("")), fold).alias("words"))
    return worded.where(F.size("words") >= LEAST_WORDS).select("workspace_id", "id", F.size("words").alias("n_words"), shingles(F.col("words")).alias("shingles"))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits mixed so that every bit hangs on all others; no two become one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_runs(texts: pa.Array, seeds: np.ndarray, least: int = LEAST_WORDS) -> list[np.ndarray | None]:
    """The shingle set of each text of spaced words, as sorted hashes that hold the seed; None for fewer than `least` words."""
    lists = pc.split_pattern(texts, " ")
    said = lists.flatten()
    real = pc.not_equal(said, "")
    ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy()]
    coded = said.filter(real).dictionary_encode()
    words = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)[coded.indices.to_numpy()]
    if len(words) < SHINGLE:
        return [None] * len(texts)
    runs = np.repeat(seeds.view(np.uint64), np.diff(ends))[: len(words) - SHINGLE + 1]
    for k in range(SHINGLE):
        runs = mixed(runs + words[k : len(words) - SHINGLE + 1 + k])
    sets = [np.sort(runs[a : b - SHINGLE + 1].view(np.int64)) if b - a >= max(least, SHINGLE) else None for a, b in zip(ends, ends[1:])]
    return [x if x is None else x[np.diff(x, prepend=~x[0]) != 0] for x in sets]


def hashed_texts(outputs: DataFrame, fold: bool = True) -> DataFrame:
    """(workspace_id, id, set_key, runs): comparable's texts with their shingles as hashes that hold the workspace, and a digest of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sets = hash_runs(part["text"], part["seed"].to_numpy())
                long = [k for k, runs in enumerate(sets) if runs is not None]
                if long:
                    keys = pa.array([hashlib.sha256(sets[k]).hexdigest() for k in long], pa.string())
                    runs = lists_of(np.concatenate([sets[k] for k in long]), np.cumsum([0, *(len(sets[k]) for k in long[:-1])]))
                    yield pa.RecordBatch.from_arrays([part["workspace_id"].take(pa.array(long)), part["id"].take(pa.array(long)), keys, runs], names=["workspace_id", "id", "set_key", "runs"])
        give_back()

    few_at_once(outputs.sparkSession)
    texts = spread(outputs.where("published").select("workspace_id", "id", "text"))
    spaced = texts.select("workspace_id", "id", F.xxhash64("workspace_id").alias("seed"), spaced_words(F.coalesce("text", F.lit("")), fold).alias("text"))
    kinds = [outputs.schema[c].dataType.simpleString() for c in ("workspace_id", "id")]
    return spaced.mapInArrow(run, f"workspace_id {kinds[0]}, id {kinds[1]}, set_key string, runs array<long>")


def text_classes(sets: DataFrame) -> DataFrame:
    """sets with class_id: the smallest id of the workspace with the same shingle set."""
    keyed = sets.withColumn("set_key", F.sha2(F.array_join(F.array_sort("shingles"), "\n").cast("binary"), 256))
    first = keyed.groupBy("workspace_id", "set_key").agg(F.min("id").alias("class_id"))
    return keyed.join(first, ["workspace_id", "set_key"]).drop("set_key")


def shared_parts(sets: DataFrame, often: int = OFTEN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What classes of equal sets share, without pairing those that share but common shingles.

    (docs (workspace_id, id, n, pattern, common), rare (workspace_id, a, b, rare), patterns (workspace_id, p, q, both)):

    - rare: of every two classes, how many shingles they share that at most `often` classes of the workspace have. The
      classes of such a shingle are a short list, so their pairs grow with the text, never with the square of a group.
    - common shingles are not paired by class. Those that stand in the same classes (the runs of one shared line) are
      one mark of their weight; the marks of a class are its pattern, `common` their weight; patterns: what any two
      share. Classes have few patterns where lines are shared.

    So two classes share rare + both shingles, and classes that share no rare one are told by their patterns and sizes.
    """
    reps = text_classes(sets).where("id = class_id").select("workspace_id", "id", F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(s))).alias("shingles"))
    reps = shared_table(reps)
    each = reps.select("workspace_id", "id", F.explode("shingles").alias("shingle"))
    seen = each.groupBy("workspace_id", "shingle").agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")).where("many > 1")
    counted = shared_table(each.join(seen, ["workspace_id", "shingle"]))
    lists = counted.where(F.col("many") <= often).groupBy("workspace_id", "shingle").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    firsts = lists.select("workspace_id", "ids", F.posexplode("ids").alias("place", "a"))
    rare = firsts.select("workspace_id", "a", F.explode(F.slice("ids", F.col("place") + 2, F.greatest(F.size("ids") - F.col("place") - 1, F.lit(0)))).alias("b")).groupBy("workspace_id", "a", "b").agg(F.count("*").alias("rare"))
    common = counted.where(F.col("many") > often)
    # Shingles of the same classes have the same counts and sums of hashes.
    alike = ["workspace_id", "many", "x", "y"]
    marks = common.select("workspace_id", "shingle", "many", "x", "y").distinct().groupBy(*alike).agg(F.min("shingle").alias("shingle"), F.count("*").alias("weight")).select("workspace_id", "shingle", "weight")
    marked = common.join(marks, ["workspace_id", "shingle"]).groupBy("workspace_id", "id").agg(F.array_sort(F.collect_list(F.struct("shingle", "weight"))).alias("marks"))
    patterned = marked.select("workspace_id", "id", "marks", F.sha2(F.to_json("marks"), 256).alias("pattern"), F.aggregate("marks.weight", F.lit(0).cast("long"), lambda total, w: total + w).alias("common"))
    patterned = shared_table(patterned)
    docs = reps.select("workspace_id", "id", F.size("shingles").alias("n")).join(patterned.drop("marks"), ["workspace_id", "id"], "left").na.fill(0, ["common"])
    of = patterned.groupBy("workspace_id", "pattern").agg(F.first("marks").alias("marks")).select("workspace_id", "pattern", F.explode("marks").alias("mark")).select("workspace_id", "pattern", "mark.*")
    other = of.select("workspace_id", "shingle", F.col("pattern").alias("q"))
    patterns = of.withColumnRenamed("pattern", "p").join(other, ["workspace_id", "shingle"]).groupBy("workspace_id", "p", "q").agg(F.sum("weight").alias("both"))
    return shared_table(docs), shared_table(rare), shared_table(patterns)


def rare_similarities(docs: DataFrame, rare: DataFrame, patterns: DataFrame) -> DataFrame:
    """(workspace_id, a, b, both, either) of the classes that share a rare shingle."""
    side = lambda own, size, pattern: docs.select("workspace_id", F.col("id").alias(own), F.col("n").alias(size), F.col("pattern").alias(pattern))
    placed = rare.join(side("a", "n", "p"), ["workspace_id", "a"]).join(side("b", "m", "q"), ["workspace_id", "b"]).join(patterns, ["workspace_id", "p", "q"], "left")
    both = F.col("rare") + F.coalesce("both", F.lit(0))
    return placed.select("workspace_id", "a", "b", both.alias("both"), (F.col("n") + F.col("m") - both).alias("either"))


def pairs_from(docs: DataFrame, patterns: DataFrame, close: DataFrame, percent: int) -> DataFrame:
    """T5's pairs, from shared_parts and rare_similarities."""
    enough = 100 * F.col("both") >= percent * F.col("either")
    # Without a rare shingle in common, what they share must be a part of either.
    part = docs.where((F.col("common") > 0) & (100 * F.col("common") >= percent * F.col("n")))
    left, right = part.select("workspace_id", F.col("id").alias("a"), F.col("n"), F.col("pattern").alias("p")), part.select("workspace_id", F.col("id").alias("b"), F.col("n").alias("m"), F.col("pattern").alias("q"))
    met = left.join(patterns, ["workspace_id", "p"]).where(100 * F.col("both") >= percent * F.col("n")).join(right, ["workspace_id", "q"])
    told = met.where("a < b").select("workspace_id", "a", "b", "both", (F.col("n") + F.col("m") - F.col("both")).alias("either")).where(enough).join(close.select("workspace_id", "a", "b"), ["workspace_id", "a", "b"], "left_anti")
    return close.where(enough).unionByName(told).select("workspace_id", "a", "b", F.round(F.col("both") / F.col("either"), 6).alias("similarity"))


def hashed_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes (workspace_id, id, class_id), reps (workspace_id, id, n, runs)): classes as in text_classes, and each class's shingles as hashes that hold the workspace.

    sets are comparable's or, which takes a tenth of the time, hashed_texts'.
    """
    if "runs" not in sets.columns:
        hashed = F.array_distinct(F.transform("shingles", lambda s: F.xxhash64("workspace_id", s)))
        sets = sets.select("workspace_id", "id", F.sha2(F.array_join(F.array_sort("shingles"), "\n").cast("binary"), 256).alias("set_key"), hashed.alias("runs"))
    keyed = shared_table(sets.withColumn("n", F.size("runs")))
    first = keyed.groupBy("workspace_id", "set_key").agg(F.min("id").alias("class_id"))
    classes = shared_table(keyed.select("workspace_id", "id", "set_key").join(first, ["workspace_id", "set_key"]).drop("set_key"))
    # Written first, so that few copies are sent to where the runs are, and not the runs to them.
    copies = shared_table(classes.where("id <> class_id").select("workspace_id", "id"))
    return classes, keyed.join(copies, ["workspace_id", "id"], "left_anti").select("workspace_id", "id", "n", "runs")


def shared_runs(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(workspace_id, id, n, runs) of docs, a row or several each, with numbers of the runs that more than one of them has.

    Runs are dealt by the range of their hash over buckets of about `bucket`, what a document has of one in a row. A bucket is read in one sort.
    """
    buckets = max(1, -(-(docs.agg(F.sum("n")).first()[0] or 0) // bucket))
    kinds = [docs.schema[c].dataType.simpleString() for c in ("workspace_id", "id")]
    schema = f"workspace_id {kinds[0]}, id {kinds[1]}, n int, runs array<long>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                rows, runs = listed(part["runs"])
                places = rows * buckets + ((runs.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(places, kind="stable")
                begins = np.flatnonzero(np.diff(places[order], prepend=-1))
                if len(begins):
                    first = order[begins]
                    own = part.select(["workspace_id", "id", "n"]).take(pa.array(rows[first]))
                    numbers = pa.array((places[first] % buckets).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([numbers, *own.columns, lists_of(runs[order], begins)], names=["bucket", "workspace_id", "id", "n", "runs"])
        give_back()

    def keep(dealt: pa.Table) -> pa.Table:
        rows, runs = listed(dealt["runs"].combine_chunks())
        order = np.argsort(runs)
        same = runs[order[1:]] == runs[order[:-1]]
        shared, numbers = np.zeros(len(runs), bool), np.empty(len(runs), np.int64)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        # Shared runs are numbered from 0 in each bucket, and no two buckets give the same numbers.
        starts = np.diff(runs[order], prepend=~runs[order[:1]]) != 0
        numbers[order] = (np.cumsum(starts & shared[order]) - 1) * buckets + dealt["bucket"][0].as_py()
        rows, numbers = rows[shared], numbers[shared]
        begins = np.flatnonzero(np.diff(rows, prepend=-1))
        give_back()
        return dealt.select(["workspace_id", "id", "n"]).take(pa.array(rows[begins])).append_column("runs", lists_of(numbers, begins))

    few_at_once(docs.sparkSession)
    dealt = docs.select("workspace_id", "id", "n", "runs").mapInArrow(deal, f"bucket int, {schema}")
    return dealt.repartition(min(2 * buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(keep, schema)


def listed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, elements) of lists."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)), lists.flatten().to_numpy()


def lists_of(elements: np.ndarray, begins: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(elements)).astype(np.int32)), pa.array(elements))


def overlaps(docs: DataFrame, percent: int, nearest: bool = False, block: int = BLOCK) -> DataFrame:
    """(workspace_id, a, b, both, either) of every two classes of docs (workspace_id, id, n, runs) at or above the threshold; with nearest also each class's most similar ones, at least one of every cell that has any.

    Runs that one class has are left out. The classes of a workspace are dealt over blocks of about `block` runs, and every two blocks
    are a cell, counted by a task of its own in memory. So no pair of classes is written that is not asked for: what
    is shuffled are the runs, once for each block, whatever number of classes a run is in.
    """
    kept = shared_runs(docs).groupBy("workspace_id", "id", "n").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    if not nearest:
        # Two classes share no more than all that this one shares, and together have no fewer than its own.
        kept = kept.where(100 * F.size("runs") >= percent * F.col("n"))
    kept = shared_table(kept)
    if (kept.agg(F.max(F.array_max("runs"))).first()[0] or 0) < 1 << 31:
        kept = kept.withColumn("runs", F.col("runs").cast("array<int>"))
    total = F.sum(F.size("runs"))
    blocks = kept.groupBy("workspace_id").agg(F.greatest(F.ceil(total / block), F.least(F.lit(3), F.ceil(total * 8 / block))).cast("int").alias("blocks"))
    placed = kept.join(blocks, "workspace_id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = placed.select("workspace_id", "id", "n", "runs", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other").cast("int"), F.greatest("own", "other").cast("int")
    cells = dealt.select("workspace_id", low.alias("low"), high.alias("high"), (F.col("own") == low).alias("left"), "id", "n", "runs")
    kinds = [docs.schema[c].dataType.simpleString() for c in ("workspace_id", "id")]

    def count(key: tuple, cell: pa.Table) -> pa.Table:
        found = cell_pairs(cell, key[1].as_py() == key[2].as_py(), percent, nearest)
        give_back()
        ids = cell["id"].combine_chunks()
        a, b = ids.take(pa.array(found[0])), ids.take(pa.array(found[1]))
        ordered = pc.less(a, b)
        columns = [pa.array([key[0].as_py()] * len(a), cell.schema.field("workspace_id").type), pc.if_else(ordered, a, b), pc.if_else(ordered, b, a), pa.array(found[2], pa.int64()), pa.array(found[3], pa.int64())]
        return pa.table(columns, names=["workspace_id", "a", "b", "both", "either"])

    # As many tasks as there are cells, so that Spark does not merge small shuffles of much work.
    tasks = blocks.agg(F.sum(F.expr("blocks * (blocks + 1) div 2"))).first()[0] or 1
    dealt = cells.repartition(min(2 * tasks, MOST_TASKS), "workspace_id", "low", "high")
    return dealt.groupBy("workspace_id", "low", "high").applyInArrow(count, f"workspace_id {kinds[0]}, a {kinds[1]}, b {kinds[1]}, both long, either long")


def cell_pairs(cell: pa.Table, diagonal: bool, percent: int, nearest: bool, most: int = 1 << 20) -> list[np.ndarray]:
    """Rows x and y of a cell, both and either of the pairs that overlaps asks for; most: posting entries gathered at once."""
    lists = cell["runs"].combine_chunks()
    sizes, n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), cell["n"].to_numpy().astype(np.int64)
    rows, runs = np.repeat(np.arange(len(n), dtype=np.int32), sizes), lists.flatten().dictionary_encode().indices.to_numpy()
    left = np.ones(len(n), bool) if diagonal else cell["left"].to_numpy(zero_copy_only=False)
    out = (nearest_pairs if nearest else close_pairs)(rows, runs, n, left, diagonal, percent, most)
    return [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out) if out else [()] * 4)]


def list_postings(rows: np.ndarray, runs: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows by run, how many a run has, where they end)."""
    many = np.bincount(runs, minlength=kinds)
    return rows[np.argsort(runs, kind="stable")], many, np.cumsum(many)


def gather(postings: tuple[np.ndarray, np.ndarray, np.ndarray], of: np.ndarray) -> np.ndarray:
    """The rows of the runs `of`, one run after the other."""
    rows, many, ends = postings
    width = many[of]
    return rows[np.repeat(ends[of] - np.cumsum(width), width) + np.arange(width.sum())]


def cuts(widths: np.ndarray, most: int) -> list[int]:
    """Where to cut widths so that each piece sums up to `most`, or is one."""
    reach, at = np.cumsum(widths), [0]
    if not len(widths) or reach[-1] <= most:
        return [0, len(widths)] if len(widths) else at
    while at[-1] < len(widths):
        before = reach[at[-1] - 1] if at[-1] else 0
        at.append(max(at[-1] + 1, int(np.searchsorted(reach, before + most, "right"))))
    return at


def close_pairs(rows: np.ndarray, runs: np.ndarray, n: np.ndarray, left: np.ndarray, diagonal: bool, percent: int, most: int) -> list[tuple]:
    """cell_pairs at or above the threshold.

    Such a pair shares a least number of runs, so with the runs of each row in one order, the rare ones first, two rows
    share one before the last `least` - 1 of either. Only these are looked up; what they and the rest could come to
    at most tells which pairs are counted in full.
    """
    least, kinds = -(-percent * n // 100), int(runs.max(initial=-1)) + 1
    while True:
        # Runs of one side only, and rows left with too few others, are nothing to any pair.
        of = left[rows]
        lefts, rights = np.bincount(runs[of], minlength=kinds), np.bincount(runs if diagonal else runs[~of], minlength=kinds)
        live = (rights > 1)[runs] if diagonal else ((lefts > 0) & (rights > 0))[runs]
        size = np.bincount(rows[live], minlength=len(n))
        live &= (size >= np.maximum(least, 1))[rows]
        if live.all():
            break
        rows, runs = rows[live], runs[live]
    if not len(rows):
        return []
    rank = np.empty(kinds, np.int32)
    rank[np.argsort(lefts + rights, kind="stable")] = np.arange(kinds)
    runs = rank[runs]
    order = np.lexsort((runs, rows))
    rows, runs = rows[order], runs[order]
    begins = np.cumsum(size) - size
    first = size - np.maximum(least, 1) + 1
    early = np.arange(len(rows)) - begins[rows] < first[rows]
    # What a row may share after its early runs, and the rank of the last of these.
    rest, last = size - first, np.where(size > 0, runs[np.minimum(begins + np.maximum(first, 1) - 1, len(runs) - 1)], -1)
    right = early if diagonal else early & ~left[rows]
    postings = list_postings(rows[right], runs[right], kinds)
    looked = np.flatnonzero(early & left[rows])
    looked = looked[postings[1][runs[looked]] > 0]
    out, kept, counts, marked = [], np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(kinds, bool)
    at = cuts(postings[1][runs[looked]], most)
    for begin, end in zip(at, at[1:]):
        part = looked[begin:end]
        met = np.repeat(rows[part].astype(np.int64), postings[1][runs[part]]) * len(n) + gather(postings, runs[part])
        # What the row cut in two had before is counted in.
        met, where = np.unique(np.concatenate([kept, met]), return_inverse=True)
        count = np.bincount(where, np.concatenate([counts, np.ones(len(where) - len(kept), np.int64)]), len(met)).astype(np.int64)
        x, y = met // len(n), met % len(n)
        open_row = x == (rows[looked[end]] if end < len(looked) else -1)
        kept, counts = met[open_row], count[open_row]
        could = count + np.where(last[x] < last[y], rest[x], np.where(last[x] > last[y], rest[y], np.minimum(rest[x], rest[y])))
        asked = ~open_row & ((100 + percent) * could >= percent * (n[x] + n[y]))
        if diagonal:
            asked &= y > x
        x, y = x[asked], y[asked]
        for k, to in zip(turns := np.flatnonzero(np.diff(x, prepend=-1)), [*turns[1:], len(x)]):
            own, others = x[k], y[k:to]
            for a in range(0, len(others), 1000):
                some = others[a : a + 1000]
                mine = runs[begins[own] : begins[own] + size[own]]
                marked[mine] = True
                places = np.repeat(begins[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
                both = np.add.reduceat(marked[runs[places]], np.cumsum(size[some]) - size[some], dtype=np.int64)
                marked[mine] = False
                either = n[own] + n[some] - both
                close = 100 * both >= percent * either
                out.append((np.full(int(close.sum()), own), some[close], both[close], either[close]))
    return out


def nearest_pairs(rows: np.ndarray, runs: np.ndarray, n: np.ndarray, left: np.ndarray, diagonal: bool, percent: int, most: int) -> list[tuple]:
    """cell_pairs at or above the threshold, and each row's most similar one: every left row is counted against all right ones.

    What a row shares of wide runs (lines that many have) is a sum of rows of bytes, and rows that have the same wide runs share that sum.
    """
    sizes, kinds = np.bincount(rows, minlength=len(n)), int(runs.max(initial=-1)) + 1
    begins = np.cumsum(sizes) - sizes
    lefts, rights = np.flatnonzero(left), np.arange(len(n)) if diagonal else np.flatnonzero(~left)
    of = np.ones(len(rows), bool) if diagonal else ~left[rows]
    places, whose = np.searchsorted(rights, rows[of]), runs[of]
    many = np.bincount(whose, minlength=kinds)
    wide = many * WIDE > len(rights)
    postings = list_postings(places[~wide[whose]], whose[~wide[whose]], kinds)
    number = np.cumsum(wide) - 1
    table = np.zeros((int(wide.sum()), len(rights)), np.uint8)
    table[number[whose[wide[whose]]], places[wide[whose]]] = 1
    # Rows of the same wide runs follow one another.
    pattern, of = np.zeros(len(n), np.uint64), wide[runs]
    np.add.at(pattern, rows[of], mixed(runs[of].astype(np.uint64)))
    sized, out = n[rights], []
    best, best_of = np.zeros(len(rights)), np.zeros((3, len(rights)), np.int64)
    before, common = None, None
    for x in lefts[np.argsort(pattern[lefts], kind="stable")]:
        mine = runs[begins[x] : begins[x] + sizes[x]]
        shown = np.sort(number[mine[wide[mine]]])
        if before is None or not np.array_equal(shown, before):
            # Sums of 255 bytes still fit a byte.
            before, common = shown, sum((table[shown[k : k + 255]].sum(axis=0, dtype=np.uint8).astype(np.int64) for k in range(0, len(shown), 255)), np.zeros(len(rights), np.int64))
        mine = mine[postings[1][mine] > 0]
        if not len(mine) and not len(shown):
            continue
        both, at = common, cuts(postings[1][mine], most)
        for begin, end in zip(at, at[1:]):
            both = both + np.bincount(gather(postings, mine[begin:end]), minlength=len(rights))
        if diagonal:
            both = both.copy() if both is common else both
            both[x] = 0
        either = n[x] + sized - both
        alike = both / either
        top = int(np.argmax(alike))
        if not both[top]:
            continue
        if 100 * both[top] >= percent * either[top]:
            asked = np.flatnonzero(100 * both >= percent * either)
            asked = asked[rights[asked] > x] if diagonal else asked
        else:
            asked = np.array([top])
        if not diagonal:
            better = np.flatnonzero(alike > best)
            best[better] = alike[better]
            best_of[0, better], best_of[1, better], best_of[2, better] = x, both[better], either[better]
        out.append((np.full(len(asked), x), rights[asked], both[asked], either[asked]))
    if not diagonal:
        # Those at or above the threshold are out already.
        some = (best > 0) & (100 * best_of[1] < percent * best_of[2])
        out.append((best_of[0][some], rights[some], best_of[1][some], best_of[2][some]))
    return out


def above(found: DataFrame, percent: int) -> DataFrame:
    """T5's pairs, from overlaps."""
    return found.where(100 * F.col("both") >= percent * F.col("either")).select("workspace_id", "a", "b", F.round(F.col("both") / F.col("either"), 6).alias("similarity"))


def similar_pairs(sets: DataFrame, percent: int = THRESHOLD_PERCENT, often: int = OFTEN) -> DataFrame:
    """T5: (workspace_id, a, b, similarity): pairs of classes of equal sets at or above the threshold; membership is in text_classes.

    Every pair is counted exactly (overlaps), whatever is common; often is of shared_parts and changes nothing here.
    """
    return above(overlaps(hashed_classes(sets)[1], percent), percent)


def highest_similarities(docs: DataFrame, patterns: DataFrame, close: DataFrame) -> DataFrame:
    """(workspace_id, id, near): the greatest similarity of each class to another one, exactly, 0 without any shared shingle.

    Of the classes of one pattern the smallest is the most similar to whatever shares but common shingles with them, so a
    class looks at patterns, not at classes; those with a rare shingle in common have their own count.
    """
    ends = close.select("workspace_id", F.explode(F.array("a", "b")).alias("id"), (F.col("both") / F.col("either")).alias("s"))
    exact = ends.groupBy("workspace_id", "id").agg(F.max("s").alias("exact"))
    place = F.row_number().over(Window.partitionBy("workspace_id", "pattern").orderBy("n", "id"))
    small = docs.where("pattern is not null").withColumn("place", place).where("place <= 2")
    own = small.groupBy("workspace_id", "pattern").agg(F.min(F.when(F.col("place") == 1, F.struct("n", "id"))).alias("least"), F.min(F.when(F.col("place") == 2, F.col("n"))).alias("next"))
    sizes = small.where("place = 1").select("workspace_id", F.col("pattern").alias("q"), F.col("n").alias("m"))
    # For what is shared with a pattern only its smallest size matters.
    offers = patterns.where("p <> q").join(sizes, ["workspace_id", "q"]).groupBy("workspace_id", "p", "both").agg(F.min("m").alias("m")).groupBy("workspace_id", F.col("p").alias("pattern")).agg(F.collect_list(F.struct("both", "m")).alias("offers"))
    known = docs.where("pattern is not null").join(own, ["workspace_id", "pattern"]).join(offers, ["workspace_id", "pattern"], "left")
    same = F.when(F.col("least.id") == F.col("id"), F.col("next")).otherwise(F.col("least.n"))
    best = F.array_max(F.transform("offers", lambda o: o["both"] / (F.col("n") + o["m"] - o["both"])))
    told = known.select("workspace_id", "id", F.greatest(best, F.col("common") / (F.col("n") + same - F.col("common"))).alias("told"))
    joined = docs.select("workspace_id", "id").join(exact, ["workspace_id", "id"], "left").join(told, ["workspace_id", "id"], "left")
    return joined.select("workspace_id", "id", F.round(F.coalesce(F.greatest("exact", "told"), F.lit(0.0)), 6).alias("near"))


def duplication_verdicts(outputs: DataFrame, percent: int = THRESHOLD_PERCENT, fold: bool = True, often: int = OFTEN, nearest: bool = True) -> DataFrame:
    """(id, verdict, highest, matches) of every published output against the others of its workspace.

    fail if any is similar from `percent` on; indeterminate if the output, or every other, is too short to compare;
    pass otherwise, also without any other. highest is the greatest similarity, match or not; without nearest, which
    costs a comparison of all that share anything, that of the matches. matches are (class_id,
    similarity), the most similar first: a class is all outputs of equal sets, its own with similarity 1 if it has
    others; text_classes has the members.
    """
    classes, reps = hashed_classes(hashed_texts(outputs, fold))
    sizes = classes.groupBy("workspace_id", "class_id").agg(F.count("*").alias("copies"))
    found = shared_table(overlaps(reps, percent, nearest))
    pairs = above(found, percent)
    of = lambda own, other: pairs.select("workspace_id", F.col(own).alias("class_id"), F.struct((-F.col("similarity")).alias("rank"), F.col(other).alias("class_id")).alias("near"))
    others = of("a", "b").unionByName(of("b", "a")).groupBy("workspace_id", "class_id").agg(F.array_sort(F.collect_list("near")).alias("others"))
    ends = found.select("workspace_id", F.explode(F.array("a", "b")).alias("class_id"), F.round(F.col("both") / F.col("either"), 6).alias("s"))
    near = ends.groupBy("workspace_id", "class_id").agg(F.max("s").alias("near"))
    known = classes.join(sizes, ["workspace_id", "class_id"]).join(near, ["workspace_id", "class_id"], "left").join(others, ["workspace_id", "class_id"], "left")
    own = F.when(F.col("copies") > 1, F.array(F.struct(F.lit(-1.0).alias("rank"), "class_id"))).otherwise(F.array())
    matches = F.transform(F.concat(own, F.coalesce("others", F.array())), lambda m: F.struct(m["class_id"].alias("class_id"), (-m["rank"]).alias("similarity")))
    judged = known.select("workspace_id", "id", F.when(F.col("copies") > 1, 1.0).otherwise(F.coalesce("near", F.lit(0.0))).alias("highest"), matches.alias("matches"))
    published = outputs.where("published").select("workspace_id", "id")
    counts = published.groupBy("workspace_id").agg(F.count("*").alias("published")).join(classes.groupBy("workspace_id").agg(F.count("*").alias("long")), "workspace_id", "left")
    rows = published.join(judged, ["workspace_id", "id"], "left").join(counts, "workspace_id")
    verdict = F.when(F.col("matches").isNull(), "indeterminate").when(F.size("matches") > 0, "fail").when((F.col("published") > 1) & (F.col("long") < 2), "indeterminate").otherwise("pass")
    return rows.select("id", verdict.alias("verdict"), F.coalesce("highest", F.lit(0.0)).alias("highest"), F.coalesce("matches", F.array()).alias("matches"))


def guardrail_report(verdicts: DataFrame, truncated: bool = False) -> DataFrame:
    """The worst verdict of all; a truncated corpus turns pass into indeterminate."""
    rank = F.max(F.when(F.col("verdict") == "fail", 2).when(F.col("verdict") == "indeterminate", 1).otherwise(0))
    least = F.greatest(rank, F.lit(1 if truncated else 0))
    return verdicts.agg(F.element_at(F.array(F.lit("pass"), F.lit("indeterminate"), F.lit("fail")), least + 1).alias("verdict"), F.count("*").alias("checked"))
