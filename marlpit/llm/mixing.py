"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every source gets a target of words. A document of a source is taken
target / source size times in the mean: some whole copies and, with the fraction
that is left as its probability, one more. The fractions are rounded in pairs: of
two documents one gives words of probability to the other, which of them by a
draw that keeps both means, until one fraction is 0 or 1; the other goes on. So
the words taken in a source stay at the target but for one document's. Pairs meet
in a reduction tree: a bucket of about FAN documents leaves one fraction, the
buckets of a source are the next level's documents, until one is left, which a
last draw rounds.

Sizes are counts of words, `[^\\x20\\x09-\\x0D]+`. Sources in the order of their
code points, null last, weigh WEIGHTS in turn and share all words; a target stops
at MOST_TIMES its source's size, and the excess is shared anew by weight until
none is above. Draws come from hashes of the seed and the documents, so reruns
agree, however rows are dealt.

Null texts and texts without words have size 0 and are taken 0 times. Null and
empty sources are sources of their own. Rows that agree in doc_id, source and
size are alike: all their fractions together are some whole copies and one
fraction, so they are one document of the tree, however many they are; which of
them is taken more often can't be told. Extra columns are left behind; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ranked
from .common import cut

#: Weights of the sources in turn; what a target may be of its source's size.
WEIGHTS, MOST_TIMES = (1, 2, 3), 3
#: Documents of a bucket, in the mean, and rows of a class that are written out at a time.
FAN, CHUNK = 48, 4096
#: Sources up to this many are broadcast.
BROADCAST_SOURCES = 100_000


def words_in(text: Column) -> Column:
    """How many words a text has; no list of them is made."""
    trimmed = F.rtrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.length(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "w")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size), one row a source.

    The share of a weight is what the sources below their limit have to divide; it only grows, and more sources reach their limit, until none is above.
    """
    place = ranked(sizes, [], [F.col("source").isNull().asc(), F.col("source").asc()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS)).cast("int") + 1)
    weighed = cut(place.select("source", "source_size", weight.cast("long").alias("weight")))
    limit, share, last = F.col("source_size") * MOST_TIMES, 0.0, None
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while share != last:
        full = F.lit(False) if last is None else F.col("weight") * F.lit(share) >= limit
        # Sums of whole numbers, the same in any order.
        weights, spent = weighed.agg(F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.coalesce(F.sum(F.when(full, limit)), F.lit(0))).first()
        last, share = share, (total - spent) / weights if weights else share
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(share), limit.cast("double")).alias("target"))


def uniform(seed: int, *of: Column) -> Column:
    """A number in [0, 1) drawn from the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) * F.lit(2.0**-53)


def duel(a: Column, b: Column, seed: int) -> tuple[Column, Column, Column]:
    """(whether b goes on, the fraction left, whether the other is taken) of two documents (key, words, p) with 0 < p < 1.

    Words of probability go from one to the other until one of them is 0 or 1; the directions are drawn so that both means stay.
    """
    wa, wb = a["words"], b["words"]
    up = F.least((F.lit(1.0) - a["p"]) * wa, b["p"] * wb)  # what a can get
    down = F.least(a["p"] * wa, (F.lit(1.0) - b["p"]) * wb)
    a_gains = uniform(seed, a["key"], b["key"], a["p"]) * (up + down) < down
    # Whichever bound was the least is met exactly, whatever rounding says.
    a_full = a_gains & ((F.lit(1.0) - a["p"]) * wa <= b["p"] * wb)
    a_empty = ~a_gains & (a["p"] * wa <= (F.lit(1.0) - b["p"]) * wb)
    a_left = F.when(a_gains, a["p"] + b["p"] * wb / wa).otherwise(a["p"] - (F.lit(1.0) - b["p"]) * wb / wa)
    b_left = F.when(a_gains, b["p"] - (F.lit(1.0) - a["p"]) * wa / wb).otherwise(b["p"] + a["p"] * wa / wb)
    settled = a_full | a_empty
    left = F.when(settled, b_left).otherwise(a_left)
    return settled, F.least(F.lit(1.0), F.greatest(F.lit(0.0), left)), F.when(settled, a_full).otherwise(~a_gains)


DOCUMENT = "struct<key:string,words:double,p:double>"


def round_bucket(members: Column, seed: int) -> Column:
    """(left, done): the fraction that is left of a bucket's documents, and (key, taken) of all others."""
    start = F.struct(F.lit(None).cast(DOCUMENT).alias("left"), F.array().cast("array<struct<key:string,taken:boolean>>").alias("done"))

    def meet(state: Column, b: Column) -> Column:
        a = state["left"]
        settled, p, taken = duel(a, b, seed)
        goes_on = F.struct(F.when(settled, b["key"]).otherwise(a["key"]).alias("key"), F.when(settled, b["words"]).otherwise(a["words"]).alias("words"), p.alias("p"))
        loser = F.struct(F.when(settled, a["key"]).otherwise(b["key"]).alias("key"), taken.alias("taken"))
        whole = (b["p"] <= 0.0) | (b["p"] >= 1.0)
        over = F.struct(b["key"].alias("key"), (b["p"] >= 1.0).alias("taken"))
        a_whole = (a["p"] <= 0.0) | (a["p"] >= 1.0)
        a_over = F.struct(a["key"].alias("key"), (a["p"] >= 1.0).alias("taken"))
        return (
            F.when(whole, F.struct(a.alias("left"), F.array_append(state["done"], over).alias("done")))
            .when(a.isNull(), F.struct(b.cast(DOCUMENT).alias("left"), state["done"].alias("done")))
            .when(a_whole, F.struct(b.cast(DOCUMENT).alias("left"), F.array_append(state["done"], a_over).alias("done")))
            .otherwise(F.struct(goes_on.cast(DOCUMENT).alias("left"), F.array_append(state["done"], loser).alias("done")))
        )

    return F.aggregate(members, start, meet)


def rounded(documents: DataFrame, seed: int) -> DataFrame:
    """(source, key, taken) of documents (source, key, words, p): every fraction rounded, the words of each source kept but for one document's."""
    level, decided = cut(documents.where("p > 0 and p < 1 and words > 0")), []
    while not level.isEmpty():
        sizes = level.groupBy("source").agg(F.count("*").alias("n")).withColumn("buckets", F.ceil(F.col("n") / FAN)).select(F.col("source").alias("of"), "buckets")
        # Bucket sizes vary about FAN; a bucket of a source with one is that source's root.
        many = sizes.count()
        dealt = level.join(F.broadcast(sizes) if many <= BROADCAST_SOURCES else sizes, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit(len(decided)), "key"), F.col("buckets"))
        grouped = dealt.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.first("buckets").alias("buckets"), F.array_sort(F.collect_list(F.struct("key", "words", "p"))).alias("members"))
        met = cut(grouped.select("source", "buckets", round_bucket(F.col("members"), seed + len(decided)).alias("out")))
        decided.append(met.select("source", F.explode("out.done").alias("d")).select("source", "d.key", "d.taken"))
        left = met.where("out.left is not null").select("source", "buckets", "out.left.*")
        whole = (F.col("buckets") == 1) | (F.col("p") <= 0) | (F.col("p") >= 1)
        decided.append(left.where(whole).select("source", "key", (uniform(seed, F.col("key"), F.lit("last")) < F.col("p")).alias("taken")))
        level = left.where(~whole).select("source", "key", "words", "p")
    out = decided[0] if decided else documents.select("source", "key", F.lit(False).alias("taken")).limit(0)
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of every row of docs the mix takes, copies counted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"))
    # Rows that are alike are one document with `many` times the fraction.
    classes = cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("many")))
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"))
    aims = cut(targets(sizes))
    many = aims.count()
    aims = aims.withColumnRenamed("source", "of")
    placed = classes.join(F.broadcast(aims) if many <= BROADCAST_SOURCES else aims, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_TIMES)))).otherwise(0.0)
    # Rates within rounding of a whole number are that number.
    near = F.round(rate)
    rate = F.when(F.abs(rate - near) < 1e-12, near).otherwise(rate)
    extra = (rate - F.floor(rate)) * F.col("many")
    parts = [F.col("doc_id").cast("string"), F.col("doc_id").isNull(), "source", F.col("source").isNull(), "size"]
    key = F.concat_ws(" ", *[F.hex(F.xxhash64(F.lit(k), *parts)) for k in (1, 2)])
    asked = cut(placed.withColumns({"key": key, "copies": F.floor(rate), "sure": F.floor(extra), "p": extra - F.floor(extra)}))
    drawn = rounded(asked.select("source", "key", F.col("size").cast("double").alias("words"), "p"), seed).where("taken").select(F.col("key"), F.lit(1).alias("one"))
    settled = asked.join(drawn, "key", "left").withColumn("more", F.col("sure") + F.coalesce("one", F.lit(0)))
    # Of a class `more` rows have a copy more; long classes are written out in chunks, which are spread.
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / CHUNK)))
    chunked = settled.where(F.col("many") > 1).withColumn("chunk", chunk).repartition("key", "chunk")
    within = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("many")) - 1))
    repeats = chunked.withColumn("at", within).withColumn("more", F.when(F.col("at") < F.col("more"), 1).otherwise(0).cast("long"))
    names = ["doc_id", "size", "source_size", "target", "copies", "more"]
    every = settled.where(F.col("many") == 1).select(names).unionByName(repeats.select(names))
    return every.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.col("more"))).cast("long").alias("taken"))
