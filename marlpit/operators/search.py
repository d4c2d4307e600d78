"""Substring search by an index of grams, for many terms at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import settled
from ..sources.tables import shared_table, spread

#: Characters of the longest gram; shorter ones are indexed too, so that shorter terms are found by themselves.
GRAM = 3
#: Characters of what is indexed from every character on; longer terms are verified on the texts.
LONGEST = 12


def grams(chars: Column, sizes: range) -> Column:
    """The distinct runs of characters of these sizes; chars is a column that is there, not an expression."""

    def runs(c: Column, k: Column) -> Column:
        out, run = [], c
        for size in range(1, sizes.stop):
            if size > 1:
                run = F.concat(run, F.get(chars, k + size - 1))
            if size in sizes:
                out.append(run)
        return F.array(*out)

    # A run over the end is null.
    return F.array_compact(F.array_distinct(F.flatten(F.transform(chars, runs))))


def gram_index(df: DataFrame, id_col: str, columns: list[str], longest: int = LONGEST) -> DataFrame:
    """(gram, id) of every run of one to three characters of the columns in lower case and of what follows every character, up to `longest` of them, each once, in ranges sorted by gram.

    Written as Parquet, a search reads only the row groups of its grams. A gram that most rows hold is cut into ranges of ids.
    Null and empty texts have none.
    """
    texts = spread(df.select(id_col, *columns)).select(F.col(id_col).alias("id"), F.array_compact(F.array_distinct(F.array(*[F.lower(c) for c in columns]))).alias("texts"))
    chars = texts.select("id", F.transform("texts", lambda t: F.split(t, "")).alias("said"))

    def both(said: Column) -> Column:
        # Runs of the longest size, cut at the end; shorter than a gram more they are grams.
        long = F.filter(F.transform(said, lambda c, k: F.array_join(F.slice(said, k + 1, longest), "")), lambda run: F.length(run) > GRAM)
        return F.concat(grams(said, range(1, GRAM + 1)), long)

    found = settled(chars, each=F.col("said")).select("id", F.explode(F.array_distinct(F.flatten(F.transform("each", both)))).alias("gram")).where("gram <> ''")
    return found.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")


def looked_up(index: DataFrame, terms: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(term, id) of the rows that the index names for terms (term), in lower case and once each; a row may come twice, and for a term beyond `longest` may lack it."""
    asked = shared_table(terms)
    begun = asked.where(F.length("term") <= longest).select("term", F.col("term").alias("gram"))
    # Of a longer term the rarest part is looked up.
    windows = asked.where(F.length("term") > longest).select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term") - longest + 1), lambda k: F.col("term").substr(k, F.lit(longest)))).alias("gram"))
    held = index.join(windows.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("many"))
    rarest = F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "gram"))
    begun = shared_table(begun.unionByName(windows.join(held, "gram", "left").groupBy("term").agg(rarest.alias("least")).select("term", "least.gram")))
    sizes = sorted(r.size for r in begun.where(F.length("gram") > GRAM).select(F.length("gram").alias("size")).distinct().collect())
    met = index.join(begun.where(F.length("gram") <= GRAM), "gram").select("term", "id")
    if sizes:
        cut = F.array(*[F.when(F.length("gram") >= size, F.substring("gram", 1, size)) for size in sizes])
        begins = index.where(F.length("gram") > GRAM).select("id", F.explode(F.array_compact(cut)).alias("gram"))
        met = met.unionByName(begins.join(begun.where(F.length("gram") > GRAM), "gram").select("term", "id"))
    return met


def search_terms(df: DataFrame, index: DataFrame, id_col: str, columns: list[str], terms: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(term, id) of the rows that hold a term (column term) literally in any column, ignoring case: contains_search for each term in one job.

    A term of up to three characters is a gram of its own. A longer one is looked up whole, one beyond `longest` characters by its rarest part of that size: the long
    grams are cut once for each length that terms have and joined, so what is read are the index and the rows found, however
    many terms there are. Only terms beyond `longest` are verified on the texts. Terms come in lower case and once each; null and empty ones find nothing.
    """
    asked = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    met = looked_up(index, asked, longest).distinct()
    texts = df.select(F.col(id_col).alias("id"), *[F.lower(c).alias(f"text {k}") for k, c in enumerate(columns)])
    found = F.lit(False)
    for k in range(len(columns)):
        found = found | F.coalesce(F.contains(F.col(f"text {k}"), F.col("term")), F.lit(False))
    told = met.where(F.length("term") > longest).join(texts, "id").where(found).select("term", "id")
    return met.where(F.length("term") <= longest).unionByName(told)
