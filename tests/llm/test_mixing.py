"""Mixing against a plain division of words, and what pivotal rounding promises."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from marlpit.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size int, key string, target double, many int, bucket int, p double, left int"


def frame(spark, rows, n=3):
    return spark.createDataFrame([(*r, 1, "k", 1.0, 1, 1, 0.5, 1) for r in rows], SCHEMA).repartition(n)


def size_of(text):
    return len(WORD.findall(text or ""))


def plain_targets(sizes):
    """Divide, stop at three times the size, divide what is left among the others, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    done, open_ = {}, set(order)
    while True:
        left, weights = sum(sizes.values()) - sum(done.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * left > 3 * sizes[s] * weights}
        if not full:
            return done | {s: left * weight[s] / weights for s in open_}
        done |= {s: 3.0 * sizes[s] for s in full}
        open_ -= full


def held(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    sizes, largest, taken = Counter({s: 0 for *_, s in rows}), Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += size_of(text)
        largest[source] = max(largest[source], size_of(text))
    aims = plain_targets(sizes) if rows else {}
    places = defaultdict(set)
    for s in sizes:
        places[(sizes[s], round(aims[s], 6))].add(s)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((k, size_of(t)) for k, t, _ in rows)
    by_target = Counter()
    for r in got:
        assert (r.source_size, round(r.target, 6)) in places
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        by_target[(r.source_size, round(r.target, 6))] += r.taken
    for at, sources in places.items():
        assert abs(by_target[at] - at[1] * len(sources)) <= sum(largest[s] for s in sources) + 1e-6
    again = mixing.mix(frame(spark, rows, 7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    return got


def test_nulls_no_rows_and_sources_without_words(spark):
    held(spark, [])
    held(spark, [(1, None, None)])
    held(spark, [(1, "a b c", "s"), (None, "d", None), (None, None, ""), (2, " \t\n", "t"), (2, "x y", "ß"), (2, "x y", "\U0001f600"), (3, "\x0ba\x0cb\rc ", "s"), (4, "a b  c", "s")])


def test_small_large_and_very_long_documents(spark):
    own = random.Random(2)
    rows = [(k, "w " * own.choice([0, 1, 2, 50, 300]), f"s{own.choice([0, 0, 0, 0, 1, 2, 3, 4])}") for k in range(3000)]
    rows += [(9000, "long " * 200_000, "s5"), (9001, "one", "s6"), (9002, "two words", "s6")]
    held(spark, rows)


def test_repeated_rows_share_their_copies(spark):
    """A third of all rows are one document; exactly as many of them are taken more often as their share asks for, but for one."""
    rows = [(k, "a b c d", "x") for k in range(600)] + [(7, "same text here", "y")] * 10_000 + [(k, "e f", "z") for k in range(20_000)]
    got = held(spark, rows)
    same = [r.taken // 3 for r in got if r.doc_id == 7 and r.size == 3]
    rate = next(r.target / r.source_size for r in got if r.doc_id == 7 and r.size == 3)
    assert len(same) == 10_000 and max(same) - min(same) <= 1 and abs(sum(same) - 10_000 * rate) <= 1


def test_every_document_is_as_likely_as_another(spark):
    """Over many seeds a document is taken as often as its source's rate says, whatever its size."""
    rows = spark.createDataFrame([("s", f"{k}", float(1 + k % 5), 0.3) for k in range(1200)], "source string, key string, words double, p double")
    total, runs, words = Counter(), 3, {str(k): 1 + k % 5 for k in range(1200)}
    for seed in range(runs):
        taken = [r.key for r in mixing.rounded(rows, seed * 100).where("taken").collect()]
        assert abs(sum(words[k] for k in taken) - 0.3 * sum(words.values())) <= 5
        total.update(taken)
    for size in range(5):
        assert abs(sum(n for k, n in total.items() if int(k) % 5 == size) / (240 * runs) - 0.3) < 0.07


def test_words_are_counted_without_a_list(spark):
    texts = [None, "", " ", "a", " a ", "a\tb\n\nc", "\x1ca", "ü b c\x0b", "日本 語", "a" * 100_000 + " b"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", mixing.words_in(F.col("text")).alias("n")).collect()
    assert [r.n for r in sorted(got)] == [size_of(t) for t in texts]
