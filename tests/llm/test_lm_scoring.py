"""The attention models against numeric derivatives and plain sums, and the operator against a plain word count."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from marlpit.llm import lm_score
from marlpit.llm.attention import BUCKETS, START, Adam, Attention, initial, windows_of
from marlpit.llm.textkernel import run_hashes

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def trained(key):
    return key is None or zlib.crc32(str(key).encode()) % 5 != 1


@pytest.fixture(scope="module")
def rows():
    """Texts of two languages that share no syllable, with the cases that tables bring."""
    own = random.Random(2)
    syllables = [["ka", "lo", "mi", "tur", "sen"], ["ghe", "wop", "zix", "bry", "ont"]]
    texts = [" ".join("".join(own.choices(syllables[k % 2], k=own.randint(1, 3))) for _ in range(own.randint(20, 200))) for k in range(120)]
    texts += [None, "", "One word", "\t \n", "Zażółć gęślą jaźń 日本語", "x" * 5000, texts[0], texts[0]]
    return [*enumerate(texts), (None, "nobody knows"), (3, texts[3])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, 1.5, "x") for k, t in rows], "doc_id long, text string, score double, row string").repartition(3)


def test_base_matches_a_plain_count(docs, rows):
    count = Counter(w for k, t in rows if trained(k) for w in words(t))
    ends = sum(trained(k) for k, _ in rows)
    total, kinds = count.total() + ends, len(count) + 1
    base = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    want = sorted((str(k), len(w := words(t)) + 1, sum(x in count for x in w) + 1, total, round(sum(base(count[x]) for x in w) + base(ends), 6)) for k, t in rows)
    got = lm_score.score_texts(docs, lm_score.training_rows(), PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if not trained(r.doc_id) and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_do_not_hang_on_the_split_or_the_broadcast(docs, monkeypatch):
    monkeypatch.setattr(lm_score, "WHOLE", 3)
    monkeypatch.setattr(lm_score, "SHARD_PIECES", 8000)
    found = []
    for many, frequent in ((1, 1 << 17), (5, 1 << 17), (3, 9)):
        monkeypatch.setattr(lm_score, "FREQUENT", frequent)
        got = lm_score.score_texts(docs.where("doc_id is not null").repartition(many), lm_score.training_rows(), PATH).collect()
        found.append(sorted((r.doc_id, r.n_tokens, r.score) for r in got))
    for other in found[1:]:
        assert np.allclose(np.array(found[0]), np.array(other), rtol=1e-4)


def test_no_training_rows_and_no_rows(spark, docs):
    from pyspark.sql import functions as F

    got = lm_score.score_texts(docs, F.lit(False), PATH).collect()
    assert len(got) == docs.count() and {(r.n_known, r.train_tokens) for r in got} == {(0, 0)} and all(math.isfinite(r.score) for r in got)
    assert lm_score.score_texts(docs.limit(0), lm_score.training_rows(), PATH).count() == 0


def test_table_of_hashes():
    own = np.random.default_rng(3)
    hashes = np.unique(np.concatenate([own.integers(0, 2**63, 500).astype(np.uint64), np.arange(1, 60, dtype=np.uint64)]))
    table = lm_score.Table(hashes)
    asked = np.concatenate([hashes[::-1], np.array([2**62 + 1, 61, 0], np.uint64)])
    grown = lm_score.Table(hashes[:100], len(hashes))
    grown.add(hashes[100:])
    assert grown.find(asked).tolist() == table.find(asked).tolist()
    assert table.find(asked).tolist() == [*range(len(hashes))][::-1] + [-1, -1, -1] and lm_score.Table(hashes[:0]).find(asked).max() == -1


@pytest.mark.parametrize("kind", ["u1", "<u2"])
def test_hashes_tell_runs_apart_wherever_they_stand(kind):
    own = np.random.default_rng(4)
    letters = own.integers(0, 3, 3000).astype(kind)
    first, size = own.integers(0, 2900, 4000), own.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 34, 90], 4000)
    hashes, runs = run_hashes(letters, first, size), [letters[a : a + n].tobytes() for a, n in zip(first, size)]
    assert len({*hashes.tolist()}) == len({*runs}) == len({*zip(hashes.tolist(), runs)}) < 4000
    assert run_hashes(letters[:0], first[:0], size[:0]).size == 0


def test_speller_that_forgets_spells_alike():
    """Also where one text has more words than there is room for."""
    vocabulary = lm_score.Vocabulary(open(PATH, "rb").read())
    own = random.Random(5)
    texts = [" ".join(f"W{own.randint(0, 400)}x\t" for _ in range(own.randint(0, 300))).encode() for _ in range(40)] + [b"", b" \n", "é Ünï".encode()]
    large, small = lm_score.Speller(vocabulary.ranks), lm_score.Speller(vocabulary.ranks, room=7)
    want = [*large(texts, vocabulary.opens)]
    assert [x for t in texts for x in small([t], vocabulary.opens)] == want == [*small(texts, vocabulary.opens)]
    plain = [np.array(large.encoding.encode_ordinary("".join(f" {w}" for w in words(t.decode()))), "<u2").tobytes() for t in texts]
    assert want == plain and large.at.many == len({w for t in texts for w in words(t.decode())})


def windows(own, many=5, width=8):
    one, two, goal = (own.integers(0, BUCKETS, (many, width)) for _ in range(3))
    return one, two, own.integers(0, 2, (many, width)).cumsum(axis=1), goal


def test_slopes_are_derivatives():
    own = np.random.default_rng(0)
    model = Attention(8, initial(8, np.full(BUCKETS, 1 / BUCKETS)))
    model.weights = {k: v.astype(np.float64) + own.standard_normal(v.shape) * 0.1 for k, v in model.weights.items()}
    one, two, group, goal = windows(own)
    weight = own.random(goal.shape)
    weight /= weight.sum()
    loss = lambda: -(model.log_probability(one, two, group, goal) * weight).sum()
    for name, slope in model.slopes(one, two, group, goal, weight)[1].items():
        values = model.weights[name]
        at = tuple(a[0] for a in np.nonzero(np.abs(slope) > 1e-5))
        values[at] += 1e-5
        above = loss()
        values[at] -= 2e-5
        below = loss()
        values[at] += 1e-5
        assert abs((above - below) / 2e-5 - slope[at]) < 1e-6, name


def test_windows_are_looked_at_a_few_at_a_time(monkeypatch):
    own, looked, look = np.random.default_rng(3), [], Attention.look
    monkeypatch.setattr(Attention, "look", lambda self, one, *rest: looked.append(len(one)) or look(self, one, *rest))
    model = Attention(24, initial(24, np.full(BUCKETS, 1 / BUCKETS)))
    model.weights["member"] *= 20
    one, two, goal = (own.integers(0, BUCKETS, (300, 24)) for _ in range(3))
    group = np.repeat(own.integers(0, 2, (300, 1)), 24, axis=1)
    group[:, 12:] += own.integers(0, 2, (300, 1))
    got = model.log_probability(one, two, group, goal[:, 6:], 6)
    assert max(looked) <= 128 and sum(looked) == 300
    alone = [model.log_probability(*(x[k : k + 1] for x in (one, two, group)), goal[k : k + 1, 6:], 6) for k in range(300)]
    assert np.abs(got - np.concatenate(alone)).max() < 1e-4


def test_attention_is_causal_and_adds_up_to_one():
    own = np.random.default_rng(1)
    model = Attention(8, initial(8, np.full(BUCKETS, 1 / BUCKETS)))
    one, two, group, goal = windows(own, 1)
    group[:] = [[0, 0, 0, 1, 1, 1, 1, 1]]
    before = model.log_probability(one, two, group, goal)
    changed = one.copy()
    changed[0, [0, 6]] = [5, 7]
    after = model.log_probability(changed, two, group, goal)
    assert np.array_equal(before[0, 3:6], after[0, 3:6]) and not np.isclose(before[0, [0, 1, 2, 6, 7]], after[0, [0, 1, 2, 6, 7]]).any()
    every = np.repeat(np.arange(BUCKETS)[:, None], 8, axis=1)
    lots = [np.repeat(x, BUCKETS, axis=0) for x in (one, two, group)]
    assert np.allclose(np.exp(model.log_probability(*lots, every)).sum(axis=0), 1, atol=1e-4)


def test_windows_give_each_position_once():
    for n, window, step in ((0, 8, 6), (1, 8, 6), (50, 8, 6), (50, 8, 8), (7, 8, 8)):
        index, given = windows_of(np.array([n, 0, 9]), window, step)
        assert sorted(index[given]) == [*range(n + 9)] and (np.argwhere(given)[:, 1] >= window - step).all()


def test_every_position_is_learned_from(spark, monkeypatch):
    """All words and ends of all texts are targets once, and so are all pieces of all words that are not whole."""
    vocabulary = lm_score.Vocabulary(open(PATH, "rb").read())
    texts = ["kalomi turka senlo the the", "", "tur", "mi " * 100, "q7" * 40]
    ids = [*lm_score.Speller(vocabulary.ranks)([t.encode() for t in texts], vocabulary.opens)]
    own = lm_score.Words(ids, vocabulary.opens)
    assert len(own.first) == 107 and [*np.diff(own.offsets)] == [5, 0, 1, 100, 1]
    language = lm_score.Language(np.ones(vocabulary.stop + 1), np.ones(vocabulary.stop + 1), 5, vocabulary.stop, own.hashes[3:4], np.array([2]))
    seen = [[], []]
    for k, model in enumerate(language.models):
        monkeypatch.setattr(model, "slopes", lambda one, two, group, goal, weight, into=seen[k]: (into.extend(goal[weight > 0]), (0.0, {}))[1])
    language.text_positions(own, language.heads(own)[0]).learn(Adam(language.models[0], 0.01, 1), 2)
    assert len(seen[0]) == 112 and seen[0].count(int(language.opening.of[vocabulary.stop])) == 5

    shared = spark.sparkContext.broadcast(vocabulary)
    rows = spark.createDataFrame([(True, bytearray(x)) for x in ids] + [(False, bytearray(ids[0]))], "trained boolean, ids binary").coalesce(1)
    counts = [r for r in lm_score.corpus_counts(rows, shared).collect() if r.n and (r.kind == lm_score.RUN_OF or r.kind == lm_score.WORD and r.size <= lm_score.PACKED and np.uint64(r.word % 2**64) not in language.whole)]
    pieces, size = lm_score.unpacked_pieces(*(np.array([r[c] for r in counts]) for c in ("low", "high")))
    language.word_positions(pieces, size, np.array([r.size > 0 for r in counts])).learn(Adam(language.models[1], 0.01, 1), 2)
    distinct = {w: len(spelled(vocabulary, w)) for w in {*" ".join(texts).split()} - {"the"}}
    assert max(distinct.values()) > 3 * lm_score.PACKED
    assert len(seen[1]) == sum(distinct.values()) and seen[1].count(int(language.inner.of[vocabulary.stop])) == len(distinct)


def spelled(vocabulary, word):
    return np.frombuffer(next(lm_score.Speller(vocabulary.ranks)([word.encode()], vocabulary.opens)), "<u2")


def test_words_and_their_pieces():
    vocabulary = lm_score.Vocabulary(open(PATH, "rb").read())
    tokens = {i: t for t, i in vocabulary.ranks.items()}
    long = "y" * 1000 + " Ünï日本" + " " + "end"
    ids = np.frombuffer(next(lm_score.Speller(vocabulary.ranks)([f"\tA b\n{long} ".encode()], vocabulary.opens)), "<u2")
    assert b"".join(tokens[i] for i in ids.tolist()) == f" a b {long}".encode() and vocabulary.opens[ids].sum() == 4
    assert START == BUCKETS


def test_a_task_hands_on_each_word_once(spark, monkeypatch):
    """Not once for each batch; and merged counts add up, also where they are handed on early."""
    vocabulary = lm_score.Vocabulary(open(PATH, "rb").read())
    own = random.Random(6)
    texts = [" ".join(f"w{own.randint(0, 300)}" for _ in range(own.randint(0, 80))) for _ in range(60)] + ["", "q7" * 40]
    ids = [*lm_score.Speller(vocabulary.ranks)([t.encode() for t in texts], vocabulary.opens)]
    want = Counter(hash_ for x in ids[::2] for hash_ in lm_score.Words([x], vocabulary.opens).hashes.view(np.int64).tolist())
    batches = [pa.RecordBatch.from_pydict({"trained": [k % 2 == 0 for k in range(a, min(a + 7, len(ids)))], "ids": ids[a : a + 7]}) for a in range(0, len(ids), 7)]
    runs, plain = [], lm_score.map_batches
    monkeypatch.setattr(lm_score, "map_batches", lambda df, run, schema: (runs.append(run), plain(df, run, schema))[1])
    lm_score.corpus_counts(spark.createDataFrame([(True, bytearray())], "trained boolean, ids binary"), spark.sparkContext.broadcast(vocabulary))
    for room in (1 << 19, 40):
        monkeypatch.setattr(lm_score, "GATHERED", room, raising=False)
        rows = [r for b in runs[0](iter(batches)) for r in b.to_pylist() if r["kind"] == lm_score.WORD]
        found = Counter()
        for r in rows:
            found[r["word"]] += r["n"]
        assert +found == want and len(found) == len({w for t in texts for w in t.split()})
        assert len(rows) == len(found) if room > 1000 else len(rows) > len(found)


def test_equal_hashes_lie_together():
    own = np.random.default_rng(6)
    for hashes in (own.integers(0, 40, 500).astype(np.uint64) << np.uint64(50), own.integers(0, 40, 500).astype(np.uint64), np.zeros(0, np.uint64), np.array([7], np.uint64)):
        order, first = lm_score.grouped(hashes)
        found, n = np.unique(hashes, return_counts=True)
        assert sorted(order.tolist()) == [*range(len(hashes))] and hashes[order[first]].tolist() == found.tolist() and np.diff(first, append=len(hashes)).tolist() == n.tolist()


def test_products_of_ids_give_what_multiplied_inputs_give():
    own = np.random.default_rng(7)
    model = Attention(24, initial(24, np.full(BUCKETS, 1 / BUCKETS)))
    model.weights = {k: v + own.standard_normal(v.shape).astype(np.float32) * np.float32(0.1) for k, v in model.weights.items()}
    one, two, group, _ = windows(own, 20, 24)
    plain, known = model.look(one, two, group, 6)["hidden"], model.look(one, two, group, 6, model.products())["hidden"]
    assert plain.shape == known.shape and np.abs(plain - known).max() < 1e-4
