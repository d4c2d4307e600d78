"""Every operator on whole tables: nulls, empty and very long texts, repeats, clashing columns, no rows at all."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from marlpit.llm import bpe, chat, components, decontam, fingerprints, minhash, pii, suffix_dedup, token_counts, toxicity

own = random.Random(12)
WORDS = ["".join(own.choice("abcdefghij") for _ in range(own.randint(1, 7))) for _ in range(400)]
LONG = " ".join(own.choice(WORDS) for _ in range(40_000))
TEXTS = [None, "", " \n\t", "one", "Ünï çödé 日本語 \U0001f600 <|endoftext|>", LONG, "a" * 3000, "a\r\nb\n\nc\n" * 30, "don't it's I'll 123,456.78 !!!", "x" * 300 + " " + "é" * 300]


@pytest.fixture(scope="module")
def rows():
    out = [*enumerate(TEXTS)] + [(k, " ".join(own.choice(WORDS) for _ in range(own.randint(1, 60)))) for k in range(20, 60)]
    return out + [(3, "one"), (3, "other"), (None, "nobody"), (None, "nobody"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns that operators use themselves for other things."""
    columns = "doc_id long, text string, ids string, key string, row int, place int, bucket string, score string, component string, shingles int, entities int, many int, at int"
    return spark.createDataFrame([(k, t, "i", "k", 1, 1, "b", "s", "c", 1, 1, 1, 1) for k, t in rows], columns).repartition(3)


def test_encoding_matches_the_library(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(k), np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for k, t in rows)
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    got = encoded.collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in got) == sorted((str(k), (t or "").encode()) for k, t in rows)
    again = bpe.decode(encoded.select("doc_id", "ids"), path).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in again) == sorted((str(k), (t or "").encode()) for k, t in rows)


def test_counts_match_the_library(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(k), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for k, t in rows)
    got = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 1024)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want


def test_fingerprints_match_plain_sums(spark, docs, rows):
    """Equality lanes against sums of paragraph digests, edits against plain slices, likeness against a cosine of the lanes."""
    unique = [(k, t) for k, t in {k: t for k, t in rows if k is not None}.items()]
    frame = spark.createDataFrame(unique, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edit_report(frame).collect()}
    order = sorted((k for k, _ in unique), reverse=True)
    text = {k: t or "" for k, t in unique}

    def lanes(t):
        sums = [0] * 4
        for line in t.encode().splitlines():
            if line.strip():
                digest = hashlib.blake2b(line, digest_size=32).digest()
                sums = [(s + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) % 2**64 for k, s in enumerate(sums)]
        return b"".join(s.to_bytes(8, "little") for s in sums).hex()

    def near(a, b):
        x, y = (np.frombuffer(bytes.fromhex(h[64:]), "<i2").astype(float) for h in (a, b))
        size = np.sqrt((x @ x) * (y @ y))
        return 1.0 if a == b else float(np.clip(x @ y / (size or 1), 0, 1))

    for at, k in enumerate(order):
        after = order[(at + 1) % len(order)]
        cut = len(text[k]) // 3
        edited = text[k][: len(text[k]) - cut] + text[after][:cut]
        r = got[k]
        assert r.n_chars == len(text[k]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint[:64] == lanes(text[k]) and r.edited_fingerprint[:64] == lanes(edited)
        assert abs(r.near_edited - near(r.fingerprint, r.edited_fingerprint)) < 1e-9 and abs(r.near_next - near(r.fingerprint, got[after].fingerprint)) < 1e-9
    assert fingerprints.edit_report(docs).count() == len(rows)
    first, second = "a line\nof text", "and another\n"
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(spark.createDataFrame([(1, first), (2, second), (3, second + first), (4, "of text\nand another\na line")], "doc_id long, text string")).collect()}
    assert prints[3] == prints[4] == fingerprints.combine([prints[1]], [prints[2]])[0] and fingerprints.combine([prints[3]], [prints[2]], -1)[0] == prints[1]


def test_ranges_are_partitions(spark):
    """Many ids, half of them null: the next text follows, and no partition holds much more than another."""
    frame = spark.createDataFrame([(k if k % 2 else None, f"text {k}") for k in range(4000)], "doc_id long, text string")
    spread = fingerprints.with_next(frame)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 4 * sum(sizes) / len(sizes) and len(sizes) > 40
    assert fingerprints.edit_report(frame).count() == 4000


def test_toxicity_of_odd_tables(spark, docs, rows):
    labels = spark.createDataFrame([(k, int(k % 2), 5) for k in range(20, 60)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1 and len({r.score for r in got if r.doc_id is None}) == 2
    # Labels of one class, or none, teach nothing.
    for few in (labels.where("toxic = 1"), labels.limit(0)):
        assert {r.score for r in toxicity.score(docs, toxicity.train(docs, few)).collect()} == {0.0}


def test_sampled_labels_are_the_same_in_any_order(spark):
    """Of equal texts with one label one is learned from, always the same."""
    texts = [" ".join(own.choice(WORDS) for _ in range(20)) for _ in range(30)]
    frame = [(k, texts[k % 30]) for k in range(120)]
    marks = spark.createDataFrame([(k, int(k % 30 < 12)) for k in range(120)], "doc_id long, toxic int")
    scores = []
    for many in (1, 5):
        shuffled = spark.createDataFrame(own.sample(frame, len(frame)), "doc_id long, text string").repartition(many)
        scores.append(sorted((r.doc_id, r.score) for r in toxicity.score(shuffled, toxicity.train(shuffled, marks)).collect()))
    assert np.allclose(np.array(scores[0]), np.array(scores[1]), rtol=1e-6)


def test_conversations_of_odd_tables(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, None, "x"), (2, 5, "assistant", "a\\<|im_end|>\\|" * 50), (3, None, "user", LONG)]
    turns = spark.createDataFrame([(*r, "n", "p") for r in rows], "conv_id long, turn long, role string, text string, node string, parent string")
    got = {r.tree: r for r in chat.read_back(chat.format_trees(chat.chain_messages(turns))).collect()}
    assert {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()} == {1: [("user", "hi"), ("assistant", ""), ("assistant", "")], None: [("", "x")], 2: [("assistant", "a\\<|im_end|>\\|" * 50)], 3: [("user", LONG)]}
    assert got[2].loss_text == "a\\<|im_end|>\\|" * 50 and got[3].loss_text == ""
    assert chat.format_trees(chat.chain_messages(turns.limit(0))).count() == 0


def test_long_texts_in_sets_spans_and_windows(spark, docs):
    """The long text against copies of itself with a few words changed."""
    words = LONG.split()
    changed = words[:20_000] + ["zz"] + words[20_001:]
    frame = spark.createDataFrame([(1, LONG), (2, " ".join(changed)), (3, None), (4, " ".join(words[:200]))], "doc_id long, text string, ".rstrip(", "))
    linked = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, 85).collect()}
    assert linked == {1: 1, 2: 1, 3: 3, 4: 4}
    lost = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.removal_report(frame).collect()}
    assert lost[1][1] == 2 and lost[3] == (0, 0) and lost[4][1] == 1
    items = spark.createDataFrame([(7, " ".join(words[30_000:30_030])), (8, " ".join(changed[19_995:20_005]))], "item_id long, text string")
    hits = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.contamination(frame, items).collect()}
    assert hits[1][0] >= 30 and hits[2][1] == 2 and hits[3] == (0, 0) and hits[4] == (0, 0)


def test_recall_of_links(spark):
    """Pairs of every similarity from 0.7 up, in one table: all links of full sets are found and no others."""
    base = [own.choice(WORDS) + str(own.randrange(1000)) for _ in range(300)]
    texts = [" ".join(base)]
    for k in range(150):
        mine = [own.choice(WORDS) + str(own.randrange(1000)) for _ in range(own.randint(60, 300))]
        texts.append(" ".join(mine))
        for _ in range(own.randint(1, 3)):
            other = list(mine)
            for _ in range(own.randint(1, max(1, len(mine) // 40))):
                other[own.randrange(len(other))] = "new" + str(own.randrange(10**6))
            texts.append(" ".join(other))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    index = {}
    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    pairs = {(a, b) for group in index.values() for a in group for b in group if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert 60 < len(links) < len(pairs)
    root = [*range(len(texts))]

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 80).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def test_no_rows(spark, docs):
    none = docs.limit(0)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 1024).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontam.contamination(none, items).count() == 0 and fingerprints.fingerprint(none).count() == 0
    assert components.label_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clashing_columns(docs, rows):
    assert minhash.near_duplicates(docs, 85).count() == len(rows) and suffix_dedup.removal_report(docs).count() == len(rows)
    clean = pii.replace_pii(docs, "key")
    assert clean.columns == [*docs.columns, "n_entities"] and clean.count() == len(rows)


def test_endless_entities_end_no_machine(spark):
    """100,000 characters of what repeats in each pattern; an address with more labels than a host name may have is none."""
    n = 50_000
    texts = ["a@" + "b." * n + "com", "a@" + "bc." * 100 + "com x", "a." * n + "@b.com", "@" * 2 * n, "0f" * n + " end", "1" * 2 * n, "1234 " * n, "+1" + " 22" * n, "(22) " * n, "DE12" + " ABCD" * n, "1.2.3.4." * n, "Mr " + "Ab" * n, "Mr Ab " * n, "sk_" + "a1" * n, "123-45-6789-" * (n // 4)]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), "key").collect()}
    assert len(got) == len(texts)
    assert got[0].n_entities == 0 and got[0].text == texts[0]
    assert got[1].n_entities == 1 and got[1].text.endswith("@example.invalid x")
    assert got[4].n_entities == 1 and got[4].text.endswith(" end") and len(got[4].text) == len(texts[4]) and got[4].text != texts[4]
    assert got[11].n_entities == 1 and got[11].text.startswith("Mr ") and len(got[11].text) < 100
