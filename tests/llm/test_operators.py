"""Whole operators on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.llm import chat, common, components, decontam, fingerprints, minhash, pii, suffix_dedup, toxicity

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    shared, base = prose(60), prose(200)
    texts = [None, "", "one", base, base, base.replace(" ", "  ", 3), " ".join(base.split()[:195] + ["zz"]), prose(50) + " " + shared, shared + " " + prose(40), prose(300), "a" * 900, prose(120)]
    rows = [(k, t, "en", "x", "band") for k, t in enumerate(texts)] + [(11, texts[11], "en", "x", "band")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, salt string, kind string").repartition(3)


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def test_near_duplicates_match_brute_force(docs):
    texts = texts_of(docs)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in texts.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 85).collect()}
    assert got == {(i, len(sets[i]), root[i], root[i] == i) for i in sets}


def test_components(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 50), (7, 7), (1, 2)], "a long, b long")
    got = {r.node: r.component for r in components.label_components(pairs).collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, 100: 50}


def test_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "cut", lambda df: written.append(1) or common.cut(df))
    pairs = spark.createDataFrame([(1, k) for k in range(2, 30)] + [(60, 50), (50, 70), (4, 4)], "a long, b long")
    assert {(r.node, r.component) for r in components.label_components(pairs).collect()} == {*((k, 1) for k in range(2, 30)), (60, 50), (70, 50)}
    assert len(written) == 1


def test_filter_of_ids_takes_little_of_the_driver(spark):
    ids = spark.range(150_000).select(F.col("id").alias("doc_id"))
    places = np.array([r[0] for r in ids.where("doc_id % 50 = 0").select(minhash.bit_place("doc_id")).collect()])
    tracemalloc.start()
    bits = minhash.membership_bits(ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * minhash.FILTER_BITS / 8
    assert ((bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).all()
    assert 149_000 < np.unpackbits(bits.view(np.uint8)).sum() <= 150_000


def repeats(rows):
    starts = {}
    for _, b in rows:
        for s in range(len(b) - 199):
            starts[b[s : s + 200]] = starts.get(b[s : s + 200], 0) + 1
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if starts[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeats_match_brute_force(docs, hot):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert sorted(tuple(r) for r in suffix_dedup.removal_report(docs, hot=hot, shard=50).collect()) == sorted(repeats(rows))


@pytest.mark.parametrize("hot", [50_000, 30])
def test_repeats_of_passages(spark, hot):
    """Passages of about the length with other neighbours, a common one in every third text, edits, periods and runs."""
    own = random.Random(11)
    said = lambda n: "".join(own.choice("abcdefgh ") for _ in range(n))
    common, passages = said(230), [said(own.randint(195, 420)) for _ in range(8)]
    texts = []
    for k in range(150):
        parts = [said(own.randint(0, 300)), common if k % 3 == 0 else "", said(own.randint(0, 20)), own.choice(passages), said(own.randint(0, 150))]
        text = "".join(parts)
        if k % 7 == 0 and text:
            at = own.randrange(len(text))
            text = text[:at] + "É" + text[at + 1 :]
        texts.append(text)
    texts += ["ab" * 900 + "x", "z" * 20_000, "q" + "z" * 300, "z" * 199, texts[5], texts[5], None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    want = sorted(repeats([(k, (t or "").encode()) for k, t in enumerate(texts)]))
    assert sorted(tuple(r) for r in suffix_dedup.removal_report(docs, hot=hot, shard=40).collect()) == want


@pytest.mark.parametrize("block", [200_000, 7])
def test_windows_match_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    texts = texts_of(docs)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    asked = {1: " ".join(texts[9].split()[20:45]), 2: "one", 3: None, 4: "never seen at all", 5: "ONE!"}
    items = spark.createDataFrame(list(asked.items()), "item_id long, text string")
    want = set()
    for i, t in texts.items():
        w, hit, found = split(t), set(), set()
        for item, body in asked.items():
            q = split(body or "")
            for s in range(max(1, len(q) - 9) if q else 0):
                window = q[s : s + 10]
                for p in range(len(w) - len(window) + 1):
                    if w[p : p + len(window)] == window:
                        hit |= {*range(p, p + len(window))}
                        found.add(str(item))
        want.add((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert {tuple(r) for r in decontam.contamination(docs, items).collect()} == want


def test_items_without_an_id_contaminate(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "say a b c now"), (2, "clean"), (3, "q r")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c"), (None, "b c"), (7, "a b c"), (None, "q r")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(docs, items).collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got == {1: (3, 2, digest("7"), True), 2: (0, 0, digest(""), False), 3: (2, 1, digest(""), True)}
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()] == [2]


def test_surrogates(spark):
    rows = [(1, "Mr. John Smith met Mrs Mary Smith; a@b.com A@B.com 4111 1111 1111 1111, 10.0.0.1", "k"), (None, "x 10.0.0.1", "k"), (2, None, "k"), (3, "", "k"), (4, "+1 (201) 555-0123 +1 (201) 555-0124", "k")]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string, kind string"), "key").collect()}
    assert len(got) == 5 and got[2].text is None and got[3].text == ""
    text = got[1].text
    names = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+); (\S+) (\S+) (\d{4} \d{4} \d{4} \d{4}), (\S+)$", text)
    assert names and names[2] == names[4] != "Smith" and names[5] == names[6] and names[8] == got[None].text[2:] != "10.0.0.1"
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[4].text)
    assert len({*phones}) == 2 and "555-012" not in got[4].text


def test_surrogates_keep_people_apart_and_together(spark):
    """Many names of few families: one family name has one surrogate, whole names are as many as before, and no original is left."""
    own = random.Random(3)
    families = ["".join(own.choice("bcdfg") + own.choice("aeiou") for _ in range(3)).capitalize() + "x" for _ in range(60)]
    given = [f"G{c}{d}n" for c in "aeiou" for d in "bcdfghkl"]
    people = [(own.choice(["Mr.", "Mrs"]), own.choice(given), own.choice(families)) for _ in range(600)]
    rows = [(k, f"{t} {g} {f} and {t} {f}. Tel +49123{k % 10}") for k, (t, g, f) in enumerate(people)]
    got = {r.doc_id: r.text for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    of_family, of_name, of_number = {}, {}, {}
    for k, (t, g, f) in enumerate(people):
        m = re.fullmatch(rf"{re.escape(t)} (\w+) (\w+) and {re.escape(t)} (\w+)\. Tel (\+\d+)", got[k])
        assert m[2] == m[3] and m[1] != g
        of_family.setdefault(f, set()).add(m[2])
        of_name.setdefault((t, g, f), set()).add((m[1], m[2]))
        of_number.setdefault(k % 10, set()).add(m[4])
    for found in (of_family, of_name, of_number):
        values = [next(iter(v)) for v in found.values()]
        assert all(len(v) == 1 for v in found.values()) and len({*values}) == len(values)
    assert not {next(iter(v)) for v in of_family.values()} & {*families}


def test_every_kind_alone_in_a_text_is_replaced(spark):
    """One example of every alternative of PATTERNS: each must pass SIGN with nothing else in the text."""
    titles = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Mister", "Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"]
    alone = [f"{t} Garcia" for t in titles] + ["Señora García", "a@b.com", "0123456789abcdef" * 2, *(f"{k}_abcdefghijklmnop" for k in ("sk", "pk", "ghp", "xoxb", "AKIA"))]
    alone += ["GB29 NWBK 6016 1331 9268 19", "GB29NWBKABCDEFGH", "4111111111111111", "123-45-6789", "1.1.1.1", "(201) 555-0123", "+1 (201) 555-0123", "+491234", "+49 30 1234", "555-123-4567", "555.123.4567", "555 123 4567"]
    got = pii.replace_pii(spark.createDataFrame([(k, f"x {t} y") for k, t in enumerate(alone)], "doc_id long, text string"), "key").collect()
    assert len(got) == len(alone) and [alone[r.doc_id] for r in got if r.n_entities != 1 or alone[r.doc_id] in r.text] == []


def test_toxicity_learns(spark):
    bad = ["scumm", "lozer", "idyot"]
    rows, labels = [(0, None), (1, "")], []
    for k in range(2, 602):
        toxic = k % 5 == 0
        w = prose(60).split()
        for b in bad if toxic else []:
            w.insert(rng.randint(0, 60), b)
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, marks, toxicity.not_held_out())).collect()}
    held = [(got[i].predicted, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == t for p, t in held) / len(held) > 0.95 and 0 <= got[0].score <= 1 and got[1].predicted == 0


def test_toxicity_is_kneser_ney():
    """Against the formulas over plain dictionaries, for words and bytes; every context's probabilities add up to one."""
    import numpy as np

    base, d = toxicity.WORD_SLOTS, toxicity.DISCOUNT
    own = random.Random(3)
    for shift, units in ((0, base), (base, 257)):
        n = {(own.randrange(6) + shift, own.randrange(9) + shift): (own.randrange(3), own.randrange(3)) for _ in range(40)}
        n = {k: v for k, v in n.items() if any(v)}
        keys = sorted(n, key=lambda k: int(toxicity.packed(np.int64(k[0]), np.int64(k[1]))))
        model = toxicity.kneser_ney(toxicity.packed(*np.array(keys, np.int64).T), np.array([n[k] for k in keys], np.int32).T)

        def lower(pairs, shorter):
            left = {v: sum(k[1] == v for k in pairs) for _, v in pairs}
            return lambda v: (max(left.get(v, 0) - d, 0) + d * len(left) * shorter(v)) / len(pairs)

        shared = lower([k for k in n if all(n[k])], lambda v: 1 / units)
        everything = np.arange(units) + shift
        for c in (0, 1):
            alone = lower([k for k in n if n[k][c]], shared)
            for u in range(8):
                of = {v: m[c] for (w, v), m in n.items() if w == u + shift and m[c]}
                total = sum(of.values())
                got = np.exp(model.log_probability(np.full(units, u + shift), everything)[c].astype(np.float64))
                want = [(max(of.get(v, 0) - d, 0) + d * len(of) * alone(v)) / total if total else alone(v) for v in range(shift, shift + 12)]
                assert np.allclose(got[:12], want, rtol=1e-4) and abs(got.sum() - 1) < 1e-4


def test_toxicity_of_few_texts_and_new_compounds(spark):
    """A word of four toxic texts speaks for that class, and so does a new word that starts as toxic ones do."""
    import numpy as np

    own = random.Random(8)
    rows = []
    for k in range(300):
        w = [own.choice(VOCABULARY) for _ in range(40)]
        if k % 3 == 0:
            w += ["zqx" + own.choice(VOCABULARY) + own.choice(VOCABULARY)]
        rows.append((k, " ".join(w + ["wuggle"] * (k in (0, 3, 6, 9))), int(k % 3 == 0)))
    model = toxicity.fit_models(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    plain, rare, new = toxicity.features(model, [b"abc", b"wuggle", b"zqxhahahaheded"])
    assert rare[1] > 3 > plain[1] and new[1 + 2 + len(toxicity.TELLING)] > 2
    assert np.isfinite([plain, rare, new]).all()


def test_chat_trees(spark):
    rows = [("t", 1, None, "user", "q <|im_end|> \\ x", 0.0), ("t", 2, 1, "assistant", "weak", 0.1), ("t", 3, 1, "assistant", "<|im_start|>good\\|", 0.9), ("t", 4, 3, "us\ner", None, None), (None, 1, None, "assistant", "z", None), ("c", 1, 2, "user", "loop", 0.0), ("c", 2, 1, "user", "loop", 0.0)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {r.tree: r for r in chat.read_back(chat.format_trees(messages)).collect()}
    assert {*got} == {"t", None}
    assert [tuple(t) for t in got["t"].turns] == [("user", "q <|im_end|> \\ x"), ("assistant", "<|im_start|>good\\|"), ("us\ner", "")]
    assert got["t"].loss_text == "<|im_start|>good\\|" and got["t"].formatted.count("<|im_start|>") == 3


def test_next_documents_and_fingerprints(docs):
    texts = texts_of(docs)
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in fingerprints.edit_report(docs.dropDuplicates(["doc_id"])).collect()}
    for k, i in enumerate(order):
        t, n = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 3
        assert rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest()
    assert rows[3].fingerprint == rows[4].fingerprint != rows[9].fingerprint


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert minhash.near_duplicates(none).count() == 0 and suffix_dedup.removal_report(none).count() == 0
    assert decontam.contamination(docs, items).where("contaminated").count() == 0
    assert pii.replace_pii(none, "key").count() == 0 and fingerprints.edit_report(none).count() == 0
