import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlpit.functions import identity
from marlpit.operators import crm, ingest, limits, similarity
from marlpit.sources.tables import KeyedTable
from marlpit.streaming import jobs


def test_search_is_literal(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",)], "name string")
    assert [r.name for r in crm.contains_search(df, ["name"], "50%").collect()] == ["50% off"]


def test_phones_and_dates(spark):
    df = spark.createDataFrame([("0412 345 678", "AU"), ("+61412345678", "AU"), ("12", "AU"), ("(212) 555-0101", "US"), ("1", "XX")], "p string, r string")
    assert [r.phone_e164 for r in identity.normalise_phone(df, "p", "r", identity.phone_rules(spark)).collect()] == ["+61412345678", "+61412345678", None, "+12125550101", None]
    values = spark.createDataFrame([(1, 1, "2026-02-30"), (2, 1, "2024-02-29")], "contact_id int, field_id int, value string")
    kinds = spark.createDataFrame([(1, "date", ["a"])], "field_id int, kind string, options array<string>")
    assert {r.contact_id: r.error for r in identity.coerce_fields(values, kinds).collect()} == {1: "not_a_date", 2: None}


LEAD = "id long, workspace_id int, source_system string, external_key string, email string, phone string, first_name string"


def test_ingestion(spark):
    leads = [(1, 1, "w", "a", "x@y.z", None, "A"), (2, 1, "w", "b", "X@y.z ", "0412 345 005", "B"), (3, 1, "w", "c", None, "+61412345005", "C"), (4, 1, "w", "a", "x@y.z", None, "A"), (5, 1, "w", "a", "other@y.z", None, "A"), (6, 2, "w", "a", "x@y.z", None, "A"), (7, 1, "w", "d", "old@y.z", None, "D")]
    contacts = spark.createDataFrame([(100, 1, "old@y.z", None, False, False, False)], "id long, workspace_id int, email string, phone string, is_deleted boolean, is_merged boolean, is_erased boolean")
    receipts = spark.createDataFrame([], "workspace_id int, source_system string, external_key string, digest string, contact_id long")
    got = {r.id: (r.outcome, r.contact_id) for r in ingest.ingest_leads(spark.createDataFrame(leads, LEAD), receipts, contacts).collect()}
    assert got == {1: ("created", -1), 2: ("matched", -1), 3: ("matched", -1), 4: ("duplicate", -1), 5: ("conflict", None), 6: ("created", -6), 7: ("matched", 100)}


def test_burst_log_skips_rejected():
    assert [v[0] for v in limits.sliding_log([0, 1, 2, 10.5, 11.5], 2, 10)] == [True, True, False, True, True]


# Spellings of three numbers, and one that is none.
NUMBERS = {"0412 345 001": "+61412345001", "+61412345001": "+61412345001", "(04) 12345002": "+61412345002", "0412-345-003": "+61412345003", "12": None}


def test_spellings_of_a_number_are_one_key(spark):
    columns = "id long, workspace_id int, region string, email string, phone string, is_deleted boolean, is_merged boolean, is_erased boolean"
    rows = [(1, 1, None, None, "0400 000 000"), (2, 1, "AU", None, "+61400000000"), (3, 1, "AU", None, "0400000000"), (4, 1, "US", None, "0400000000"), (5, 1, "AU", None, "12"), (6, 1, "AU", None, "12"), (7, 1, "US", None, "(212) 555-0101"), (8, 1, "US", None, "+1 212 555 0101")]
    contacts = spark.createDataFrame([(*r, False, False, False) for r in rows], columns)
    assert {(r.id, r.other_id) for r in crm.merge_candidates(contacts).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b} | {(7, 8), (8, 7)}
    digests = {r.id: r.d for r in contacts.select("id", identity.request_digest(["email", "phone", "region"]).alias("d")).collect()}
    assert digests[1] == digests[2] == digests[3] != digests[4] and digests[7] == digests[8]


def test_long_chains_of_leads_match_a_plain_replay(spark):
    """Chains in which every lead shares a key with the one before, in and out of order, a hot key, and keys of stored contacts."""
    own = random.Random(9)
    chain = [(f"e{k}@x.y", f"04000{k + d:05d}") for k in range(300) for d in (0, 1)]
    parts = chain + [tuple(own.choice([None, f"{kind}{own.randrange(40)}@x.y" if kind == "m" else f"0411{own.randrange(40):06d}"]) for kind in "mp") for _ in range(150)] + [("hot@x.y", f"0422{k:06d}") for k in range(80)]
    own.shuffle(parts)
    half = sorted(range(len(parts)), key=lambda k: (k % 3 == 0, parts[k] in chain and chain.index(parts[k])))
    leads = [(n + 1, 1, "w", f"k{n}", *parts[k], "Ann") for n, k in enumerate(half)]
    rows = [(10_000 + k, 1, f"e{own.randrange(300)}@x.y", f"0411{own.randrange(40):06d}", False, False, False) for k in range(6)]
    contacts = spark.createDataFrame(rows, "id long, workspace_id int, email string, phone string, is_deleted boolean, is_merged boolean, is_erased boolean")
    stored, owner, want = {}, {}, {}
    for k, _, mail, phone, *_ in rows:
        for x in (mail, phone):
            stored.setdefault(x, k)
    for k, _, _, _, mail, phone, _ in leads:
        keys = [x for x in (mail, phone) if x]
        found = [stored[x] for x in keys if x in stored] + [owner[x] for x in keys if x in owner]
        kept = [c for c in found if c > 0]
        contact = min(kept) if kept else max(found, default=-k)
        want[k] = ("created" if contact == -k else "matched", contact)
        for x in keys:
            owner.setdefault(x, contact)
    got = ingest.place_leads(spark.createDataFrame(leads, LEAD), ingest.stored_keys(contacts)).collect()
    assert {r.id: (r.outcome, r.contact_id) for r in got} == want and len(got) == len(leads)


def test_leads_in_order_match_a_plain_replay(spark):
    """Random leads of few keys against the rules read one lead at a time."""
    own = random.Random(6)
    pick = lambda *xs: own.choice(xs)
    leads = [(k, 1, "w", f"k{own.randrange(60)}", pick(None, " A@x.y", "a@x.y", "b@x.y", "c@x.y"), pick(None, *NUMBERS), pick("Ann", "ann ", "Bob")) for k in range(1, 91)]
    stored = {"b@x.y": 500, "+61412345003": 501}
    contacts = spark.createDataFrame([(500, 1, "b@x.y", None, False, False, False), (501, 1, None, "+61 412 345 003", False, False, False)], "id long, workspace_id int, email string, phone string, is_deleted boolean, is_merged boolean, is_erased boolean")
    want, seen, owner = {}, {}, {}
    for k, _, _, key, mail, phone, name in leads:
        keys = [x for x in ((mail or "").strip().lower(), NUMBERS.get(phone)) if x]
        digest = (tuple(keys), mail is None, name.strip().lower())
        if key in seen:
            want[k] = ("duplicate", seen[key][1]) if seen[key][0] == digest else ("conflict", None)
            continue
        old = [stored[x] for x in keys if x in stored] + [owner[x] for x in keys if x in owner and owner[x] > 0]
        new = [owner[x] for x in keys if x in owner and owner[x] < 0]
        contact = min(old) if old else max(new) if new else None
        want[k] = ("created", -k) if contact is None else ("matched", contact)
        for x in keys:
            owner.setdefault(x, want[k][1])
        seen[key] = (digest, want[k][1])
    receipts = spark.createDataFrame([], "workspace_id int, source_system string, external_key string, digest string, contact_id long")
    made = ingest.ingest_batch(spark.createDataFrame(leads, LEAD), receipts, contacts)
    got = {r.id: (r.outcome, r.contact_id) for r in made["outcomes"].collect()}
    assert got == want
    again = ingest.ingest_batch(spark.createDataFrame(leads, LEAD), made["receipts"].select(*receipts.columns), contacts)
    assert {o for (o,) in again["outcomes"].select("outcome").distinct().collect()} <= {"duplicate", "conflict"} and again["touches"].count() == 0
    assert ingest.ingest_batch(spark.createDataFrame(leads[:5], LEAD), receipts, contacts, always_create=True)["contacts"].count() == len({x[3] for x in leads[:5]})


@pytest.mark.parametrize("often", [1, 2, 4, 64])
def test_similarities_match_every_pair(spark, often):
    """Shared lines, near copies, short texts and two workspaces against a comparison of all pairs, whatever counts as common."""
    own = random.Random(8)
    word = lambda n=300: f"w{own.randrange(n)}"
    lines = [" ".join(word(10**6) for _ in range(own.randint(3, 30))) for _ in range(4)]
    rows, texts = [], []
    for k in range(90):
        parts = [" ".join(word() for _ in range(own.choice([0, 5, 40, 80])))] + [x for x in lines if own.random() < 0.4]
        if texts and own.random() < 0.3:
            parts = own.choice(texts).split()
            if own.random() < 0.7 and parts:
                parts[own.randrange(len(parts))] = word()
        own.shuffle(parts)
        texts.append(" ".join(parts))
        rows.append((k % 2, k, texts[-1]))
    sets = spark.createDataFrame([(w, k, len(t.split()), sorted({" ".join(t.split()[p : p + 3]) for p in range(len(t.split()) - 2)})) for w, k, t in rows if len(t.split()) > 3], "workspace_id int, id int, n_words int, shingles array<string>")
    classes = {}
    for r in sorted(sets.collect(), key=lambda r: r.id):
        classes.setdefault((r.workspace_id, frozenset(r.shingles)), r.id)
    pairs, best = {}, dict.fromkeys(classes.values(), 0.0)
    for (w, x), a in classes.items():
        for (v, y), b in classes.items():
            if w == v and a < b:
                s = len(x & y) / len(x | y)
                best[a], best[b] = max(best[a], s), max(best[b], s)
                if s >= 0.3:
                    pairs[a, b] = round(s, 6)
    assert {(r.a, r.b): r.similarity for r in similarity.similar_pairs(sets, often=often).collect()} == pairs
    docs, rare, patterns = similarity.shared_parts(sets, often)
    got = similarity.highest_similarities(docs, patterns, similarity.rare_similarities(docs, rare, patterns)).collect()
    assert {r.id: r.near for r in got} == {k: round(s, 6) for k, s in best.items()}


@pytest.mark.parametrize("block", [40, 300, similarity.BLOCK])
def test_overlaps_of_blocks_match_every_pair(spark, block):
    """All pairs over many cells and few: the close ones, and every class's most similar."""
    own = random.Random(block)
    texts = [[own.randrange(60 if k % 2 else 10**6) for _ in range(own.choice([0, 1, 5, 30]))] for k in range(80)]
    texts += [t[:-1] + [own.randrange(10**6)] for t in texts[-20:]]
    rows = [(k % 2, k, [f"run {x}" for x in dict.fromkeys(t)]) for k, t in enumerate(texts)]
    sets = spark.createDataFrame(rows, "workspace_id int, id int, shingles array<string>")
    classes, reps = similarity.hashed_classes(sets)
    firsts = {r.id: r.class_id for r in classes.collect()}
    by_set = {}
    assert firsts == {k: by_set.setdefault((w, frozenset(runs)), k) for w, k, runs in rows}
    kept = [(w, k, set(runs)) for w, k, runs in rows if firsts[k] == k]
    alike = {(w, a, b): (len(x & y), len(x | y)) for w, a, x in kept for v, b, y in kept if w == v and a < b and x & y}
    close = {k: v for k, v in alike.items() if 100 * v[0] >= 30 * v[1]}
    told = lambda rows: {(r.workspace_id, r.a, r.b): (r.both, r.either) for r in rows}
    found = similarity.overlaps(reps, 30, block=block).collect()
    assert len(found) == len(close) and told(found) == close
    near = similarity.overlaps(reps, 30, nearest=True, block=block).collect()
    assert told(near).items() <= alike.items() and close.items() <= told(near).items()
    best = lambda pairs: {k: max(b / e for (_, x, y), (b, e) in pairs.items() if k in (x, y)) for k in {k for _, *ends in pairs for k in ends}}
    assert best(told(near)) == best(alike)


@pytest.mark.parametrize("most", [1, 7])
def test_a_cell_gathers_few_postings_at_once(most):
    """The counts of a cell do not hang on how many posting entries are gathered at once."""
    cell = pa.table({"left": [True, True, False, False], "id": [1, 2, 3, 4], "n": [3, 2, 4, 2], "runs": pa.array([[1, 2, 3], [3, 9], [1, 2, 3, 4], [8, 9]], pa.list_(pa.int64()))})
    pairs = lambda *how: {(x, y, b, e) for x, y, b, e in zip(*(c.tolist() for c in similarity.cell_pairs(cell, *how, most=most)))}
    assert pairs(False, 30, False) == {(0, 2, 3, 4), (1, 3, 1, 3)} and pairs(False, 90, True) == {(0, 2, 3, 4), (1, 3, 1, 3)}
    assert pairs(True, 30, False) == {(0, 2, 3, 4), (1, 3, 1, 3)}


def test_patterns_cost_no_pairs_of_patterns(spark):
    """300 texts, each with half of 40 common runs, have 300 patterns; no pair of these is written (F2)."""
    own = random.Random(2)
    sets = spark.createDataFrame([("w", k, [f"common {x}" for x in own.sample(range(40), 20)] + [f"own {k} {x}" for x in range(400)]) for k in range(300)], "workspace_id string, id int, shingles array<string>")
    _, reps = similarity.hashed_classes(sets)
    assert similarity.overlaps(reps, 30).count() == 0 and similarity.overlaps(reps, 30, nearest=True, block=2000).count() < 300 * 10


def test_duplication_verdicts(spark):
    words = " ".join(f"w{k}" for k in range(60))
    half = " ".join([f"w{k}" for k in range(12)] + [f"u{k}" for k in range(48)])
    rows = [(1, "w", True, words), (2, "w", True, words.replace("w7 ", "zz ")), (3, "w", True, "too short"), (4, "w", True, half), (5, "x", True, words), (6, "y", True, words), (7, "y", True, "short"), (8, "w", False, words), (9, "w", True, words.upper().replace("W1 ", "Ẃ1 "))]
    df = spark.createDataFrame(rows, "id long, workspace_id string, published boolean, text string")
    got = {r.id: r for r in similarity.duplication_verdicts(df).collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "fail", 2: "fail", 3: "indeterminate", 4: "pass", 5: "pass", 6: "indeterminate", 7: "indeterminate", 9: "fail"}
    # Accents and case fold, so 9 is 1; 4 shares 10 of 106 runs with it.
    assert got[1].highest == got[9].highest == 1.0 and abs(got[4].highest - 10 / 106) < 1e-6 and got[5].highest == 0
    assert [m.class_id for m in got[1].matches] == [1, 2] and got[4].matches == []


def test_merge_chains(spark):
    rows = [(k, k - 1) for k in range(1, 200)] + [(0, None), (300, 301), (301, 300), (302, 300), (400, 400)]
    df = spark.createDataFrame(rows, "id long, merged_into long")
    got = {r.id: r.survivor for r in crm.merge_redirects(df).collect()}
    assert got == {**{k: 0 for k in range(1, 200)}, 300: None, 301: None, 302: None, 400: None}


def test_digest_ignores_case_and_blanks(spark):
    rows = [("a@x.y", "1", " Ann", None, "web"), (" A@X.Y", "1", "ann", "", "web"), ("a@x.y", "1", "ann", None, "other"), (None, "1", "ann", None, "web"), ("", "1", "ann", None, "web")]
    df = spark.createDataFrame(rows, "email string, phone string, first_name string, last_name string, source_type string")
    got = [r.d for r in df.select(identity.request_digest(df.columns).alias("d")).collect()]
    assert got[0] == got[1] and got[3] == got[4] and len({*got}) == 3


def test_erasure_leaves_no_trace(spark):
    contacts = spark.createDataFrame([(1, "Ann", "ann@x.y", "1", False, False, False), (2, "Bob", "b@x.y", "2", False, False, False)], "id long, first_name string, email string, phone string, is_deleted boolean, is_merged boolean, is_erased boolean")
    touches = spark.createDataFrame([(1, 1, "g", None, "https://ann.test", "email")], "id long, contact_id long, gclid string, fbclid string, referrer string, utm_medium string")
    deals = spark.createDataFrame([(1, 1, "Deal of Ann"), (2, 2, "Deal of Bob")], "id long, contact_id long, title string")
    work = spark.createDataFrame([(1, 1, None, "Call Ann", "d"), (2, 2, 1, "Ask about Ann", "d"), (3, 2, 2, "Call Bob", "d")], "id long, contact_id long, opportunity_id long, title string, description string")
    acts = spark.createDataFrame([(1, None, None, 1, "Ann came", "x"), (2, None, 1, None, "Deal of Ann", "x"), (3, 2, None, None, "Bob", "x")], "id long, contact_id long, opportunity_id long, touch_id long, summary string, detail string")
    fields = spark.createDataFrame([(1, "Ann's"), (2, "y")], "contact_id long, value string")
    after, log = ingest.apply_erasures({"contacts": contacts, "touches": touches, "opportunities": deals, "tasks": work, "activities": acts, "fields": fields, "tags": fields}, spark.createDataFrame([(1,), (9,)], "id long"))
    columns = {"contacts": ["first_name", "email"], "touches": ["referrer"], "opportunities": ["title"], "tasks": ["title"], "activities": ["summary"], "fields": ["value"], "tags": ["value"]}
    traces = {r.table_name: r.n for r in crm.count_traces({k: (after[k], c) for k, c in columns.items()}, "ann").collect()}
    assert set(traces.values()) == {0} and len(traces) == 8
    assert [tuple(r) for r in log.collect()] == [(1, 1, 1, 2, 2, 1, 1)] and after["touches"].first().utm_medium == "email"
    assert {r.title for r in after["tasks"].collect()} == {"Erased task", "Call Bob"} and after["contacts"].where("id = 2").first().email == "b@x.y"
    assert ingest.apply_erasures({"contacts": after["contacts"], "touches": touches}, spark.createDataFrame([(1,)], "id long"))[1].count() == 0


def test_the_log_of_erasures_is_one_aggregate(spark):
    contacts = spark.createDataFrame([(k, k == 3, False) for k in range(1, 6)], "id long, is_erased boolean, is_merged boolean")
    owned = {name: spark.createDataFrame([(10 * k + n, k) for k in (1, 2, 3) for n in range(k)], "id long, contact_id long") for name in ("touches", "opportunities")}
    fields = spark.createDataFrame([(2, "x"), (5, "y"), (5, "z")], "contact_id long, value string")
    _, log = ingest.apply_erasures({"contacts": contacts, **owned, "fields": fields}, spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (5,), (9,)], "id long"))
    assert log.columns == ["id", "touches", "opportunities", "fields"]
    assert sorted(map(tuple, log.collect())) == [(1, 1, 1, 0), (2, 2, 2, 1), (4, 0, 0, 0), (5, 0, 0, 2)]
    assert "Join LeftOuter" not in log._jdf.queryExecution().optimizedPlan().toString()


def test_imports_run_once(spark):
    rows = spark.createDataFrame([(1, "Ann", "a@x.y"), (2, "", "b@x.y"), (3, "Cy", "nonsense"), (4, "Di", "A@x.y")], "row_number long, Name string, Mail string")
    contacts = spark.createDataFrame([], "id long, workspace_id long, email string, phone string, is_deleted boolean, is_merged boolean, is_erased boolean")
    receipts = spark.createDataFrame([], "workspace_id long, source_system string, external_key string, digest string, contact_id long")
    status, made = ingest.run_import(rows, {"Name": "first_name", "Mail": "email", "Other": "ignore"}, receipts, contacts, 1, "b")
    assert tuple(status.first()) == ("b", 1, 1, 2, "partial")
    again, _ = ingest.run_import(rows, {"Name": "first_name", "Mail": "email"}, made["receipts"].select(*receipts.columns), contacts, 1, "b")
    assert tuple(again.first())[1:3] == (0, 2)


def test_titles_of_deals(spark):
    rows = [("{contact} via {form} ({company})", "Ann", "Form", "Co"), ("{contact}", "", "F", None), ("  ", "a", "f", "c"), ("x" * 300, "a", "f", "c")]
    df = spark.createDataFrame(rows, "t string, c string, f string, k string")
    assert [r.d for r in df.select(ingest.deal_title(F.col("t"), F.col("c"), F.col("f"), F.col("k")).alias("d")).collect()] == ["Ann via Form (Co)", "Website visitor", "Website enquiry", "x" * 200]


def test_ordered_limits_match_a_plain_replay(spark):
    own = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    hits = [(k, own.randrange(3), own.choice("ab"), start + datetime.timedelta(seconds=own.randrange(200))) for k in range(200)]
    df = spark.createDataFrame(hits, "id long, subject long, form string, ts timestamp")

    def replay(key, most, width):
        logs, out = {}, {}
        for k, subject, form, ts in sorted(hits, key=lambda h: (h[3], h[0])):
            log = [t for t in logs.get(key(subject, form), []) if t > ts - datetime.timedelta(seconds=width)]
            out[k] = len(log) < most
            logs[key(subject, form)] = log + [ts] * out[k]
        return out

    assert {r.id: r.allowed for r in limits.burst_verdicts(df, 2, 10.0).collect()} == replay(lambda s, f: (s, f), 2, 10)
    assert {r.id: r.allowed for r in limits.attempt_limits(df, 3, 20.0).collect()} == replay(lambda s, f: s, 3, 20)
    # Ranges of a few rows, so that logs are carried over many of them.
    assert {r.id: r.allowed for r in limits.burst_verdicts(df, 2, 10.0, ranges=40).collect()} == replay(lambda s, f: (s, f), 2, 10)
    assert {r.id: r.allowed for r in limits.attempt_limits(df, 3, 20.0, ranges=40).collect()} == replay(lambda s, f: s, 3, 20)


def test_ranges_do_not_grow_with_the_rows(spark, monkeypatch):
    """What a task holds is a range, so rows make more of them, not larger ones."""
    monkeypatch.setattr(limits, "RANGE_ROWS", 100)
    for n in (500, 4000):
        sizes = limits.in_ranges(spark.range(n).selectExpr("id", "id % 3 as subject"), ["subject"], ["id"]).groupBy("range ").count().collect()
        assert sum(r["count"] for r in sizes) == n and max(r["count"] for r in sizes) < 300


def test_a_hot_key_is_spread_over_ranges(spark):
    """A key with most of all hits, calm at first, over its limit without a pause later; null keys and times."""
    own = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    times = sorted([own.randrange(40_000) for _ in range(1500)] + [40_000 + own.randrange(600) for _ in range(1500)])
    hits = [(k, 1 if k % 10 else k % 70, start + datetime.timedelta(seconds=t)) for k, t in enumerate(times)]
    hits += [(5000 + k, None, start + datetime.timedelta(seconds=k // 3)) for k in range(60)] + [(6000 + k, 1, None) for k in range(5)]
    df = spark.createDataFrame(hits, "id long, subject long, ts timestamp").repartition(5)
    logs, want = {}, {}
    for k, subject, ts in sorted(hits, key=lambda h: (h[2] is not None, h[2] or start, h[0])):
        if ts is None:
            want[k] = (True, 4, 0.0)
            continue
        log = [t for t in logs.get(subject, []) if t > ts - datetime.timedelta(seconds=60)]
        allowed = len(log) < 4
        logs[subject] = log = log + [ts] * allowed
        want[k] = (allowed, 4 - len(log), 0.0 if allowed else (log[0] - ts).total_seconds() + 60)
    got = limits.attempt_limits(df, 4, 60.0, ranges=30).collect()
    known = {r.id: (r.allowed, r.remaining, r.retry_after) for r in got}
    assert len(got) == len(hits) and all(known[k] == want[k] for k in want if k < 6000)
    assert all(known[k][0] for k in range(6000, 6005))
    placed = limits.in_ranges(df.withColumn("at", F.col("ts").cast("double")), ["subject"], ["at", "id"], 30)
    assert placed.where("subject = 1").select("range ").distinct().count() > 20


def test_stage_moves_match_a_plain_replay(spark):
    own = random.Random(2)
    stages, terminal = ["a", "b", "won"], {"won": "deal_won"}
    moves = [(d, m, own.choice(stages), own.choice([None, "a", "b"]), m) for d in range(5) for m in range(12)]
    deals = spark.createDataFrame([(d, "a") for d in range(5)], "deal long, stage string")
    df = spark.createDataFrame(moves, "deal long, move_id long, to_stage string, expected_stage string, ts long")
    want, at = {}, dict.fromkeys(range(5), "a")
    for d, m, to, expected, _ in moves:
        result = "rejected" if expected and expected != at[d] else "no_op" if to == at[d] else terminal.get(to, "stage_changed")
        at[d] = to if result not in ("rejected", "no_op") else at[d]
        want[d, m] = (result, at[d], at[d] in terminal)
    assert {(r.deal, r.move_id): (r.result, r.stage, r.closed) for r in limits.apply_stage_moves(deals, df, terminal).collect()} == want
    # Ranges of a few moves: a deal's stage goes through several of them.
    assert {(r.deal, r.move_id): (r.result, r.stage, r.closed) for r in limits.apply_stage_moves(deals, df, terminal, ranges=15).collect()} == want


def test_moves_compose():
    """Tables and constants of moves against a replay from every stage."""
    own = random.Random(3)
    for _ in range(300):
        moves = [(own.choice("abcd"), own.choice(["a", "b", "c", "x", None][: own.randint(1, 5)])) for _ in range(own.randint(0, 6))]
        ends, constant = limits.compose(moves)
        for start in "abcdxy":
            at = start
            for to, expected in moves:
                at = to if expected in (None, at) else at
            assert (constant if constant is not None else ends.get(start, start)) == at


def run_stream(spark, df, schema, fn, tmp_path, name, mode="append"):
    source = tmp_path / f"{name}-in"
    df.write.parquet(str(source))
    query = fn(spark.readStream.schema(schema).parquet(str(source))).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 10)
    hits = spark.createDataFrame([(k, 1, "f", t + datetime.timedelta(seconds=k)) for k in range(4)], "id long, subject long, form string, ts timestamp")
    out = run_stream(spark, hits, hits.schema, lambda s: jobs.burst_stream(s, 2, 10.0), tmp_path, "burst")
    assert {r.id: r.allowed for r in out.collect()} == {0: True, 1: True, 2: False, 3: False}
    touches = hits.select("id", F.col("subject").alias("contact_id"), F.col("ts").alias("captured_at"))
    out = run_stream(spark, touches, touches.schema, jobs.first_touch_stream, tmp_path, "firsts")
    assert {r.id: r.is_first_touch for r in out.collect()} == {0: True, 1: False, 2: False, 3: False}
    moves = hits.select("id", F.col("subject").alias("deal"), F.col("id").cast("string").alias("stage"), "ts")
    assert [r.stage for r in run_stream(spark, moves, moves.schema, jobs.current_stage, tmp_path, "stages", "update").collect()] == ["3"]


def test_submission_stream_writes_each_key_once(spark, tmp_path):
    rows = [(f"k{k % 5}", k, datetime.datetime(2024, 1, 1, 10)) for k in range(12)]
    schema = "external_key string, id long, ts timestamp"
    source, receipts = str(tmp_path / "in"), str(tmp_path / "receipts")
    for part in (rows[:7], rows[3:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        jobs.ingest_stream(spark.readStream.schema(schema).parquet(source), receipts, str(tmp_path / "one")).awaitTermination()
    # A stream that starts anew finds the receipts of the old one.
    jobs.ingest_stream(spark.readStream.schema(schema).parquet(source), receipts, str(tmp_path / "two")).awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(receipts)
    assert sorted(r.external_key for r in got.collect()) == [f"k{k}" for k in range(5)]


def posted(spark, own, ids, before):
    t = datetime.datetime(2024, 1, 1, 10)
    rows = []
    for k in ids:
        key = own.randrange(20) if own.random() < 0.1 else 1000 + k
        values = {"name": own.choice(["Ann", "Bob"]), "mail": own.choice(["", f"m{own.randrange(25)}@x.y", f"n{k}@x.y"]), "tel": own.choice(["", f"0412 {own.randrange(30):06d}"])}
        if before and own.random() < 0.15:
            key, values = own.choice(before)
        before.append((key, values))
        rows.append((k, "f", f"s{key}", "https://site.test", f"ip{own.randrange(6)}", t + datetime.timedelta(seconds=40 * k), "x" if own.random() < 0.1 else None, 9000, True, values, *[None] * 6))
    return spark.createDataFrame(rows, "id long, form_id string, submission_id string, origin string, ip string, ts timestamp, trap string, elapsed_ms long, challenge_ok boolean, values map<string,string>, gclid string, fbclid string, utm_medium string, utm_source string, utm_campaign string, referrer string")


def test_submission_stream_as_a_whole(spark, tmp_path, monkeypatch):
    """Three batches, one of which is cut short twice, against all submissions in one job; a stream that starts anew adds nothing."""
    forms = spark.createDataFrame([("f", 1, "Form", "active", ["https://site.test"], True, 2, "{contact} via {form}", "p", 100)], "form_id string, workspace_id long, name string, status string, allowed_origins array<string>, honeypot boolean, min_seconds int, title_template string, pipeline_id string, value_minor long")
    fields = spark.createDataFrame([("f", k, k, target, n, 200, "text", False, None) for n, (k, target) in enumerate((("name", "first_name"), ("mail", "email"), ("tel", "phone")))], "form_id string, key string, label string, target string, position int, max_length int, kind string, required boolean, options array<string>")
    tiers = [("ip", ["subject"], 12)]
    own, source, folder = random.Random(11), str(tmp_path / "in"), str(tmp_path / "out")
    before = []
    parts = [posted(spark, own, range(n, n + 40), before) for n in (1, 41, 81)]
    start = lambda checkpoint: jobs.submission_stream(spark.readStream.schema(parts[0].schema).parquet(source), forms, fields, folder, str(tmp_path / checkpoint), "https://app.test", tiers, 4)
    tables, swap, calls = jobs.submission_tables(f"{folder}/tables", 4), KeyedTable.swap, []
    parts[0].write.mode("append").parquet(source)
    start("one").awaitTermination()
    parts[1].write.mode("append").parquet(source)
    for last in (1, 3):

        def failing(self, merged, last=last):
            calls.append(self.path)
            if len(calls) == last:
                raise OSError("cut short")
            swap(self, merged)

        calls.clear()
        monkeypatch.setattr(KeyedTable, "swap", failing)
        with pytest.raises(Exception, match="cut short"):
            start("one").awaitTermination()
    monkeypatch.setattr(KeyedTable, "swap", swap)
    start("one").awaitTermination()
    parts[2].write.mode("append").parquet(source)
    start("one").awaitTermination()
    nobody = spark.createDataFrame([], "id long, workspace_id long, email string, phone string, is_deleted boolean, is_merged boolean, is_erased boolean")
    receipts = spark.createDataFrame([], "workspace_id long, source_system string, external_key string, digest string, contact_id long")
    whole = ingest.process_submissions(parts[0].unionByName(parts[1]).unionByName(parts[2]), forms, fields, receipts, nobody, "https://app.test", tiers)

    def content(df, name):
        ids = {"contacts": ["id"]}.get(name, ["contact_id"] if "contact_id" in df.columns else [])
        return sorted(map(str, df.withColumns({c: F.abs(c) for c in ids}).select(tables[name].columns(df)).collect()))

    def now():
        return {name: content(t.read(spark).drop("bucket"), name) for name, t in tables.items()}

    got = now()
    assert {r.split("outcome=")[1].split(",")[0] for r in got["submissions"]} == {"'created'", "'matched'", "'duplicate'", "'rejected'"}
    for name in ("submissions", "contacts", "touches", "opportunities", "receipts", "activities", "hits"):
        assert got[name] == content(whole[name], name), name
    # The same submissions again, under new batch numbers of another folder of commits.
    jobs.commit_batch(spark, f"{folder}/other", 0, lambda: {n: t.merged(t.read(spark).drop("bucket")) for n, t in tables.items()}, tables)
    assert now() == got


def test_keyed_tables_touch_only_their_buckets(spark, tmp_path):
    import os

    table = KeyedTable(str(tmp_path / "t"), "k long, a string, b string", ("k",), buckets=8)
    rows = lambda *r: spark.createDataFrame(r, "k long, a string, b string")
    write = lambda df, cols=None: table.swap(spark.read.schema(f"{table.schema}, bucket long").parquet(saved(df, cols)))

    def saved(df, cols):
        path = str(tmp_path / f"m{len(os.listdir(tmp_path))}")
        table.merged(df, cols).write.parquet(path)
        return path

    assert table.read(spark).isEmpty()
    write(rows(*[(k, "x", "y") for k in range(40)]))
    files = {f for d, _, names in os.walk(table.path) for f in (os.path.join(d, n) for n in names) if "part-" in f}
    write(rows((3, "new", "new"), (100, "p", "q"), (100, "r", "s")))
    assert {tuple(r)[:3] for r in table.read(spark).where("k in (3, 100)").collect()} == {(3, "x", "y"), (100, "p", "q")}
    write(rows((3, "new", "new"), (101, "t", "u")), ["a"])
    assert {tuple(r)[:3] for r in table.read(spark).where("k in (3, 101)").collect()} == {(3, "new", "y"), (101, "t", "u")} and table.read(spark).count() == 42
    kept = [f for f in files if os.path.exists(f)]
    assert 0 < len(kept) < len(files)


def test_window_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 10)
    rows = [(k, k % 2, "accepted" if k % 3 else "rejected", "e", 1, t + datetime.timedelta(minutes=30 * k)) for k in range(6)]
    df = spark.createDataFrame(rows, "id long, subject long, outcome string, name string, workspace_id long, ts timestamp")
    for name, fn, want in (("hits", jobs.window_hits, 6), ("funnel", jobs.funnel, 6), ("events", jobs.event_counts, 6)):
        out = run_stream(spark, df, df.schema, fn, tmp_path, name, "complete")
        total = out.agg(F.sum("hits" if name == "hits" else "n")).first()[0] if name != "funnel" else out.agg(F.sum(F.col("captured") + F.col("rejected"))).first()[0]
        assert total == want
