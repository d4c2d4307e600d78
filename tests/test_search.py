import random

from pyspark.sql import functions as F

from marlpit.operators import quality, search
from marlpit.sources import tables


def test_indexed_search_finds_what_a_scan_finds(spark):
    rng = random.Random(3)
    letters = ["a", "B", "b", "%", "_", "ü", "Ü", "ß", "😀", " "]
    word = lambda n: "".join(rng.choices(letters, k=n))
    rows = [(k, rng.choice([None, "", word(rng.randrange(12))]), word(rng.randrange(30)), "clash") for k in range(300)] + [(300, "same aab", "same aab", "x"), (301, None, None, "x"), (302, "ab" * 3000, None, "x")]
    df = spark.createDataFrame(rows, "id int, name string, mail string, gram string")
    terms = [word(n) for n in (1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 6) for _ in range(4)] + ["", None, "zzz", "AAB", "aab", "ab" * 50, "same aab"]
    found = search.search_terms(df, search.gram_index(df, "id", ["name", "mail"]), "id", ["name", "mail"], spark.createDataFrame([(t,) for t in terms], "term string"))
    # Lower case as the engine has it, so that both sides fold alike.
    low = lambda s: s.lower() if s else ""
    want = {(low(t), r[0]) for t in terms if t for r in rows if low(t) in low(r[1]) or low(t) in low(r[2])}
    got = [(r.term, r.id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_many_terms_read_their_own_rows(spark, tmp_path):
    """Terms of common grams: what is joined grows with the rows found, not with terms times posting lists (F1)."""
    df = spark.range(3000).select("id", F.format_string("customer#%09d", "id").alias("name"))
    index = tables.shared_table(search.gram_index(df, "id", ["name"]))
    ends = df.select(F.expr("right(name, 5)").alias("term"))
    terms = ends.unionByName(df.select(F.col("name").alias("term")))
    found = search.search_terms(df, index, "id", ["name"], terms).cache()
    want = {(r.name[-5:], r.id) for r in df.collect()} | {(r.name, r.id) for r in df.collect()}
    names = [(r.id, r.name) for r in df.collect()]
    assert {(t, k) for t, k in found.collect()} == want | {(n[-5:], k) for k, m in names for j in range(len(m) - 4) if (n := m[j : j + 5]).isdigit() and int(n) < 3000 and n in m}
    # Joined rows as counted by the engine.
    joined = search.looked_up(index, terms.distinct())
    assert joined.count() < 3 * found.count()


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "id int, name string")
    index = search.gram_index(df, "id", ["name"])
    assert search.search_terms(df, index, "id", ["name"], spark.createDataFrame([("abc",)], "term string")).count() == 0


def test_index_reads_only_its_grams(spark, tmp_path):
    df = spark.range(500).select("id", F.concat(F.lit("row "), "id").alias("name"))
    search.gram_index(df, "id", ["name"]).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    plan = index.where(F.col("gram").isin("row", "ow "))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [In(gram" in plan
    assert index.where("gram = 'w 1'").count() == 111


def test_outcomes_name_their_own_record(spark):
    rows = [
        (1, 1, "contact_created", 5, None, None), (2, 1, "contact_created", 5, 6, None), (3, 1, "acquisition_recorded", None, 6, None), (4, 1, "opportunity_won", None, None, 7), (5, 1, "opportunity_won", 5, None, 7),
        (6, 1, "opportunity_created", None, None, None), (7, 1, "viewed", 5, None, None), (8, 2, "opportunity_stage_changed", None, None, 7), (9, 3, None, None, None, None),
    ]
    events = spark.createDataFrame(rows, "id int, output_id int, outcome string, contact_id int, acquisition_id int, opportunity_id int")
    outputs = spark.createDataFrame([(1, True), (2, False)], "id int, published boolean")
    got = sorted((r.id, r.violation) for r in quality.outcome_violations(events, outputs).collect())
    assert got == [(2, "target_contradicts_outcome"), (5, "target_contradicts_outcome"), (6, "target_contradicts_outcome"), (7, "target_contradicts_outcome"), (8, "unpublished_output"), (9, "missing_output"), (9, "target_contradicts_outcome")]


def test_crawl_rules_keep_what_is_null(spark):
    crawl = "status string, started_at int, completed_at int, failure_category string, page_limit int, max_depth int, pages_discovered int, pages_fetched int, pages_failed int, pages_skipped int, bytes_downloaded long, sitemap_url_count int"
    rows = [("queued", None, None, None, 1, 20, 0, 0, 0, 0, 0, 0), ("running", None, None, None, 0, 1, 0, 0, 0, 0, 0, -1), ("failed", 1, 2, None, 10000, 1, 0, 0, 0, 0, 0, 0), ("completed", 1, None, None, 10, 21, 0, 0, 0, 0, None, 0), ("paused", 1, 1, None, None, None, 0, 0, 0, 0, 0, 0)]
    got = {r.rule: r.n for r in quality.check_rows(spark.createDataFrame(rows, crawl), quality.crawl_rules()).collect()}
    assert got == {"budget_out_of_bounds": 2, "ended_without_completed_at": 2, "running_without_started_at": 1, "failed_without_category": 1, "counter_below_zero": 1}
    pages = spark.createDataFrame([(None,) * 3, ("", 5, 4), ("u" * 2049, 1, 1), ("u", 1, 2)], "normalised_url string, first_seen_at int, last_seen_at int")
    assert {r.rule: r.n for r in quality.check_rows(pages, quality.site_page_rules()).collect()} == {"page_url_out_of_bounds": 2, "seen_range_reversed": 1}
