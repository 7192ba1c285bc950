"""Unit fixtures of the reference operators: values that the semantics notes fix."""

import json
import shutil

from pyspark.sql import functions as F

from tallywright.functions import columns as C
from tallywright.operators import identity, merge, rollups, snapshots, status
from tallywright.sources import documents, paged, pages
from tallywright.streaming import ingest


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_years(spark):
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in ["2020", " 2020 ", "2020.0", "N/A", "NA", "?", "", None, "2999"]], "v string").select(C.citation_year(F.col("v")), C.publication_year(F.col("v"), 2025)).collect()]
    assert got == [(2020, 2020), (2020, 2020), (None, None), (None, None), (None, None), (None, None), (None, None), (None, None), (2999, None)]


def test_text_and_ids(spark):
    r = one(
        spark,
        a=C.normal_text(F.lit(" A  B　c\u001cD\t")),
        b=C.ids_in_url(F.lit("/s?cites=12,,34&x=1")),
        c=C.ids_in_url(F.lit("/s?q=1")),
        d=C.cluster_in_url(F.lit("info:abc:scholar.google.com")),
        e=C.author_in_url(F.lit("http://x/c?user=QQ&hl=en")),
        f=C.identity_keys(F.lit(" 5 "), F.lit("T"), F.lit("N/A"), F.lit("X")),
        g=C.identity_keys(F.lit(None).cast("string"), F.lit("T"), F.lit(""), F.lit("X")),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == ("a b c d", "12,34", None, "abc", "QQ")
    assert (r.f, r.g) == (["id:5", "meta:t|n/a"], ["meta:t|x"])


def test_paging_and_policy(spark):
    r = one(spark, a=C.page_start(F.lit(13)), b=C.page_start(F.lit(-3)), c=C.with_start(F.lit("/s?x=1&start=10"), F.lit(20)), d=C.with_start(F.lit("/s"), F.lit(20)), e=C.fetch_policy(F.lit(60), F.lit(2020)), f=C.resume_state(F.lit(5), F.lit(4), F.lit("u")))
    assert (r.a, r.b, r.c, r.d, r.e.strategy, r.e.reason, r.f) == (10, 0, "/s?x=1&start=20", "/s?start=20", "year", "at_or_above_year_threshold", None)


def dedup(spark, rows, seeds=None):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(rows)], "g long, pos long, keys array<string>")
    return [(r.pos, r.existing_pos) for r in identity.greedy_dedup(df, ["g"], "pos", "keys", seeds).orderBy("pos").collect() if not r.is_dupe], df


def test_greedy_dedup_is_not_transitive(spark):
    kept, df = dedup(spark, [["i1", "m1"], ["i1", "m2"], ["i2", "m2"]])
    assert [p for p, _ in kept] == [0, 2]
    assert sorted(r.pos for r in identity.greedy_dedup_native(df, ["g"], "pos", "keys").collect()) == [0, 2]
    assert [p for p, _ in dedup(spark, [["i1", "m1"], ["i2", "m1"], ["i2", "m3"]])[0]] == [0, 2]
    seeds = spark.createDataFrame([(1, "m1")], "g long, key string")
    assert [p for p, _ in dedup(spark, [["i1", "m1"], ["i1"]], seeds)[0]] == [1]


def test_overlay_and_buckets(spark):
    schema = "e long, pos long, keys array<string>, url string"
    base = spark.createDataFrame([(1, 0, ["m:a"], "old"), (1, 1, ["i:2", "m:b"], "keep")], schema)
    fresh = spark.createDataFrame([(1, 0, ["i:1", "m:a"], "new"), (1, 1, ["i:9"], "added")], schema)
    got = [(r.side, r.pos, r.url) for r in merge.overlay(base, fresh, ["e"]).orderBy("side", "pos").collect()]
    assert got == [(0, 0, "new"), (0, 1, "keep"), (1, 1, "added")]
    base = spark.createDataFrame([(1, 0, 2024, "a"), (1, 1, 2023, "b"), (1, 2, None, "c")], "e long, pos long, year int, t string")
    fresh = spark.createDataFrame([(1, 0, 2024, "x"), (1, 1, None, "y")], base.schema)
    got = [r.t for r in merge.replace_buckets(base, fresh, ["e"], fresh.select("e", "year").distinct()).orderBy("side", "pos").collect()]
    assert got == ["b", "x", "y"]


def test_status_and_plan(spark):
    r = one(
        spark,
        a=status.year_action(F.lit(0), F.lit(None).cast("int")),
        b=status.year_action(F.lit(None).cast("int"), F.lit(0)),
        c=status.year_action(F.lit(27), F.lit(28), "exact"),
        d=status.candidate_years(F.create_map(F.lit(1), F.lit(2)), F.create_map(F.lit(1), F.lit(2)), F.array(F.lit(1)), F.array().cast("array<int>")),
        e=status.candidate_years(F.create_map(F.lit(1), F.lit(2)), F.lit(None).cast("map<int,int>"), F.array(F.lit(1)), F.array().cast("array<int>")),
        h=status.candidate_years(F.create_map(F.lit(1), F.lit(2)), F.create_map().cast("map<int,int>"), F.array(F.lit(1)), F.array().cast("array<int>")),
        i=status.candidate_years(F.create_map(F.lit(2021), F.lit(2)), F.create_map(F.lit(2020), F.lit(1)), F.sequence(F.lit(2019), F.lit(2022)), F.array(F.lit(2022), F.lit(1999))),
        f=status.is_complete(F.lit("year"), F.lit(10), F.lit(10), F.lit(99)),
        g=status.start_year(F.lit(2024), F.lit(False), F.lit(2021), F.lit(None).cast("int"), F.lit(None).cast("int")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("seen_total_match_skip", "fetch", "fetch", [], None, True, 2021)
    assert (r.h, r.i) == (None, [2020, 2022])


def test_gap_and_snapshots(spark):
    basics = spark.createDataFrame([(8035, {"2015": 100, "2016": 200, "2026": 7658})], "citedby long, cites_per_year map<string,long>")
    r = rollups.histogram_gap(basics).first()
    assert (r.year_table_total_citations, r.year_table_gap, r.year_table_matches_total) == (7958, 77, False)
    now = spark.createDataFrame([("Old", 12), ("New", 3)], "t string, n long")
    before = spark.createDataFrame([("Old", 10)], "t string, n long")
    r = snapshots.change_record(now, before, "t", "n").first()
    assert (r.new_items, r.changed_items) == (["New"], ["Old:10>12"])


def test_documents(spark, tmp_path):
    state = {"title": "T", "complete": True, "num_citations_on_scholar": "7", "year_fetch_diagnostics": {"summary": {"histogram_total": 4, "seen_total": 3}}, "year_records": {"2020": {"histogram_count": 2, "cached_total": 1}, "bad": {}}}
    doc = {"author_id": "A", "papers": [{"pub": {"title": "T"}, "citations": [{"title": "x"}], "_fetch_state": state}, {"pub": {"title": ""}}, {"pub": {"title": "T"}, "citations": [], "_fetch_state": state}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("{ nonsense")
    outputs = documents.read_json(spark, str(tmp_path), documents.OUTPUT)
    rows = documents.fetch_states(outputs).collect()
    assert len(rows) == 1
    s = rows[0].state
    assert (s.complete_fetch_attempt, s.num_citations_on_scholar, s.year_fetch_diagnostics.histogram_total, s.year_fetch_diagnostics.cached_total) == (True, 7, 4, 0)
    assert [(y.year, y.histogram_count) for y in s.year_records] == [(2020, 2)]
    assert documents.read_json(spark, str(tmp_path / "none"), documents.PROFILE).count() == 0


def test_pages(spark):
    html = '<a data-year="1989" data-count="3"></a><a data-year="1990" data-count="2"></a><a data-year="2024" data-count="x"></a><a data-year="2030" data-count="1"></a><a href="/s?as_ylo=2001&as_yhi=2001"></a><a href="/s?as_ylo=2005"></a>'
    r = one(spark, h=pages.histogram(F.lit(html), 2025), e=pages.link_years(F.lit(html), True), a=pages.link_years(F.lit(html), False), s=pages.snippet_years(F.lit("in 1999, 2031 and 12005"), 2025))
    assert (r.h, r.e, r.a, r.s) == ({1990: 2}, [2001], [2001, 2005], [1999])


def test_histogram_bars(spark):
    html = '<a data-year="2001" data-count="5"></a><a data-year="2002"></a><a data-year="2001" data-count="3"></a>'
    r = one(spark, h=pages.histogram(F.lit(html), 2025), z=pages.usable_histogram(F.lit('<a data-year="2001" data-count="0"></a>'), 2025))
    assert (r.h, r.z) == ({2001: 3, 2002: 0}, None)


def test_nested_result_blocks(spark):
    html = 'x<div class="gs_r gs_or"><div>in</div><p>a</p></div>\n<div class="gs_r">no</div><div id="k" class="gsc_mpat_ttl y">b<br>'
    rows = pages.result_rows(spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "page_id long, html string")).orderBy("pos").collect()
    assert [(r.page_id, r.pos, r.block) for r in rows] == [(1, 0, "<div>in</div><p>a</p>"), (1, 1, "b<br>")]


def test_scan_resumes_on_its_page(spark):
    rows = paged.pages_of(spark.range(25).select(F.lit("p").alias("e"), F.col("id")), ["e"], F.col("id"))
    resume = spark.createDataFrame([("p", 13)], "e string, next_index int")
    got = paged.scan(rows, ["e"], resume).orderBy("id").collect()
    assert [r.id for r in got] == list(range(13, 25)) and {r.start for r in got} == {10, 20} and [r.id for r in got if r.page_end] == [19, 24]


def test_legacy_status_ladder(spark):
    none = F.lit(None).cast("long")
    two = lambda a, b: F.struct(F.lit(a).cast("long").alias("total"), F.lit(b).cast("long").alias("seen"))
    empty = two(None, None)
    status_of = lambda strategy, y, p, d, counter, rows, current=60: status.legacy_status(F.lit(current), F.lit(strategy), y, p, d, counter, F.lit(rows))
    r = one(
        spark,
        a=status_of("year", two(10, 10), empty, empty, none, 3),
        b=status_of("year", two(None, None), two(10, 9), empty, none, 99),
        c=status_of("direct", empty, empty, two(5, 4), none, 99, 5),
        d=status_of("direct", empty, empty, empty, F.lit(7), 3, 7),
        e=status_of("direct", empty, empty, empty, none, 3, 7),
    )
    assert tuple(r) == ("complete", "partial", "partial", "complete", "partial")


def test_documents_are_swapped(spark, tmp_path):
    path = f"file://{tmp_path}/doc"
    for text in ("one", "two"):
        df = spark.createDataFrame([(text,)], "t string") if text == "one" else spark.read.json(path).withColumn("t", F.lit(text))
        documents.swap(df, path)
        assert [r.t for r in spark.read.json(path).collect()] == [text] and sorted(x.name for x in tmp_path.iterdir()) == ["doc"]


def test_stream_restarts(spark, tmp_path):
    """New files after a restart merge once, a replayed batch changes nothing, and a late year replaces what was held."""
    def land(name, rows):
        spark.createDataFrame(rows, "id long, pos long, year long, v string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{name}.parquet")

    def run(make, name, *args):
        return make(ingest.landed(spark, f"file://{tmp_path}/in", name), f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}.state", *args)

    land("a", [(1, 1, 0, "x"), (2, 1, 0, "y")])
    assert run(ingest.merge_batches, "a", ["id"], "pos").count() == 2
    land("a", [(1, 2, 0, "z"), (3, 1, 0, "w"), (2, 0, 0, "old")])
    for _ in range(2):
        assert {(r.id, r.v) for r in run(ingest.merge_batches, "a", ["id"], "pos").collect()} == {(1, "z"), (2, "y"), (3, "w")}
    shutil.rmtree(f"{tmp_path}/a.state/commits")  # the last batch was not committed: it is done again
    assert {(r.id, r.v) for r in run(ingest.merge_batches, "a", ["id"], "pos").collect()} == {(1, "z"), (2, "y"), (3, "w")}
    land("b", [(1, 1, 2001, "p"), (1, 2, 2002, "q")])
    run(ingest.replace_years, "b", ["id"])
    land("b", [(1, 3, 2001, "late"), (1, 4, None, "none")])
    assert sorted(r.v for r in run(ingest.replace_years, "b", ["id"]).collect()) == ["late", "none", "q"]
    rows = [(1, k, 0, k % 4) for k in range(8)]
    for name, part in (("c", rows[:5]), ("c", rows[5:])):
        land(name, [(a, b, c, str(d)) for a, b, c, d in part])
        stream = ingest.landed(spark, f"file://{tmp_path}/in", "c").withColumn("keys", F.array("v"))
        ingest.drain(ingest.stream_dedup(stream, "id", "pos", "keys"), f"file://{tmp_path}/c", f"file://{tmp_path}/c.state")
    assert sorted(r.pos for r in spark.read.parquet(f"file://{tmp_path}/c").collect()) == [0, 1, 2, 3]
