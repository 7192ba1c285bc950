"""Queries of landed sources, documents, reports and streams, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions import columns as C
from tallywright.operators import reports, rollups, snapshots, status
from tallywright.plans.catalog import CACHED, CITES, HIST, Tables, _records, query
from tallywright.sources import documents, paged, pages
from tallywright.streaming import ingest

PAGED = f"{CITES}, pg AS (SELECT cust, pos AS id, year, row_number() OVER (PARTITION BY cust ORDER BY pos) - 1 AS i FROM cites), py AS (SELECT cust, pos AS id, year, row_number() OVER (PARTITION BY cust, year ORDER BY pos) - 1 AS i FROM cites)"


def _pages(t: Tables, group: list[str]) -> DataFrame:
    rows = t.cites().select("cust", "year", F.col("pos").alias("id"))
    return paged.pages_of(rows, group, F.col("id"))


@query(f"WITH {PAGED} SELECT cust, id, i // 10 * 10 AS start, i AS index, i = max(i) OVER (PARTITION BY cust, i // 10) AS page_end FROM pg WHERE CASE WHEN cust % 2 = 0 THEN i >= 13 ELSE true END")
def paged_scan(spark, d):
    t = Tables(spark, d)
    resume = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("cust"), F.lit(13).alias("next_index"))
    return paged.scan(_pages(t, ["cust"]), ["cust"], resume).select("cust", "id", "start", "index", "page_end")


@query(f"WITH {HIST}, py AS (SELECT cust, pos AS id, year, row_number() OVER (PARTITION BY cust, year ORDER BY pos) - 1 AS i FROM cites) SELECT py.cust, py.year, id, i AS index, i = max(i) OVER (PARTITION BY py.cust, py.year, i // 10) AS page_end FROM py JOIN hist h ON h.cust = py.cust AND h.year = py.year LEFT JOIN sy s ON s.cust = py.cust AND s.year = py.year WHERE coalesce(s.n, 0) < h.n")
def paged_year_scan(spark, d):
    t = Tables(spark, d)
    both = t.histogram().join(t.seen_years().withColumnRenamed("n", "seen"), ["cust", "year"], "left")
    plan = both.withColumn("action", status.year_action(F.col("n"), F.col("seen")))
    return paged.scan_years(_pages(t, ["cust", "year"]), ["cust"], plan).select("cust", "year", "id", "index", "page_end")


@query(r"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'N/A' ELSE 'T' || event_id END AS title, 'A' || (user_id % 9) || ', ' || event_type AS authors, CASE WHEN event_id % 7 = 0 THEN 'N/A' ELSE event_type END AS venue, CASE event_id % 4 WHEN 0 THEN '2001' WHEN 1 THEN CAST(1990 + event_id % 30 AS VARCHAR) WHEN 2 THEN '2001' ELSE '2001' END AS year, CASE WHEN event_id % 3 = 0 THEN 'p' || event_id WHEN event_id % 3 = 1 THEN 'e' || event_id ELSE 'N/A' END AS url, CASE event_id % 4 WHEN 0 THEN 'own' WHEN 1 THEN event_id || ',' || user_id WHEN 2 THEN 'c' || event_id END AS cites_id FROM events")
def citation_rows(spark, d):
    e, s = F.col("event_id"), F.col("event_id").cast("string")
    year = F.when(e % 4 == 0, " N/A").when(e % 4 == 1, (F.lit(1990) + e % 30).cast("string")).when(e % 4 == 2, "?")
    bib = F.struct(F.when(e % 5 != 0, F.concat(F.lit("T"), s)).alias("title"), F.array(F.concat(F.lit("A"), (F.col("user_id") % 9).cast("string")), "event_type").alias("author"), F.when(e % 7 != 0, F.col("event_type")).alias("venue"), year.alias("pub_year"))
    raw = F.struct(
        bib.alias("bib"),
        F.when(e % 3 == 0, F.concat(F.lit("p"), s)).alias("pub_url"),
        F.when(e % 3 == 1, F.concat(F.lit("e"), s)).alias("eprint_url"),
        F.when(e % 4 == 0, " own ").otherwise("").alias("cites_id"),
        F.when(e % 4 == 1, F.concat(F.lit("/s?cites="), s, F.lit(",,"), F.col("user_id").cast("string"))).otherwise("/s?q=1").alias("citedby_url"),
        F.when(e % 4 == 2, F.concat(F.lit("q=info:c"), s, F.lit(":scholar.google.com/"))).alias("url_scholarbib"),
    )
    return Tables(spark, d).events.select("event_id", C.citation_row(raw, F.lit(2001)).alias("r")).select("event_id", "r.*")


@query("SELECT p_partkey AS no_key, p_partkey + 1 AS no, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN '19' || (50 + p_size) ELSE '' END AS year, CASE p_partkey % 3 WHEN 0 THEN 'cit' WHEN 1 THEN p_brand ELSE p_type END AS venue, 'A; B' AS authors, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS num_citations, CASE WHEN p_partkey % 4 = 0 THEN 'u' ELSE 'e' END AS url FROM part")
def raw_publications(spark, d):
    k = F.col("p_partkey")
    bib = F.struct(F.col("p_name").alias("title"), F.when(k % 2 == 0, F.concat(F.lit("19"), (F.col("p_size") + 50).cast("string"))).alias("pub_year"), F.when(k % 3 == 0, "cit").alias("citation"), F.when(k % 3 == 1, F.col("p_brand")).alias("venue"), F.col("p_type").alias("journal"), F.array(F.lit("A"), F.lit("B")).alias("author"))
    raw = Tables(spark, d).part.select(k.alias("pos"), bib.alias("bib"), F.when(k % 5 == 0, "many").otherwise(F.col("p_size").cast("string")).alias("num_citations"), F.when(k % 4 == 0, "u").alias("pub_url"), F.lit("e").alias("eprint_url"), F.lit(None).cast("string").alias("citedby_url"))
    out = documents.raw_publication(raw)
    return out.select((F.col("no") - 1).alias("no_key"), "no", "title", "year", "venue", "authors", F.col("num_citations").cast("int").alias("num_citations"), "url")


@query(f"WITH {HIST} SELECT c_custkey AS cust, CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE c_name END AS name, (SELECT count(*) FROM cites c WHERE c.cust = c_custkey) AS citedby, coalesce((SELECT n FROM hist h WHERE h.cust = c_custkey AND h.year = 1996), 0) AS citedby_this_year FROM customer")
def author_basics(spark, d):
    t = Tables(spark, d)
    counts = rollups.year_count_map(t.cites().withColumn("year", F.col("year").cast("string")), ["cust"]).withColumnRenamed("counts", "cites_per_year")
    rows = t.customer.select(F.col("c_custkey").alias("cust"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("affiliation"))
    rows = rows.join(counts, "cust", "left").join(t.cites().groupBy("cust").agg(F.count("*").alias("citedby")), "cust", "left")
    return documents.author_basics(rows, 1996).select("cust", "name", "citedby", "citedby_this_year")


@query(f"WITH {HIST}, b AS (SELECT c_nationkey AS nation, h.year, sum(h.n) AS n FROM hist h JOIN customer ON c_custkey = h.cust GROUP BY ALL), t AS (SELECT nation, sum(n)::BIGINT AS t FROM b GROUP BY 1), p AS (SELECT c_nationkey AS nation, count(*) AS k FROM customer GROUP BY 1) SELECT nation, CAST(k AS VARCHAR) AS total_publications, CAST(t + nation AS VARCHAR) AS total_citations, CAST(nation AS VARCHAR) AS gap, CASE WHEN nation = 0 THEN 'true' ELSE 'false' END AS matches, (SELECT min(c_name) FROM customer WHERE c_nationkey = nation) AS first_title FROM t JOIN p USING (nation)")
def profile_document(spark, d):
    t = Tables(spark, d)
    own = t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_name").alias("title"))
    rows = t.cites().join(own, "cust")
    counts = rollups.year_count_map(rows.withColumn("year", F.col("year").cast("string")), ["nation"]).withColumnRenamed("counts", "cites_per_year")
    basics = rows.groupBy("nation").agg((F.count("*") + F.col("nation")).alias("citedby")).join(counts, "nation")
    pubs = snapshots.rank(own.withColumn("num_citations", F.lit(0).cast("bigint")), ["nation"], "num_citations", "title").withColumn("no", F.col("no").cast("bigint")).drop("cust")
    get = lambda path: F.get_json_object("document", path)
    made = reports.profile_document(basics, pubs, ["nation"])
    return made.select(F.col("nation").cast("int").alias("nation"), get("$.total_publications").alias("total_publications"), get("$.total_citations").alias("total_citations"), get("$.citation_count_summary.year_table_gap").alias("gap"), get("$.citation_count_summary.year_table_matches_total").alias("matches"), get("$.publications[0].title").alias("first_title"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(7 AS BIGINT) ELSE user_id END AS scholar_total, CASE WHEN event_id % 3 = 0 THEN CAST(5 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS cached_total, CAST(9 AS BIGINT) AS seen_total FROM events")
def entry_state(spark, d):
    big = lambda v: F.lit(v).cast("bigint")
    stored = F.struct(big(7).alias("scholar_total"), big(5).alias("cached_total"), big(9).alias("seen_total"))
    total = F.when(F.col("event_id") % 3 != 0, F.col("user_id"))
    return Tables(spark, d).events.select("event_id", reports.entry_state(stored, total, big(2)).alias("s")).select("event_id", "s.*")


@query(f"WITH {HIST}, b AS (SELECT c_nationkey AS nation, h.year, sum(h.n)::BIGINT AS n FROM hist h JOIN customer ON c_custkey = h.cust GROUP BY ALL) SELECT nation, year, n AS citations FROM b")
def overview_years(spark, d):
    t = Tables(spark, d)
    rows = t.cites().join(t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation")), "cust")
    basics = rollups.year_count_map(rows, ["nation"]).withColumnRenamed("counts", "cites_per_year")
    return reports.overview_years(basics)


@query("SELECT p_partkey AS no, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'N/A' ELSE CAST(p_size AS VARCHAR) END AS year, coalesce(nullif(p_brand, ''), 'N/A') AS venue, 'N/A' AS authors, 'N/A' AS url FROM part")
def publications_sheet(spark, d):
    rows = Tables(spark, d).part.select(F.col("p_partkey").alias("no"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 1, F.col("p_size").cast("string")).otherwise("").alias("year"), F.col("p_brand").alias("venue"), F.lit("").alias("authors"), F.lit(None).cast("string").alias("url"))
    return reports.publications_sheet(rows)


@query("WITH a AS (SELECT c_nationkey AS nation, list(c_name ORDER BY c_name) AS ts, count(*) FILTER (c_custkey % 3 = 0) AS k FROM customer GROUP BY 1) SELECT nation, array_to_string(ts[1:3], '; ') || CASE WHEN len(ts) > 3 THEN ' ... (+' || (len(ts) - 3) || ')' ELSE '' END AS new_titles, CAST(len(ts) AS INT) AS n_new, CAST(k AS INT) AS n_changed, '2024-05-06 07:08:09' AS shown FROM a")
def history_sheet(spark, d):
    rows = Tables(spark, d).customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_list("c_name").alias("new_papers"), F.collect_list(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey"))).alias("changed_citations"))
    return reports.history_sheet(rows).select("nation", "new_titles", "n_new", "n_changed", C.display_time(F.lit("2024-05-06T07:08:09.123")).alias("shown"))


@query("SELECT page_id, CAST(k AS INT) AS pos, 'http://base/p' || page_id || '-' || k AS link, CASE WHEN k = 1 THEN NULL ELSE 'Author ' || k END AS authors FROM pages, range(0, 3) r(k) WHERE k <= page_id % 3")
def html_result_rows(spark, d):
    """Synthetic pages: up to three results with nested divs, in both kinds of block, the last one not closed."""
    i = F.col("page_id").cast("string")

    def block(k: int, kind: str, end: str):
        gray = F.lit("" if k == 1 else f'<div class="gs_gray"> <b>Author</b> {k}</div><div class="gs_gray">venue</div>')
        return F.concat(F.lit(f'<div class="{kind}"><div class="in"><div>x</div></div><h3><a class="gsc_a_at" href="/p'), i, F.lit(f'-{k}">t</a></h3>'), gray, F.lit(end))

    parts = [block(0, "gs_r gs_or gs_scl", "</div><div class='gs_r'>no row</div>"), block(1, "more gsc_mpat_ttl", "</div>"), block(2, "gs_or gs_r", "")]
    html = F.concat(F.lit("<html><body><div class='list'>"), *(F.when(F.col("page_id") % 3 >= k, p).otherwise("") for k, p in enumerate(parts)))
    rows = pages.result_rows(Tables(spark, d).pages.select("page_id", html.alias("html")))
    return rows.select("page_id", "pos", pages.title_link(F.col("block"), "http://base").alias("link"), pages.block_authors(F.col("block")).alias("authors"))


@query(f"WITH {HIST}, b AS (SELECT cust, min(year) FILTER (n > 0) AS low, sum(n)::BIGINT AS t, string_agg(year || ':' || n, ',' ORDER BY year) AS counts FROM hist WHERE year <> 1994 GROUP BY 1) SELECT cust, counts, CAST(CASE WHEN cust % 2 = 0 THEN low ELSE least(low, 1991) END AS INT) AS start_year, CASE WHEN cust % 3 = 0 THEN 'none' ELSE counts END AS usable FROM b")
def html_histogram(spark, d):
    """Synthetic pages with the bars of each customer's orders, one year given twice and years out of range."""
    t = Tables(spark, d)
    bar = F.concat(F.lit('<a class="gs_hist_g_a" data-year="'), F.col("year").cast("string"), F.lit('" data-count="'), F.col("n").cast("string"), F.lit('"></a>'))
    rows = t.histogram().where("year <> 1994").groupBy("cust").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", bar.alias("bar")))), lambda b: b["bar"]), "").alias("bars"), F.min("year").alias("low"))
    twice = F.concat(F.lit('<a data-year="'), F.col("low").cast("string"), F.lit('" data-count="99"></a><a data-year="1889" data-count="3"></a><a data-year="2090" data-count="3"></a><a data-year="bad" data-count="3"></a>'), F.col("bars"))
    found = pages.histogram(F.col("html"), 2025)
    zero = F.regexp_replace("html", 'data-count="[0-9]+"', "")
    none = F.lit(None).cast("int")
    start = status.start_year(F.array_min(F.map_keys("h")), F.col("cust") % 2 == 0, F.lit(1991), none, none)
    rows = rows.withColumn("html", twice).withColumn("h", found)
    usable = pages.usable_histogram(F.when(F.col("cust") % 3 == 0, zero).otherwise(F.col("html")), 2025)
    return rows.select("cust", C.counts_text(F.col("h")).alias("counts"), start.cast("int").alias("start_year"), F.coalesce(C.counts_text(usable), F.lit("none")).alias("usable"))


@query("SELECT doc_id, substr(text, 1, 50) AS label FROM documents")
def label_prefix(spark, d):
    return Tables(spark, d).documents.select("doc_id", C.label(F.col("text")).alias("label"))


@query(f"WITH {CACHED}, y AS (SELECT cust, list(year ORDER BY year) AS ys FROM records GROUP BY 1), l AS (SELECT cust, string_agg(year || ': histogram=' || histogram_count || ',seen=' || seen_total || ',cached=' || cached_total || ',dedup=' || dedup_count, ';' ORDER BY year) AS lines FROM records GROUP BY 1) SELECT cust, lines, array_to_string(ys, ', ') AS years, CASE WHEN len(ys) > 3 THEN 'long' ELSE 'short' END AS size FROM l JOIN y USING (cust)")
def diagnostic_texts(spark, d):
    rows = _records(Tables(spark, d)).groupBy("cust").agg(F.array_sort(F.collect_list(F.struct("year", "histogram_count", "cached_total", "seen_total", "dedup_count"))).alias("r"))
    return rows.select("cust", F.array_join(F.transform("r", C.diagnostic_line), ";").alias("lines"), C.years_text(F.transform("r", lambda x: x["year"])).alias("years"), F.when(F.size("r") > 3, "long").otherwise("short").alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '2001:' || user_id ELSE '' END || CASE WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN ',' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '2002:4' ELSE '' END AS counts, CASE WHEN user_id % 8 >= 3 THEN user_id % 8 - 3 ELSE event_id % 5 END AS dedup FROM events")
def normal_counts(spark, d):
    e = F.col("event_id")
    counts = F.create_map(F.when(e % 4 == 0, " 2001").otherwise("x"), F.col("user_id").cast("string"), F.lit("2002"), F.when(e % 3 == 0, "4").otherwise("-4"), F.lit("2003"), F.lit("many"))
    seen = F.col("user_id") % 8
    return Tables(spark, d).events.select("event_id", C.counts_text(C.normal_counts(counts)).alias("counts"), C.rederived_dedup(seen, F.lit(3), e % 5).cast("bigint").alias("dedup"))


@query("SELECT event_id, i AS index, i - i % 10 AS page_start, i % 10 AS skip FROM (SELECT event_id, greatest(0, user_id - 3) AS i FROM events)")
def page_skips(spark, d):
    i = F.greatest(F.lit(0).cast("bigint"), F.col("user_id") - 3)
    return Tables(spark, d).events.select("event_id", i.alias("index"), C.page_start(i).alias("page_start"), C.page_skip(i).alias("skip"))


@query(f"WITH {CITES}, p AS (SELECT c_custkey AS cust, c_nationkey AS author, c_mktsegment AS title FROM customer), x AS (SELECT author, title, arg_max(cust, cust) AS cust FROM p GROUP BY ALL) SELECT author, title, cust % 2 = 0 AS complete_fetch_attempt, cust AS num_citations_on_scholar, cust + 1 AS seen_total FROM x")
def paper_states(spark, d):
    """Output documents of each nation, with repeated and untitled papers, read back as states by title."""
    t = Tables(spark, d)
    rows = t.customer.where("c_custkey is not null").select(F.col("c_nationkey").alias("author"), F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("title"))
    diag = F.map_from_arrays(F.array(F.lit("summary")), F.array(F.to_json(F.struct((F.col("cust") + 1).alias("seen_total")))))
    state = F.struct("title", F.col("cust").cast("string").alias("num_citations_on_scholar"), (F.col("cust") % 2 == 0).alias("complete"), diag.alias("year_fetch_diagnostics"))
    paper = F.to_json(F.struct(F.struct(F.when(F.col("cust") % 3 != 0, F.col("title")).alias("title")).alias("pub"), state.alias("_fetch_state")))
    docs = rows.groupBy("author").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cust", paper.alias("p")))), lambda x: x["p"]), ",").alias("papers"))
    texts = docs.select(F.concat(F.lit('{"author_id":"'), F.col("author").cast("string"), F.lit('","papers":['), "papers", F.lit("]}")).alias("value"))
    outputs = texts.select(F.from_json("value", documents.OUTPUT).alias("d")).select("d.*")
    out = documents.fetch_states(outputs)
    return out.select(F.col("author_id").cast("int").alias("author"), "title", "state.complete_fetch_attempt", "state.num_citations_on_scholar", "state.year_fetch_diagnostics.seen_total")


@query(f"WITH {CITES} SELECT cust, title, (SELECT count(*) FROM cites c WHERE c.cust = s.cust) AS n FROM (SELECT c_custkey AS cust, c_name AS title FROM customer) s WHERE cust % 5 = 0")
def state_lookup(spark, d):
    t = Tables(spark, d)
    states = t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_name").alias("title")).join(t.cites().groupBy("cust").agg(F.count("*").alias("n")), "cust", "left").na.fill(0, ["n"])
    return documents.state_of(states, t.customer.where("c_custkey % 5 = 0").select(F.col("c_name").alias("title"))).select("cust", "title", "n")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_upsert(spark, d):
    folder = ingest.work_folder(spark, "stream-upsert")
    rows = ingest.landed(spark, d, "events").select("user_id", "event_id", "event_type")
    return ingest.merge_batches(rows, f"{folder}/out", f"{folder}/state", ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id % 5 AS year, event_id FROM events")
def stream_replace_years(spark, d):
    folder = ingest.work_folder(spark, "stream-years")
    rows = ingest.landed(spark, d, "events").select("user_id", (F.col("event_id") % 5).alias("year"), "event_id")
    return ingest.replace_years(rows, f"{folder}/out", f"{folder}/state", ["user_id"])
