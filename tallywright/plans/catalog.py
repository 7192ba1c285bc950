"""Queries over the driver's tables, each with the SQL that it is held against.

Analogues: a publication is a customer (or part), a citing row an order (year of its date, priority as venue, status as
authors), reported histograms are orders by year, what was seen are orders with a line that was not returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.functions import columns as C
from tallywright.operators import identity, merge, reports, rollups, snapshots, status
from tallywright.sources import documents, pages
from tallywright.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
THRESHOLD = 10  # orders from which a customer is read year by year
CUTOFF = "1996-01-01"  # of the previous snapshot
YEARS = list(range(1992, 1999))


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def cites(self) -> DataFrame:
        return self.orders.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("pos"), F.year("o_orderdate").cast("bigint").alias("year"), F.col("o_orderpriority").alias("venue"), F.col("o_orderstatus").alias("authors"))

    def dirty(self) -> DataFrame:
        k = F.col("pos") % 7
        text = F.when(k == 0, "N/A").when(k == 1, F.concat(F.lit(" "), F.col("year"), F.lit(" "))).when(k == 2, "").when(k == 3, "?").when(k == 4, F.lit(None)).when(k == 5, F.concat(F.col("year"), F.lit(".0"))).otherwise(F.col("year").cast("string"))
        return self.cites().withColumn("year_text", text)

    def seen(self) -> DataFrame:
        lines = self.lineitem.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("pos"))
        return self.cites().join(lines, "pos", "left_semi")

    def totals(self) -> DataFrame:
        n = self.cites().groupBy("cust").agg(F.count("*").alias("scholar_total"))
        s = self.seen().groupBy("cust").agg(F.count("*").alias("seen_total"))
        out = self.customer.select(F.col("c_custkey").alias("cust"), F.col("c_name").alias("title")).join(n, "cust", "left").join(s, "cust", "left")
        return out.withColumn("has_state", F.col("cust") % 5 != 0).na.fill(0, ["scholar_total", "seen_total"])

    def histogram(self) -> DataFrame:
        return rollups.year_counts(self.cites(), ["cust"])

    def seen_years(self) -> DataFrame:
        return rollups.year_counts(self.seen(), ["cust"])


CITES = "cites AS (SELECT o_custkey AS cust, o_orderkey AS pos, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS venue, o_orderstatus AS authors FROM orders)"
DIRTY = f"{CITES}, dirty AS (SELECT *, CASE pos % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN ' ' || year || ' ' WHEN 2 THEN '' WHEN 3 THEN '?' WHEN 4 THEN NULL WHEN 5 THEN year || '.0' ELSE CAST(year AS VARCHAR) END AS year_text FROM cites), clean AS (SELECT *, CASE WHEN regexp_full_match(trim(year_text), '[0-9]+') THEN CAST(trim(year_text) AS INT) END AS y FROM dirty)"
SEEN = f"{CITES}, seen AS (SELECT * FROM cites WHERE pos IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R'))"
HIST = f"{SEEN}, hist AS (SELECT cust, year, count(*) AS n FROM cites GROUP BY ALL), sy AS (SELECT cust, year, count(*) AS n FROM seen GROUP BY ALL)"
TOTALS = f"{HIST}, totals AS (SELECT c_custkey AS cust, c_name AS title, coalesce(a.n, 0) AS scholar_total, coalesce(b.n, 0) AS seen_total, c_custkey % 5 <> 0 AS has_state FROM customer LEFT JOIN (SELECT cust, count(*) AS n FROM cites GROUP BY 1) a ON a.cust = c_custkey LEFT JOIN (SELECT cust, count(*) AS n FROM seen GROUP BY 1) b ON b.cust = c_custkey)"
STATUS = "CASE WHEN scholar_total = 0 THEN 'skip_zero' WHEN NOT has_state THEN 'missing' WHEN seen_total >= scholar_total THEN 'complete' ELSE 'partial' END"


@query(f"WITH {CITES} SELECT cust, year, count(*) AS n FROM cites GROUP BY ALL")
def year_counts(spark, d):
    return rollups.year_counts(Tables(spark, d).cites(), ["cust"])


@query(f"WITH {CITES}, g AS (SELECT cust, year, count(*) AS n FROM cites GROUP BY ALL) SELECT cust, string_agg(year || ':' || n, ',' ORDER BY year) AS counts FROM g GROUP BY 1")
def year_counts_map(spark, d):
    return rollups.year_count_map(Tables(spark, d).cites(), ["cust"]).select("cust", C.counts_text(F.col("counts")).alias("counts"))


@query(f"WITH {DIRTY} SELECT cust, count(*) AS n, count(y) AS yeared, count(*) - count(y) AS unyeared FROM clean GROUP BY 1")
def unyeared_counts(spark, d):
    rows = Tables(spark, d).dirty().withColumn("y", C.citation_year(F.col("year_text")))
    return rows.groupBy("cust").agg(F.count("*").alias("n"), F.count("y").alias("yeared"), F.count_if(F.col("y").isNull()).alias("unyeared"))


@query(f"WITH {DIRTY} SELECT cust, pos, CAST(y AS BIGINT) AS year FROM clean WHERE y IS NOT NULL")
def yeared_citations(spark, d):
    return Tables(spark, d).dirty().withColumn("year", C.citation_year(F.col("year_text")).cast("bigint")).where("year is not null").select("cust", "pos", "year")


@query(f"WITH {DIRTY} SELECT pos, CASE WHEN year_text IS NULL OR lower(trim(year_text)) IN ('', 'n/a', 'na', '?') THEN CAST(year AS VARCHAR) ELSE year_text END AS year_text, CAST(CASE WHEN y <= 1996 THEN y END AS BIGINT) AS pub_year FROM clean")
def year_backfill(spark, d):
    rows = Tables(spark, d).dirty()
    return rows.select("pos", C.year_with_fallback(F.col("year_text"), F.col("year")).alias("year_text"), C.publication_year(F.col("year_text"), 1996).cast("bigint").alias("pub_year"))


@query(f"WITH {CITES} SELECT DISTINCT year FROM cites ORDER BY year DESC")
def distinct_years_desc(spark, d):
    return Tables(spark, d).cites().select("year").distinct().orderBy(F.col("year").desc())


@query(f"WITH {CITES} SELECT cust, " + ", ".join(f"nullif(count(*) FILTER (year = {y}), 0) AS y{y}" for y in reversed(YEARS)) + " FROM cites GROUP BY 1")
def pivot_by_year(spark, d):
    return reports.pivot_by_year(Tables(spark, d).cites(), ["cust"], YEARS)


@query(f"WITH {DIRTY} SELECT c_name AS cited, pos, coalesce(nullif(year_text, ''), 'N/A') AS year, coalesce(nullif(venue, ''), 'N/A') AS venue FROM clean JOIN customer ON c_custkey = cust")
def flat_citations(spark, d):
    t = Tables(spark, d)
    rows = t.dirty().join(t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_name").alias("cited")), "cust").select("cited", "pos", F.col("year_text").alias("year"), "venue")
    return reports.flat_detail(rows, ["year", "venue"])


@query("SELECT unnest(['total_papers', 'total_citations', 'first_year']) AS key, unnest([CAST(p AS VARCHAR), CAST(c AS VARCHAR), CAST(y AS VARCHAR)]) AS value FROM (SELECT count(*) AS p FROM customer), (SELECT count(*) AS c, min(year(o_orderdate)) AS y FROM orders)")
def run_metadata(spark, d):
    t = Tables(spark, d)
    row = t.customer.agg(F.count("*").alias("total_papers")).crossJoin(t.cites().agg(F.count("*").alias("total_citations"), F.min("year").alias("first_year")))  # one row each
    return reports.key_values(row, ["total_papers", "total_citations", "first_year"])


def _classified(t: Tables) -> DataFrame:
    complete = status.is_complete(F.lit("direct"), F.col("seen_total"), F.lit(None), F.col("scholar_total"))
    return t.totals().withColumn("status", status.status(F.col("scholar_total"), F.col("has_state"), F.lit(False), complete))


@query(f"WITH {TOTALS} SELECT cust, title, scholar_total, seen_total, {STATUS} AS status FROM totals")
def status_classification(spark, d):
    return _classified(Tables(spark, d)).select("cust", "title", "scholar_total", "seen_total", "status")


@query(f"WITH {TOTALS} SELECT {STATUS} AS status, count(*) AS n FROM totals GROUP BY 1")
def status_histogram(spark, d):
    return _classified(Tables(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {TOTALS} SELECT cust, scholar_total AS target, seen_total AS seen, greatest(0, scholar_total - seen_total) AS gap, seen_total < scholar_total AS underfetched FROM totals")
def completeness_gap(spark, d):
    gap = F.greatest(F.lit(0).cast("bigint"), F.col("scholar_total") - F.col("seen_total"))
    return Tables(spark, d).totals().select("cust", F.col("scholar_total").alias("target"), F.col("seen_total").alias("seen"), gap.alias("gap"), (F.col("seen_total") < F.col("scholar_total")).alias("underfetched"))


@query(f"WITH {TOTALS} SELECT cust, CASE WHEN scholar_total < {THRESHOLD} THEN 'direct' ELSE 'year' END AS strategy, CASE WHEN scholar_total < {THRESHOLD} THEN 'below_year_threshold' ELSE 'at_or_above_year_threshold' END AS reason FROM totals")
def fetch_policy(spark, d):
    policy = C.fetch_policy(F.col("scholar_total"), F.lit(None).cast("int"), THRESHOLD)
    return Tables(spark, d).totals().select("cust", policy.alias("p")).select("cust", "p.strategy", "p.reason")


FLAGGED = f"{DIRTY}, flagged AS (SELECT *, pos % 11 = 0 AS is_dupe FROM clean), rep AS (SELECT cust, count(*) AS scholar_total FROM cites GROUP BY 1), own AS (SELECT cust, count(*) FILTER (NOT is_dupe) AS cached_total, count(*) FILTER (NOT is_dupe AND y IS NOT NULL) AS cached_year_total, count(y) AS seen_total, count(*) FILTER (NOT is_dupe AND y IS NULL) AS cached_unyeared_count, count(*) FILTER (is_dupe) AS dedup_count, count(*) FILTER (pos % 3 <> 0) AS histogram_total FROM flagged GROUP BY 1)"


@query(f"WITH {FLAGGED} SELECT cust, scholar_total, cached_total, cached_year_total, seen_total, cached_unyeared_count, dedup_count, histogram_total, greatest(0, scholar_total - histogram_total) AS scholar_unyeared_count FROM rep JOIN own USING (cust)")
def count_summary(spark, d):
    t = Tables(spark, d)
    rows = t.dirty().select("cust", C.citation_year(F.col("year_text")).alias("year"), (F.col("pos") % 11 == 0).alias("is_dupe"))
    reported = t.cites().groupBy("cust").agg(F.count("*").alias("scholar_total"))
    return rollups.count_summary(rows, ["cust"], reported, rollups.year_counts(t.cites().where("pos % 3 <> 0"), ["cust"]))


CACHED = f"{HIST}, cached AS (SELECT cust, year, count(*) FILTER (pos % 4 <> 0) AS cached, count(*) FILTER (pos % 4 = 0) AS dedup FROM seen GROUP BY ALL), records AS (SELECT coalesce(c.cust, h.cust) AS cust, coalesce(c.year, h.year) AS year, coalesce(h.n, 0) AS histogram_count, coalesce(cached, 0) AS cached_total, coalesce(cached, 0) + coalesce(dedup, 0) AS seen_total, coalesce(dedup, 0) AS dedup_count FROM cached c FULL JOIN (SELECT * FROM hist WHERE year <> 1995) h ON c.cust = h.cust AND c.year = h.year)"


def _records(t: Tables) -> DataFrame:
    cached = t.seen().groupBy("cust", "year").agg(F.count_if(F.col("pos") % 4 != 0).alias("cached"), F.count_if(F.col("pos") % 4 == 0).alias("dedup"))
    return rollups.reconcile_years(cached, t.histogram().where("year <> 1995"), ["cust"])


@query(f"WITH {CACHED} SELECT * FROM records")
def year_reconciliation(spark, d):
    return _records(Tables(spark, d))


@query(f"WITH {CACHED}, s AS (SELECT cust, CAST(sum(histogram_count) AS BIGINT) AS histogram_total, CAST(sum(cached_total) AS BIGINT) AS cached_total, CAST(sum(seen_total) AS BIGINT) AS seen_total, CAST(sum(dedup_count) AS BIGINT) AS dedup_count FROM records GROUP BY 1), r AS (SELECT cust, count(*) AS scholar_total FROM cites GROUP BY 1) SELECT *, greatest(0, scholar_total - histogram_total) AS scholar_unyeared_count FROM r JOIN s USING (cust)")
def repair_year_summary(spark, d):
    t = Tables(spark, d)
    return rollups.summary_from_records(_records(t), ["cust"], t.cites().groupBy("cust").agg(F.count("*").alias("scholar_total")))


@query(f"WITH {TOTALS} SELECT cust, scholar_total, seen_total AS cached_total, seen_total, CAST(0 AS BIGINT) AS dedup_count, 'repaired' AS termination_reason FROM totals WHERE has_state")
def repair_direct_summary(spark, d):
    rows = Tables(spark, d).totals().where("has_state")
    return rows.select("cust", "scholar_total", F.col("seen_total").alias("cached_total"), C.seen_or_sum(F.lit(0), F.col("seen_total"), F.lit(0)).alias("seen_total"), F.lit(0).cast("bigint").alias("dedup_count"), F.lit("repaired").alias("termination_reason"))


ACTION = "CASE WHEN h.n IS NOT NULL AND coalesce(s.n, 0) {op} h.n THEN '{why}' WHEN h.n IS NULL AND coalesce(s.n, 0) > 0 THEN 'no_probe_data_skip' ELSE 'fetch' END"
PLAN = "WITH {hist}, st AS (SELECT cust, min(year) AS start_year FROM cites GROUP BY 1), ys AS (SELECT cust, unnest(range(start_year, 1999)) AS year FROM st) SELECT ys.cust, ys.year, h.n AS probed, s.n AS seen, {action} AS action FROM ys LEFT JOIN (SELECT * FROM hist WHERE year <> 1994) h ON h.cust = ys.cust AND h.year = ys.year LEFT JOIN sy s ON s.cust = ys.cust AND s.year = ys.year"


def _plan(t: Tables, mode: str) -> DataFrame:
    start = t.cites().groupBy("cust").agg(F.min("year").alias("start_year"))
    plan = status.year_plan(start, ["cust"], t.histogram().where("year <> 1994").withColumnRenamed("n", "probed"), t.seen_years().withColumnRenamed("n", "seen"), 1998, mode)
    return plan.select("cust", F.col("year").cast("bigint").alias("year"), "probed", "seen", "action")


@query(PLAN.format(hist=HIST, action=ACTION.format(op=">=", why="seen_total_match_skip")))
def year_plan(spark, d):
    return _plan(Tables(spark, d), "normal")


@query("SELECT cust, year, action FROM (" + PLAN.format(hist=HIST, action=ACTION.format(op="=", why="seen_total_exact_match")) + ") WHERE action <> 'fetch'")
def refresh_years_exact(spark, d):
    return _plan(Tables(spark, d), "exact").where("action <> 'fetch'").select("cust", "year", "action")


@query(f"WITH {TOTALS} SELECT count(*) > 0 AS pending FROM totals WHERE {STATUS} IN ('missing', 'partial')")
def pending_exists(spark, d):
    return _classified(Tables(spark, d)).where("status in ('missing', 'partial')").limit(1).agg((F.count("*") > 0).alias("pending"))


RANKED = f"{CITES}, tot AS (SELECT c_custkey AS cust, c_nationkey AS nation, c_name AS title, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT cust, count(*) AS n FROM cites GROUP BY 1) ON cust = c_custkey), ranked AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY n DESC, cust) AS no FROM tot)"


def _ranked(t: Tables) -> DataFrame:
    n = t.cites().groupBy("cust").agg(F.count("*").alias("n"))
    rows = t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("title")).join(n, "cust", "left").na.fill(0, ["n"])
    return snapshots.rank(rows, ["nation"], "n", "cust").withColumn("no", F.col("no").cast("bigint"))


@query(f"WITH {RANKED} SELECT nation, no, cust, n FROM ranked")
def profile_rank(spark, d):
    return _ranked(Tables(spark, d)).select("nation", "no", "cust", "n")


@query(f"WITH {RANKED} SELECT nation, no, cust FROM ranked WHERE no BETWEEN 4 AND 8")
def skip_limit_slice(spark, d):
    return _ranked(Tables(spark, d)).where(F.col("no").between(4, 8)).select("nation", "no", "cust")


@query(f"WITH {RANKED}, a AS (SELECT nation, list(title ORDER BY title) AS ts FROM ranked GROUP BY 1) SELECT nation, array_to_string(ts[1:3], '; ') || CASE WHEN len(ts) > 3 THEN ' ... (+' || (len(ts) - 3) || ')' ELSE '' END AS titles FROM a")
def top3_titles(spark, d):
    # the three first titles need no list of all: rank, keep three, count the rest
    w = Window.partitionBy("nation")
    rows = _ranked(Tables(spark, d)).withColumn("at", F.row_number().over(w.orderBy("title", "cust"))).groupBy("nation").agg(F.array_sort(F.collect_list(F.when(F.col("at") <= 3, F.col("title")))).alias("top"), F.count("*").alias("n"))
    return rows.select("nation", F.concat(F.array_join("top", "; "), F.when(F.col("n") > 3, F.concat(F.lit(" ... (+"), (F.col("n") - 3).cast("string"), F.lit(")"))).otherwise("")).alias("titles"))


SNAP = f"WITH o AS (SELECT o_custkey AS cust, o_orderdate < TIMESTAMP '{CUTOFF}' AS before FROM orders), cur AS (SELECT cust, count(*) AS n FROM o GROUP BY 1), prev AS (SELECT cust, count(*) AS n FROM o WHERE before GROUP BY 1 HAVING count(*) > 2)"


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.orders.select(F.col("o_custkey").alias("cust"), (F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz")).alias("before"))
    return rows.groupBy("cust").agg(F.count("*").alias("n")), rows.where("before").groupBy("cust").agg(F.count("*").alias("n")).where("n > 2")


@query(f"{SNAP} SELECT cust, n FROM cur WHERE cust NOT IN (SELECT cust FROM prev)")
def snapshot_new(spark, d):
    current, previous = _snapshots(Tables(spark, d))
    return snapshots.new_rows(current, previous, "cust")


@query(f"{SNAP} SELECT cust, prev.n AS old, cur.n AS new FROM cur JOIN prev USING (cust) WHERE cur.n <> prev.n")
def snapshot_changed(spark, d):
    current, previous = _snapshots(Tables(spark, d))
    return snapshots.changed_rows(current, previous, "cust", "n")


@query(f"{SNAP}, e AS (SELECT cur.cust, c_nationkey AS nation, cur.n AS new, prev.n AS old FROM cur JOIN customer ON c_custkey = cur.cust LEFT JOIN prev ON prev.cust = cur.cust) SELECT nation, coalesce(string_agg(CAST(cust AS VARCHAR), ',' ORDER BY cust) FILTER (old IS NULL), '') AS new_items, coalesce(string_agg(cust || ':' || old || '>' || new, ',' ORDER BY cust || ':' || old || '>' || new) FILTER (old IS NOT NULL), '') AS changed_items FROM e WHERE old IS DISTINCT FROM new GROUP BY 1")
def change_record(spark, d):
    t = Tables(spark, d)
    current, previous = _snapshots(t)
    current = current.join(t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation")), "cust")
    out = snapshots.change_record(current, previous, "cust", "n", ["nation"])
    return out.select("nation", F.array_join(F.transform("new_items", lambda x: x.cast("string")), ",").alias("new_items"), F.array_join("changed_items", ",").alias("changed_items"))


@query(f"{SNAP} SELECT (SELECT sum(n) FROM cur)::BIGINT AS new_total, (SELECT sum(n) FROM prev)::BIGINT AS old_total, (SELECT sum(n) FROM cur) <> (SELECT sum(n) FROM prev) AS refresh")
def snapshot_refresh_decision(spark, d):
    current, previous = _snapshots(Tables(spark, d))
    both = current.agg(F.sum("n").alias("new_total")).crossJoin(previous.agg(F.sum("n").alias("old_total")))  # one row each
    return both.withColumn("refresh", F.col("new_total") != F.col("old_total"))


@query(f"WITH {HIST}, c AS (SELECT cust, count(*) AS citedby FROM cites GROUP BY 1), h AS (SELECT cust, CAST(sum(n) AS BIGINT) AS t FROM sy GROUP BY 1) SELECT cust, citedby, t AS year_table_total_citations, citedby - t AS year_table_gap, citedby = t AS year_table_matches_total FROM c JOIN h USING (cust)")
def profile_gap(spark, d):
    t = Tables(spark, d)
    basics = t.cites().groupBy("cust").agg(F.count("*").alias("citedby")).join(rollups.year_count_map(t.seen(), ["cust"]).withColumnRenamed("counts", "cites_per_year"), "cust")
    return rollups.histogram_gap(basics).drop("cites_per_year")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'id:' || (user_id % 50) || ';' END || 'meta:' || lower(event_type) || '|' || CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(user_id % 7 AS VARCHAR) END AS keys FROM events")
def identity_keys(spark, d):
    keys = C.identity_keys(F.when(F.col("event_id") % 4 != 0, F.concat(F.lit(" "), (F.col("user_id") % 50).cast("string"))), F.col("event_type"), F.when(F.col("event_id") % 3 == 0, "N/A").otherwise(""), (F.col("user_id") % 7).cast("string"))
    return Tables(spark, d).events.select("event_id", F.array_join(keys, ";").alias("keys"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS text_md5 FROM documents")
def normalize_text(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.md5(C.normal_text(F.col("text"))).alias("text_md5"))


KEYED = "k AS (SELECT user_id, event_id, ['v' || CAST(floor(value) AS BIGINT) % 17, 't' || event_type || (event_id % 5)] AS keys FROM events)"
GREEDY = f"""WITH RECURSIVE {KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM k),
w AS (SELECT user_id, event_id, i, keys AS seen, false AS is_dupe FROM r WHERE i = 1 UNION ALL
SELECT r.user_id, r.event_id, r.i, CASE WHEN list_has_any(w.seen, r.keys) THEN w.seen ELSE list_concat(w.seen, r.keys) END, list_has_any(w.seen, r.keys) FROM w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1)"""


def _keyed(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", _keyed_expr().alias("keys"))


@query(GREEDY + " SELECT user_id, event_id FROM w WHERE NOT is_dupe")
def dedup_greedy(spark, d):
    return identity.greedy_dedup(_keyed(Tables(spark, d)), ["user_id"], "event_id", "keys").where("not is_dupe").select("user_id", "event_id")


@query(GREEDY + " SELECT user_id, event_id FROM w WHERE NOT is_dupe")
def dedup_greedy_native(spark, d):
    return identity.greedy_dedup_native(_keyed(Tables(spark, d)), ["user_id"], "event_id", "keys")


@query(GREEDY + " SELECT user_id, count(*) FILTER (NOT is_dupe) AS kept, count(*) FILTER (is_dupe) AS dedup_count FROM w GROUP BY 1")
def dedup_greedy_counts(spark, d):
    rows = identity.greedy_dedup(_keyed(Tables(spark, d)), ["user_id"], "event_id", "keys")
    return rows.groupBy("user_id").agg(F.count_if(~F.col("is_dupe")).alias("kept"), F.count_if("is_dupe").alias("dedup_count"))


@query(f"WITH {KEYED} SELECT user_id, min(event_id) AS event_id, keys[1] AS key FROM k GROUP BY user_id, keys[1]")
def dedup_single_key(spark, d):
    return _keyed(Tables(spark, d)).groupBy("user_id", F.element_at("keys", 1).alias("key")).agg(F.min("event_id").alias("event_id"))


NEWNESS = f"WITH {KEYED}, old AS (SELECT * FROM k WHERE event_id % 3 = 0), cur AS (SELECT * FROM k WHERE event_id % 3 <> 0)"


@query(f"{NEWNESS}, ok AS (SELECT user_id, list(DISTINCT key) AS seen FROM (SELECT user_id, unnest(keys) AS key FROM old) GROUP BY 1) SELECT event_id, coalesce(NOT list_has_any(seen, keys), true) AS is_new FROM cur LEFT JOIN ok USING (user_id)")
def new_vs_old_keys(spark, d):
    rows = _keyed(Tables(spark, d))
    return identity.flag_new(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0"), ["user_id"], "keys", ["event_id"]).select("event_id", "is_new")


@query(f"{NEWNESS}, ok AS (SELECT user_id, event_id % 4 AS year, list(DISTINCT key) AS seen FROM (SELECT user_id, event_id, unnest(keys) AS key FROM old) GROUP BY ALL), f AS (SELECT cur.user_id, event_id % 4 AS year, coalesce(NOT list_has_any(seen, keys), true) AS is_new FROM cur LEFT JOIN ok ON ok.user_id = cur.user_id AND ok.year = cur.event_id % 4) SELECT user_id, year, count(*) FILTER (is_new) AS year_new_count FROM f GROUP BY ALL")
def new_in_year(spark, d):
    rows = _keyed(Tables(spark, d)).withColumn("year", F.col("event_id") % 4)
    flagged = identity.flag_new(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0"), ["user_id", "year"], "keys", ["event_id"])
    return flagged.groupBy("user_id", "year").agg(F.count_if("is_new").alias("year_new_count"))


OVER = f"""{KEYED}, base AS (SELECT user_id, event_id AS pos, keys, event_id AS src FROM k WHERE event_id % 2 = 0), fresh AS (SELECT user_id, event_id AS pos, keys, event_id AS src FROM k WHERE event_id % 2 = 1 AND event_id % 3 = 0),
build AS (SELECT user_id, key, arg_max(src, pos) AS src, arg_max(prim, pos) AS prim FROM (SELECT user_id, pos, src, keys[1] AS prim, unnest(keys) AS key FROM fresh) GROUP BY ALL),
best AS (SELECT b.user_id, b.pos, coalesce(x.src, y.src) AS src, coalesce(x.prim, y.prim) AS prim FROM base b LEFT JOIN build x ON x.user_id = b.user_id AND x.key = b.keys[1] LEFT JOIN build y ON y.user_id = b.user_id AND y.key = b.keys[2] WHERE x.src IS NOT NULL OR y.src IS NOT NULL),
over_ AS (SELECT b.user_id, 0 AS side, b.pos, coalesce(t.src, b.src) AS src FROM base b LEFT JOIN best t ON t.user_id = b.user_id AND t.pos = b.pos
UNION ALL SELECT user_id, 1 AS side, min(pos) AS pos, min(pos) AS src FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM best t WHERE t.user_id = f.user_id AND t.prim = f.keys[1]) GROUP BY user_id, keys[1])"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = _keyed(t).select("user_id", F.col("event_id").alias("pos"), "keys", F.col("event_id").alias("src"))
    return rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1 and pos % 3 = 0")


@query(f"WITH {OVER} SELECT user_id, side, pos, src FROM over_")
def overlay_upsert(spark, d):
    return merge.overlay(*_sides(Tables(spark, d)), ["user_id"]).select("user_id", "side", "pos", "src")


@query(f"WITH {OVER} SELECT user_id, side, pos, src FROM over_ WHERE user_id % 2 = 1 UNION ALL SELECT user_id, 1, pos, src FROM fresh WHERE user_id % 2 = 0")
def materialize(spark, d):
    base, fresh = _sides(Tables(spark, d))
    complete = base.select("user_id").unionByName(fresh.select("user_id")).where("user_id % 2 = 0").distinct()
    return merge.materialize(base, fresh, ["user_id"], complete).select("user_id", "side", "pos", "src")


@query(f"WITH {DIRTY}, b AS (SELECT cust, pos, y FROM clean WHERE pos % 2 = 0), f AS (SELECT cust, pos, y FROM clean WHERE pos % 2 = 1 AND (y = 1995 OR y IS NULL)), t AS (SELECT DISTINCT cust, y FROM f) SELECT cust, pos, CAST(y AS BIGINT) AS year, 0 AS side FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.cust = b.cust AND t.y IS NOT DISTINCT FROM b.y) UNION ALL SELECT cust, pos, CAST(y AS BIGINT), 1 FROM f")
def replace_year_bucket(spark, d):
    rows = Tables(spark, d).dirty().select("cust", "pos", C.citation_year(F.col("year_text")).cast("bigint").alias("year"))
    fresh = rows.where("pos % 2 = 1 and (year = 1995 or year is null)")
    return merge.replace_buckets(rows.where("pos % 2 = 0"), fresh, ["cust"], fresh.select("cust", "year").distinct())


@query(f"WITH {RANKED} SELECT cust, n FROM tot WHERE cust NOT IN (SELECT cust FROM ranked WHERE no BETWEEN 4 AND 13)")
def force_clear(spark, d):
    ranked = _ranked(Tables(spark, d))
    return merge.clear_range(ranked.select("cust", "n"), ranked.select("cust", "no"), "cust", 3, 10)


@query(f"WITH {HIST} SELECT c_custkey AS cust, coalesce(a.n, b.n) AS n FROM customer LEFT JOIN (SELECT cust, n FROM sy WHERE year = 1995) a ON a.cust = c_custkey LEFT JOIN (SELECT cust, n FROM hist WHERE year = 1994) b ON b.cust = c_custkey")
def carry_over(spark, d):
    t = Tables(spark, d)
    return merge.carry_over(t.customer.select(F.col("c_custkey").alias("cust")), t.seen_years().where("year = 1995"), t.histogram().where("year = 1994"), "cust", "n")


@query(r"SELECT page_id, CAST(coalesce(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), ''), '0') AS BIGINT) AS start, CAST(floor(coalesce(CAST(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS BIGINT), 0) / 10) * 10 AS BIGINT) AS page_start, CAST(floor(coalesce(CAST(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS BIGINT), 0) / 10) + 1 AS BIGINT) AS page_no, CASE WHEN regexp_matches(url, '[?&]page=\d+') THEN regexp_replace(url, '([?&])page=\d+', '\1page=30', 'g') ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=30' END AS next_url FROM pages")
def url_page_start(spark, d):
    start = F.coalesce(F.regexp_extract("url", r"[?&]page=(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    return Tables(spark, d).pages.select("page_id", start.alias("start"), C.page_start(start).alias("page_start"), C.page_number(F.col("url"), "page").alias("page_no"), C.with_start(F.col("url"), F.lit(30), "page").alias("next_url"))


@query(r"SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+', '') AS path, 'http://host' || regexp_replace(url, '^[a-z]+://[^/]+', '') AS moved FROM pages")
def url_host_path(spark, d):
    path = C.without_host(F.col("url"))
    return Tables(spark, d).pages.select("page_id", path.alias("path"), C.absolute(path, "http://host").alias("moved"))


@query(r"SELECT page_id, CAST(page_id AS VARCHAR) || ',' || (page_id + 1) AS ids, CASE WHEN page_id % 3 = 0 THEN 'c' || page_id END AS cluster, 'u' || page_id AS author FROM pages")
def id_from_url(spark, d):
    i = F.col("page_id").cast("string")
    cites = F.concat(F.lit("/x?cites="), i, F.lit(",,"), (F.col("page_id") + 1).cast("string"), F.lit(","))
    cluster = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("q=info:c"), i, F.lit(":scholar.google.com/"))).otherwise("q=other")
    return Tables(spark, d).pages.select("page_id", C.ids_in_url(cites).alias("ids"), C.cluster_in_url(cluster).alias("cluster"), C.author_in_url(F.concat(F.lit("http://h/p?hl=en&user=u"), i)).alias("author"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS links, 'http://base' || regexp_extract(html, 'href="([^"]*)"', 1) AS first_link FROM pages""")
def html_title_links(spark, d):
    found = pages.links(F.col("html"))
    return Tables(spark, d).pages.select("page_id", pages.page_title(F.col("html")).alias("title"), F.size(found).cast("bigint").alias("links"), C.absolute(F.get(found, F.lit(0)), "http://base").alias("first_link"))


@query(r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '>[^<]*?(\d{1,3})[^<]*<', 1), lambda x: x), ',') AS numbers FROM pages")
def html_number_tokens(spark, d):
    return Tables(spark, d).pages.select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(r">[^<]*?(\d{1,3})[^<]*<"), F.lit(1)), ",").alias("numbers"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS scholar_total, CAST(0 AS BIGINT) AS cached_total, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) = 0 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS seen_total FROM events")
def json_state_normalize(spark, d):
    raw = F.from_json("props", "map<string,string>")
    flat = F.transform_keys(raw, lambda k, v: F.lit("scholar_total"))
    layout = F.when(F.col("event_id") % 2 == 0, flat).otherwise(F.create_map(F.lit("summary"), F.to_json(flat)))
    made = documents.year_summary(layout)
    return Tables(spark, d).events.select("event_id", made.alias("s")).select("event_id", "s.scholar_total", "s.cached_total", C.seen_or_sum(F.col("s.scholar_total"), F.lit(0), F.lit(0)).alias("seen_total"))


@query(f"WITH {CITES} SELECT cust, count(*) AS n, CASE WHEN count(*) % 10 > 0 THEN 'short_page_stop' ELSE 'iterator_exhausted' END AS reason, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM cites GROUP BY 1")
def termination_reason(spark, d):
    rows = Tables(spark, d).cites().groupBy("cust").agg(F.count("*").alias("n"))
    return rows.select("cust", "n", C.termination(F.col("n") % C.PAGE).alias("reason"), F.ceil(F.col("n") / C.PAGE).alias("pages"))


@query(f"WITH {CITES} SELECT c_custkey AS cust, count(pos) AS n_citations, coalesce(CAST(sum(pos) AS BIGINT), 0) AS pos_sum FROM customer LEFT JOIN cites ON cust = c_custkey GROUP BY 1")
def output_document(spark, d):
    t = Tables(spark, d)
    pubs = t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_name").alias("title"))
    rows = t.cites().join(pubs, "cust").select("cust", "title", "pos", "year", "venue")
    made = reports.output_document(pubs, pubs.select("cust", "title", F.lit("direct").alias("strategy")), rows, ["cust"])
    read = F.from_json("document", "citations array<struct<pos: bigint>>")["citations"]
    return made.select("cust", F.col("n_citations").cast("bigint").alias("n_citations"), F.coalesce(F.aggregate(read, F.lit(0).cast("bigint"), lambda a, x: a + x["pos"]), F.lit(0).cast("bigint")).alias("pos_sum"))


@query(GREEDY + " SELECT user_id, event_id FROM w WHERE NOT is_dupe")
def stream_dedup(spark, d):
    folder = ingest.work_folder(spark, "stream-dedup")
    rows = ingest.landed(spark, d, "events").select("user_id", "event_id", _keyed_expr().alias("keys"))
    ingest.drain(ingest.stream_dedup(rows, "user_id", "event_id", "keys"), f"{folder}/out", f"{folder}/state")
    return spark.read.schema("user_id long, event_id long").parquet(f"{folder}/out")


def _keyed_expr():
    return F.array(F.concat(F.lit("v"), F.pmod(F.floor("value").cast("bigint"), F.lit(17)).cast("string")), F.concat(F.lit("t"), F.col("event_type"), (F.col("event_id") % 5).cast("string")))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    folder = ingest.work_folder(spark, "stream-daily")
    counts = ingest.daily_counts(ingest.landed(spark, d, "events"), "ts", "event_type", late="0 seconds")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")
