"""Queries of completeness, refresh planning, repair and merging, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions import columns as C
from tallywright.operators import identity, merge, rollups, snapshots, status
from tallywright.plans.catalog import CACHED, CITES, DIRTY, HIST, KEYED, SNAP, STATUS, THRESHOLD, TOTALS, Tables, _classified, _keyed, _records, _sides, _snapshots, query

RECORDS = "records_ AS (SELECT cust, year, histogram_count + CAST(cust % 7 = 0 AS INT) AS recorded, cached_total, seen_total, dedup_count, histogram_count AS probe FROM records)"


@query(f"WITH {CACHED}, {RECORDS} SELECT cust, year, recorded = probe AND cached_total <= probe AND seen_total >= probe AS proven, recorded = probe AND cached_total <= probe AND seen_total >= probe AND cached_total = cached_total - CAST(cust % 11 = 0 AS INT) AS proven_cached FROM records_")
def year_proof(spark, d):
    rows = _records(Tables(spark, d)).withColumn("recorded", F.col("histogram_count") + (F.col("cust") % 7 == 0).cast("int"))
    proof = lambda cached: status.year_proven(F.col("histogram_count"), F.col("recorded"), F.col("cached_total"), F.col("seen_total"), cached)
    return rows.select("cust", "year", proof(None).alias("proven"), proof(F.col("cached_total") - (F.col("cust") % 11 == 0).cast("int")).alias("proven_cached"))


@query(f"""WITH {CACHED}, p AS (SELECT cust, year, n FROM hist WHERE year <> 1994), f AS (
SELECT p.cust, coalesce(c.cached_total, 0) = p.n OR coalesce(c.histogram_count = p.n AND c.cached_total <= p.n AND c.seen_total >= p.n, false) AS ok FROM p LEFT JOIN records c ON c.cust = p.cust AND c.year = p.year)
SELECT c_custkey AS cust, coalesce(bool_and(ok), false) AS satisfied FROM customer LEFT JOIN f ON f.cust = c_custkey GROUP BY 1""")
def histogram_satisfied(spark, d):
    t = Tables(spark, d)
    records = _records(t)
    cached = records.select("cust", "year", F.col("cached_total").alias("n"))
    return status.years_satisfied(t.customer.select(F.col("c_custkey").alias("cust")), ["cust"], t.histogram().where("year <> 1994"), cached, records)


@query(f"""WITH {HIST}, probe AS (SELECT cust, year, n FROM hist WHERE year <> 1994 AND cust % 9 <> 0), y AS (SELECT c_custkey AS cust, unnest(range(1993, 1998)) AS year FROM customer),
b AS (SELECT y.cust, y.year, (h.n IS NOT NULL AND coalesce(s.n, 0) <> h.n) OR (y.year = 1996 AND y.cust % 5 = 0) AS wanted FROM y LEFT JOIN probe h ON h.cust = y.cust AND h.year = y.year LEFT JOIN sy s ON s.cust = y.cust AND s.year = y.year)
SELECT cust, cust IN (SELECT cust FROM probe) AS has_probe, CASE WHEN cust IN (SELECT cust FROM probe) THEN coalesce(string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FILTER (wanted), '') ELSE 'all' END AS years FROM b GROUP BY 1""")
def refresh_years(spark, d):
    t = Tables(spark, d)
    probed = rollups.year_count_map(t.cites().where("year <> 1994 and cust % 9 <> 0"), ["cust"]).withColumnRenamed("counts", "probed")
    maps = t.customer.select(F.col("c_custkey").alias("cust")).join(probed, "cust", "left").join(rollups.year_count_map(t.seen(), ["cust"]).withColumnRenamed("counts", "cached"), "cust", "left")
    none = F.create_map().cast("map<bigint,bigint>")
    partial = F.when(F.col("cust") % 5 == 0, F.array(F.lit(1996).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    years = status.candidate_years(F.coalesce("cached", none), F.coalesce("probed", none), F.sequence(F.lit(1993).cast("bigint"), F.lit(1997).cast("bigint")), partial)
    return maps.select("cust", F.col("probed").isNotNull().alias("has_probe"), F.coalesce(F.array_join(F.transform(years, lambda y: y.cast("string")), ","), F.lit("all")).alias("years"))


@query(f"""WITH {CACHED}, r AS (SELECT cust, CAST(sum(histogram_count) AS BIGINT) AS h, CAST(sum(seen_total) AS BIGINT) AS s FROM records GROUP BY 1),
t AS (SELECT c_custkey AS cust, coalesce((SELECT count(*) FROM cites c WHERE c.cust = c_custkey), 0) AS total, coalesce((SELECT count(*) FROM seen c WHERE c.cust = c_custkey), 0) AS n FROM customer),
l AS (SELECT t.cust, total, n, CASE WHEN cust % 4 = 0 THEN total - 1 END AS sh, CASE WHEN cust % 4 = 0 THEN n END AS ss, CASE WHEN cust % 4 = 1 THEN h END AS ph, CASE WHEN cust % 4 = 1 THEN s END AS ps, CASE WHEN cust % 4 = 2 THEN total END AS dt, CASE WHEN cust % 4 = 2 THEN n + 1 END AS ds, CASE WHEN cust % 3 = 0 THEN n + 2 END AS counter FROM t LEFT JOIN r USING (cust)),
f AS (SELECT cust, total, coalesce(ds, ss, ps, greatest(coalesce(counter, n), n)) AS num_seen, CASE WHEN total >= {THRESHOLD} THEN coalesce(sh, ph) ELSE dt END AS target FROM l)
SELECT cust, CASE WHEN num_seen >= coalesce(target, total) THEN 'complete' ELSE 'partial' END AS status FROM f""")
def legacy_status(spark, d):
    t = Tables(spark, d)
    sums = _records(t).groupBy("cust").agg(F.sum("histogram_count").alias("h"), F.sum("seen_total").alias("s"))
    rows = t.totals().join(sums, "cust", "left")
    kind, total, n = F.col("cust") % 4, F.col("scholar_total"), F.col("seen_total")
    of = lambda k, a, b: F.struct(F.when(kind == k, a).alias("total"), F.when(kind == k, b).alias("seen"))
    strategy = C.fetch_policy(total, F.lit(None).cast("int"), THRESHOLD)["strategy"]
    made = status.legacy_status(total, strategy, of(0, total - 1, n), of(1, F.col("h"), F.col("s")), of(2, total, n + 1), F.when(F.col("cust") % 3 == 0, n + 2), n)
    return rows.select("cust", made.alias("status"))


@query(f"""WITH {TOTALS}, s AS (SELECT cust, scholar_total, seen_total, CASE WHEN cust % 3 <> 0 THEN 'direct' WHEN cust % 2 = 0 THEN 'year' WHEN cust % 5 = 0 THEN 'direct' END AS strategy FROM totals)
SELECT cust, strategy, CASE strategy WHEN 'year' THEN seen_total >= scholar_total - 1 WHEN 'direct' THEN seen_total >= scholar_total ELSE false END AS complete FROM s""")
def inferred_status(spark, d):
    rows = Tables(spark, d).totals()
    c = F.col("cust")
    strategy = status.inferred_strategy(F.when(c % 3 != 0, "direct"), c % 2 == 0, c % 5 == 0)
    return rows.withColumn("strategy", strategy).select("cust", "strategy", status.is_complete(F.col("strategy"), F.col("seen_total"), F.col("scholar_total") - 1, F.col("scholar_total")).alias("complete"))


SKIPS = f"""{DIRTY}, o AS (SELECT o_custkey AS cust, count(*) FILTER (o_orderdate < TIMESTAMP '1998-06-01') AS previous FROM orders GROUP BY 1),
r AS (SELECT c_custkey AS cust, coalesce(o.previous, 0) AS previous, (SELECT count(*) FROM clean c WHERE c.cust = c_custkey) AS total, (SELECT count(*) FROM clean c WHERE c.cust = c_custkey AND (c_custkey % 4 <> 0 OR y IS NULL)) AS n, (SELECT count(y) FROM clean c WHERE c.cust = c_custkey AND c_custkey % 4 <> 0) AS yeared,
c_custkey % 2 = 0 AND (SELECT count(*) FROM clean c WHERE c.cust = c_custkey AND (c_custkey % 4 <> 0 OR y IS NULL)) > 0 AS attempt, c_custkey % 13 = 0 AS no_url FROM customer LEFT JOIN o ON o.cust = c_custkey)"""


def _skips(t: Tables) -> DataFrame:
    previous = t.orders.groupBy(F.col("o_custkey").alias("cust")).agg(F.count_if(F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz")).alias("previous"))
    rows = t.dirty().withColumn("y", C.citation_year(F.col("year_text")))
    kept = (F.col("cust") % 4 != 0) | F.col("y").isNull()
    own = rows.groupBy("cust").agg(F.count("*").alias("total"), F.count_if(kept).alias("n"), F.count_if(kept & F.col("y").isNotNull()).alias("yeared"))
    out = t.customer.select(F.col("c_custkey").alias("cust")).join(previous, "cust", "left").join(own, "cust", "left").na.fill(0)
    return out.withColumn("attempt", status.attempt_flag(F.col("cust") % 2 == 0, F.col("n")))


@query(f"WITH {SKIPS} SELECT cust, attempt, CASE WHEN no_url THEN 'no_url' WHEN total >= {THRESHOLD} AND attempt AND total <= previous AND n > 0 AND yeared = 0 THEN 'skip_unyeared' ELSE 'fetch' END AS normal, CASE WHEN previous = total AND attempt THEN 'skip_rough' WHEN no_url THEN 'no_url' WHEN total >= {THRESHOLD} AND attempt AND total <= previous AND n > 0 AND yeared = 0 THEN 'skip_unyeared' ELSE 'fetch' END AS rough FROM r")
def skip_rules(spark, d):
    url = F.when(F.col("cust") % 13 != 0, F.concat(F.lit("/c?cites="), F.col("cust").cast("string")))
    strategy = C.fetch_policy(F.col("total"), F.lit(None).cast("int"), THRESHOLD)["strategy"]
    why = lambda mode: status.skip_reason(mode, F.col("previous"), F.col("total"), F.col("attempt"), strategy, F.col("n"), F.col("yeared"), url)
    return _skips(Tables(spark, d)).select("cust", "attempt", why("normal").alias("normal"), why("rough").alias("rough"))


@query(f"{SNAP} SELECT c.cust, c.n AS total, p.n AS previous, CASE WHEN c.n = p.n AND c.cust % 2 = 0 THEN 'skip_rough' ELSE 'fetch' END AS action FROM cur c LEFT JOIN prev p ON p.cust = c.cust")
def rough_plan(spark, d):
    current, previous = _snapshots(Tables(spark, d))
    before = previous.select("cust", F.col("n").alias("total"), (F.col("cust") % 2 == 0).alias("complete"))
    return status.rough_plan(before, current.withColumnRenamed("n", "total"), ["cust"])


@query(f"""WITH {TOTALS}, b AS (SELECT o_custkey AS cust, count(*) FILTER (o_orderdate < TIMESTAMP '1998-07-25') AS p, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT c_nationkey AS nation, c_custkey % 60 AS part, sum(coalesce(p, 0)) = sum(coalesce(b.n, 0)) AS same, count(*) = count(*) AS same_n, bool_or(coalesce(t.seen_total < t.scholar_total, false) AND t.cust % 4 = 0) AS pending FROM customer LEFT JOIN b ON b.cust = c_custkey LEFT JOIN totals t ON t.cust = c_custkey GROUP BY ALL)
SELECT nation, part, same AND same_n AND NOT pending AS skip, false AS skip_force FROM f""")
def whole_run_skip(spark, d):
    t = Tables(spark, d)
    b = t.orders.groupBy(F.col("o_custkey").alias("cust")).agg(F.count_if(F.col("o_orderdate") < F.lit("1998-07-25").cast("timestamp_ntz")).alias("p"), F.count("*").alias("n"))
    rows = t.totals().join(b, "cust", "left").na.fill(0).join(t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation")), "cust")
    groups = rows.groupBy("nation", (F.col("cust") % 60).alias("part")).agg(F.sum("p").alias("old"), F.sum("n").alias("new"), F.count("*").alias("k"), F.bool_or((F.col("seen_total") < F.col("scholar_total")) & (F.col("cust") % 4 == 0)).alias("pending"))
    skip = lambda mode: status.run_skip(F.col("old"), F.col("new"), F.col("k"), F.col("k"), F.col("pending"), mode)
    return groups.select("nation", "part", skip("normal").alias("skip"), skip("force").alias("skip_force"))


MIGRATED = f"{DIRTY}, yc AS (SELECT cust, y AS year, count(*) AS n FROM clean WHERE y IS NOT NULL GROUP BY ALL)"


@query(f"WITH {MIGRATED} SELECT cust, CAST(year AS BIGINT) AS year, n AS histogram_count, n AS cached_total, n AS seen_total, CAST(0 AS BIGINT) AS dedup_count, 'direct_to_year_migration' AS termination_reason FROM yc")
def migrated_records(spark, d):
    rows = Tables(spark, d).dirty().select("cust", C.citation_year(F.col("year_text")).cast("bigint").alias("year"))
    return status.migrated_records(rows, ["cust"]).withColumn("dedup_count", F.col("dedup_count").cast("bigint"))


@query(f"WITH {DIRTY}, n AS (SELECT cust, count(*) AS total FROM clean GROUP BY 1) SELECT cust, pos, CAST(y AS BIGINT) AS year FROM clean JOIN n USING (cust) WHERE total < {THRESHOLD} OR y IS NOT NULL")
def drop_unyeared(spark, d):
    rows = Tables(spark, d).dirty().select("cust", "pos", C.citation_year(F.col("year_text")).cast("bigint").alias("year"))
    rows = rows.join(rows.groupBy("cust").agg(F.count("*").alias("total")), "cust")
    return status.drop_unyeared(rows, C.fetch_policy(F.col("total"), F.lit(None).cast("int"), THRESHOLD)["strategy"]).drop("total")


@query(f"""WITH {CACHED}, p AS (SELECT cust, year, n + 1 AS n FROM hist WHERE year <> 1994), c AS (SELECT cust, year, n FROM sy WHERE cust % 2 = 0)
SELECT r.cust, r.year, coalesce(p.n, r.histogram_count) AS histogram_count, coalesce(c.n, r.cached_total) AS cached_total, CASE WHEN c.n IS NOT NULL AND c.n <> r.cached_total THEN c.n + r.dedup_count ELSE r.seen_total END AS seen_total, r.dedup_count FROM records r LEFT JOIN p ON p.cust = r.cust AND p.year = r.year LEFT JOIN c ON c.cust = r.cust AND c.year = r.year""")
def synced_records(spark, d):
    t = Tables(spark, d)
    return status.synced_records(_records(t), t.histogram().where("year <> 1994").withColumn("n", F.col("n") + 1), t.seen_years().where("cust % 2 = 0"), ["cust"])


@query(f"""WITH {HIST} SELECT h.cust, h.year, CASE WHEN h.year = 1993 AND h.cust % 2 = 0 THEN 'completed_earlier_in_run' WHEN h.cust % 3 = 0 AND coalesce(s.n, 0) >= h.n THEN 'partial_resume_completed' WHEN coalesce(s.n, 0) >= h.n THEN 'seen_total_match_skip' ELSE 'fetch' END AS action FROM hist h LEFT JOIN sy s ON s.cust = h.cust AND s.year = h.year""")
def year_outcomes(spark, d):
    t = Tables(spark, d)
    both = t.histogram().join(t.seen_years().withColumnRenamed("n", "seen"), ["cust", "year"], "left")
    return both.select("cust", "year", status.year_action(F.col("n"), F.col("seen"), "normal", (F.col("year") == 1993) & (F.col("cust") % 2 == 0), F.col("cust") % 3 == 0).alias("action"))


STRATEGY = f"""{DIRTY}, seen AS (SELECT * FROM cites WHERE pos IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')), hist AS (SELECT cust, year, count(*) AS n FROM cites GROUP BY ALL),
cached AS (SELECT cust, year, count(*) FILTER (pos % 4 <> 0) AS cached, count(*) FILTER (pos % 4 = 0) AS dedup FROM seen GROUP BY ALL), records AS (SELECT coalesce(c.cust, h.cust) AS cust, coalesce(c.year, h.year) AS year, coalesce(h.n, 0) AS h, coalesce(cached, 0) AS c, coalesce(cached, 0) + coalesce(dedup, 0) AS s FROM cached c FULL JOIN (SELECT * FROM hist WHERE year <> 1995) h ON c.cust = h.cust AND c.year = h.year),
own AS (SELECT cust, string_agg(year || ':' || h || ':' || c || ':' || s, ',' ORDER BY year) AS own FROM records WHERE cust % 2 = 0 GROUP BY 1),
yc AS (SELECT cust, y AS year, count(*) AS n FROM clean WHERE y IS NOT NULL GROUP BY ALL), made AS (SELECT cust, string_agg(year || ':' || n || ':' || n || ':' || n, ',' ORDER BY year) AS made FROM yc GROUP BY 1),
w AS (SELECT c_custkey AS cust, coalesce((SELECT count(*) FROM cites c WHERE c.cust = c_custkey), 0) AS total, coalesce((SELECT count(*) FROM seen c WHERE c.cust = c_custkey), 0) AS n, (SELECT count(*) FROM clean c WHERE c.cust = c_custkey) AS rows, (SELECT count(y) FROM clean c WHERE c.cust = c_custkey) AS yeared FROM customer),
z AS (SELECT w.*, own, made, cust % 5 = 0 AS first, total >= {THRESHOLD} AS by_year, total - CAST(cust % 3 = 0 AS INT) AS previous FROM w LEFT JOIN own USING (cust) LEFT JOIN made USING (cust))"""


@query(f"""WITH {STRATEGY} SELECT cust, CASE WHEN first THEN 'first_fetch' ELSE 'fetch' END AS mode, CAST(CASE WHEN first THEN 0 WHEN by_year THEN yeared ELSE rows END AS BIGINT) AS resume_from, CASE WHEN first THEN 0 ELSE previous END AS prev_scholar_count, NOT first AS force_year_rebuild,
CASE WHEN NOT first THEN coalesce(own, CASE WHEN by_year THEN made END) END AS records, CASE WHEN by_year THEN 'year' ELSE 'direct' END AS strategy,
CASE WHEN first THEN 'first fetch' ELSE 'fetch (' || rows || ' cached, seen=' || n || ', ' || CASE WHEN previous <> total THEN 'scholar ' || previous || ' -> ' || total ELSE 'scholar=' || total || ' unchanged; recheck ' || CASE WHEN by_year THEN 'by year' ELSE '(direct)' END END || CASE WHEN by_year THEN '; drop unyeared' ELSE '' END || ')' END AS action, 13 AS fields FROM z""")
def refresh_strategy(spark, d):
    t = Tables(spark, d)
    pubs = t.totals().select("cust", F.when(F.col("cust") % 5 == 0, "missing").otherwise("partial").alias("status"), F.col("scholar_total").alias("total"), (F.col("scholar_total") - (F.col("cust") % 3 == 0).cast("int")).alias("previous"), F.col("seen_total").alias("seen"), C.fetch_policy(F.col("scholar_total"), F.lit(None).cast("int"), THRESHOLD).alias("policy"))
    rows = t.dirty().select("cust", C.citation_year(F.col("year_text")).cast("bigint").alias("year"))
    out = status.refresh_strategy(pubs, rows, _records(t).where("cust % 2 = 0"), ["cust"], "exact")
    fields = len(out.schema["refresh"].dataType.fields)
    return out.select("cust", "refresh.mode", "refresh.resume_from", "refresh.prev_scholar_count", "refresh.force_year_rebuild", F.col("refresh.rehydrated_year_fetch_diagnostics").alias("records"), "refresh.fetch_policy.strategy", "refresh.action", F.lit(fields).alias("fields"))


@query(f"""WITH {CACHED}, s AS (SELECT cust, sum(histogram_count)::BIGINT AS h, sum(cached_total)::BIGINT AS c, sum(seen_total)::BIGINT AS n FROM records WHERE cust % 4 <> 3 GROUP BY 1), t AS (SELECT cust, count(*) AS total FROM cites GROUP BY 1)
SELECT c_custkey AS cust, coalesce(t.total, 1) AS total, CASE WHEN c_custkey % 2 = 0 AND s.cust IS NOT NULL THEN h WHEN c_custkey % 2 = 0 THEN 0 ELSE 5 END AS histogram_total, CASE WHEN c_custkey % 2 = 0 AND s.cust IS NOT NULL THEN c ELSE 0 END AS cached_total, CASE WHEN c_custkey % 2 = 0 AND s.cust IS NOT NULL THEN n ELSE 0 END AS seen_total, c_custkey % 3 = 0 AS fetch_complete FROM customer LEFT JOIN s ON s.cust = c_custkey LEFT JOIN t ON t.cust = c_custkey""")
def repair_states(spark, d):
    t = Tables(spark, d)
    zero = F.lit(0).cast("bigint")
    states = t.customer.select(F.col("c_custkey").alias("cust"), F.lit(1).cast("bigint").alias("total"), F.when(F.col("c_custkey") % 2 == 0, zero).otherwise(F.lit(5).cast("bigint")).alias("histogram_total"), zero.alias("cached_total"), zero.alias("seen_total"), F.when(F.col("c_custkey") % 3 == 0, True).alias("attempt"))
    return status.repaired(states, t.cites().groupBy("cust").agg(F.count("*").alias("total")), _records(t).where("cust % 4 <> 3"), ["cust"])


@query("SELECT coalesce(a.c_custkey, b.c_custkey) AS cust, coalesce(a.c_name || '-now', b.c_name) AS state FROM (SELECT * FROM customer WHERE c_custkey % 6 = 0) a FULL JOIN (SELECT * FROM customer WHERE c_custkey % 4 = 0) b USING (c_custkey)")
def latest_state(spark, d):
    c = Tables(spark, d).customer.select(F.col("c_custkey").alias("cust"), F.col("c_name").alias("state"))
    return status.latest_state(c.where("cust % 6 = 0").withColumn("state", F.concat("state", F.lit("-now"))), c.where("cust % 4 = 0"), ["cust"])


@query(f"WITH {CITES} SELECT cust, year, string_agg(pos, ',' ORDER BY pos) AS members FROM (SELECT cust, pos, CASE WHEN pos % 5 <> 0 THEN year END AS year FROM cites) GROUP BY ALL")
def year_buckets(spark, d):
    rows = Tables(spark, d).cites().withColumn("year", F.when(F.col("pos") % 5 != 0, F.col("year"))).withColumn("id", F.col("pos").cast("string"))
    return merge.year_buckets(rows, ["cust"], "id").withColumn("members", F.array_join("members", ","))


@query(f"WITH {CITES}, f AS (SELECT * FROM cites WHERE pos % 3 = 0 AND cust % 4 <> 0) SELECT cust, pos FROM f UNION ALL SELECT cust, pos FROM cites WHERE pos % 2 = 0 AND cust NOT IN (SELECT cust FROM f)")
def never_empty(spark, d):
    rows = Tables(spark, d).cites().select("cust", "pos")
    return merge.never_empty(rows.where("pos % 3 = 0 and cust % 4 <> 0"), rows.where("pos % 2 = 0"), ["cust"])


@query(f"WITH {CITES}, b AS (SELECT cust, pos, year FROM cites WHERE pos % 2 = 0), f AS (SELECT cust, pos, year FROM cites WHERE pos % 2 = 1 AND year IN (1993, 1996)), u AS (SELECT *, 0 AS side FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.cust = b.cust AND f.year = b.year) UNION ALL SELECT *, 1 FROM f) SELECT cust, pos, year, row_number() OVER (PARTITION BY cust ORDER BY side, CASE WHEN side = 1 THEN year END NULLS LAST, pos) AS no FROM u")
def session_rows(spark, d):
    rows = Tables(spark, d).cites().select("cust", "pos", "year")
    return merge.with_order(merge.all_rows(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1 and year in (1993, 1996)"), ["cust"]), ["cust"]).drop("side")


CURRENT = f"""{KEYED}, b AS (SELECT user_id, event_id AS pos, keys, event_id % 3 AS year FROM k WHERE event_id % 2 = 0), f AS (SELECT user_id, event_id AS pos, keys, event_id % 3 AS year FROM k WHERE event_id % 2 = 1 AND event_id % 3 = 0)"""


@query(f"WITH {CURRENT} SELECT user_id, side, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM (SELECT user_id, pos, 0 AS side FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = b.user_id AND f.year = b.year) UNION ALL SELECT user_id, pos, 1 FROM f) WHERE user_id % 2 = 0 GROUP BY ALL")
def current_view(spark, d):
    rows = _keyed(Tables(spark, d)).select("user_id", F.col("event_id").alias("pos"), "keys", (F.col("event_id") % 3).alias("year"))
    base, fresh = rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1 and pos % 3 = 0")
    out = merge.current_view(base, fresh, ["user_id"], rows.where("user_id % 2 = 0").select("user_id").distinct())
    return out.where("user_id % 2 = 0").groupBy("user_id", "side").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query("WITH u AS (SELECT c_mktsegment AS title, 'u' || c_custkey AS url, c_custkey AS pos FROM customer WHERE c_nationkey % 5 <> 0) SELECT c_custkey AS cust, (SELECT arg_max(url, pos) FROM u WHERE u.title = c_mktsegment) AS url FROM customer")
def url_lookup(spark, d):
    t = Tables(spark, d)
    urls = t.customer.where("c_nationkey % 5 <> 0").select(F.col("c_mktsegment").alias("title"), F.col("c_custkey").alias("pos"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"))
    return t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("title")).join(merge.last_by_title(urls, "title", "pos", "url"), "title", "left").select("cust", "url")


@query(f"""WITH RECURSIVE {KEYED}, ok AS (SELECT user_id, list(DISTINCT key) AS seen FROM (SELECT user_id, unnest(keys) AS key FROM k WHERE event_id % 7 = 0) GROUP BY 1),
r AS (SELECT k.user_id, event_id, keys, row_number() OVER (PARTITION BY k.user_id ORDER BY event_id) AS i FROM k WHERE event_id % 7 <> 0),
w AS (SELECT r.user_id, event_id, i, CASE WHEN list_has_any(coalesce(seen, []), keys) THEN coalesce(seen, []) ELSE list_concat(coalesce(seen, []), keys) END AS seen, list_has_any(coalesce(seen, []), keys) AS is_dupe FROM r LEFT JOIN ok ON ok.user_id = r.user_id WHERE i = 1 UNION ALL
SELECT r.user_id, r.event_id, r.i, CASE WHEN list_has_any(w.seen, r.keys) THEN w.seen ELSE list_concat(w.seen, r.keys) END, list_has_any(w.seen, r.keys) FROM w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1)
SELECT user_id, event_id FROM w WHERE NOT is_dupe""")
def once_new(spark, d):
    rows = _keyed(Tables(spark, d))
    return identity.once_new(rows.where("event_id % 7 <> 0"), rows.where("event_id % 7 = 0"), ["user_id"], "event_id", "keys").select("user_id", "event_id")


@query(f"{SNAP}, h AS (SELECT c_nationkey AS nation, CAST(c_custkey % 3 AS BIGINT) AS seq, count(*) AS n FROM customer WHERE c_nationkey % 2 = 0 GROUP BY ALL), r AS (SELECT c_nationkey AS nation, sum(cur.n)::BIGINT AS n FROM cur JOIN customer ON c_custkey = cur.cust GROUP BY 1) SELECT * FROM h UNION ALL SELECT nation, coalesce((SELECT max(seq) FROM h WHERE h.nation = r.nation), 0) + 1, n FROM r")
def append_history(spark, d):
    t = Tables(spark, d)
    history = t.customer.where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 3).alias("seq")).agg(F.count("*").alias("n"))
    current, _ = _snapshots(t)
    record = current.join(t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation")), "cust").groupBy("nation").agg(F.sum("n").alias("n"))
    return snapshots.append_history(history, record, ["nation"])


@query("WITH p AS (SELECT c_nationkey AS nation, c_custkey AS cust, 'old' AS list FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey <> 3), l AS (SELECT c_nationkey AS nation, c_custkey AS cust, 'new' AS list FROM customer), k AS (SELECT n_nationkey AS nation FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey IN (SELECT nation FROM p)) SELECT * FROM p WHERE nation IN (SELECT nation FROM k) UNION ALL SELECT * FROM l WHERE nation NOT IN (SELECT nation FROM k)")
def publication_reuse(spark, d):
    t = Tables(spark, d)
    rows = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cust"))
    totals = t.nation.select(F.col("n_nationkey").alias("nation"), F.lit(1).alias("old"), (F.col("n_nationkey") % 2).alias("new"))
    return snapshots.reused_publications(rows.where("cust % 2 = 0 and nation <> 3").withColumn("list", F.lit("old")), rows.withColumn("list", F.lit("new")), totals, ["nation"])


@query(f"WITH {TOTALS} SELECT cust, scholar_total - CAST(cust % 3 = 0 AS INT) <> scholar_total AS changed, CASE WHEN scholar_total = 0 THEN 'skip_zero' WHEN NOT has_state THEN 'missing' WHEN cust % 3 = 0 OR seen_total < scholar_total THEN 'partial' ELSE 'complete' END AS status FROM totals")
def changed_status(spark, d):
    rows = _classified(Tables(spark, d)).withColumn("previous", F.col("scholar_total") - (F.col("cust") % 3 == 0).cast("int"))
    changed = F.col("previous") != F.col("scholar_total")
    return rows.select("cust", changed.alias("changed"), status.status(F.col("scholar_total"), F.col("has_state"), changed, F.col("seen_total") >= F.col("scholar_total")).alias("status"))
