"""Completeness of entities and years, and the plan of what to refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.columns import year_diagnostic
from tallywright.operators.rollups import year_counts

MODES = ("normal", "rough", "exact", "force")


def is_complete(strategy: Column, seen: Column, histogram_total: Column, scholar_total: Column) -> Column:
    """Seen reaches the histogram (year strategy) or the reported total (direct); unknown totals are incomplete."""
    return F.coalesce(seen >= F.when(strategy == "year", histogram_total).when(strategy == "direct", scholar_total), F.lit(False))


def inferred_strategy(strategy: Column, has_year: Column, has_direct: Column) -> Column:
    """The recorded strategy, else that whose diagnostics exist (year first), else null, which is never complete."""
    return F.coalesce(F.nullif(strategy, F.lit("")), F.when(has_year, "year"), F.when(has_direct, "direct"))


def year_proven(histogram: Column, recorded: Column, recorded_cached: Column, seen: Column, cached: Column | None = None) -> Column:
    """A year's diagnostic proves that the year is whole: it was made for this histogram count, holds no more rows than that,
    has seen as many, and, if cached is given, holds as many rows as are cached now."""
    held, got = F.coalesce(recorded_cached, F.lit(0)), F.coalesce(seen, F.lit(0))
    proven = (recorded == histogram) & (held <= histogram) & (got >= histogram)
    if cached is not None:
        proven = proven & (held == F.coalesce(cached, F.lit(0)))
    return F.coalesce(proven, F.lit(False))


def years_satisfied(entities: DataFrame, entity: list[str], probed: DataFrame, cached: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(entity..., satisfied): every probed year (entity..., year, n) has as many cached rows (n), or a diagnostic (year,
    histogram_count, cached_total, seen_total) that proves it. Without a probe: false."""
    own = diagnostics.select(*entity, "year", "histogram_count", "cached_total", "seen_total")
    years = probed.join(cached.select(*entity, "year", F.col("n").alias("__cached")), [*entity, "year"], "left").join(own, [*entity, "year"], "left")
    held = F.coalesce("__cached", F.lit(0))
    proven = (held == F.col("n")) | year_proven(F.col("n"), F.col("histogram_count"), F.col("cached_total"), F.col("seen_total"), held)
    return entities.join(years.groupBy(*entity).agg(F.bool_and(proven).alias("satisfied")), entity, "left").na.fill(False, ["satisfied"])


def legacy_status(current: Column, strategy: Column, year_summary: Column, per_year: Column, direct_summary: Column, counter: Column, rows: Column) -> Column:
    """complete or partial from an old cache. The seen total is the first of the direct summary's, the year summary's, the
    per-year entries' sum, and the greater of the row counter and the rows; the target is that of the strategy's summary
    (for years else the entries' sum), without one the current total. Summaries: structs (total, seen)."""
    year_total, year_seen = F.coalesce(year_summary["total"], per_year["total"]), F.coalesce(year_summary["seen"], per_year["seen"])
    seen = F.coalesce(direct_summary["seen"], year_seen, F.greatest(F.coalesce(counter, rows), rows))
    target = F.coalesce(F.when(strategy == "year", year_total).otherwise(direct_summary["total"]), current)
    return F.when(seen >= target, "complete").otherwise("partial")


def status(total: Column, has_state: Column, changed: Column, complete: Column) -> Column:
    """skip_zero, missing, partial or complete."""
    needs = F.coalesce(changed, F.lit(False)) | ~F.coalesce(complete, F.lit(False))
    return F.when(F.coalesce(total, F.lit(0)) == 0, "skip_zero").when(~has_state, "missing").when(needs, "partial").otherwise("complete")


def year_action(probed: Column, seen: Column, mode: str = "normal", done: Column | None = None, resumed: Column | None = None) -> Column:
    """Why a year is skipped, or `fetch`; a year that was resumed and is whole now is `partial_resume_completed`. Exact mode skips on equality only. No probe and something seen is a skip too."""
    s = F.coalesce(seen, F.lit(0))
    met = (s == probed) if mode == "exact" else (s >= probed)
    reason = "seen_total_exact_match" if mode == "exact" else "seen_total_match_skip"
    out = F.when(probed.isNotNull() & met, reason).when(probed.isNull() & (s > 0), "no_probe_data_skip").otherwise("fetch")
    if resumed is not None:
        out = F.when(resumed & probed.isNotNull() & met, "partial_resume_completed").otherwise(out)
    return F.when(done, "completed_earlier_in_run").otherwise(out) if done is not None else out


def year_plan(entities: DataFrame, entity: list[str], probed: DataFrame, seen: DataFrame, last_year: int, mode: str = "normal") -> DataFrame:
    """(entity..., year, probed, seen, action) of every year from start_year to last_year of entities (entity, start_year)."""
    years = entities.where(F.col("start_year") <= last_year).withColumn("year", F.explode(F.sequence(F.col("start_year").cast("int"), F.lit(last_year))))
    return years.join(probed, [*entity, "year"], "left").join(seen, [*entity, "year"], "left").withColumn("action", year_action(F.col("probed"), F.col("seen"), mode))


def rough_skip(previous: Column, total: Column, complete: Column) -> Column:
    """Rough mode skips an entity whose total is that of the previous snapshot, if its last fetch ran to its end."""
    return F.coalesce((previous.try_cast("long") == total) & complete, F.lit(False))


def rough_plan(previous: DataFrame, current: DataFrame, entity: list[str]) -> DataFrame:
    """(entity..., total, previous, action) of current (entity..., total): `skip_rough` or `fetch`, by the snapshot before
    (entity..., total, complete), one row an entity."""
    before = previous.select(*entity, F.col("total").alias("previous"), "complete")
    action = F.when(rough_skip(F.col("previous"), F.col("total"), F.col("complete")), "skip_rough").otherwise("fetch")
    return current.select(*entity, "total").join(before, entity, "left").select(*entity, "total", "previous", action.alias("action"))


def candidate_years(cached: Column, probed: Column, years: Column, partial: Column) -> Column:
    """Those of years whose probed count differs from the cached one, or that are among partial; a year that the histogram
    lacks counts as whole. Null without a histogram, or with an empty one: then all years are to be read."""
    differs = lambda y: probed[y].isNotNull() & (F.coalesce(cached[y], F.lit(0)) != probed[y])
    return F.when(F.size(probed) > 0, F.filter(years, lambda y: differs(y) | F.array_contains(partial, y)))


def skip_reason(mode: str, previous: Column, total: Column, attempt: Column, strategy: Column, rows: Column, yeared: Column, url: Column) -> Column:
    """Why a pending entity is left as it is, else `fetch`: rough mode with an unchanged total after a whole attempt, no url,
    or only rows without year under the year strategy after a whole attempt, with a total that has not grown."""
    rough = rough_skip(previous, total, attempt) if mode == "rough" else F.lit(False)
    unyeared = (strategy == "year") & attempt & (total <= F.coalesce(previous, F.lit(0))) & (rows > 0) & (yeared == 0)
    return F.when(rough, "skip_rough").when(F.coalesce(url, F.lit("")) == "", "no_url").when(F.coalesce(unyeared, F.lit(False)), "skip_unyeared").otherwise("fetch")


def attempt_flag(attempt: Column, rows: Column) -> Column:
    """The flag of a whole attempt, reset where nothing was kept."""
    return F.coalesce(attempt, F.lit(False)) & (rows > 0)


def run_skip(previous_total: Column, total: Column, previous_n: Column, n: Column, pending: Column, mode: str) -> Column:
    """A whole run is skipped if totals and numbers are those of before and nothing is pending; never in force mode."""
    return F.lit(mode != "force") & F.coalesce((previous_total == total) & (previous_n == n) & ~pending, F.lit(False))


def migrated_records(rows: DataFrame, entity: list[str]) -> DataFrame:
    """Year records made from cached rows (entity..., year) when an entity changes from the direct to the year strategy."""
    counted = year_counts(rows, entity)
    d = year_diagnostic(F.col("year"), F.col("n"), F.col("n"), F.lit(0).cast("bigint"))
    return counted.select(*entity, d.alias("d")).select(*entity, "d.*", F.lit("direct_to_year_migration").alias("termination_reason"))


def drop_unyeared(rows: DataFrame, strategy: Column) -> DataFrame:
    """Cached rows as a refresh begins: those without a year go under the year strategy."""
    return rows.where((strategy != "year") | F.col("year").isNotNull())


def synced_records(records: DataFrame, probed: DataFrame, cached: DataFrame, entity: list[str]) -> DataFrame:
    """Year records brought up to the probe (entity..., year, n) and the cache (n) of now where these know the year."""
    now = records.join(probed.select(*entity, "year", F.col("n").alias("__probe")), [*entity, "year"], "left").join(cached.select(*entity, "year", F.col("n").alias("__cached")), [*entity, "year"], "left")
    moved = F.col("__cached").isNotNull() & ~F.col("__cached").eqNullSafe(F.col("cached_total"))
    seen = F.when(moved, F.col("__cached") + F.greatest(F.lit(0), F.col("dedup_count"))).otherwise(F.col("seen_total"))
    return now.withColumns({"histogram_count": F.coalesce("__probe", "histogram_count"), "seen_total": seen, "cached_total": F.coalesce("__cached", "cached_total")}).drop("__probe", "__cached")


def refresh_strategy(pubs: DataFrame, cached: DataFrame, records: DataFrame, entity: list[str], mode: str = "normal") -> DataFrame:
    """What each pending entity's refresh does, a struct of 13 fields. pubs: (entity..., status, total, previous, seen, policy);
    cached: rows (entity..., year); records: (entity..., year, histogram_count, cached_total, seen_total, dedup_count).
    Rows without year are dropped from what a year refresh goes on from; records are made from rows where there are none."""
    zero = F.lit(0).cast("bigint")
    rows = cached.groupBy(*entity).agg(F.count("*").alias("rows"), F.count("year").alias("yeared"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "histogram_count", "cached_total", "seen_total"))), lambda r: F.concat_ws(":", *(r[k].cast("string") for k in ("year", "histogram_count", "cached_total", "seen_total")))), ",")
    own = records.groupBy(*entity).agg(text.alias("own"))
    made = migrated_records(cached, entity).groupBy(*entity).agg(text.alias("made"))
    out = pubs.join(rows, entity, "left").join(own, entity, "left").join(made, entity, "left").na.fill(0, ["rows", "yeared"])
    first, by_year = F.col("status") == "missing", F.col("policy.strategy") == "year"
    seen = F.coalesce(F.concat(F.lit(", seen="), F.col("seen").cast("string")), F.lit(""))
    changed = F.concat(F.lit("scholar "), F.col("previous").cast("string"), F.lit(" -> "), F.col("total").cast("string"))
    same = F.concat(F.lit("scholar="), F.col("total").cast("string"), F.lit(" unchanged; recheck "), F.when(by_year, "by year").otherwise("(direct)"))
    action = F.concat(F.lit("fetch ("), F.col("rows").cast("string"), F.lit(" cached"), seen, F.lit(", "), F.when(F.col("previous") != F.col("total"), changed).otherwise(same), F.when(by_year, "; drop unyeared").otherwise(""), F.lit(")"))
    none = F.lit(None)
    made_from = F.struct(
        F.when(first, "first_fetch").otherwise("fetch").alias("mode"),
        F.when(first, zero).when(by_year, F.col("yeared")).otherwise(F.col("rows")).alias("resume_from"),
        F.array().cast("array<int>").alias("completed_years_in_current_run"),
        F.create_map().cast("map<int,int>").alias("partial_year_start"),
        zero.alias("saved_dedup_count"),
        F.when(first, zero).otherwise(F.coalesce("previous", zero)).alias("prev_scholar_count"),
        F.lit(True).alias("allow_incremental_early_stop"),
        (~first & F.lit(mode == "exact")).alias("force_year_rebuild"),
        none.cast("array<int>").alias("selective_refresh_years"),
        F.when(~first, F.coalesce("own", F.when(by_year, F.col("made")))).alias("rehydrated_year_fetch_diagnostics"),
        F.when(first, "first fetch").otherwise(action).alias("action"),
        F.col("policy").alias("fetch_policy"),
        none.cast("struct<next_index:bigint,source_total:bigint,url:string>").alias("direct_resume_state"),
    )
    return out.select(*entity, made_from.alias("refresh"))


def repaired(states: DataFrame, totals: DataFrame, records: DataFrame, entity: list[str]) -> DataFrame:
    """The repair job over stored states (entity..., total, histogram_total, cached_total, seen_total, attempt): totals as now
    reported (entity..., total), summaries that are zero throughout rebuilt from year records, the flag on the entity."""
    names = ["histogram_total", "cached_total", "seen_total"]
    sums = records.groupBy(*entity).agg(*(F.sum(a).alias(f"__{b}") for a, b in zip(["histogram_count", "cached_total", "seen_total"], names, strict=True)))
    out = states.join(totals.select(*entity, F.col("total").alias("__total")), entity, "left").join(sums, entity, "left")
    empty = F.col("__cached_total").isNotNull()
    for c in names:
        empty = empty & (F.coalesce(c, F.lit(0)) == 0)
    out = out.withColumns({c: F.when(empty, F.col(f"__{c}")).otherwise(F.col(c)) for c in names})
    return out.select(*entity, F.coalesce("__total", "total").alias("total"), *names, F.coalesce("attempt", F.lit(False)).alias("fetch_complete"))


def latest_state(mid_run: DataFrame, persisted: DataFrame, entity: list[str]) -> DataFrame:
    """(entity..., state): an entity's state of this run, if it has one, before the persisted one."""
    now = mid_run.select(*entity, F.col("state").alias("__now"), F.lit(True).alias("__has"))
    return persisted.join(now, entity, "full").select(*entity, F.when(F.col("__has"), F.col("__now")).otherwise(F.col("state")).alias("state"))


def start_year(histogram_min: Column, complete: Column, publication_year: Column, links_min: Column, snippets_min: Column) -> Column:
    """First year to read: an exact histogram's, else the earlier of it and the publication's, else fallbacks in turn."""
    return F.coalesce(F.when(complete, histogram_min), F.least(histogram_min, publication_year), links_min, snippets_min, publication_year)
