"""Quotation linking: conversations in reply order and without quotes, from quoted messages.

A message is a distinct row (conv_id, turn, role, text); a conversation's messages are numbered by turn, role and hash of the
text. A line's level is its number of leading `>`. A passage is a run of lines of one level without an empty one. Its units, all
normalised (lower case, single blanks), are the whole passage joined over its lines, so that a quote may be wrapped anew, its
sentences, so that a part may be quoted, and its lines. Units are hashed, and each quoted one is looked up among the unquoted
ones of earlier messages of the conversation; the latest that has it is its origin. A message replies to the origin of its
quoted units, of the lowest level first, then of most characters, then the latest; without one, to the message before. A line
`On ... wrote:` before a quote goes with the quote; the text keeps the other unquoted lines.

Reply order is depth first: a message, then its replies by number, each followed by its own replies. Messages that reply to the
one before form runs, so only branches need work: they are visited as an Euler tour, whose running sums come from pointer jumping
in as many rounds as the logarithm of a conversation's branches.

All is DataFrame functions. Numbers and origins come from rows sorted by range, with what earlier partitions hold carried over, so
a conversation or a quoted line that holds a third of all rows is cut like any other. The branches at one message are ordered by
one task, as narrow rows that spill.

Nulls sort first and equal each other: rows with a null conv_id are one conversation. A null text stays null and quotes nothing; an
empty text stays empty; a text of quotes only becomes empty. Repeated rows are one message and share its number, reply and text.
Ties of turn go by role and hash of the text. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.shared import stored, table

QUOTED = r"(?m)^[ \t]*>"
LEVEL = r"^([ \t]*>)+"
ATTRIBUTION = r"^[ \t]*On .* wrote:[ \t\r]*$"
PARTITION_BITS = 33  # fixed value: of monotonically_increasing_id, below the partition's number
MESSAGE = ["conv_id", "turn", "role", "message"]


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\f]+", " "))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left joined to right by keys, nulls being equal; right's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = left.join(renamed, condition, how)
    return out if how == "left_semi" else out.drop(*(f"__{k}" for k in keys))


def _sorted(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows as a stored table with __id, which ascends in the order given, and __part, which a group's rows may share or not."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return stored(ranged, name).withColumn("__part", F.shiftright("__id", PARTITION_BITS))


def _numbered(rows: DataFrame, key: str, order: list, name: str) -> DataFrame:
    """rows with at, their number from 1 among those of equal key."""
    ranged = _sorted(rows, [key, *order], name)
    parts = ranged.groupBy(key, "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(key, "__part", (earlier - F.col("__first") + 1).alias("__shift"))
    return _same(ranged, parts, [key, "__part"]).withColumn("at", F.col("__id") + F.col("__shift")).drop("__id", "__part", "__shift")


def _last_before(rows: DataFrame, keys: list[str], order: list, value: Column, found: str, name: str) -> DataFrame:
    """rows with found, the last value that isn't null of the rows of equal keys that sort before."""
    ranged = _sorted(rows.withColumn("__value", value), [*keys, *order], name)
    here = F.last("__value", ignorenulls=True).over(Window.partitionBy("__part", *keys).orderBy("__id").rowsBetween(Window.unboundedPreceding, -1))
    parts = ranged.groupBy("__part", *keys).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("__id"))).alias("__last"))
    carried = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__part", *keys, carried.alias("__carried"))
    out = _same(ranged.withColumn("__here", here), parts, ["__part", *keys])
    return out.withColumn(found, F.coalesce("__here", "__carried")).drop("__id", "__part", "__value", "__here", "__carried")


def _lines(texts: DataFrame) -> DataFrame:
    """(conv_id, at, pos, line, level, content, leads) of messages (conv_id, at, text)."""
    lines = texts.select("conv_id", "at", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("level", F.length(F.regexp_replace(F.regexp_extract("line", LEVEL, 0), "[^>]", ""))).withColumn("content", _normal(F.regexp_replace("line", LEVEL, "")))
    following = F.lead("level").over(Window.partitionBy("conv_id", "at").orderBy("pos"))
    return lines.withColumn("leads", F.col("line").rlike(ATTRIBUTION) & (F.coalesce(following, F.lit(0)) > F.col("level")))


def _units(lines: DataFrame) -> DataFrame:
    """(conv_id, at, level, passage, unit): the distinct units of each passage."""
    ends = Window.partitionBy("conv_id", "at").orderBy("pos")
    broken = (F.col("level") != F.lag("level").over(ends)) | F.col("leads") | (F.col("content") == "")
    lines = lines.withColumn("passage", F.sum(F.coalesce(broken, F.lit(False)).cast("long")).over(ends.rowsBetween(Window.unboundedPreceding, 0)))
    passages = lines.where(~F.col("leads") & (F.col("content") != "")).groupBy("conv_id", "at", "level", "passage").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]).alias("lines"))
    whole = F.array_join("lines", " ")
    sentences = F.split(F.regexp_replace(whole, r"([.!?]) ", "$1\n"), "\n")
    return passages.select("conv_id", "at", "level", "passage", F.explode(F.array_distinct(F.concat(F.array(whole), sentences, "lines"))).alias("unit")).where("unit <> ''")


def _origins(units: DataFrame) -> DataFrame:
    """(conv_id, at, origin, quoted_passages, linked_passages) of messages that quote."""
    units = units.select("conv_id", "at", "level", "passage", F.md5("unit").alias("hash"), F.length("unit").cast("long").alias("chars"))
    quoted = units.where("level > 0").select("conv_id", "hash").distinct()
    # a message's quotes sort before its own words, so that they see earlier messages only
    found = _last_before(_same(units, quoted, ["conv_id", "hash"], "left_semi"), ["conv_id", "hash"], ["at", F.col("level").desc(), "passage"], F.when(F.col("level") == 0, F.col("at")), "origin", "units")
    found = found.where("level > 0")
    votes = found.where("origin is not null").groupBy("conv_id", "at", "origin").agg(F.min("level").alias("level"), F.sum("chars").alias("chars"))
    best = votes.groupBy("conv_id", "at").agg(F.max_by("origin", F.struct(-F.col("level"), "chars", "origin")).alias("origin"))
    passages = found.groupBy("conv_id", "at", "passage").agg(F.max(F.col("origin").isNotNull().cast("long")).alias("linked"))
    counts = passages.groupBy("conv_id", "at").agg(F.count("*").alias("quoted_passages"), F.sum("linked").alias("linked_passages"))
    return _same(counts, best, ["conv_id", "at"])


def _offsets(branches: DataFrame) -> DataFrame:
    """(conv_id, start, offset): messages that precede each run in reply order, of runs (conv_id, start, parent, attached, size)."""
    among = Window.partitionBy("conv_id", "parent").orderBy(F.col("attached").desc(), "start")
    runs = branches.withColumn("sibling", F.when(F.col("parent").isNotNull(), F.lead("start").over(among))).withColumn("place", F.row_number().over(among))
    first = runs.where("place = 1 and parent is not null").select("conv_id", F.col("parent").alias("start"), F.col("start").alias("child"))
    runs = stored(_same(runs, first, ["conv_id", "start"]), "runs")
    # event 2 * start enters a run, 2 * start + 1 leaves it; rest sums the sizes of the runs entered from an event on
    enter = runs.select("conv_id", (F.col("start") * 2).alias("event"), F.coalesce(F.col("child") * 2, F.col("start") * 2 + 1).alias("next"), F.col("size").alias("rest"))
    leave = runs.select("conv_id", (F.col("start") * 2 + 1).alias("event"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("rest"))
    tour = stored(enter.unionByName(leave), "tour")
    while not tour.where("next is not null").isEmpty():
        ahead = tour.select("conv_id", F.col("event").alias("next"), F.col("rest").alias("more"), F.col("next").alias("after"))
        tour = stored(_same(tour, ahead, ["conv_id", "next"]).select("conv_id", "event", F.col("after").alias("next"), (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest")), "tour")
    entered = tour.where("event % 2 = 0").select("conv_id", (F.col("event") / 2).cast("long").alias("start"), "rest")
    totals = entered.where("start = 1").select("conv_id", F.col("rest").alias("total"))
    return _same(entered, totals, ["conv_id"]).select("conv_id", "start", (F.col("total") - F.col("rest")).alias("offset"))


def _positions(messages: DataFrame, origins: DataFrame) -> DataFrame:
    """(conv_id, at, position) of the messages of conversations with branches; origins is a stored table."""
    branches = origins.where("origin < at - 1").select("conv_id", F.col("at").alias("start"), F.col("origin").alias("attached"))
    last = _same(messages, branches.select("conv_id").distinct(), ["conv_id"], "left_semi").groupBy("conv_id").agg(F.max("at").alias("last"))
    roots = last.select("conv_id", F.lit(1).cast("long").alias("start"), F.lit(None).cast("long").alias("attached"))
    starts = stored(branches.unionByName(roots), "starts")
    members = _same(messages.select("conv_id", "at"), last.select("conv_id"), ["conv_id"], "left_semi")
    # a run's start sorts before the message of its number, and so does it before those that attach there
    marks = starts.select("conv_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("start").alias("value"))
    asked = members.select("conv_id", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("value"))
    within = stored(_last_before(marks.unionByName(asked), ["conv_id"], ["at", "kind"], F.col("value"), "run", "within").where("kind = 1").select("conv_id", "at", "run"), "run")
    sizes = within.groupBy("conv_id", F.col("run").alias("start")).agg(F.count("*").alias("size"))
    parents = within.select("conv_id", F.col("at").alias("attached"), F.col("run").alias("parent"))
    offsets = _offsets(_same(_same(starts, sizes, ["conv_id", "start"]), parents, ["conv_id", "attached"]))
    return _same(within, offsets.withColumnRenamed("start", "run"), ["conv_id", "run"]).select("conv_id", "at", (F.col("offset") + F.col("at") - F.col("run") + 1).alias("position"))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, reply_to, quoted_passages, linked_passages, position) of each row; reply_to is the turn of the
    message that it replies to, null for the first."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("message", F.md5("text"))
    quoting = F.coalesce(F.col("text").rlike(QUOTED), F.lit(False))
    keys = rows.groupBy(*MESSAGE).agg(F.max(quoting).alias("quoting"))
    messages = stored(_numbered(keys, "conv_id", ["turn", "role", "message"], "messages"), "numbered")
    out = messages.select(*MESSAGE, "at", (F.col("at") - 1).alias("reply_at"), F.lit(0).cast("long").alias("quoted_passages"), F.lit(0).cast("long").alias("linked_passages"), F.col("at").alias("position"), F.lit(None).cast("string").alias("clean"))
    if not messages.where("quoting").isEmpty():
        involved = _same(messages, messages.where("quoting").select("conv_id").distinct(), ["conv_id"], "left_semi")
        texts = _same(involved.select(*MESSAGE, "at"), rows.where("text is not null").dropDuplicates(MESSAGE), MESSAGE)
        lines = stored(_lines(texts.where("text is not null")), "lines")
        origins = stored(_origins(_units(lines)), "origins")
        kept = F.array_sort(F.collect_list(F.when((F.col("level") == 0) & ~F.col("leads"), F.struct("pos", "line"))))
        clean = lines.groupBy("conv_id", "at").agg(F.max(F.col("level") > 0).alias("quotes"), kept.alias("kept")).where("quotes")
        clean = clean.select("conv_id", "at", F.btrim(F.array_join(F.transform("kept", lambda x: x["line"]), "\n"), F.lit(" \t\r\n")).alias("__clean"))
        found = _same(out.drop("quoted_passages", "linked_passages", "clean", "position"), origins, ["conv_id", "at"])
        found = _same(_same(found, clean, ["conv_id", "at"]), _positions(messages, origins), ["conv_id", "at"])
        out = found.select(*MESSAGE, "at", F.coalesce("origin", "reply_at").alias("reply_at"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("quoted_passages", "linked_passages")), F.coalesce("position", "at").alias("position"), F.col("__clean").alias("clean"))
    parents = messages.select("conv_id", F.col("at").alias("reply_at"), F.col("turn").alias("reply_to"))
    out = _same(out, parents, ["conv_id", "reply_at"])
    return _same(rows, out.drop("at", "reply_at"), MESSAGE).select("conv_id", "turn", "role", F.coalesce("clean", "text").alias("text"), "reply_to", "quoted_passages", "linked_passages", "position")


def op5_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, message NULLS FIRST) AS nr
  FROM (SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, role, text, md5(text) AS message FROM conversations)),
l0 AS (SELECT conv_id, nr, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m
  WHERE EXISTS (SELECT 1 FROM m q WHERE q.conv_id IS NOT DISTINCT FROM m.conv_id AND regexp_matches(q.text, '(?m)^[ \t]*>'))),
l1 AS (SELECT *, length(regexp_replace(regexp_extract(line, '^([ \t]*>)+'), '[^>]', '', 'g')) AS level,
  trim(regexp_replace(lower(regexp_replace(line, '^([ \t]*>)+', '')), '[ \t\r\f]+', ' ', 'g')) AS content FROM l0),
l2 AS (SELECT *, regexp_full_match(line, '[ \t]*On .* wrote:[ \t\r]*') AND coalesce(lead(level) OVER (PARTITION BY conv_id, nr ORDER BY pos), 0) > level AS leads,
  lag(level) OVER (PARTITION BY conv_id, nr ORDER BY pos) AS before FROM l1),
l AS (SELECT *, sum(CASE WHEN level <> before OR leads OR content = '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, nr ORDER BY pos) AS passage FROM l2),
clean AS (SELECT conv_id, nr, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT leads), ''), ' ' || chr(9) || chr(13) || chr(10)) AS clean
  FROM l GROUP BY ALL HAVING max(level) > 0),
p AS (SELECT conv_id, nr, level, passage, list(content ORDER BY pos) AS lines, string_agg(content, ' ' ORDER BY pos) AS whole FROM l WHERE NOT leads AND content <> '' GROUP BY ALL),
u AS (SELECT DISTINCT conv_id, nr, level, passage, unit FROM (SELECT conv_id, nr, level, passage,
  unnest(list_concat([whole], list_concat(string_split(regexp_replace(whole, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lines))) AS unit FROM p) WHERE unit <> ''),
o AS (SELECT *, (SELECT max(e.nr) FROM u e WHERE e.conv_id IS NOT DISTINCT FROM u.conv_id AND e.unit = u.unit AND e.level = 0 AND e.nr < u.nr) AS origin FROM u WHERE level > 0),
v AS (SELECT conv_id, nr, origin, min(level) AS level, sum(length(unit)) AS chars FROM o WHERE origin IS NOT NULL GROUP BY ALL),
b AS (SELECT conv_id, nr, arg_max(origin, {'a': -level, 'b': chars, 'c': origin}) AS origin FROM v GROUP BY ALL),
c AS (SELECT conv_id, nr, count(DISTINCT passage) AS quoted, count(DISTINCT passage) FILTER (origin IS NOT NULL) AS linked FROM o GROUP BY ALL),
r AS (SELECT m.*, coalesce(b.origin, CASE WHEN m.nr > 1 THEN m.nr - 1 END) AS parent, coalesce(c.quoted, 0) AS quoted, coalesce(c.linked, 0) AS linked, coalesce(clean.clean, m.text) AS kept
  FROM m LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND b.nr = m.nr LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM m.conv_id AND c.nr = m.nr
  LEFT JOIN clean ON clean.conv_id IS NOT DISTINCT FROM m.conv_id AND clean.nr = m.nr),
t AS (SELECT conv_id, nr, [nr] AS path, CAST(NULL AS BIGINT) AS reply_to, turn FROM r WHERE parent IS NULL
  UNION ALL SELECT r.conv_id, r.nr, list_append(t.path, r.nr), t.turn, r.turn FROM r JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.nr = r.parent),
z AS (SELECT conv_id, nr, reply_to, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS position FROM t)
SELECT s.conv_id, CAST(s.turn AS BIGINT) AS turn, s.role, r.kept AS text, z.reply_to, CAST(r.quoted AS BIGINT) AS quoted_passages, CAST(r.linked AS BIGINT) AS linked_passages, z.position
FROM conversations s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.turn IS NOT DISTINCT FROM s.turn AND r.role IS NOT DISTINCT FROM s.role AND r.message IS NOT DISTINCT FROM md5(s.text)
JOIN z ON z.conv_id IS NOT DISTINCT FROM r.conv_id AND z.nr = r.nr
"""
