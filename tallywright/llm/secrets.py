"""Secret scans: a random forest over native features decides which candidates are secrets.

A candidate is a run of LONG token characters or more with a letter and a digit or a known PREFIX, wherever in a text, or one
of SHORT or more right after `=` or `:` that has a letter and a digit or stands near a word of FOR; a word may hold several, and `name=` is part of the
context. The forest's features are the value's length and mix of characters, its transitions between character
classes, the share that dictionary words cover, marks of paths, known prefixes, and the words before and after. It is trained
on labelled findings (value, before, after, path, label): given ones, of which at most LABELLED are used, or a generated set.
A score of DECIDED is a secret. Findings of one label, or none, make a forest that always says it, or no finding a secret.

A text is cut once into runs and the pieces between them, which also give a run's place and context, so that the work is
linear in the text's length, however long it is. The context reaches back to the run before the last.

Only DataFrame functions and Spark's own forest are used. Null and empty texts have no candidate. A run that a document
repeats is a finding at each place, judged by the context there. Repeated rows give repeated findings. The path is the column `source`, empty if
null or missing. An empty table gives no findings. Other columns are ignored by the scan and kept by redacted.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.shared import stored, table

LABELLED = 20_000
TREES, DEPTH, SEED = 24, 10, 17
DECIDED = 0.5
MARK = "[SECRET]"
LONG, SHORT = 16, 8
_RUN = r"(?<![A-Za-z0-9+/_~])[A-Za-z0-9+/_~][A-Za-z0-9+/_.~-]{%d,}+"
RUN = f"{_RUN % (LONG - 1)}|(?<=[=:][\"' ]{{0,2}}){_RUN % (SHORT - 1)}"
ASSIGNED = r"[=:]\s*[\"'(\[]*$"
GROUP = 256  # runs whose lengths are added up at once, so that a text of many runs costs no square
# Words that speak for or against a secret, known prefixes of keys, and common words in names.
FOR = r"(?i)(token|secret|passw|pwd|credential|api.?key|apikey|access.?key|private.?key|auth|bearer|client.?key|signing)"
AGAINST = r"(?i)(commit|sha1|sha256|sha512|md5|checksum|digest|hash|uuid|guid|etag|revision|build|version|isbn|doi|order|invoice|tracking|card|phone|mail|example|sample|dummy|fake|placeholder)"
PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abp]-|AIza|eyJ|SG\.|npm_)"
DICTIONARY = r"(?i)(test|example|sample|secret|password|token|user|admin|name|file|path|data|home|index|image|page|http|https|www|html|json|config|value|string|number|version|release|build|class|object|function|default|system|service|server|client|public|private|account|report|document|content|message|article|order|mail|com|org|net|the|and|ing|tion|ent|for|that|with|xxxx|1234|abcd|0000)"


def _with_features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the features to rows (value, before, after, path)."""
    v, size = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    kept = lambda pattern: F.length(F.regexp_replace(v, pattern, ""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A"), "[^9aA]", "-")
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    near = F.substring(F.col("before"), -32, 32)
    features = {
        "f_length": F.length("value").cast("double"),
        "f_digits": kept("[^0-9]") / size,
        "f_upper": kept("[^A-Z]") / size,
        "f_lower": kept("[^a-z]") / size,
        "f_other": kept("[A-Za-z0-9]") / size,
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / size,
        "f_changes": F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) / size,
        "f_vowels": kept("[^aeiouAEIOU]") / size,
        "f_hex": flag(v.rlike("^[0-9a-fA-F]+$")),
        "f_words": 1 - F.length(F.regexp_replace(v, DICTIONARY, "")) / size,
        "f_path": flag(v.rlike(r"/.*/|\.[a-z]{2,4}$|^www\.") | near.rlike(r"://[^\s]*$|@$")),
        "f_parts": F.size(F.split(v, r"[-_./]")).cast("double"),
        "f_prefix": flag(v.rlike(PREFIX)),
        "f_for": flag(near.rlike(FOR)),
        "f_against": flag(near.rlike(AGAINST) | F.col("after").rlike(AGAINST)),
        "f_assigned": flag(near.rlike(ASSIGNED)),
        "f_test_path": flag(F.col("path").rlike("(?i)(test|example|fixture|sample|doc|mock)")),
    }
    return rows.withColumns(features), list(features)


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """A generated set of labelled findings: keys of known forms in assignments, and look-alikes in their usual places."""
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "=", "")
    digits = F.regexp_replace(F.conv(F.substring(h, 1, 13), 16, 10), "^", "4")
    uuid = F.regexp_replace(F.substring(h, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    word = lambda k: F.element_at(F.array(*map(F.lit, "the with render parser summer release window network chapter simple border figure".split())), (F.conv(F.substring(h, k, 2), 16, 10).cast("int") % 12) + 1)
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.conv(F.substring(h, 60, 2), 16, 10).cast("int") % len(x)) + 1)
    forms = [
        (F.substring(h, 1, 40), pick("token = \"", "api_key = \"", "secret: ", "auth_token=", "password = '"), 1),
        (F.substring(h, 1, 32), pick("api key: ", "client_secret = \"", "access_key=", "SECRET_KEY: '"), 1),
        (F.substring(h, 5, 12), pick("password=", "passwd: ", "db_password = \"", "pwd='"), 1),
        (F.translate(F.substring(h, 9, 14), "0123456789", "ghjkmqvwxz"), pick("password=", "secret: ", "passwd = \"", "token='"), 1),
        (F.concat(word(3), word(5)), pick("title=", "name: ", "class=\"", "href='"), 0),
        (F.concat(word(3), F.lit("_"), F.substring(digits, 1, 3), F.lit("x")), pick("id=", "ref: ", "name=\"", "key="), 0),
        (h, pick("signing key ", "private_key = ", "token: \""), 1),
        (F.substring(b64, 1, 40), pick("aws_secret_access_key = ", "token=", "Authorization: Bearer ", "secret "), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), pick("", "key id ", "aws "), 1),
        (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/]", "x"), 1, 36)), pick("", "export T=", "the token "), 1),
        (F.concat(F.lit("sk-"), F.substring(F.regexp_replace(b64, "[+/]", "y"), 1, 40)), pick("", "key ", "OPENAI="), 1),
        (F.concat(F.lit("eyJ"), b64, F.lit("."), F.substring(b64, 3, 30)), pick("bearer ", "jwt ", "cookie: "), 1),
        (F.substring(h, 1, 40), pick("commit ", "sha1 ", "revision: ", "tree ", "checksum = "), 0),
        (h, pick("sha256: ", "digest ", "etag = \"", "sha256sum "), 0),
        (uuid, pick("uuid ", "id: ", "request id = ", ""), 0),
        (F.concat(digits, F.lit("a")), pick("order ", "card ", "number ", ""), 0),
        (F.concat(F.lit("/"), word(3), F.lit("/"), word(5), F.lit("/"), word(7), F.substring(h, 1, 2), F.lit(".html")), pick("see ", "file ", "path = "), 0),
        (F.concat(word(3), F.lit("-"), word(5), F.lit("-"), word(7), F.lit("-2"), F.substring(digits, 1, 3)), pick("the ", "page ", "id="), 0),
        (F.concat(word(3), F.lit("."), F.substring(digits, 1, 2)), pick("by ", "from ", ""), 0),
        (F.concat(F.lit("mail"), F.substring(digits, 1, 1), F.lit(".example.com")), pick("of.12@", "the.7@", "http://"), 0),
        (F.concat(word(3), word(5), word(7), F.substring(digits, 1, 1)), pick("the ", "and ", "of "), 0),
        (F.concat(F.lit("xxxxxxxxxxxx"), F.substring(digits, 1, 5)), pick("token = \"", "api_key=", "password: "), 0),
        (F.concat(F.lit("your_api_key_example_1"), F.substring(digits, 1, 2)), pick("token = \"", "api_key=", "password: "), 0),
        (F.concat(F.lit("lib"), word(3), F.lit("-"), F.substring(digits, 1, 1), F.lit(".4.2-release.tar.gz")), pick("version ", "get ", ""), 0),
    ]
    kind = F.col("id") % len(forms)
    of = lambda k: F.coalesce(*(F.when(kind == i, x[k]) for i, x in enumerate(forms)))
    label = F.coalesce(*(F.when(kind == i, F.lit(x[2])) for i, x in enumerate(forms)))
    filler = F.concat(word(9), F.lit(" "), word(11), F.lit(" "))
    path = pick("src0", "web", "code/main", "docs/readme", "tests/fixtures", "src12", "notes", "forum")
    return spark.range(n).select(of(0).alias("value"), F.concat(filler, of(1)).alias("before"), F.concat(F.lit(" "), word(13), F.lit(" "), word(15)).alias("after"), path.alias("path"), label.cast("double").alias("label"))


def train(findings: DataFrame) -> tuple[VectorAssembler, RandomForestClassificationModel | float]:
    """The forest from labelled findings, of which the LABELLED with the smallest hash are used; with less than two labels
    the one that all findings have, or 0."""
    rows = stored(findings.orderBy(F.xxhash64("value", "before")).limit(LABELLED), "findings")
    rows, names = _with_features(rows)
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    labels = [float(r[0]) for r in rows.select("label").distinct().collect()]
    if len(labels) < 2:
        return assembler, max(labels, default=0.0)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return assembler, forest.fit(assembler.transform(rows.select("label", *names)).repartition(2))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, value, position, before, after) of the candidates of whole texts, one row for each place."""
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select("doc_id", path.alias("path"), "text")
    # the pieces between runs; there is one more of them than of runs
    rows = rows.withColumn("runs", F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).where(F.size("runs") > 0).withColumn("pieces", F.split("text", RUN, -1))
    rows = rows.withColumn("sizes", F.transform("runs", lambda r, i: F.length(F.get("pieces", i)) + F.length(r)))
    rows = rows.withColumn("groups", F.expr(f"transform(sequence(0, (size(sizes) - 1) div {GROUP}), g -> slice(sizes, cast(g * {GROUP} + 1 as int), {GROUP}))"))
    add = "(s, x) -> concat(s, array(element_at(s, -1) + x))"
    sums = f"aggregate(transform(groups, g -> aggregate(g, 0, (s, x) -> s + x)), cast(array(0) as array<int>), {add})"
    ends = f"flatten(transform(groups, (g, k) -> slice(aggregate(g, cast(array(bases[k]) as array<int>), {add}), 2, {GROUP})))"
    rows = rows.withColumn("bases", F.expr(sums)).withColumn("ends", F.expr(ends))
    before = "right(concat(if(i > 0, concat(right(get(pieces, i - 1), 48), get(runs, i - 1)), ''), right(get(pieces, i), 48)), 48)"
    after = "left(concat(left(get(pieces, i + 1), 24), coalesce(get(runs, i + 1), '')), 24)"
    made = f"transform(runs, (r, i) -> named_struct('value', regexp_replace(r, '[.]+$', ''), 'position', get(ends, i) - length(r) + 1, 'before', {before}, 'after', {after}))"
    rows = rows.select("doc_id", "path", F.explode(F.expr(made)).alias("c")).select("doc_id", "path", "c.*")
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    assigned = F.col("before").rlike(ASSIGNED) & (F.length("value") >= SHORT)
    return rows.where(((mixed | F.col("value").rlike(PREFIX)) & (F.length("value") >= LONG)) | (assigned & (mixed | F.substring("before", -32, 32).rlike(FOR))))


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, value, position, score, is_secret) of every candidate."""
    assembler, forest = train(findings if findings is not None else labelled_findings(docs.sparkSession))
    rows, names = _with_features(candidates(docs))
    if isinstance(forest, float):
        scored = rows.withColumn("score", F.lit(forest))
    else:
        scored = forest.transform(assembler.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "value", "position", "score", (F.col("score") >= DECIDED).alias("is_secret"))


def redacted(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """docs with MARK for each secret in text, and n_chars anew where it exists."""
    found = scan(docs, findings).where("is_secret").groupBy("doc_id").agg(F.collect_set("value").alias("__values"))
    found = stored(found.select(F.col("doc_id").alias("__id"), "__values"), "secrets")  # Spark broadcasts it if it is small in bytes
    longest_first = F.array_sort("__values", lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    clean = F.aggregate(longest_first, F.col("text"), lambda t, v: F.replace(t, v, F.lit(MARK)))
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left").withColumn("text", F.coalesce(clean, F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__values").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the value's digest in place of the value."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "position", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_digest"), F.round("score", 6).alias("score"), "is_secret")
