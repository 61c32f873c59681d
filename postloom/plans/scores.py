"""Scores from weights that are data, explanations, acceptance gates: queries over postings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.operators import relational as R
from postloom.operators import scoring as S
from postloom.operators.rules import classify, extract_terms, seniority
from postloom.plans import records as P
from postloom.plans import texts as T
from postloom.sources.tables import spread_table, table

Q: dict = {}
SQL: dict[str, str] = {}
_q = T._q


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Versions of the weights; the active one counts, the newest of several.
WEIGHTS = [
    (1, False, '{"skill_match": 1.0}', '{"overall_match": 1.0}'),
    (2, True, '{"skill_match": 0.40, "resume_match": 0.30, "never": 0.3}', '{"overall_match": 0.24, "deadline_urgency": 0.03, "compensation": 0.09, "growth": 0.07, "text_length": 0.14}'),
]
_WEIGHT_ROWS = ", ".join(f"({v}, {str(a).lower()}, {_q(o)}, {_q(p)})" for v, a, o, p in WEIGHTS)
#: Levels of the user, 0 to 5.
LEVELS = {"go": 4, "python": 5, "rust": 2, "kubernetes": 3}
_LEVEL_SQL = "CASE s " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEVELS.items()) + " ELSE 0 END"


def _weights(spark: SparkSession) -> DataFrame:
    w = spark.createDataFrame(WEIGHTS, "version int, active boolean, overall string, priority string")
    return w.where("active").orderBy(F.desc("version")).limit(1)


@query(f"SELECT version, overall, priority FROM (VALUES {_WEIGHT_ROWS}) AS w(version, active, overall, priority) WHERE active ORDER BY version DESC LIMIT 1")
def active_weights(spark, d):
    """The weights in force: one row of a small table."""
    return _weights(spark).select("version", "overall", "priority")


_JOB, _OWN = T._skills_sql("description_text"), T._skills_sql("requirements_text")
_SKILL = (
    f"sk AS (SELECT posting_id, {_JOB} AS job, {_OWN} AS own FROM posting), sm AS (SELECT posting_id, job, own, list_filter(job, lambda s: {_LEVEL_SQL} = 0) AS missing,"
    f" CASE WHEN len(job) > 0 THEN round(100.0 * list_sum(list_transform(job, lambda s: {_LEVEL_SQL})) / (5 * len(job)))::INTEGER ELSE 50 END AS skill_match FROM sk)"
)


def _skills(x: DataFrame) -> DataFrame:
    levels = F.create_map(*[F.lit(v) for kv in LEVELS.items() for v in kv])
    score, missing = S.coverage_score(F.col("job"), levels)
    return x.withColumn("skill_match", score).withColumn("missing", missing)


@query(f"WITH {_SKILL} SELECT posting_id, skill_match, missing FROM sm")
def skill_match(spark, d):
    """Coverage of the terms of a posting by a user's levels, and the terms that are missing."""
    x = table(spark, d, "posting").select("posting_id", extract_terms(F.col("description_text"), T.SKILLS).alias("job"))
    return _skills(x).select("posting_id", "skill_match", "missing")


_COS = "CASE WHEN vec_id % 3 = 0 THEN NULL ELSE list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))) END"


@query(
    f"SELECT vec_id, round(100 * (CASE WHEN c IS NULL THEN k ELSE 0.55 * greatest(0.0, least(1.0, (c - 0.55) / 0.40)) + 0.35 * k + 0.10 END))::INTEGER AS resume_match FROM (SELECT vec_id, round({_COS}, 6) AS c, (label % 5) / 4.0 AS k FROM embeddings)"
)
def resume_match(spark, d):
    """Blend of a cosine to one vector (joined as a table of one row) with a keyword share; the share alone where the cosine is missing."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    one = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("mine"), F.lit(1).alias("k"))
    x = e.withColumn("k", F.lit(1)).join(F.broadcast(one), "k")  # one row: its size is fixed
    c = F.when(F.col("vec_id") % 3 != 0, F.round(R.cosine(F.col("embedding"), F.col("mine")), 6))
    return x.select("vec_id", S.fused_match(c, (F.col("label") % 5) / 4.0).alias("resume_match"))


_LEFT = f"(epoch_us(deadline_at) - epoch_us(TIMESTAMP '{P.NOW}')) / 86400e6"
_AGE = f"greatest(coalesce((epoch_us(TIMESTAMP '{P.NOW}') - epoch_us(posted_at)) / 86400e6, 14.0), 0)"
_PARTS = (
    P._pay_sql()
    + f", {_SKILL}, {P._PLACES}, ev AS (SELECT posting_id, {T._NAME} AS fam, inr_month FROM posting JOIN pay USING (posting_id)),"
    " pc_ AS (SELECT posting_id, CASE WHEN inr_month IS NOT NULL AND count(inr_month) OVER (PARTITION BY fam) >= 20 THEN count(inr_month) OVER (PARTITION BY fam ORDER BY inr_month RANGE UNBOUNDED PRECEDING) / count(inr_month) OVER (PARTITION BY fam) END AS pct FROM ev),"
    " vals AS (SELECT posting_id, job, missing, skill_match, CASE WHEN requirements_text <> '' THEN round(CASE WHEN len(job) > 0 THEN 100.0 * len(list_filter(job, lambda s: list_contains(own, s))) / len(job) ELSE 0 END)::INTEGER END AS resume_match,"
    f" CASE WHEN deadline_at IS NULL THEN 40 WHEN {_LEFT} < 0 THEN 0 WHEN {_LEFT} < 3 THEN 100 WHEN {_LEFT} < 7 THEN 85 WHEN {_LEFT} < 14 THEN 65 WHEN {_LEFT} < 30 THEN 40 ELSE 20 END AS deadline_urgency,"
    " round(100 * pct)::INTEGER AS compensation, least(100, length(description_text) // 40)::INTEGER AS text_length, pct, inr_month, tier, mode, canonical AS city,"
    f" 0.55 + 0.45 * exp(-{_AGE} * ln(2.0) / 14.0) AS fresh FROM posting JOIN sm USING (posting_id) JOIN pc_ USING (posting_id) JOIN ev USING (posting_id) JOIN tb USING (posting_id) LEFT JOIN location_ref ON location_id = entry_id),"
    " ov AS (SELECT *, (0.40 * skill_match + CASE WHEN resume_match IS NOT NULL THEN 0.30 * resume_match ELSE 0 END) / (0.40 + CASE WHEN resume_match IS NOT NULL THEN 0.30 ELSE 0 END) AS overall FROM vals),"
    " sc AS (SELECT *, round(overall)::INTEGER AS overall_match, (0.24 * overall + 0.03 * deadline_urgency + CASE WHEN compensation IS NOT NULL THEN 0.09 * compensation ELSE 0 END + 0.14 * text_length) / (0.24 + 0.03 + CASE WHEN compensation IS NOT NULL THEN 0.09 ELSE 0 END + 0.14) AS base FROM ov)"
)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    p = spread_table(spark, d, "posting", "posting_id", "title_raw", "description_text", "requirements_text", "deadline_at", "posted_at")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    now = F.unix_micros(F.lit(P.NOW).cast("timestamp"))
    left = (micros("deadline_at") - now) / 86400e6
    urgency = F.when(left.isNull(), 40).when(left < 0, 0).when(left < 3, 100).when(left < 7, 85).when(left < 14, 65).when(left < 30, 40).otherwise(20)
    x = p.select(
        "posting_id", extract_terms(F.col("description_text"), T.SKILLS).alias("job"), extract_terms(F.col("requirements_text"), T.SKILLS).alias("own"), (F.col("requirements_text") != "").alias("has_text"),
        urgency.alias("deadline_urgency"), F.least(F.lit(100), F.floor(F.length("description_text") / 40).cast("int")).alias("text_length"), R.decay((now - micros("posted_at")) / 86400e6).alias("fresh"),
        classify(F.lower("title_raw"), T.FAMILIES, "other", F.col("description_text").rlike(T.EVIDENCE))["family"].alias("fam"),
    )
    x = _skills(x)
    n = F.size("job")
    x = x.withColumn("resume_match", F.when(F.col("has_text"), F.round(F.when(n > 0, 100 * F.size(F.array_intersect("job", "own")) / n).otherwise(0.0)).cast("int")))
    x = x.join(P._pay(spark, d).select("posting_id", "inr_month"), "posting_id")
    x = R.percentile_ladder(x, "inr_month", [["fam"]]).withColumn("compensation", F.round(100 * F.col("percentile")).cast("int"))
    x = x.join(P._places(spark, d), "posting_id")
    names = table(spark, d, "location_ref").select(F.col("location_id").alias("entry_id"), F.col("canonical").alias("city"))
    x = x.join(names, "entry_id", "left")
    w = _weights(spark).select(S.parse_weights(F.col("overall")).alias("w_overall"), S.parse_weights(F.col("priority")).alias("w_priority"), F.lit(1).alias("k"))
    x = x.withColumn("k", F.lit(1)).join(F.broadcast(w), "k")  # one row: its size is fixed
    overall = S.weighted_by(F.col("w_overall"), {"skill_match": F.col("skill_match"), "resume_match": F.col("resume_match")})
    x = x.withColumn("overall", overall).withColumn("overall_match", F.round("overall").cast("int"))
    parts = {"overall_match": F.col("overall"), "deadline_urgency": F.col("deadline_urgency"), "compensation": F.col("compensation"), "growth": F.lit(None).cast("int"), "text_length": F.col("text_length")}
    return x.withColumn("base", S.weighted_by(F.col("w_priority"), parts))


@query(_PARTS + " SELECT posting_id, overall_match, round(greatest(0, least(100, base * fresh)))::INTEGER AS priority, compensation, to_json({'job_skills': job, 'missing_skills': missing, 'confidence_low': pct IS NULL, 'urgency': deadline_urgency}) AS inputs FROM sc")
def score_composite(spark, d):
    """Overall match and priority: parts that aren't known are left out with their weight; what went in is kept as JSON."""
    inputs = F.to_json(F.struct(F.col("job").alias("job_skills"), F.col("missing").alias("missing_skills"), F.col("percentile").isNull().alias("confidence_low"), F.col("deadline_urgency").alias("urgency")))
    return _scored(spark, d).select("posting_id", "overall_match", F.round(S.clamp(F.col("base") * F.col("fresh"))).cast("int").alias("priority"), "compensation", inputs.alias("inputs"))


_FACTOR = lambda i, k, w: f"CASE WHEN {k} IS NOT NULL THEN {{'c': -round({w} * {k}, 6)::DOUBLE, 'i': {i}, 't': '{k}=' || {k}}} END"
_WORDS_OF = "regexp_split_to_array(trim(regexp_replace(description_text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '), ' ')"


@query(
    _PARTS
    + f" SELECT posting_id, list_transform(list_sort(list_filter([{_FACTOR(0, 'overall_match', 0.24)}, {_FACTOR(1, 'deadline_urgency', 0.03)}, {_FACTOR(2, 'compensation', 0.09)}, {_FACTOR(3, 'text_length', 0.14)}], lambda x: x IS NOT NULL))[1:3], lambda x: x.t) AS factors FROM sc"
)
def score_factors(spark, d):
    """The three parts that weigh most, as ``name=value``."""
    parts = {k: F.col(k) for k in ("overall_match", "deadline_urgency", "compensation", "text_length")}
    return _scored(spark, d).select("posting_id", S.top_factors(F.col("w_priority"), parts, 3).alias("factors"))


@query(f"SELECT posting_id, CASE WHEN len({_WORDS_OF}) <= 45 THEN description_text ELSE array_to_string(({_WORDS_OF})[1:45], ' ') || '…' END AS short FROM posting")
def first_words(spark, d):
    """Texts cut to 45 words (the limit is the operation)."""
    return table(spark, d, "posting").select("posting_id", S.first_words(F.col("description_text"), 45).alias("short"))


_ORD = "(round(100 * pct)::INTEGER)::VARCHAR || CASE WHEN round(100 * pct)::INTEGER % 100 BETWEEN 11 AND 13 THEN 'th' WHEN round(100 * pct)::INTEGER % 10 = 1 THEN 'st' WHEN round(100 * pct)::INTEGER % 10 = 2 THEN 'nd' WHEN round(100 * pct)::INTEGER % 10 = 3 THEN 'rd' ELSE 'th' END"
_HAD = "list_filter(job, lambda s: NOT list_contains(missing, s))"


@query(
    _PARTS
    + f" SELECT posting_id, CASE WHEN t = '' THEN 'Not enough data yet for a specific explanation — check back after this posting is re-processed.' ELSE t END AS explanation FROM (SELECT posting_id, concat_ws(' ',"
    f" CASE WHEN len(job) > 0 THEN CASE WHEN len({_HAD}) = 0 THEN 'Matches 0 of ' || len(job) || ' required skills.' ELSE 'Matches ' || len({_HAD}) || ' of ' || len(job) || ' required skills (' || array_to_string(({_HAD})[1:5], ', ') || CASE WHEN len({_HAD}) > 5 THEN ', …).' ELSE ').' END END END,"
    " CASE WHEN coalesce(city, '') = '' AND mode = 'remote' THEN 'Remote.' WHEN coalesce(city, '') = '' THEN NULL WHEN tier BETWEEN 1 AND 4 THEN 'Tier ' || tier || ' location: ' || city || '.' ELSE city || '.' END,"
    f" CASE WHEN inr_month IS NOT NULL THEN '₹' || format('{{:,}}', round(inr_month)::BIGINT) || '/month' || CASE WHEN pct IS NULL THEN '.' ELSE ', ' || {_ORD} || ' percentile among comparable roles.' END END) AS t FROM sc)"
)
def score_explanation(spark, d):
    """Sentences on skills, place and pay of each posting."""
    x = _scored(spark, d)
    text = S.explanation(F.col("job"), F.col("missing"), F.col("city"), F.col("tier"), F.col("mode") == "remote", F.col("inr_month"), F.col("percentile"))
    return x.select("posting_id", text.alias("explanation"))


@query(
    "SELECT posting_id, sha256(regexp_replace(coalesce(title_raw, '') || chr(10) || coalesce(nullif(requirements_text, ''), nullif(description_text, ''), ''), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')) AS text_hash FROM posting"
)
def embedding_input(spark, d):
    """Hash of the text that an embedding model would read."""
    return table(spark, d, "posting").select("posting_id", F.sha2(S.embedding_text(F.col("title_raw"), F.col("requirements_text"), F.col("description_text")), 256).alias("text_hash"))


def _embed_sql() -> str:
    h = "('0x' || sha256(w)[1:16])::UBIGINT"
    return (
        f"WITH w AS (SELECT posting_id, unnest(regexp_split_to_array(trim(regexp_replace(lower(title_raw), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '), ' ')) AS w FROM posting), c AS (SELECT posting_id, ({h} % 64)::INTEGER AS b, sum(CASE WHEN {h} >= 9223372036854775808 THEN 1 ELSE -1 END) AS v FROM w WHERE w <> '' GROUP BY ALL),"
        " n AS (SELECT posting_id, sqrt(sum(v * v)) AS norm FROM c GROUP BY posting_id)"
        " SELECT posting_id, b AS bucket, round(v / norm, 4) AS x FROM c JOIN n USING (posting_id) WHERE v <> 0"
    )


@query(_embed_sql())
def hashed_embeddings(spark, d):
    """Vectors of titles from the stand-in model, as their entries other than zero."""
    x = S.hashed_embedding(spread_table(spark, d, "posting", "posting_id", "title_raw"), "posting_id", "title_raw")
    return x.select("posting_id", F.posexplode("embedding").alias("bucket", "x")).where("x <> 0").withColumn("x", F.round(F.col("x").cast("double"), 4))


_SECOND = "CASE WHEN posting_id % 7 = 0 THEN 'nonsense' WHEN posting_id % 2 = 0 THEN 'data' ELSE 'ml' END"
_SECOND_CONF = "(posting_id % 11) / 10.0"


@query(
    f"WITH f AS (SELECT posting_id, {T._NAME} AS fam, ({T._CONF})::DOUBLE AS conf, {_SECOND} AS fam2, ({_SECOND_CONF})::DOUBLE AS conf2 FROM posting)"
    " SELECT posting_id, CASE WHEN conf < 0.6 AND fam2 IN ('data', 'ml') AND conf2 >= 0.7 THEN fam2 ELSE fam END AS family, CASE WHEN conf < 0.6 AND fam2 IN ('data', 'ml') AND conf2 >= 0.7 THEN conf2 ELSE conf END AS confidence FROM f"
)
def second_opinion_gate(spark, d):
    """A second classifier (here a stub) is believed only where the rules are unsure, it names a known class, and it is sure."""
    c = classify(F.lower("title_raw"), T.FAMILIES, "other", F.col("description_text").rlike(T.EVIDENCE))
    x = table(spark, d, "posting").select("posting_id", c.alias("c"), F.expr(_SECOND).alias("fam2"), F.expr(_SECOND_CONF).cast("double").alias("conf2"))
    family, conf = S.accept(F.col("c.family"), F.col("c.confidence"), F.col("fam2"), F.col("conf2"), ["data", "ml"], 0.6, 0.7)
    return x.select("posting_id", family.alias("family"), conf.alias("confidence"))


@query(
    f"WITH x AS (SELECT posting_id, {_JOB} AS t FROM posting), k AS (SELECT ['go', 'python', 'swift'] AS old)"
    " SELECT posting_id, list_transform(list_sort(t), lambda s: s || '=' || CASE s WHEN 'go' THEN 4 WHEN 'python' THEN 5 WHEN 'swift' THEN 1 ELSE 3 END) AS levels, list_sort(list_filter(t, lambda s: NOT list_contains(old, s))) AS added, list_sort(list_filter(old, lambda s: NOT list_contains(t, s))) AS removed FROM x, k"
)
def skill_level_merge(spark, d):
    """Levels after a new list of terms: kept ones keep their level, new ones get 3; what came and what went."""
    old = F.create_map(*[F.lit(v) for kv in {"go": 4, "python": 5, "swift": 1}.items() for v in kv])
    x = table(spark, d, "posting").select("posting_id", S.merged_levels(old, extract_terms(F.col("description_text"), T.SKILLS)).alias("m"))
    entries = F.transform(F.array_sort(F.map_keys("m.levels")), lambda s: F.concat(s, F.lit("="), F.try_element_at(F.col("m.levels"), s).cast("string")))
    return x.select("posting_id", entries.alias("levels"), "m.added", "m.removed")


@query(
    f"WITH f AS (SELECT ats_token, {T._NAME} AS fam, {P._SENIORITY} AS sen FROM posting) SELECT ats_token, bool_or(fam <> 'other' AND sen IN ('internship', 'new_grad', 'entry')) AS relevant, count(*)::BIGINT AS n FROM f GROUP BY ats_token"
)
def board_relevance(spark, d):
    """Boards with at least one posting of a known family at entry level."""
    fam = classify(F.lower("title_raw"), T.FAMILIES, "other", F.col("description_text").rlike(T.EVIDENCE))["family"]
    sen = seniority(F.col("title_raw"), F.col("requirements_text"), F.col("employment_type_raw"))
    return table(spark, d, "posting").groupBy("ats_token").agg(F.bool_or((fam != "other") & sen.isin("internship", "new_grad", "entry")).alias("relevant"), F.count(F.lit(1)).alias("n"))


@query(
    f"WITH f AS (SELECT ats_token AS slug, {T._NAME} AS fam, {P._SENIORITY} AS sen FROM posting WHERE ats_token <> ''), b AS (SELECT slug, bool_or(fam <> 'other' AND sen IN ('internship', 'new_grad', 'entry')) AS relevant FROM f GROUP BY slug)"
    " SELECT slug, 'pending_review' AS status FROM b WHERE relevant AND NOT EXISTS (SELECT 1 FROM job_source WHERE status = 'active' AND json_extract_string(adapter_config, '$.token') = slug)"
)
def slug_discovery(spark, d):
    """Relevant boards that aren't active in the registry yet, to be added for review."""
    known = table(spark, d, "job_source").where("status = 'active'").select(F.get_json_object("adapter_config", "$.token").alias("slug"))
    b = board_relevance(spark, d).where("relevant AND ats_token <> ''").select(F.col("ats_token").alias("slug"))
    return b.join(known, "slug", "left_anti").withColumn("status", F.lit("pending_review"))


QUERIES, ORACLE_SQL = Q, SQL
