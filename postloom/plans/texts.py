"""Normalization, classification, duplicates, vectors and search over the driver's postings and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import text as X
from postloom.functions.url import FRAGMENT_HOSTS, SESSION, TRACKING, TWO_LABEL_SUFFIXES, canonical_url, registered_domain, url_hash
from postloom.operators import dedup as D
from postloom.operators import relational as R
from postloom.operators.rules import Family, classify, extract_terms, seniority, SENIORITY, tri_state
from postloom.sources.tables import spread_table, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- SQL of the text functions: the same rules in RE2 --------------------------------------------------------------------
def _unescape_sql(c: str) -> str:
    for k, v in X.ENTITIES.items():
        c = f"replace({c}, {_q(k)}, {_q(v)})"
    return c


def _squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')"


def strip_html_sql(c: str) -> str:
    return _squeeze_sql(_unescape_sql(f"regexp_replace({_unescape_sql(c)}, '<[^>]+>', ' ', 'g')"))


def _url_sql(u: str) -> str:
    rx = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    p = lambda i: f"regexp_extract({u}, '{rx}', {i})"
    drop = ", ".join(_q(x) for x in [*TRACKING, *SESSION])
    query = (
        f"array_to_string(list_transform(list_sort(list_transform(list_filter(string_split({p(4)}, '&'), lambda x: regexp_matches(x, '^[^=]+=.+') AND lower(regexp_extract(x, '^([^=]*)', 1)) NOT IN ({drop})"
        f" AND NOT starts_with(lower(regexp_extract(x, '^([^=]*)', 1)), 'utm_')), lambda x, i: {{'k': regexp_extract(x, '^([^=]*)', 1), 'i': i, 'p': x}})), lambda s: s.p), '&')"
    )
    hosts = "|".join(h.replace(".", "[.]") for h in FRAGMENT_HOSTS)
    scheme = f"CASE WHEN lower({p(1)}) = 'http' THEN 'https' ELSE lower({p(1)}) END"
    return (
        f"CASE WHEN regexp_matches({u}, '{rx}') THEN {scheme} || '://' || CASE WHEN lower({p(1)}) IN ('http', 'https') THEN regexp_replace(lower({p(2)}), ':443$', '') ELSE lower({p(2)}) END"
        f" || CASE WHEN length({p(3)}) > 1 THEN regexp_replace({p(3)}, '/$', '') ELSE {p(3)} END || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"
        f" || CASE WHEN regexp_matches(regexp_replace(lower({p(2)}), ':[0-9]+$', ''), '(^|[.])({hosts})$') AND {p(5)} <> '' THEN '#' || {p(5)} ELSE '' END ELSE {u} END"
    )


@query(f"SELECT posting_id, {_url_sql('trim(url)')} AS canonical, sha256({_url_sql('trim(url)')}) AS url_hash FROM posting")
def url_canonical(spark, d):
    return table(spark, d, "posting").select("posting_id", canonical_url(F.col("url")).alias("canonical"), url_hash(F.col("url")).alias("url_hash"))


@query(f"WITH u AS (SELECT posting_id, sha256({_url_sql('trim(url)')}) AS h FROM posting) SELECT h AS url_hash, min(posting_id) AS first_id, count(*)::BIGINT AS n FROM u GROUP BY h HAVING count(*) > 1")
def url_dup_groups(spark, d):
    return table(spark, d, "posting").groupBy(url_hash(F.col("url")).alias("url_hash")).agg(F.min("posting_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"SELECT posting_id, {strip_html_sql('description_html')} AS plain FROM posting WHERE description_html <> ''")
def html_to_text(spark, d):
    return table(spark, d, "posting").where("description_html <> ''").select("posting_id", X.strip_html(F.col("description_html")).alias("plain"))


_T = "regexp_replace(title_raw, '(?i)\\b(req|job|id)[\\s#-]*\\d{3,}\\b', '', 'g')"
_SEASON = "(?i)\\b(summer|winter|fall|spring)\\s*(20\\d\\d)\\b"
_TITLE = f"lower(regexp_replace({_T}, '{_SEASON}', '', 'g'))"
for _k, _v in X.TITLE_WORDS.items():
    _TITLE = f"regexp_replace({_TITLE}, '\\b{_k}\\b', '{_v}', 'g')"


@query(f"SELECT posting_id, {_squeeze_sql(_TITLE)} AS normalized, lower(regexp_extract({_T}, '{_SEASON}', 1)) AS season, regexp_extract({_T}, '{_SEASON}', 2) AS year FROM posting")
def title_normalize(spark, d):
    return table(spark, d, "posting").select("posting_id", X.normalize_title(F.col("title_raw")).alias("t")).select("posting_id", "t.*")


@query(
    "SELECT posting_id, CASE WHEN coalesce(remote_hint, false) OR regexp_matches(location_raw, '(?i)\\bremote\\b') THEN 'remote' WHEN regexp_matches(location_raw, '(?i)\\bhybrid\\b') THEN 'hybrid' WHEN coalesce(location_raw, '') = '' THEN 'unknown' ELSE 'onsite' END AS mode FROM posting"
)
def work_mode(spark, d):
    return table(spark, d, "posting").select("posting_id", X.work_mode(F.col("location_raw"), F.col("remote_hint")).alias("mode"))


def _scrub_sql(c: str) -> str:
    for p in (X.EMAIL, X.SECRET, X.PHONE):
        c = f"regexp_replace({c}, {_q(p)}, '[REDACTED]', 'g')"
    return c


@query(f"SELECT doc_id, sha256({_scrub_sql('text')}) AS scrubbed FROM documents")
def pii_scrub(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.scrub(F.col("text")), 256).alias("scrubbed"))


def _volatile_sql(c: str) -> str:
    for p in X.VOLATILE:
        c = f"regexp_replace({c}, {_q(p)}, '', 'g')"
    return _squeeze_sql(c)


@query(f"SELECT item_id, sha256({_volatile_sql('content')}) AS page_hash FROM greenhouse_job WHERE content IS NOT NULL")
def volatile_hash(spark, d):
    return table(spark, d, "greenhouse_job").where("content IS NOT NULL").select("item_id", F.sha2(X.without_volatile(F.col("content")), 256).alias("page_hash"))


@query(
    f"WITH h AS (SELECT item_id, source_id, id, fetched_at, sha256({_volatile_sql('content')}) AS h FROM greenhouse_job) SELECT item_id, h IS DISTINCT FROM lag(h) OVER (PARTITION BY source_id, id ORDER BY fetched_at, item_id) OR lag(h) OVER (PARTITION BY source_id, id ORDER BY fetched_at, item_id) IS NULL AS changed FROM h"
)
def change_detection(spark, d):
    from pyspark.sql import Window

    x = table(spark, d, "greenhouse_job").select("item_id", "source_id", "id", "fetched_at", F.sha2(X.without_volatile(F.col("content")), 256).alias("h"))
    before = F.lag("h").over(Window.partitionBy("source_id", "id").orderBy("fetched_at", "item_id"))
    return x.select("item_id", (before.isNull() | ~F.col("h").eqNullSafe(before)).alias("changed"))


@query("SELECT posting_id, trim(regexp_replace(lower(trim(company_name_raw)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, sha256(url || '|' || title_raw || '|' || description_text) AS content_hash FROM posting")
def slug_and_content_hash(spark, d):
    return table(spark, d, "posting").select("posting_id", X.slug(F.col("company_name_raw")).alias("slug"), F.sha2(F.concat_ws("|", "url", "title_raw", "description_text"), 256).alias("content_hash"))


_HOST = "regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.$', '')"
_LABELS = f"string_split({_HOST}, '.')"


@query(
    f"SELECT posting_id, CASE WHEN regexp_matches({_HOST}, '^[0-9.]+$') THEN {_HOST} WHEN array_to_string({_LABELS}[-2:], '.') IN ({', '.join(_q(x) for x in TWO_LABEL_SUFFIXES)}) THEN array_to_string({_LABELS}[-3:], '.') ELSE array_to_string({_LABELS}[-2:], '.') END AS domain FROM posting"
)
def url_domain(spark, d):
    return table(spark, d, "posting").select("posting_id", registered_domain(F.col("url")).alias("domain"))


_POS, _NEG = r"(?i)\bmentor\b|\bwelcome\b", r"(?i)\btravel\b|\bon-call\b"


@query(f"SELECT posting_id, CASE WHEN regexp_matches(description_text, {_q(_POS)}) AND NOT regexp_matches(description_text, {_q(_NEG)}) THEN true WHEN regexp_matches(description_text, {_q(_NEG)}) AND NOT regexp_matches(description_text, {_q(_POS)}) THEN false END AS state FROM posting")
def tri_state_signal(spark, d):
    return table(spark, d, "posting").select("posting_id", tri_state(F.col("description_text"), _POS, _NEG).alias("state"))


# --- classification -----------------------------------------------------------------------------------------------------------
FAMILIES = [
    Family("backend", ("backend engineer", "back[- ]end engineer"), ("software engineer.*backend",), ("backend.*designer",)),
    Family("frontend", ("frontend engineer", "front[- ]end engineer", "ui engineer"), ("software engineer.*frontend",)),
    Family("data", ("data engineer", "data analyst", "analytics engineer"), ("data.*intern",)),
    Family("ml", ("machine learning engineer", "research engineer"), ("learning",)),
    Family("infra", ("site reliability engineer", "devops engineer", "platform engineer"), ("infrastructure",)),
    Family("support", ("support engineer",), ("support",), (), True),
    Family("general", (), ("engineer", "developer"), ("sales engineer",)),
]
EVIDENCE = r"(?i)\bAPIs?\b|\bcode\b|\bdebug"


def _classify_sql(t: str, text: str) -> tuple[str, str]:
    name, conf = ["CASE"], ["CASE"]
    for kind, c in (("strong", 0.9), ("weak", 0.6)):
        for f in FAMILIES:
            if ps := getattr(f, kind):
                hit = f"regexp_matches({t}, {_q('(?i)' + '|'.join(f'(?:{p})' for p in ps))})"
                if f.negative:
                    hit += f" AND NOT regexp_matches({t}, {_q('(?i)' + '|'.join(f'(?:{p})' for p in f.negative))})"
                if f.evidence:
                    name.append(f"WHEN {hit} AND NOT regexp_matches({text}, {_q(EVIDENCE)}) THEN 'other'")
                    conf.append(f"WHEN {hit} AND NOT regexp_matches({text}, {_q(EVIDENCE)}) THEN 0.0")
                name.append(f"WHEN {hit} THEN '{f.name}'")
                conf.append(f"WHEN {hit} THEN {c}")
    return " ".join([*name, "ELSE 'other' END"]), " ".join([*conf, "ELSE 0.0 END"])


_NAME, _CONF = _classify_sql("lower(title_raw)", "description_text")


@query(f"SELECT posting_id, {_NAME} AS family, ({_CONF})::DOUBLE AS confidence FROM posting")
def role_rule_ladder(spark, d):
    c = classify(F.lower("title_raw"), FAMILIES, "other", F.col("description_text").rlike(EVIDENCE)).alias("c")
    return table(spark, d, "posting").select("posting_id", c).select("posting_id", "c.*")


def _seniority_sql() -> str:
    t, r, e = "title_raw", "requirements_text", "employment_type_raw"
    both = f"({t} || ' ' || {r})"
    m = lambda c, p: f"regexp_matches({c}, {_q(p)})"
    y = f"TRY_CAST(regexp_extract({r}, '(?i)(\\d+)\\+?\\s*years?(?:\\s+of)?(?:\\s+[a-z]+){{0,3}}?\\s+experience', 1) AS INTEGER)"
    s = SENIORITY
    rules = [
        (f"{y} <= 1", "new_grad"), (f"{y} < 3", "entry"), (f"{y} < 5", "mid"), (f"{y} < 8", "senior"), (f"{y} >= 8", "staff"),
        (m(e, r"(?i)\bintern(?:ship)?\b"), "internship"),
        (f"{m(both, s['graduation'])} OR {m(both, s['trainee'])} OR {m(both, s['trainee_acronym'])}", "new_grad"),
        (m(both, s["intern"]), "internship"), (m(both, s["new_grad"]), "new_grad"), (m(t, s["level_4"]), "staff"), (m(t, s["level_3"]), "senior"), (m(t, s["level_2"]), "mid"),
        (m(both, r"(?i)\bstaff\b|\bprincipal\b"), "staff"), (m(both, r"(?i)\bsenior\b|\bsr\.?\b"), "senior"), (m(both, s["senior"]), "mid"), (m(t, s["manager"]), "senior"), (m(both, s["entry"]), "entry"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + " ELSE 'unknown' END"


@query(f"SELECT posting_id, {_seniority_sql()} AS seniority FROM posting")
def seniority_ladder(spark, d):
    return table(spark, d, "posting").select("posting_id", seniority(F.col("title_raw"), F.col("requirements_text"), F.col("employment_type_raw")).alias("seniority"))


SKILLS = {"go": ["go", "golang"], "python": ["python"], "rust": ["rust"], "kotlin": ["kotlin"], "swift": ["swift"], "scala": ["scala"], "kubernetes": ["kubernetes", "k8s"], "postgres": ["postgres", "postgresql"], "airflow": ["airflow"], "graphql": ["graphql"], "redis": ["redis"], "webassembly": ["webassembly"], "node": ["node", "node.js"]}


def _skills_sql(c: str) -> str:
    import re

    one = lambda i, a: f"CASE WHEN regexp_matches({c}, {_q('(?i)' + '|'.join(f'(?:^|[^a-zA-Z0-9_]){re.escape(x)}(?:$|[^a-zA-Z0-9_])' for x in a))}) THEN '{i}' END"
    return "list_filter([" + ", ".join(one(i, a) for i, a in SKILLS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT posting_id, {_skills_sql('description_text')} AS skills FROM posting")
def skill_extract(spark, d):
    return table(spark, d, "posting").select("posting_id", extract_terms(F.col("description_text"), SKILLS).alias("skills"))


@query(
    f"WITH s AS (SELECT posting_id, {_skills_sql('description_text')} AS job, {_skills_sql('requirements_text')} AS own FROM posting) SELECT posting_id, len(job)::BIGINT AS n_skills, round(CASE WHEN len(job) > 0 THEN 1.0 * len(list_intersect(job, own)) / len(job) ELSE 0 END, 6) AS fraction, list_sort(list_filter(job, lambda x: NOT list_contains(own, x))) AS missing FROM s"
)
def keyword_fraction(spark, d):
    x = table(spark, d, "posting").select("posting_id", extract_terms(F.col("description_text"), SKILLS).alias("job"), extract_terms(F.col("requirements_text"), SKILLS).alias("own"))
    n = F.size("job")
    return x.select("posting_id", n.cast("bigint").alias("n_skills"), F.round(F.when(n > 0, F.size(F.array_intersect("job", "own")) / n).otherwise(0.0), 6).alias("fraction"), F.array_sort(F.array_except("job", "own")).alias("missing"))


# --- duplicates ------------------------------------------------------------------------------------------------------------------
@query("SELECT sha256(text) AS h, min(doc_id) AS keep_id, count(*)::BIGINT AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_dedup(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


_EDGES = """
WITH p AS (SELECT posting_id AS id, url AS k1, CASE WHEN ats_token <> '' AND external_id <> '' THEN ats_token || '/' || external_id END AS k2, CASE WHEN description_text <> '' THEN sha256(title_raw || '|' || description_text) END AS k3 FROM posting),
e AS (SELECT id, min(id) OVER (PARTITION BY k1) AS m, 1 AS s FROM p WHERE k1 <> '' UNION ALL SELECT id, min(id) OVER (PARTITION BY k2), 2 FROM p WHERE k2 IS NOT NULL UNION ALL SELECT id, min(id) OVER (PARTITION BY k3), 3 FROM p WHERE k3 IS NOT NULL)
"""


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "posting")
    k2 = F.when((F.col("ats_token") != "") & (F.col("external_id") != ""), F.concat_ws("/", "ats_token", "external_id"))
    k3 = F.when(F.col("description_text") != "", F.sha2(F.concat_ws("|", "title_raw", "description_text"), 256))
    return p.select(F.col("posting_id").alias("id"), F.col("url").alias("k1"), k2.alias("k2"), k3.alias("k3"))


@query(_EDGES + "SELECT id, arg_min(m, s) AS match, min(s) AS stage FROM e WHERE id > m GROUP BY id")
def stage1_matches(spark, d):
    return D.exact_edges(_keyed(spark, d), "id", ["k1", "k2", "k3"])


_PARAS = "list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t\\r\\f]*\\n'), lambda p: regexp_replace(p, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')), lambda p: strlen(p) >= 40)"
_LEARNED = f"""
WITH p AS (SELECT board_token, doc_id, unnest({_PARAS}) AS p FROM documents WHERE board_token IS NOT NULL),
h AS (SELECT DISTINCT board_token, doc_id, sha256({_squeeze_sql('p')}) AS h FROM p),
n AS (SELECT board_token, count(DISTINCT doc_id) AS n FROM documents WHERE board_token IS NOT NULL GROUP BY board_token HAVING count(DISTINCT doc_id) >= 3),
l AS (SELECT h.board_token, h.h FROM h JOIN n USING (board_token) GROUP BY h.board_token, h.h, n.n HAVING count(*) >= n.n * 0.2)
"""


@query(_LEARNED + "SELECT board_token, h FROM l")
def boilerplate_learn(spark, d):
    return D.learned_boilerplate(table(spark, d, "documents"), "board_token", "doc_id", "text", 0.2, 3)


@query(
    _LEARNED.replace("FROM documents WHERE board_token IS NOT NULL", "FROM recent").replace("WITH p AS", "WITH recent AS (SELECT * FROM documents WHERE board_token IS NOT NULL QUALIFY row_number() OVER (PARTITION BY board_token ORDER BY fetched_at DESC NULLS LAST, doc_id) <= 50), p AS").replace(">= 3)", ">= 5)").replace("* 0.2", "* 0.1")
    + "SELECT board_token, h FROM l"
)
def boilerplate_recent(spark, d):
    """Boilerplate of the last fifty documents of each board (the frame is the operation)."""
    return D.learned_boilerplate(table(spark, d, "documents"), "board_token", "doc_id", "text", 0.1, 5, 50, [F.desc_nulls_last("fetched_at"), F.col("doc_id")])


@query(
    _LEARNED
    + f", q AS (SELECT board_token, doc_id, unnest({_PARAS}) AS p, generate_subscripts({_PARAS}, 1) AS i FROM documents), k AS (SELECT q.* FROM q WHERE NOT ("
    + " OR ".join(f"regexp_matches(p, {_q(x)})" for x in D.GLOBAL_BOILERPLATE)
    + f") AND NOT EXISTS (SELECT 1 FROM l WHERE l.board_token = q.board_token AND l.h = sha256({_squeeze_sql('q.p')})))"
    + " SELECT doc_id, sha256(coalesce(s, '')) AS stripped FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT doc_id, string_agg(p, '\n\n' ORDER BY i) AS s FROM k GROUP BY doc_id) USING (doc_id)"
)
def strip_boilerplate(spark, d):
    docs = table(spark, d, "documents")
    x = D.strip_boilerplate(docs, "board_token", "doc_id", "text", D.learned_boilerplate(docs, "board_token", "doc_id", "text", 0.2, 3))
    return x.withColumn("stripped", F.sha2("stripped", 256))


@query(
    "WITH s AS (SELECT board_token, doc_id, 40 + CASE WHEN length(text) >= 1000 THEN 25 ELSE 0 END + CASE WHEN lang IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN n_chars IS NOT NULL THEN 10 ELSE 0 END AS score FROM documents)"
    " SELECT board_token, doc_id, score, n AS members FROM (SELECT *, count(*) OVER (PARTITION BY board_token)::BIGINT AS n, row_number() OVER (PARTITION BY board_token ORDER BY score DESC, doc_id) AS r FROM s) WHERE r = 1"
)
def representative_pick(spark, d):
    score = 40 + F.when(F.length("text") >= 1000, 25).otherwise(0) + F.when(F.col("lang").isNotNull(), 15).otherwise(0) + F.when(F.col("n_chars").isNotNull(), 10).otherwise(0)
    return D.representatives(table(spark, d, "documents"), "board_token", score, "doc_id")


# --- vectors and search ---------------------------------------------------------------------------------------------------------
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 4) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id)::INTEGER AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return R.cosine_topk(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10).withColumn("similarity", F.round("similarity", 4))


@query(
    f"WITH x AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label), s AS (SELECT a.vec_id, b.label, {_COS} AS c FROM embeddings a CROSS JOIN x b) SELECT vec_id, CASE WHEN max(c) >= 0.3 THEN arg_max(label, c) END AS label, round(max(c), 4) AS similarity FROM s GROUP BY vec_id"
)
def nearest_exemplar(spark, d):
    e = table(spark, d, "embeddings")
    ex = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).orderBy("label").limit(100_001).toPandas()  # refused beyond 100,000
    return R.nearest_exemplar(e, "vec_id", "embedding", ex, 0.3).withColumn("similarity", F.round("similarity", 4))


@query(
    f"WITH t AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 50)"
    " SELECT a, b, round(s, 4) AS similarity, CASE WHEN s >= 0.5 THEN 'merge' WHEN s < 0.2 THEN 'distinct' ELSE 'review' END AS band FROM t"
)
def semantic_bands(spark, d):
    """Bands of the fifty nearest vectors of each stated query (ids divisible by 100), searched among all."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    x = R.cosine_topk(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 50)
    return R.bands(x, 0.5, 0.2).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("similarity", 4).alias("similarity"), "band")


@query(
    f"WITH t AS (SELECT a.vec_id AS q, b.vec_id AS i, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 10)"
    " SELECT least(q, i) AS a, greatest(q, i) AS b, round(max(s), 4) AS similarity, CASE WHEN max(s) >= 0.5 THEN 'merge' WHEN max(s) < 0.2 THEN 'distinct' ELSE 'review' END AS band FROM t GROUP BY least(q, i), greatest(q, i)"
)
def semantic_candidate_bands(spark, d):
    """Bands of real candidates: each vector with its ten nearest, whatever their ids (``semantic_bands`` has those of stated queries)."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    x = R.cosine_topk(e, e, "vec_id", "embedding", 10)
    x = x.groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.max("similarity").alias("similarity"))
    return R.bands(x, 0.5, 0.2).select("a", "b", F.round("similarity", 4).alias("similarity"), "band")


_PAD = "' ' || regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g') || ' '"
_T1, _D1 = _PAD.format("title_raw"), _PAD.format("description_text")


def _has_sql(t: str) -> str:
    return f"(contains({_T1}, ' {t} ') OR contains({_D1}, ' {t} '))"


def _count_sql(f: str, t: str) -> str:
    return f"(len(string_split(replace({f}, ' ', '  '), ' {t} ')) - 1)"


@query(
    f"SELECT posting_id, round(1.0 * {_count_sql(_T1, 'engineer')} + 1.0 * {_count_sql(_T1, 'kubernetes')} + 1.0 * {_count_sql(_T1, 'postgres')} + 0.2 * {_count_sql(_D1, 'engineer')} + 0.2 * {_count_sql(_D1, 'kubernetes')} + 0.2 * {_count_sql(_D1, 'postgres')}, 4)::DOUBLE AS score FROM posting"
    f" WHERE {_has_sql('engineer')} AND ({_has_sql('kubernetes')} OR {_has_sql('postgres')}) AND NOT {_has_sql('on alternate fridays')} ORDER BY score DESC, posting_id LIMIT 50"
)
def keyword_search(spark, d):
    x = R.keyword_search(table(spark, d, "posting").select("posting_id", "title_raw", "description_text"), 'engineer kubernetes or postgres -"on alternate fridays"', {"title_raw": 1.0, "description_text": 0.2})
    return x.select("posting_id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "posting_id").limit(50)


@query(
    "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100), b AS (SELECT doc_id, row_number() OVER (ORDER BY fetched_at DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100)"
    " SELECT doc_id, round(sum(1.0 / (60 + rank)), 8) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY rrf DESC, doc_id LIMIT 50"
)
def rrf_hybrid(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents")
    top = lambda *o: docs.orderBy(*o).limit(100).select("doc_id", F.row_number().over(Window.orderBy(*o)).alias("rank"))
    x = R.reciprocal_rank_fusion([top(F.desc(F.length("text")), "doc_id"), top(F.desc("fetched_at"), "doc_id")], "doc_id")
    return x.select("doc_id", F.round("rrf", 8).alias("rrf")).orderBy(F.desc("rrf"), "doc_id").limit(50)


QUERIES, ORACLE_SQL = Q, SQL
