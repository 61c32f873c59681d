"""Records as they are normalised, resolved, scored and served: queries over postings, boards and events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions import payladder as L
from postloom.functions import text as X
from postloom.functions.similarity import jaro_winkler
from postloom.functions.url import canonical_url, url_hash
from postloom.operators import dedup as D
from postloom.operators import queueing as U
from postloom.operators import relational as R
from postloom.operators import scoring as S
from postloom.operators.boards import board_settings
from postloom.operators.lineage import written
from postloom.operators.places import DELIMITERS, best_places
from postloom.operators.rules import classify, extract_terms, load_families, resolve_aliases, seniority
from postloom.plans import texts as T
from postloom.sources.tables import spread_table, table

Q: dict = {}
SQL: dict[str, str] = {}
_q = T._q
#: The moment that stands for now in the queries below.
NOW = "2024-10-15 00:00:00"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- pay, places -------------------------------------------------------------------------------------------------------------
_PAY_TEXT = "coalesce(nullif(compensation_raw_text, ''), description_text)"


def _pay_sql(source: str = "posting", key: str = "posting_id", text: str = _PAY_TEXT) -> str:
    """CTEs ending in ``pay``: the ladder of payladder in RE2."""
    g = lambda p, i: f"regexp_extract(t, {_q(p)}, {i})"
    num = lambda p, i, j: f"TRY_CAST(CASE WHEN length(replace({g(p, i)}, ',', '')) <= 300 THEN replace({g(p, i)}, ',', '') END AS DOUBLE) * CASE WHEN lower({g(p, j)}) IN ('lpa', 'lakh', 'lakhs', 'lac') THEN 1e5 WHEN lower({g(p, j)}) IN ('crore', 'cr') THEN 1e7 WHEN lower({g(p, j)}) = 'k' THEN 1e3 ELSE 1 END"
    period = "CASE " + " ".join(f"WHEN regexp_matches(t, {_q(p)}) THEN '{n}'" for n, p in L.PERIODS) + " ELSE '' END"
    return f"""
WITH txt AS (SELECT {key}, trim(coalesce({text}, '')) AS t FROM {source}),
par AS (SELECT {key}, t, {num(L.RANGE, 1, 2)} AS lo, {num(L.RANGE, 3, 4)} AS hi, {num(L.SINGLE, 2, 3)} AS v,
  CASE WHEN regexp_matches(t, {_q(L.RUPEES)}) THEN 'INR' WHEN regexp_matches(t, {_q(L.DOLLARS)}) THEN 'USD' ELSE '' END AS cur, {period} AS per FROM txt),
kind AS (SELECT *, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 1 WHEN v IS NOT NULL THEN 2 WHEN regexp_matches(t, {_q(L.UNPAID)}) THEN 3 WHEN regexp_matches(t, {_q(L.VAGUE)}) THEN 4 ELSE 5 END AS k FROM par),
row_ AS (SELECT {key}, k, CASE k WHEN 1 THEN lo WHEN 2 THEN v END AS comp_min, CASE k WHEN 1 THEN hi END AS comp_max,
  CASE WHEN k = 1 THEN cur WHEN k = 2 AND cur = '' THEN 'INR' WHEN k = 2 THEN cur ELSE '' END AS currency, CASE WHEN k = 1 THEN per WHEN k = 2 AND per = '' THEN 'month' WHEN k = 2 THEN per ELSE '' END AS period,
  (CASE WHEN k = 1 THEN 0.95 WHEN k = 2 AND per = '' THEN 0.75 WHEN k = 2 AND cur = '' THEN 0.60 WHEN k = 2 THEN 0.90 WHEN k = 4 THEN 0.50 ELSE 0 END)::DOUBLE AS confidence FROM kind),
pay AS (SELECT {key}, comp_min, comp_max, currency, period, confidence, round(CASE WHEN currency = 'INR' THEN CASE period WHEN 'hour' THEN comp_min * 160 WHEN 'year' THEN comp_min / 12 ELSE comp_min END END, 4) AS inr_month,
  CASE WHEN k IN (1, 2, 4) THEN 'paid' WHEN k = 3 THEN 'unpaid' ELSE 'unknown' END AS paid FROM row_)
"""


def _pay(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce(F.nullif(F.col("compensation_raw_text"), F.lit("")), F.col("description_text"))
    p = spread_table(spark, d, "posting", "posting_id", "compensation_raw_text", "description_text")
    x = p.select("posting_id", L.parse_pay(text).alias("p")).select("posting_id", "p.*")
    return x.withColumn("inr_month", F.round("inr_month", 4))


@query(_pay_sql() + "SELECT * FROM pay")
def comp_parse(spark, d):
    """What the ladder reads from the pay field, or from the description where that is blank."""
    return _pay(spark, d)


_WORDS = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}.''-]+', ' ', 'g'))"
_ALIASES = (
    f"al AS (SELECT alias, min(entry_id) AS entry_id FROM (SELECT {_WORDS.format('a')} AS alias, location_id AS entry_id FROM (SELECT unnest(list_concat([canonical], coalesce(aliases, []))) AS a, location_id FROM location_ref)) WHERE alias <> '' GROUP BY alias)"
)


def _gazetteer(spark: SparkSession, d: str) -> DataFrame:
    names = F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return table(spark, d, "location_ref").select(names.alias("alias"), F.col("location_id").alias("entry_id"))


def _resolved_sql(texts: str) -> str:
    """CTEs ``al`` and ``hit (t, entry_id)`` for a CTE or subquery of distinct texts ``t``."""
    return f"{_ALIASES}, hit AS (SELECT t, arg_min(entry_id, (-length(alias), entry_id)) AS entry_id FROM {texts} JOIN al ON contains(' ' || {_WORDS.format('t')} || ' ', ' ' || alias || ' ') GROUP BY t)"


@query(
    f"WITH tx AS (SELECT DISTINCT t FROM (SELECT location_name AS t FROM greenhouse_job UNION ALL SELECT location_raw FROM posting UNION ALL SELECT categories_location FROM lever_posting) WHERE t IS NOT NULL), {_resolved_sql('tx')}"
    " SELECT origin, record_id, entry_id FROM (SELECT 'greenhouse' AS origin, item_id AS record_id, location_name AS t FROM greenhouse_job UNION ALL SELECT 'posting', posting_id, location_raw FROM posting UNION ALL SELECT 'lever', item_id, categories_location FROM lever_posting) LEFT JOIN hit USING (t)"
)
def gazetteer_resolve(spark, d):
    """Longest alias that stands in the text as words, of every place field."""
    fields = [("greenhouse", "greenhouse_job", "item_id", "location_name"), ("posting", "posting", "posting_id", "location_raw"), ("lever", "lever_posting", "item_id", "categories_location")]
    x = None
    for origin, t, key, field in fields:
        y = table(spark, d, t).select(F.lit(origin).alias("origin"), F.col(key).alias("record_id"), F.col(field).alias("t"))
        x = y if x is None else x.union(y)
    return resolve_aliases(x, "t", _gazetteer(spark, d)).select("origin", "record_id", "entry_id")


_HOME, _HOME_COUNTRY = 3, "IN"
_MODE = "CASE WHEN coalesce(remote_hint, false) OR regexp_matches(location_raw, '(?i)\\bremote\\b') THEN 'remote' WHEN regexp_matches(location_raw, '(?i)\\bhybrid\\b') THEN 'hybrid' WHEN coalesce(location_raw, '') = '' THEN 'unknown' ELSE 'onsite' END"
_TIER = f"CASE WHEN entry_id = {_HOME} THEN 1 WHEN mode = 'remote' THEN 3 WHEN country = '{_HOME_COUNTRY}' THEN 2 WHEN coalesce(country, '') <> '' THEN 4 ELSE 0 END"
_PLACES = (
    f"raws AS (SELECT DISTINCT location_raw AS raw FROM posting WHERE trim(location_raw) <> ''), pc AS (SELECT raw, trim(p) AS t, pos FROM (SELECT raw, unnest(l) AS p, generate_subscripts(l, 1) AS pos FROM (SELECT raw, regexp_split_to_array(raw, {_q(DELIMITERS)}) AS l FROM raws)) WHERE trim(p) <> ''),"
    f" pt AS (SELECT DISTINCT t FROM pc), {_resolved_sql('pt')}, modes AS (SELECT posting_id, location_raw AS raw, {_MODE} AS mode FROM posting),"
    f" cand AS (SELECT posting_id, entry_id, {_TIER} AS tier, pos FROM modes JOIN pc USING (raw) JOIN hit USING (t) JOIN location_ref ON location_id = entry_id),"
    " pick AS (SELECT posting_id, arg_min(entry_id, (CASE WHEN tier > 0 THEN tier ELSE 99 END, CASE WHEN tier > 0 THEN pos ELSE -pos END)) AS entry_id, arg_min(tier, (CASE WHEN tier > 0 THEN tier ELSE 99 END, CASE WHEN tier > 0 THEN pos ELSE -pos END)) AS tier FROM cand GROUP BY posting_id),"
    " tb AS (SELECT posting_id, mode, entry_id, CASE WHEN coalesce(tier, 0) = 0 AND mode = 'remote' THEN 3 ELSE coalesce(tier, 0) END AS tier FROM modes LEFT JOIN pick USING (posting_id))"
)


def _places(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "location_ref").select(F.col("location_id").alias("entry_id"), "country")
    return best_places(table(spark, d, "posting").select("posting_id", "location_raw", "remote_hint"), "posting_id", "location_raw", "remote_hint", _gazetteer(spark, d), ref, _HOME, _HOME_COUNTRY)


@query(f"WITH {_PLACES} SELECT posting_id, mode, entry_id, tier FROM tb")
def tier_best(spark, d):
    """The best tier among the places that a field names."""
    return _places(spark, d)


# --- the composed record -------------------------------------------------------------------------------------------------------
_FAMILIES_JSON = (
    '{"platform": {"strong": ["platform engineer", "site reliability"], "weak": ["infrastructure"]}, "product": {"strong": ["product engineer"], "negative": ["product engineer.*intern"]}, "any": {"weak": ["engineer", "analyst"]}}'
)


@query(
    "SELECT posting_id, CASE WHEN regexp_matches(t, 'platform engineer|site reliability') THEN 'platform' WHEN regexp_matches(t, 'product engineer') AND NOT regexp_matches(t, 'product engineer.*intern') THEN 'product' WHEN regexp_matches(t, 'infrastructure') THEN 'platform' WHEN regexp_matches(t, 'engineer|analyst') THEN 'any' ELSE 'none' END AS family"
    " FROM (SELECT posting_id, lower(title_raw) AS t FROM posting)"
)
def taxonomy_from_file(spark, d):
    """Families in the order of a file, which is their priority."""
    c = classify(F.lower("title_raw"), load_families(_FAMILIES_JSON), "none")["family"]
    return table(spark, d, "posting").select("posting_id", c.alias("family"))


_STRIPPED = T.strip_html_sql("description_html")
_DESC = f"coalesce(nullif(description_text, ''), {_STRIPPED})"
_SENIORITY = T._seniority_sql()
_NORM_TITLE = T._squeeze_sql(T._TITLE)


@query(
    _pay_sql(f"(SELECT posting_id, coalesce(nullif(compensation_raw_text, ''), nullif(description_text, ''), {_STRIPPED}) AS c FROM posting)", text="c")
    + f", {_PLACES}, r AS (SELECT posting_id, {T._url_sql('trim(url)')} AS canonical, sha256({T._url_sql('trim(url)')}) AS url_hash, {_NORM_TITLE} AS title, coalesce(nullif(apply_url, ''), url) AS apply_to, length({_DESC})::BIGINT AS n_chars,"
    f" sha256(url || '|' || title_raw || '|' || description_text) AS content_hash, {_SENIORITY} AS seniority, len({T._skills_sql(_DESC)})::BIGINT AS n_skills, {T._NAME} AS family FROM posting)"
    " SELECT posting_id, canonical, url_hash, title, apply_to, n_chars, content_hash, seniority, n_skills, family, mode, entry_id, tier, paid, inr_month FROM r JOIN pay USING (posting_id) JOIN tb USING (posting_id)"
)
def normalized_record(spark, d):
    """All scalar steps in one projection, with the fallbacks of a record: text from markup, pay from the text, the apply address from the address."""
    p = spread_table(
        spark, d, "posting", "posting_id", "url", "apply_url", "title_raw", "description_text", "description_html", "requirements_text", "employment_type_raw", "compensation_raw_text"
    )
    desc = F.coalesce(F.nullif(F.col("description_text"), F.lit("")), X.strip_html(F.col("description_html")))
    pay = L.parse_pay(F.coalesce(F.nullif(F.col("compensation_raw_text"), F.lit("")), desc))
    x = p.select(
        "posting_id", canonical_url(F.col("url")).alias("canonical"), url_hash(F.col("url")).alias("url_hash"), X.normalize_title(F.col("title_raw"))["normalized"].alias("title"),
        F.coalesce(F.nullif(F.col("apply_url"), F.lit("")), F.col("url")).alias("apply_to"), F.length(desc).cast("bigint").alias("n_chars"),
        F.sha2(F.concat_ws("|", "url", "title_raw", "description_text"), 256).alias("content_hash"), seniority(F.col("title_raw"), F.col("requirements_text"), F.col("employment_type_raw")).alias("seniority"),
        F.size(extract_terms(desc, T.SKILLS)).cast("bigint").alias("n_skills"), classify(F.lower("title_raw"), T.FAMILIES, "other", F.col("description_text").rlike(T.EVIDENCE))["family"].alias("family"),
        pay["paid"].alias("paid"), F.round(pay["inr_month"], 4).alias("inr_month"),
    )
    return x.join(_places(spark, d), "posting_id")


# --- structural duplicates ------------------------------------------------------------------------------------------------------------
def _simhash_sql() -> str:
    """CTE ``sh (posting_id, simhash)``: bit votes over sha256 prefixes of shingles of five words, in 64-bit arithmetic."""
    votes = ", ".join(f"sum(CASE WHEN (h >> {63 - i}) & 1 = 1 THEN n ELSE -n END) > 0 AS b{i}" for i in range(64))
    word = " + ".join(f"CASE WHEN b{i} THEN {1 << (63 - i)}::HUGEINT ELSE 0 END" for i in range(64))
    return (
        "w AS (SELECT posting_id, regexp_extract_all(lower(coalesce(description_text, '')), '[a-z0-9]+') AS w FROM posting),"
        " g AS (SELECT posting_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT posting_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),"
        " c AS (SELECT posting_id, ('0x' || sha256(s)[1:16])::UBIGINT AS h, count(*) AS n FROM g GROUP BY posting_id, s),"
        f" v AS (SELECT posting_id, {votes} FROM c GROUP BY posting_id), u AS (SELECT posting_id, {word} AS x FROM v),"
        " sh AS (SELECT posting.posting_id, coalesce(CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END, 0)::BIGINT AS simhash FROM posting LEFT JOIN u USING (posting_id))"
    )


_SIMHASH = _simhash_sql()


@query(f"WITH {_SIMHASH} SELECT posting_id, simhash FROM sh")
def simhash64(spark, d):
    return D.simhash(spread_table(spark, d, "posting", "posting_id", "description_text"), "posting_id", "description_text")


@query(
    f"WITH {_SIMHASH}, reps AS (SELECT simhash, min(posting_id) AS id FROM sh WHERE simhash <> 0 GROUP BY simhash)"
    " SELECT a.id AS a, b.id AS b, bit_count(xor(a.simhash, b.simhash))::INTEGER AS distance FROM reps a JOIN reps b ON a.id < b.id AND bit_count(xor(a.simhash, b.simhash)) <= 3"
)
def simhash_pairs(spark, d):
    """Pairs of representatives of different SimHashes at most three bits apart; ``simhash_classes`` has the members."""
    return D.close_simhashes(D.simhash(spread_table(spark, d, "posting", "posting_id", "description_text"), "posting_id", "description_text"), "posting_id")


@query(
    f"WITH {_SIMHASH}, reps AS (SELECT simhash, min(posting_id) AS rep, count(*) AS n FROM sh WHERE simhash <> 0 GROUP BY simhash),"
    " l AS (SELECT a.rep, sum(b.n) AS far FROM reps a JOIN reps b ON a.rep <> b.rep AND bit_count(xor(a.simhash, b.simhash)) <= 3 GROUP BY a.rep)"
    " SELECT posting_id, rep AS representative, (n - 1 + coalesce(far, 0))::BIGINT AS n_links FROM sh JOIN reps USING (simhash) LEFT JOIN l USING (rep)"
)
def simhash_classes(spark, d):
    """One row per posting with text: the representative of its SimHash and the number of its links, copies of linked patterns included."""
    h = written(D.simhash(spread_table(spark, d, "posting", "posting_id", "description_text"), "posting_id", "description_text").where("simhash <> 0"))
    reps = h.groupBy("simhash").agg(F.min("posting_id").alias("representative"), F.count(F.lit(1)).alias("n"))
    pairs = D.close_simhashes(h, "posting_id")
    ends = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("representative", "other")
    far = ends.join(reps.select(F.col("representative").alias("other"), "n"), "other").groupBy("representative").agg(F.sum("n").alias("far"))
    x = h.join(reps, "simhash").join(far, "representative", "left")
    return x.select("posting_id", "representative", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))


#: CTEs ending in ``jw (ta, tb, s)``: Jaro-Winkler over characters with half transpositions, of the pairs of ``tp (ta, tb)``.
_JW = (
    "jwm AS (SELECT ta, tb, list_reduce(list_transform(range(1, length(ta) + 1), lambda i: [i]), lambda acc, x: list_append(acc, coalesce(list_filter(range(greatest(1, x[1] - greatest(greatest(length(ta), length(tb)) // 2 - 1, 0)), least(x[1] + greatest(greatest(length(ta), length(tb)) // 2 - 1, 0), length(tb)) + 1), lambda j: tb[j] = ta[x[1]] AND NOT list_contains(acc, j))[1], -x[1])), []::BIGINT[]) AS hit FROM tp),"
    " jwc AS (SELECT ta, tb, list_filter(hit, lambda j: j > 0) AS hit, list_filter(range(1, len(hit) + 1), lambda i: hit[i] > 0) AS own FROM jwm),"
    " jws AS (SELECT ta, tb, len(hit) AS m, len(list_filter(range(1, len(hit) + 1), lambda k: ta[own[k]] <> tb[list_sort(hit)[k]])) / 2.0 AS t, CASE WHEN ta[1] <> tb[1] THEN 0 WHEN ta[1:2] <> tb[1:2] THEN 1 WHEN ta[1:3] <> tb[1:3] THEN 2 WHEN ta[1:4] <> tb[1:4] THEN 3 ELSE least(4, length(ta), length(tb)) END AS p FROM jwc),"
    " jw AS (SELECT ta, tb, s + 0.1 * p * (1 - s) AS s FROM (SELECT ta, tb, p, CASE WHEN ta = tb THEN 1.0 WHEN m = 0 THEN 0.0 ELSE (m / length(ta) + m / length(tb) + (m - t) / m) / 3 END AS s FROM jws))"
)
_STAGE2 = (
    f"WITH {_PLACES}, {_SIMHASH}, rec AS (SELECT posting_id AS id, trim(regexp_replace(lower(trim(company_name_raw)), '[^a-z0-9]+', '-', 'g'), '-') AS b0, {T._NAME} AS b1, {_SENIORITY} AS b2, {_NORM_TITLE} AS t, posted_at AS seen, entry_id AS city, tier, mode, simhash"
    " FROM posting JOIN tb USING (posting_id) JOIN sh USING (posting_id)),"
    f" lim AS (SELECT * FROM rec WHERE seen > TIMESTAMP '{NOW}' - INTERVAL 45 DAY AND seen <= TIMESTAMP '{NOW}' QUALIFY row_number() OVER (PARTITION BY b0, b1, b2 ORDER BY seen DESC, id) <= 200),"
    " cp AS (SELECT x.id, o.id AS o, x.t AS ta, o.t AS tb, bit_count(xor(x.simhash, o.simhash)) AS dist FROM rec x JOIN lim o USING (b0, b1, b2) WHERE x.id <> o.id AND x.simhash <> 0 AND o.simhash <> 0"
    " AND (coalesce(x.city = o.city, false) OR (x.mode = 'remote' AND o.mode = 'remote') OR ((x.mode = 'remote' OR o.mode = 'remote') AND x.tier = o.tier) OR (x.city IS NULL) <> (o.city IS NULL))),"
    f" tp AS (SELECT DISTINCT ta, tb FROM cp), {_JW}, prs AS (SELECT cp.* FROM cp JOIN jw USING (ta, tb) WHERE jw.s >= 0.85),"
    " best AS (SELECT id AS posting_id, arg_min(o, (dist, o)) AS match, min(dist)::INTEGER AS distance FROM prs GROUP BY id)"
)


def _structural(spark: SparkSession, d: str) -> DataFrame:
    p = spread_table(spark, d, "posting", "posting_id", "company_name_raw", "title_raw", "description_text", "requirements_text", "employment_type_raw", "posted_at")
    x = p.select(
        "posting_id", "posted_at", X.slug(F.col("company_name_raw")).alias("company"), X.normalize_title(F.col("title_raw"))["normalized"].alias("title"),
        classify(F.lower("title_raw"), T.FAMILIES, "other", F.col("description_text").rlike(T.EVIDENCE))["family"].alias("family"),
        seniority(F.col("title_raw"), F.col("requirements_text"), F.col("employment_type_raw")).alias("seniority"),
    )
    x = x.join(D.simhash(p, "posting_id", "description_text"), "posting_id").join(_places(spark, d).withColumnRenamed("entry_id", "city"), "posting_id")
    return D.structural_matches(written(x), "posting_id", ["company", "family", "seniority"], "title", "posted_at", F.lit(NOW).cast("timestamp_ntz"))


@query(_STAGE2 + " SELECT posting_id, match, distance, CASE WHEN distance <= 3 THEN 'merge' ELSE 'escalate' END AS action FROM best")
def stage2_matches(spark, d):
    """The closest structural candidate of each posting, to merge with or to look at again."""
    return _structural(spark, d)


@query(
    f"WITH n AS (SELECT p_brand, p_name, count(*)::BIGINT AS n FROM part GROUP BY ALL), pr AS (SELECT p_brand, a.p_name AS name_a, b.p_name AS name_b, a.n AS n_a, b.n AS n_b FROM n a JOIN n b USING (p_brand) WHERE a.p_name < b.p_name),"
    f" tp AS (SELECT DISTINCT name_a AS ta, name_b AS tb FROM pr), {_JW} SELECT pr.* FROM pr JOIN jw ON ta = name_a AND tb = name_b WHERE s >= 0.85"
)
def jw_title_pairs(spark, d):
    """Similar names within a brand: pairs of different names with the number of parts of each; parts of one name are one row."""
    n = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    x = n.select("p_brand", F.col("p_name").alias("name_a"), F.col("n").alias("n_a")).join(n.select("p_brand", F.col("p_name").alias("name_b"), F.col("n").alias("n_b")), "p_brand").where("name_a < name_b")
    alike = x.select("name_a", "name_b").distinct().where(jaro_winkler("name_a", "name_b") >= 0.85)
    return x.join(alike, ["name_a", "name_b"], "left_semi")


@query(None)
def stage2_groups(spark, d):
    """Groups of at most 25 after the structural merges, closest first, and the kept group of each posting."""
    m = _structural(spark, d).where("action = 'merge'")
    order = F.struct("distance", F.xxhash64("posting_id", "match"))
    p = table(spark, d, "posting").select(F.col("posting_id").alias("id"), F.col("fetched_at").alias("first_seen"))
    groups, _ = D.merge_groups(m.select(F.col("posting_id").alias("a"), F.col("match").alias("b"), order.alias("priority")), p)
    return groups.select(F.col("id").alias("posting_id"), F.col("group").alias("group_id"))


@query(
    T._EDGES.replace("WITH ", "WITH RECURSIVE ")
    + ", ed AS (SELECT DISTINCT id AS a, m AS b FROM e WHERE id <> m), both_ AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, s.b FROM reach r JOIN both_ s ON r.b = s.a)"
    ' SELECT id, least(id, coalesce(m, id)) AS "group" FROM p LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = id'
)
def dup_components(spark, d):
    """Groups of postings tied by any of the exact keys."""
    k = T._keyed(spark, d)
    e = None
    for c in ("k1", "k2", "k3"):
        x = D.exact_edges(k, "id", [c]).select("id", "match")
        e = x if e is None else e.union(x)
    return D.groups_of(e, k.select("id"))


_REP = "40 + CASE WHEN length(description_text) >= 1000 THEN 25 ELSE 0 END + CASE WHEN compensation_raw_text <> '' THEN 15 ELSE 0 END + CASE WHEN location_raw <> '' THEN 10 ELSE 0 END + CASE WHEN posted_at IS NOT NULL AND NOT posted_at_estimated THEN 10 ELSE 0 END"


@query(
    f"WITH s AS (SELECT ats_token, posting_id, {_REP} AS s, fetched_at FROM posting), m AS (SELECT *, s + CASE WHEN row_number() OVER (PARTITION BY ats_token ORDER BY fetched_at DESC NULLS LAST, posting_id) = 1 THEN 5 ELSE 0 END AS score FROM s)"
    " SELECT ats_token, posting_id, score::INTEGER AS score, count(*) OVER (PARTITION BY ats_token)::BIGINT AS members FROM m QUALIFY row_number() OVER (PARTITION BY ats_token ORDER BY score DESC, posting_id) = 1"
)
def recent_representative(spark, d):
    """Best record of each board, the most recent one with a bonus."""
    score = D.representative_score(F.length("description_text"), (F.col("compensation_raw_text") != "", 15), (F.col("location_raw") != "", 10), (F.col("posted_at").isNotNull() & ~F.col("posted_at_estimated"), 10))
    return D.recent_representatives(table(spark, d, "posting"), "ats_token", score, "posting_id", "fetched_at")


QUERIES, ORACLE_SQL = Q, SQL
