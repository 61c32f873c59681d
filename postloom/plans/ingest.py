"""Pages of boards parsed to postings, rejected and corrupt pages, and the event stream; pages are put together from the driver's board tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.lineage import shared_dir
from postloom.plans.queues import BUDGET_SQL, TOKEN_SQL
from postloom.plans.texts import _unescape_sql
from postloom.sources.alerts import alert_postings, robots_allowed, robots_rules
from postloom.sources.payloads import DAY, RFC3339, corrupt_pages, parse_pages, valid_pages
from postloom.sources.tables import table
from postloom.streaming import feeds

Q: dict = {}
SQL: dict[str, str] = {}
PAGE = 40


def _posted_sql(c: str) -> str:
    """Microseconds of a moment in the notation of payloads."""
    part = lambda i: f"regexp_extract({c}, '^(.{{10}})T(.{{8}})(?:\\.(\\d+))?(?:Z|([+-])(\\d{{2}}):(\\d{{2}}))$', {i})"
    minutes = f"(TRY_CAST({part(5)} AS BIGINT) * 60 + TRY_CAST({part(6)} AS BIGINT))"
    return (
        f"CASE WHEN regexp_matches({c}, {_quoted(RFC3339)}) THEN epoch_us(TRY_CAST({part(1)} || ' ' || {part(2)} AS TIMESTAMP)) + rpad({part(3)}[1:6], 6, '0')::BIGINT"
        f" - CASE {part(4)} WHEN '' THEN 0 WHEN '-' THEN -{minutes} ELSE {minutes} END * 60000000 END"
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pages(rows: DataFrame, key: str, item, wrap: str | None) -> DataFrame:
    """Pages of ``PAGE`` items of a source as JSON; a source of a third of all items has a third of all pages."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), item.alias("i")))), lambda s: s["i"])
    g = rows.groupBy("source_id", F.floor(F.col(key) / PAGE).alias("page_no")).agg(items.alias("items"), F.min(F.col("fetched_at").cast("timestamp")).alias("fetched_at"))
    return g.select("source_id", "page_no", "fetched_at", F.to_json(F.struct(F.col("items").alias(wrap)) if wrap else F.col("items")).alias("body"))


def _named(*pairs: str):
    """struct of ``json=column``."""
    return F.struct(*[F.expr(p.split("=", 1)[1]).alias(p.split("=", 1)[0]) for p in pairs])


def greenhouse_pages(spark: SparkSession, d: str) -> DataFrame:
    item = _named("id=id", "title=title", "updated_at=updated_at", "absolute_url=absolute_url", "content=content", "location=struct(location_name AS name)", "departments=transform(departments, x -> struct(x AS name))", "company_name=company_name", "extra=1")
    return _pages(table(spark, d, "greenhouse_job"), "item_id", item, "jobs")


_OUT = ["external_id", "title_raw", "url", "apply_url", "department", "employment_type_raw", "location_raw", "remote_hint"]
_C = lambda c: f"coalesce({c}, '')"


@query(
    f"SELECT coalesce(id::VARCHAR, '') AS external_id, {_C('title')} AS title_raw, {_C('absolute_url')} AS url, {_C('absolute_url')} AS apply_url, {_C('departments[1]')} AS department, '' AS employment_type_raw, {_C('location_name')} AS location_raw, false AS remote_hint,"
    f" {_C('company_name')} AS company_name_raw, sha256({_unescape_sql(_C('content'))}) AS description, {_posted_sql(_C('updated_at'))} AS posted_us FROM greenhouse_job"
)
def parse_greenhouse(spark, d):
    x = parse_pages(greenhouse_pages(spark, d), "greenhouse")
    return x.select(*_OUT, "company_name_raw", F.sha2("description_html", 256).alias("description"), F.unix_micros("posted_at").alias("posted_us"))


@query(
    f"SELECT {_C('id')} AS external_id, {_C('text')} AS title_raw, {_C('hosted_url')} AS url, CASE WHEN {_C('apply_url')} <> '' THEN apply_url ELSE {_C('hosted_url')} END AS apply_url, CASE WHEN {_C('categories_department')} <> '' THEN categories_department ELSE {_C('categories_team')} END AS department,"
    f" {_C('categories_commitment')} AS employment_type_raw, {_C('categories_location')} AS location_raw, lower({_C('workplace_type')}) = 'remote' AS remote_hint, CASE WHEN regexp_matches(created_at, '^[0-9]{{13}}$') THEN created_at::BIGINT END AS posted_ms FROM lever_posting"
)
def parse_lever(spark, d):
    created = "createdAt=CASE WHEN created_at RLIKE '^[0-9]{13}$' THEN cast(created_at AS bigint) END"
    cats = "categories=struct(categories_commitment AS commitment, categories_department AS department, categories_team AS team, categories_location AS location)"
    item = _named("id=id", "text=text", created, "hostedUrl=hosted_url", "applyUrl=apply_url", "country=country", "workplaceType=workplace_type", "descriptionPlain=description_plain", "description=description", cats)
    x = parse_pages(_pages(table(spark, d, "lever_posting"), "item_id", item, None), "lever")
    return x.select(*_OUT, F.unix_millis("posted_at").alias("posted_ms"))


@query(
    f"SELECT {_C('id')} AS external_id, {_C('title')} AS title_raw, {_C('job_url')} AS url, CASE WHEN {_C('apply_url')} <> '' THEN apply_url ELSE {_C('job_url')} END AS apply_url, {_C('department')} AS department, {_C('employment_type')} AS employment_type_raw, {_C('location_name')} AS location_raw,"
    f" coalesce(is_remote, false) AS remote_hint, {_C('compensation_tier_summary')} AS compensation_raw_text, {_posted_sql(_C('published_at'))} AS posted_us FROM ashby_job"
)
def parse_ashby(spark, d):
    item = _named("id=id", "title=title", "department=department", "employmentType=employment_type", "location=location_name", "publishedAt=published_at", "isRemote=is_remote", "jobUrl=job_url", "applyUrl=apply_url", "descriptionPlain=description_plain", "compensation=struct(compensation_tier_summary AS scrapeableCompensationSalarySummary)")
    return parse_pages(_pages(table(spark, d, "ashby_job"), "item_id", item, "jobs"), "ashby").select(*_OUT, "compensation_raw_text", F.unix_micros("posted_at").alias("posted_us"))


@query(
    f"SELECT {_C('shortcode')} AS external_id, {_C('title')} AS title_raw, {_C('url')} AS url, CASE WHEN {_C('application_url')} <> '' THEN application_url ELSE {_C('url')} END AS apply_url, {_C('department')} AS department, {_C('employment_type')} AS employment_type_raw,"
    f" array_to_string(list_filter([{_C('city')}, {_C('region_name')}, {_C('country')}], lambda x: x <> ''), ', ') AS location_raw, coalesce(telecommute, false) AS remote_hint, CASE WHEN regexp_matches(published_on, {_quoted(DAY)}) THEN epoch_us(TRY_CAST(published_on AS DATE)::TIMESTAMP) END AS posted_us FROM workable_job"
)
def parse_workable(spark, d):
    item = _named("title=title", "shortcode=shortcode", "employment_type=employment_type", "telecommute=telecommute", "department=department", "url=url", "application_url=application_url", "published_on=published_on", "country=country", "city=city", "state=region_name")
    return parse_pages(_pages(table(spark, d, "workable_job"), "item_id", item, "jobs"), "workable").select(*_OUT, F.unix_micros("posted_at").alias("posted_us"))


def _of(adapter: str) -> str:
    return f"SELECT external_id, title_raw, url, url AS apply_url, {{}} AS department, {{}} AS employment_type_raw, {{}} AS location_raw, {{}} AS remote_hint FROM posting WHERE adapter = '{adapter}'"


@query(_of("smartrecruiters").format("department", "employment_type_raw", "location_raw", "coalesce(remote_hint, false)"))
def parse_smartrecruiters(spark, d):
    item = _named("id=external_id", "name=title_raw", "releasedDate=cast(posted_at AS string)", "location=struct(location_raw AS city, remote_hint AS remote)", "department=struct(department AS label)", "typeOfEmployment=struct(employment_type_raw AS label)", "postingUrl=url")
    p = table(spark, d, "posting").where("adapter = 'smartrecruiters'")
    return parse_pages(_pages(p, "posting_id", item, "content"), "smartrecruiters").select(*_OUT)


@query(_of("recruitee").format("department", "employment_type_raw", "location_raw", "coalesce(remote_hint, false)").replace("external_id,", "posting_id::VARCHAR AS external_id,") + " AND posting_id % 3 <> 0")
def parse_recruitee(spark, d):
    """Only published offers come out."""
    item = _named("id=posting_id", "title=title_raw", "status=CASE WHEN posting_id % 3 = 0 THEN 'draft' ELSE 'published' END", "department=department", "remote=remote_hint", "employment_type_code=employment_type_raw", "careers_url=url", "description=description_html", "requirements=requirements_text", "city=location_raw")
    p = table(spark, d, "posting").where("adapter = 'recruitee'")
    return parse_pages(_pages(p, "posting_id", item, "offers"), "recruitee").select(*_OUT)


@query(_of("teamtailor").format("''", "''", "array_to_string(list_filter([location_raw, department], lambda x: x <> ''), '; ')", "contains(lower(array_to_string(list_filter([location_raw, department], lambda x: x <> ''), '; ')), 'remote')"))
def parse_teamtailor(spark, d):
    item = _named("id=external_id", "title=title_raw", "url=url", "content_html=description_html", "_jobposting=struct(array(struct(struct(location_raw AS addressLocality, '' AS addressCountry) AS address), struct(struct(department AS addressLocality, '' AS addressCountry) AS address)) AS jobLocation)")
    p = table(spark, d, "posting").where("adapter = 'teamtailor'")
    return parse_pages(_pages(p, "posting_id", item, "items"), "teamtailor").select(*_OUT)


@query(
    "SELECT CASE WHEN posting_id % 2 = 0 THEN 'R-' || posting_id ELSE '/job/' || posting_id END AS external_id, title_raw, 'https://wd.example/site/job/' || posting_id AS url, 'https://wd.example/site/job/' || posting_id AS apply_url, '' AS department, employment_type_raw, location_raw,"
    " contains(lower(location_raw), 'remote') AS remote_hint, CASE posting_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 30 END AS days FROM posting WHERE adapter = 'workday'"
)
def parse_workday(spark, d):
    item = _named("title=title_raw", "externalPath=concat('/job/', posting_id)", "locationsText=location_raw", "postedOn=CASE posting_id % 3 WHEN 0 THEN 'Posted Today' WHEN 1 THEN 'Posted Yesterday' ELSE 'Posted 30+ Days Ago' END", "bulletFields=CASE WHEN posting_id % 2 = 0 THEN array('Full', concat('R-', posting_id)) ELSE array('Full') END", "timeType=employment_type_raw")
    p = table(spark, d, "posting").where("adapter = 'workday'")
    pages = _pages(p, "posting_id", item, "jobPostings").withColumn("page_url", F.lit("https://wd.example/wday/cxs/tenant/site/jobs"))
    x = parse_pages(pages, "workday")
    return x.select(*_OUT, F.expr("(unix_micros(fetched_at) - unix_micros(posted_at)) div 86400000000").cast("int").alias("days"))


@query(
    "WITH p AS (SELECT *, item_id // 40 AS page_no FROM workable_job), d AS (SELECT *, count(*) OVER (PARTITION BY source_id, page_no, shortcode) AS n FROM p),"
    " bad AS (SELECT DISTINCT source_id, page_no FROM d WHERE coalesce(title, '') = '' OR (coalesce(shortcode, '') <> '' AND n > 1) OR (coalesce(application_url, '') = '' AND coalesce(url, '') = ''))"
    " SELECT source_id, page_no, count(*)::BIGINT AS n FROM p WHERE (source_id, page_no) NOT IN (SELECT (source_id, page_no) FROM bad) GROUP BY ALL"
)
def validate_pages(spark, d):
    item = _named("title=title", "shortcode=shortcode", "url=url", "application_url=application_url")
    x = valid_pages(parse_pages(_pages(table(spark, d, "workable_job"), "item_id", item, "jobs"), "workable"), ["source_id", "page_no"])
    return x.groupBy("source_id", "page_no").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT source_id, item_id // 40 AS page_no, 'not JSON' AS error, sha256('https://' || source_id || '.example/' || (item_id // 40)) AS url_hash FROM greenhouse_job WHERE (item_id // 40) % 5 = 0")
def parse_errors(spark, d):
    """Every fifth page is cut short; it comes out as corrupt and gives no postings."""
    pages = greenhouse_pages(spark, d).withColumn("page_url", F.concat(F.lit("https://"), "source_id", F.lit(".example/"), F.col("page_no").cast("string")))
    cut = pages.withColumn("body", F.when(F.col("page_no") % 5 == 0, F.expr("substring(body, 1, length(body) - 9)")).otherwise(F.col("body")))
    return corrupt_pages(cut, "greenhouse").select("source_id", "page_no", "error", "url_hash")


_PROVIDER = "list_extract(['linkedin', 'indeed', 'glassdoor', 'handshake'], (posting_id % 4 + 1)::INTEGER)"
_LINK = "list_extract(['https://www.linkedin.com/comm/jobs/view/', 'https://www.indeed.com/viewjob?jk=', 'https://www.glassdoor.com/job-listing/', 'https://app.joinhandshake.com/stu/jobs/'], (posting_id % 4 + 1)::INTEGER)"
_PLAIN_TITLE = f"trim(regexp_replace({_unescape_sql('title_raw')}, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')"


@query(
    f"SELECT posting_id, 0 AS pos, {_PROVIDER} AS provider, {_LINK} || posting_id AS url, {_PLAIN_TITLE} AS title, 'Firm ' || posting_id AS company, 'Place ' || posting_id AS place FROM posting WHERE {_PLAIN_TITLE} <> ''"
)
def alert_mails(spark, d):
    """Anchors of alert mails of four senders with the texts after them; one mail for each posting, its title escaped as in markup."""
    p = table(spark, d, "posting")
    i = (F.col("posting_id") % 4 + 1).cast("int")
    link = F.element_at(F.array(*[F.lit(x) for x in ("https://www.linkedin.com/comm/jobs/view/", "https://www.indeed.com/viewjob?jk=", "https://www.glassdoor.com/job-listing/", "https://app.joinhandshake.com/stu/jobs/")]), i)
    sender = F.element_at(F.array(*[F.lit(x) for x in ("Alerts <jobs@linkedin.com>", "alert@indeed.com", "noreply@glassdoor.com", "Handshake <handshake@mail.joinhandshake.com>")]), i)
    title = F.replace(F.replace(F.replace("title_raw", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.format_string("<p>New</p><a href='%s%s'><b>%s</b></a><div>Firm %s</div><div>Place %s</div><a href='https://x.example/unsubscribe'>Leave</a>", link, "posting_id", title, "posting_id", "posting_id")
    return alert_postings(p.select("posting_id", sender.alias("sender"), body.alias("body")), "posting_id", "sender", "body")


_ROBOTS = "User-agent: *\nDisallow: /\n\nUser-agent: loom\nDisallow: /*/jobs/R-\nAllow: /*/jobs/R-1*\nDisallow: /*/apply$"


@query("SELECT posting_id, NOT (contains(path, '/jobs/R-') AND NOT contains(path, '/jobs/R-1')) AS allowed FROM (SELECT posting_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM posting)")
def robots_check(spark, d):
    p = table(spark, d, "posting").select("posting_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("h"), F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1).alias("path"))
    files = p.select(F.col("h").alias("host")).distinct().withColumn("body", F.lit(_ROBOTS))
    return robots_allowed(p, "h", "path", robots_rules(files, "host", "body", "loom/1.0")).select("posting_id", "allowed")


# --- streams ----------------------------------------------------------------------------------------------------------------------
def _events(spark: SparkSession, d: str) -> DataFrame:
    s = feeds.read_stream(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df: DataFrame) -> DataFrame:
    """The stream's output as files in the shared folder."""
    at = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    feeds.run_to_parquet(df, f"{at}/out", f"{at}/checkpoint")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_new_feed(spark, d):
    return _run(feeds.new_records(_events(spark, d), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"))


@query(
    "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL"
)
def stream_windowed_counts(spark, d):
    """Hours that the watermark has closed."""
    x = _run(feeds.windowed_counts(_events(spark, d), "ts", ["event_type"]))
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events), g AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),"
    " r AS (SELECT *, sum(f) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM g)"
    " SELECT event_id, user_id, failures::BIGINT AS failures, CASE WHEN failures >= 3 THEN least(21600, 60 * power(2, failures - 3))::BIGINT ELSE 0 END AS open_s FROM r"
)
def stream_circuit(spark, d):
    e = _events(spark, d).select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return _run(feeds.circuit_stream(e, "user_id", "ts", "event_id", "failed", threshold=3)).withColumn("failures", F.col("failures").cast("bigint"))


@query(
    "WITH s AS (SELECT event_type, unnest([date_trunc('hour', ts) - INTERVAL 30 MINUTE, date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 30 MINUTE]) AS start, ts FROM events)"
    " SELECT start::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n FROM s WHERE ts >= start AND ts < start + INTERVAL 1 HOUR AND start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL"
)
def stream_sliding_counts(spark, d):
    """Windows of an hour that begin every half hour, once the watermark has closed them."""
    x = _run(feeds.windowed_counts(_events(spark, d), "ts", ["event_type"], slide="30 minutes"))
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),"
    ' s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k'
    " HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
)
def stream_sessions(spark, d):
    """Runs of a user's events with less than six hours between, once the watermark has closed them."""
    x = _run(feeds.sessions(_events(spark, d), "ts", ["user_id"], gap="6 hours"))
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(TOKEN_SQL)
def stream_token_bucket(spark, d):
    """The token bucket with its level kept from batch to batch."""
    e = _events(spark, d).select("event_id", "user_id", "ts")
    return _run(feeds.token_stream(e, "user_id", "ts", "event_id", rate=1 / 3600, burst=3.0)).withColumn("tokens", F.round("tokens", 4))


@query(BUDGET_SQL)
def stream_budgets(spark, d):
    """Sequential budgets with the sent events of the last day kept from batch to batch."""
    e = _events(spark, d).select("event_id", "user_id", "ts", "event_type")
    return _run(feeds.budget_stream(e, "user_id", "ts", "event_id", "event_type", per_hour=1, per_day=3, per_kind_day=2))


@query("SELECT event_id, user_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200) WHERE event_id > (SELECT max(event_id) - 150 FROM events)")
def feed_replay(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    last = e.agg(F.max("event_id")).first()[0]
    return feeds.replay(e, (0 if last is None else last) - 150)


QUERIES, ORACLE_SQL = Q, SQL
