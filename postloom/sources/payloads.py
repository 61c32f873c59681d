"""Pages of job boards to one posting schema.

A page is a row ``source_id string, fetched_at timestamp, body string`` (from files: ``read_pages``). Each board has a declared schema of the
fields read; unknown fields are ignored, missing ones are blank. A body that isn't JSON of the schema gives no postings and one row of
``corrupt_pages``. A page with a blank title or address, or with an id twice, is rejected as a whole (``valid_pages``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions.text import strip_html, unescape

POSTING = [
    "external_id", "url", "apply_url", "company_name_raw", "title_raw", "description_html", "description_text", "requirements_text", "department",
    "employment_type_raw", "location_raw", "remote_hint", "compensation_raw_text", "posted_at", "posted_at_estimated",
]


def _s(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _first(*cols: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def _join(sep: str, *cols: Column) -> Column:
    return F.array_join(F.filter(F.array(*cols), lambda x: x != ""), sep)


# The notations of moments and days in payloads, and the address of a search page whose postings live beside it.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
DAY = r"^\d{4}-\d{2}-\d{2}$"
SEARCH_PAGE = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)/wday/cxs/[^/?#]+/([^/?#]+)/jobs(?:[?#].*)?$"


def _time(c: Column, pattern: str = RFC3339) -> Column:
    """The moment of a text in exactly this notation, NULL for others and for impossible dates."""
    return F.when(c.rlike(pattern), F.try_to_timestamp(c))


def site_base(page_url: Column) -> Column:
    """Where the postings of a search page live; NULL for other addresses."""
    return F.nullif(F.regexp_replace(F.regexp_extract(page_url, SEARCH_PAGE, 0), SEARCH_PAGE, "$1/$2"), F.lit(""))


@dataclass(frozen=True)
class Board:
    """How the pages of one kind of board are read."""

    schema: str
    items: str | None
    fields: Callable[[], dict[str, Column]]
    keep: str | None = None


def _greenhouse() -> dict[str, Column]:
    return {
        "external_id": _s("i.id"), "title_raw": _s("i.title"), "url": _s("i.absolute_url"), "apply_url": _s("i.absolute_url"), "company_name_raw": _s("i.company_name"),
        "description_html": unescape(_s("i.content")), "department": F.coalesce(F.try_element_at(F.col("i.departments"), F.lit(1))["name"], F.lit("")),
        "location_raw": _s("i.location.name"), "posted_at": _time(_s("i.updated_at")), "posted_at_estimated": F.lit(True),
    }


def _lever() -> dict[str, Column]:
    at = F.when(F.col("i.createdAt") > 0, F.timestamp_millis(F.col("i.createdAt")))
    return {
        "external_id": _s("i.id"), "title_raw": _s("i.text"), "url": _s("i.hostedUrl"), "apply_url": _first(_s("i.applyUrl"), _s("i.hostedUrl")), "description_html": _s("i.description"),
        "description_text": _s("i.descriptionPlain"), "department": _first(_s("i.categories.department"), _s("i.categories.team")), "employment_type_raw": _s("i.categories.commitment"),
        "location_raw": _s("i.categories.location"), "remote_hint": F.lower(_s("i.workplaceType")) == "remote", "posted_at": at, "posted_at_estimated": F.lit(False),
    }


def _ashby() -> dict[str, Column]:
    return {
        "external_id": _s("i.id"), "title_raw": _s("i.title"), "url": _s("i.jobUrl"), "apply_url": _first(_s("i.applyUrl"), _s("i.jobUrl")), "description_html": _s("i.descriptionHtml"), "description_text": _s("i.descriptionPlain"),
        "department": _s("i.department"), "employment_type_raw": _s("i.employmentType"), "location_raw": _s("i.location"), "remote_hint": F.coalesce(F.col("i.isRemote"), F.lit(False)),
        "compensation_raw_text": _s("i.compensation.scrapeableCompensationSalarySummary"), "posted_at": _time(_s("i.publishedAt")), "posted_at_estimated": F.lit(False),
    }


def _workable() -> dict[str, Column]:
    return {
        "external_id": _s("i.shortcode"), "title_raw": _s("i.title"), "url": _s("i.url"), "apply_url": _first(_s("i.application_url"), _s("i.url")), "department": _s("i.department"), "employment_type_raw": _s("i.employment_type"),
        "location_raw": _join(", ", _s("i.city"), _s("i.state"), _s("i.country")), "remote_hint": F.coalesce(F.col("i.telecommute"), F.lit(False)), "posted_at": _time(_s("i.published_on"), DAY), "posted_at_estimated": F.lit(False),
    }


def _smartrecruiters() -> dict[str, Column]:
    return {
        "external_id": _s("i.id"), "title_raw": _s("i.name"), "url": _s("i.postingUrl"), "apply_url": _s("i.postingUrl"), "department": _s("i.department.label"), "employment_type_raw": _s("i.typeOfEmployment.label"),
        "location_raw": _join(", ", _s("i.location.city"), _s("i.location.region"), _s("i.location.country")), "remote_hint": F.coalesce(F.col("i.location.remote"), F.lit(False)), "posted_at": _time(_s("i.releasedDate")), "posted_at_estimated": F.lit(False),
    }


def _recruitee() -> dict[str, Column]:
    return {
        "external_id": _s("i.id"), "title_raw": _s("i.title"), "url": _s("i.careers_url"), "apply_url": _first(_s("i.careers_apply_url"), _s("i.careers_url")), "description_html": _s("i.description"), "requirements_text": strip_html(_s("i.requirements")),
        "department": _s("i.department"), "employment_type_raw": _s("i.employment_type_code"), "location_raw": _join(", ", _s("i.city"), _s("i.country")), "remote_hint": F.coalesce(F.col("i.remote"), F.lit(False)), "posted_at": _time(_s("i.published_at")), "posted_at_estimated": F.lit(False),
    }


def _teamtailor() -> dict[str, Column]:
    label = lambda p: F.array_join(F.filter(F.array(p["address"]["addressLocality"], p["address"]["addressCountry"]), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    place = F.array_join(F.filter(F.transform(F.coalesce(F.col("i._jobposting.jobLocation"), F.array()), label), lambda x: x != ""), "; ")
    return {
        "external_id": _s("i.id"), "title_raw": _s("i.title"), "url": _s("i.url"), "apply_url": _s("i.url"), "description_html": _s("i.content_html"), "location_raw": place, "remote_hint": F.lower(place).contains("remote"),
        "posted_at": _time(_s("i.date_published")), "posted_at_estimated": F.lit(False),
    }


def relative_day(text: Column, fetched_at: Column) -> Column:
    """Posted Today, Posted Yesterday, Posted N(+) Days Ago, against the time of fetching; NULL for other texts."""
    n = F.when(text.rlike(r"(?i)\btoday\b"), 0).when(text.rlike(r"(?i)\byesterday\b"), 1).otherwise(F.regexp_extract(text, r"(?i)(\d+)\+?\s+days?\s+ago", 1).try_cast("int"))
    return fetched_at - F.make_dt_interval(n)


def _workday() -> dict[str, Column]:
    bullet = F.try_element_at(F.filter(F.coalesce(F.col("i.bulletFields"), F.array().cast("array<string>")), lambda b: b.rlike(r"^R-\d+$")), F.lit(1))
    base = F.coalesce(F.col("site"), F.lit(""))
    return {
        "external_id": F.coalesce(bullet, _s("i.externalPath")), "title_raw": _s("i.title"), "url": F.concat(base, _s("i.externalPath")), "apply_url": F.concat(base, _s("i.externalPath")), "employment_type_raw": _s("i.timeType"),
        "location_raw": _s("i.locationsText"), "remote_hint": F.lower(_s("i.locationsText")).contains("remote"), "posted_at": relative_day(_s("i.postedOn"), F.col("fetched_at")), "posted_at_estimated": F.lit(True),
    }


BOARDS = {
    "greenhouse": Board("jobs array<struct<id:bigint,title:string,updated_at:string,absolute_url:string,content:string,location:struct<name:string>,departments:array<struct<name:string>>,requisition_id:string,company_name:string>>", "jobs", _greenhouse),
    "lever": Board("array<struct<id:string,text:string,createdAt:bigint,hostedUrl:string,applyUrl:string,country:string,workplaceType:string,descriptionPlain:string,description:string,categories:struct<commitment:string,department:string,team:string,location:string>>>", None, _lever),
    "ashby": Board("jobs array<struct<id:string,title:string,department:string,employmentType:string,location:string,publishedAt:string,isRemote:boolean,jobUrl:string,applyUrl:string,descriptionHtml:string,descriptionPlain:string,compensation:struct<scrapeableCompensationSalarySummary:string>>>", "jobs", _ashby),
    "workable": Board("jobs array<struct<title:string,shortcode:string,employment_type:string,telecommute:boolean,department:string,url:string,application_url:string,published_on:string,country:string,city:string,state:string>>", "jobs", _workable),
    "smartrecruiters": Board("totalFound int, content array<struct<id:string,name:string,refNumber:string,releasedDate:string,location:struct<city:string,region:string,country:string,remote:boolean>,department:struct<label:string>,typeOfEmployment:struct<label:string>,postingUrl:string>>", "content", _smartrecruiters),
    "recruitee": Board("offers array<struct<id:bigint,title:string,status:string,department:string,remote:boolean,employment_type_code:string,careers_url:string,careers_apply_url:string,description:string,requirements:string,published_at:string,city:string,country:string>>", "offers", _recruitee, "i.status = 'published'"),
    "teamtailor": Board("items array<struct<id:string,title:string,url:string,date_published:string,content_html:string,_jobposting:struct<jobLocation:array<struct<address:struct<addressLocality:string,addressCountry:string>>>>>>", "items", _teamtailor),
    "workday": Board("total int, jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>,timeType:string>>", "jobPostings", _workday),
}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files of one page each as ``path, body``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def _parsed(pages: DataFrame, board: str) -> DataFrame:
    b = BOARDS[board]
    x = F.from_json("body", b.schema, {"mode": "PERMISSIVE"})
    return pages.withColumn("_items", x[b.items] if b.items else x)


def corrupt_pages(pages: DataFrame, board: str) -> DataFrame:
    """Pages whose body isn't JSON of the board's shape: what is wrong, and hashes of the body and, where there is a ``page_url``, of the address."""
    wrong = F.when(F.trim(F.coalesce("body", F.lit(""))) == "", "empty body").when(F.try_parse_json("body").isNull(), "not JSON").otherwise("another shape")
    hashes = [F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_hash")]
    if "page_url" in pages.columns:
        hashes.append(F.sha2(F.coalesce("page_url", F.lit("")), 256).alias("url_hash"))
    return _parsed(pages, board).where("_items IS NULL").select(*pages.columns, wrong.alias("error"), *hashes)


def parse_pages(pages: DataFrame, board: str) -> DataFrame:
    """Postings of the pages, one row per item, with the page's other columns. Empty pages and corrupt ones give none."""
    b = BOARDS[board]
    if "site" not in pages.columns:
        pages = pages.withColumn("site", site_base(F.col("page_url")) if "page_url" in pages.columns else F.lit(None).cast("string"))
    x = _parsed(pages, board).select(*[c for c in pages.columns if c != "body"], F.posexplode("_items").alias("item_no", "i"))
    if b.keep:
        x = x.where(b.keep)
    f = b.fields()
    blank = {"remote_hint": F.lit(False), "posted_at": F.lit(None).cast("timestamp"), "posted_at_estimated": F.lit(False)}
    return x.select(*[c for c in pages.columns if c not in ("body", "site")], "item_no", *[f.get(c, blank.get(c, F.lit(""))).alias(c) for c in POSTING], F.lit(board).alias("adapter"))


def valid_pages(postings: DataFrame, page: list[str]) -> DataFrame:
    """Postings of the pages in which every title and address is given and no id occurs twice."""
    seen = F.count(F.lit(1)).over(Window.partitionBy(*page, "external_id"))
    bad = (F.coalesce("title_raw", F.lit("")) == "") | (F.coalesce("apply_url", F.lit("")) == "") | ((F.col("external_id") != "") & (seen > 1))
    rejected = postings.withColumn("_bad", bad).where("_bad").select(*page).distinct()
    return postings.join(rejected, page, "left_anti")
