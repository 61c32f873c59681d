"""Text functions as column expressions; they stay inside generated code.

Patterns use ASCII classes where Java's and RE2's regular expressions differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f]+"
# The named entities that occur in payloads.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&#8377;": "₹", "&ndash;": "–", "&mdash;": "—", "&amp;": "&"}
# Words of a title that are written out.
TITLE_WORDS = {"swe": "software engineer", "sde": "software development engineer", "mle": "machine learning engineer", "sre": "site reliability engineer"}
# Patterns of personal data and secrets, in the order in which they are replaced.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
SECRET = r"(?i)\bBearer\s+[A-Za-z0-9._\-]{10,}\b|\bsk-[A-Za-z0-9]{10,}\b|\bgh[opsu]_[A-Za-z0-9]{10,}\b"
PHONE = r"\+\d{1,3}[-.\s]?\d{2,5}(?:[-.\s]?\d{2,5}){1,3}\b|\b\d{2,5}[-.\s]\d{2,5}(?:[-.\s]\d{2,5})*\b"
REDACTED = "[REDACTED]"
_MONTHS = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_KEYS = r"csrf[-_]?token|csrf|nonce|_token|sessionid|session[-_]?id|session[-_]?token"
# What changes in a page without its content changing, in the order in which it is removed.
VOLATILE = [
    r"(?s)<!--.*?-->",
    r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d{2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4} \d{2}:\d{2}:\d{2} GMT\b",
    r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?\b",
    rf"(?i)\b{_MONTHS}\.?\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"(?i)\b\d{{1,2}}\s+{_MONTHS}\.?,?\s+\d{{4}}\b",
    rf"(?i)<[^>]*\bname=[\"']?(?:{_KEYS})[\"']?[^>]*>",
    rf"(?i)\b(?:{_KEYS})\s*[:=]\s*[\"']?[A-Za-z0-9._-]+[\"']?",
    r"(?i)\b\d+\s*(?:second|minute|hour|day|week|month|year)s?\s+ago\b",
    r"(?i)\b(?:yesterday|today|just now)\b",
]


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(c, WS, " "))


def unescape(c: Column) -> Column:
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def strip_html(c: Column) -> Column:
    """Plain text of markup; escaped markup counts as markup. NULL stays NULL."""
    return squeeze(unescape(F.regexp_replace(unescape(c), r"<[^>]+>", " ")))


def normalize_title(c: Column) -> Column:
    """Struct normalized, season, year of a title."""
    t = F.regexp_replace(c, r"(?i)\b(req|job|id)[\s#-]*\d{3,}\b", "")
    pattern = r"(?i)\b(summer|winter|fall|spring)\s*(20\d\d)\b"
    season, year = F.lower(F.regexp_extract(t, pattern, 1)), F.regexp_extract(t, pattern, 2)
    t = F.lower(F.regexp_replace(t, pattern, ""))
    for k, v in TITLE_WORDS.items():
        t = F.regexp_replace(t, rf"\b{k}\b", v)
    return F.struct(squeeze(t).alias("normalized"), season.alias("season"), year.alias("year"))


def scrub(c: Column) -> Column:
    for p in (EMAIL, SECRET, PHONE):
        c = F.regexp_replace(c, p, REDACTED.replace("[", r"\[").replace("]", r"\]"))
    return c


def without_volatile(c: Column) -> Column:
    for p in VOLATILE:
        c = F.regexp_replace(c, p, "")
    return squeeze(c)


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), F.lit("-"))


def work_mode(raw: Column, remote_hint: Column) -> Column:
    return (
        F.when(F.coalesce(remote_hint, F.lit(False)) | raw.rlike(r"(?i)\bremote\b"), "remote").when(raw.rlike(r"(?i)\bhybrid\b"), "hybrid").when(F.coalesce(raw, F.lit("")) == "", "unknown").otherwise("onsite")
    )


def words(c: Column) -> Column:
    """Array of runs of a-z and 0-9 after lower-casing."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1))
