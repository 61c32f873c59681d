"""Postings out of alert mails, and robots rules: texts whose structure only regular expressions give."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Provider:
    """A sender and the links of its mails that lead to postings."""

    name: str
    sender: str
    link: str


# Senders of alerts and the addresses of their postings, in order of trial.
PROVIDERS = [
    Provider("linkedin", r"(?i)linkedin\.com", r"(?i)linkedin\.com/(?:comm/)?jobs/view/\d+"),
    Provider("indeed", r"(?i)indeed\.com", r"(?i)indeed\.com/(?:rc/clk|viewjob|pagead/clk)"),
    Provider("glassdoor", r"(?i)glassdoor\.com", r"(?i)glassdoor\.com/(?:job-listing|partner/jobListing)"),
    Provider("handshake", r"(?i)joinhandshake\.com", r"(?i)joinhandshake\.com/(?:stu/)?jobs/\d+"),
]
_ANCHOR = re.compile(r"""<a\b[^>]*\bhref=["']([^"']+)["'][^>]*>(.*?)</a>""", re.I | re.S)
_TAGS = re.compile(r"<[^>]+>")


def _text(fragment: str) -> str:
    return " ".join(html.unescape(_TAGS.sub(" ", html.unescape(fragment))).split())


def extract(sender: str | None, body: str | None, window: int = 400) -> list[tuple[str, str, str, str, str]]:
    """(provider, url, title, company, place): anchors of the first provider that fits the sender; company and place are the first texts within ``window`` bytes after."""
    p = next((p for p in PROVIDERS if re.search(p.sender, sender or "")), None)
    out = []
    for m in _ANCHOR.finditer(body or "") if p else ():
        title = _text(m.group(2))
        if not title or not re.search(p.link, html.unescape(m.group(1))):
            continue
        after = body[m.end() :].encode()[:window].decode("utf-8", "ignore")
        after = _ANCHOR.split(after)[0]
        runs = [r for r in (_text(x) for x in re.split(r"<[^>]*>?", after)) if r]
        out.append((p.name, html.unescape(m.group(1)), title, runs[0] if runs else "", runs[1] if len(runs) > 1 else ""))
    return out


def alert_postings(mails: DataFrame, key: str, sender: str, body: str) -> DataFrame:
    """``key, pos, provider, url, title, company, place``; mails of unknown senders or without anchors give no rows."""
    kind = dict(mails.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *x) for k, s, b in zip(pdf["k"], pdf["s"], pdf["b"], strict=True) for i, x in enumerate(extract(s, b))]
            yield pd.DataFrame(rows, columns=[key, "pos", "provider", "url", "title", "company", "place"])

    x = mails.select(F.col(key).alias("k"), F.col(sender).alias("s"), F.col(body).alias("b"))
    return x.mapInPandas(run, f"{key} {kind}, pos int, provider string, url string, title string, company string, place string")


def robots_rules(files: DataFrame, host: str, body: str, agent: str) -> DataFrame:
    """``host, allow, pattern``: rules of the group that names ``agent`` most closely, of ``*`` if none does."""

    def rules(text: str) -> list[tuple[bool, str]]:
        groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
        fresh = False
        for line in text.splitlines():
            k, sep, v = line.split("#", 1)[0].partition(":")
            k, v = k.strip().lower(), v.strip()
            if not sep:
                continue
            if k == "user-agent":
                if not fresh:
                    groups.append(([], []))
                groups[-1][0].append(v.lower())
                fresh = True
            elif k in ("allow", "disallow"):
                fresh = False
                if groups and v:
                    groups[-1][1].append((k == "allow", v))
        best = max((len(a) for g, _ in groups for a in g if a != "*" and a in agent.lower()), default=0)
        name = lambda a: len(a) if a != "*" and a in agent.lower() else 0
        return [r for g, rs in groups if any((name(a) == best) if best else a == "*" for a in g) for r in rs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(h, *r) for h, b in zip(pdf["h"], pdf["b"], strict=True) for r in rules(b or "")], columns=["host", "allow", "pattern"])

    return files.select(F.col(host).alias("h"), F.col(body).alias("b")).mapInPandas(run, "host string, allow boolean, pattern string")


def robots_allowed(urls: DataFrame, host: str, path: str, rules: DataFrame) -> DataFrame:
    """``urls`` with ``allowed``: the longest pattern that fits decides, an allow wins ties, nothing fitting allows."""
    escaped = F.regexp_replace(F.regexp_replace("pattern", r"([.+?^(){}|\[\]\\])", r"\\$1"), r"\*", ".*")
    rx = F.concat(F.lit("^"), F.when(F.col("pattern").endswith("$"), escaped).otherwise(F.concat(escaped, F.lit(".*"))))
    u = urls.select(F.col(host).alias("_h"), F.col(path).alias("_p")).distinct()
    fits = u.join(rules.withColumn("rx", rx), F.col("_h") == F.col("host")).where(F.regexp_like("_p", F.col("rx")))
    best = fits.groupBy("_h", "_p").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("_a"))
    return urls.join(best, (F.col(host) == F.col("_h")) & (F.col(path) == F.col("_p")), "left").withColumn("allowed", F.coalesce("_a", F.lit(True))).drop("_h", "_p", "_a")
