"""All queries of the core by name, with their SQL where there is one."""

from __future__ import annotations

from postloom.plans import cleaning, ingest, queues, records, scores, serving, texts

MODULES = [serving, texts, records, scores, queues, ingest, cleaning]
FLAGSHIP = "feed_topk"


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= getattr(m, "ORACLE_SQL", {})
    return out
