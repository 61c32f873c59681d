"""Canonical URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track or name a session, and hosts that route by fragment.
TRACKING = ["gh_src", "lever-source", "ref", "source", "src", "fbclid", "gclid", "mc_cid", "mc_eid", "trk", "trackingid", "refid", "position", "pagenum", "li_fat_id", "_hsenc", "_hsmi"]
SESSION = ["sessionid", "jsessionid", "phpsessid", "sid"]
FRAGMENT_HOSTS = ["myworkdayjobs.com", "successfactors.com"]
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def canonical_url(raw: Column) -> Column:
    """Scheme and host in lower case, https, no default port, no tracking or empty parameters, parameters in order of their
    keys, no fragment (but for hosts that route by it), no slash at the end of a path. Texts that are no URL stay as they are."""
    u = F.trim(raw)
    part = lambda i: F.regexp_extract(u, _URL, i)
    scheme = F.lower(part(1))
    scheme = F.when(scheme == "http", "https").otherwise(scheme)
    host = F.lower(part(2))
    host = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.when(F.length(part(3)) > 1, F.regexp_replace(part(3), r"/$", "")).otherwise(part(3))
    key = lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1))
    keep = F.filter(F.split(part(4), "&"), lambda p: p.rlike(r"^[^=]+=.+") & ~key(p).isin(*TRACKING, *SESSION) & ~key(p).startswith("utm_"))
    # by key, values of one key in their order
    order = F.transform(keep, lambda p, i: F.struct(F.regexp_extract(p, r"^([^=]*)", 1).alias("k"), i.alias("i"), p.alias("p")))
    query = F.array_join(F.transform(F.array_sort(order), lambda s: s["p"]), "&")
    bare = F.regexp_replace(host, r":\d+$", "")
    routed = bare.rlike("(^|[.])(" + "|".join(h.replace(".", "[.]") for h in FRAGMENT_HOSTS) + ")$")
    out = F.concat(
        scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(routed & (part(5) != ""), F.concat(F.lit("#"), part(5))).otherwise("")
    )
    return F.when(u.rlike(_URL), out).otherwise(u)


def url_hash(raw: Column) -> Column:
    return F.sha2(canonical_url(raw), 256)


# Endings of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "co.in", "org.in", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "com.sg", "co.za", "com.mx", "co.kr"]


def registered_domain(url: Column) -> Column:
    """The name under a public suffix; addresses of numbers and single labels stay. Suffixes beyond the listed ones count as one label."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")
    n = F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), 3).otherwise(2)
    return F.when(host.rlike(r"^[0-9.]+$"), host).when(n == 3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
