"""Normal form of site names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(col: Column) -> Column:
    """Lower-case host of a domain, URL or host:port text, without ``www.``; null for blank or missing text."""
    host = F.lower(F.trim(col))
    host = F.regexp_replace(host, r"^[a-z][a-z0-9+.-]*:(?://)?", "")
    host = F.regexp_replace(host, r"^//", "")
    host = F.regexp_replace(host, r"[/?#].*$", "")
    host = F.regexp_replace(host, r"^[^@]*@|:\d*$|\.$", "")
    host = F.regexp_replace(host, r"^www\d?\.", "")
    return F.when(host == "", None).otherwise(host)


def site_key(col: Column) -> Column:
    """First label of the host: ``www.Some-Site.example/`` and ``some-site`` both give ``some-site``."""
    return F.element_at(F.split(host_of(col), r"\."), 1)
