"""Connector registry: a key for each publishing platform, read from files that a fetcher left.

The engine has no network; each platform's records arrive as line-delimited JSON
in its folder and go through the same schema, coercions and quarantine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.sources.tables import read_meetings

# Platform keys, and the hosts expected of their documents (none: any host).
PLATFORMS = {
    "granicus": ("granicus.com", "granicus_production_attachments.s3.amazonaws.com"),
    "iqm2": ("iqm2.com",),
    "legistar": ("legistar.com", "legistar1.com"),
    "novusagenda": ("novusagenda.com",),
    "onbase": ("onbaseonline.com", "hyland.com"),
    "primegov": ("primegov.com",),
    "civicclerk": ("civicclerk.com",),
    "civicplus": ("civicplus.com", "civicplus.pro"),
    "civicengage": (),
    "civicweb": ("civicweb.net",),
    "escribe": ("escribemeetings.com",),
    "municode": ("municodemeetings.com", "municode.com"),
    "proudcity": ("proudcity.com",),
    "wp_events": (),
    "berkeley": (),
    "chicago": (),
    "menlopark": (),
    "ross": (),
    "selfhosted": (),
    "visioninternet": (),
    "agendaonline": ("agendaonline.net",),
    "destiny": ("destinyhosted.com",),
    "boardbook": ("boardbook.org",),
}


@dataclass(frozen=True)
class Connector:
    key: str
    hosts: tuple[str, ...]

    def read(self, spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        good, bad = read_meetings(spark, f"{path}/{self.key}")
        return good.withColumn("vendor", F.lit(self.key)), bad.withColumn("vendor", F.lit(self.key))


def connector(key: str) -> Connector:
    if key not in PLATFORMS:
        raise KeyError(f"no connector for {key!r}; known: {', '.join(sorted(PLATFORMS))}")
    return Connector(key, PLATFORMS[key])


def url_verdict(url: Column, vendor: Column) -> Column:
    """store, warn or reject: a link that is no web address is rejected, one on an unexpected host is stored with a warning."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    known = F.create_map(*[x for k, hosts in PLATFORMS.items() if hosts for x in (F.lit(k), F.array(*[F.lit(h) for h in hosts]))])
    expected = F.try_element_at(known, vendor)
    fits = F.exists(expected, lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))
    return F.when(F.coalesce(host, F.lit("")) == "", "reject").when(expected.isNull() | fits, "store").otherwise("warn")
