"""URL columns: host, scheme and public routability."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import page_formats as formats

#: IPv4 blocks that are not publicly routable, multicast included.
NON_PUBLIC_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
#: Single addresses inside those blocks that are public after all.
PUBLIC_V4 = ("192.0.0.9", "192.0.0.10")


def normalise_url(url: Column) -> Column:
    """Protocol-relative sources mean https."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def url_host(url: Column) -> Column:
    """Lower-case host without user-info and port; null without an authority."""
    authority = F.nullif(F.regexp_extract(url, formats.AUTHORITY, 1), F.lit(""))
    return F.lower(F.split_part(F.regexp_replace(authority, "^.*@", ""), F.lit(":"), F.lit(1)))


def _v4_number(host: Column) -> Column:
    part = lambda i: F.split_part(host, F.lit("."), F.lit(i)).cast("bigint")
    return part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)


def _v4_private(number: Column) -> Column:
    blocks = [ipaddress.ip_network(b) for b in NON_PUBLIC_V4]
    private = F.lit(False)
    for block in blocks:
        private = private | number.between(int(block[0]), int(block[-1]))
    return private & ~number.isin(*(int(ipaddress.ip_address(a)) for a in PUBLIC_V4))


@F.pandas_udf(T.BooleanType())
def _v6_public(host: pd.Series) -> pd.Series:
    def one(h: str | None) -> bool:
        try:
            a = ipaddress.IPv6Address(h or "")
        except ValueError:
            return False
        return a.is_global and not a.is_multicast and not a.is_unspecified

    return host.map(one).astype(bool)


def classify_url_table(rows: DataFrame, url_col: str = "source_url", out: str = "verdict") -> DataFrame:
    """`rows` with 'ok' or 'blocked'; no name is resolved.

    Blocked: another scheme than http(s), no host, an address that is not publicly routable, or
    digits and dots that are no canonical IPv4 address. Only bracketed literals reach Python.
    """
    url = normalise_url(F.col(url_col))
    web = F.coalesce(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), F.lit(False))
    octet = r"(?:0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    literal = F.coalesce(F.contains(F.regexp_extract(url, formats.AUTHORITY, 1), F.lit("[")), F.lit(False))
    # Step by step, so that each part is evaluated once.
    names = rows.where(~literal).withColumn("__web", web).withColumn("__host", F.coalesce(url_host(url), F.lit("")))
    host = F.col("__host")
    numbers = names.withColumn("__ip", F.when(host.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), _v4_number(host)))
    digits = host.rlike(r"^[0-9.]*[0-9][0-9.]*$")
    bad = ~F.col("__web") | (host == "") | (digits & F.col("__ip").isNull()) | F.coalesce(_v4_private(F.col("__ip")), F.lit(False))
    plain = numbers.withColumn(out, F.when(bad, "blocked").otherwise("ok")).drop("__web", "__host", "__ip")
    bracket = F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?\[([^\]/?#]*)\](?::[0-9]*)?(?:[/?#]|$)", 1)
    bracketed = rows.where(literal).withColumn(out, F.when(web & _v6_public(bracket), "ok").otherwise("blocked"))
    return plain.unionByName(bracketed)




def audit_private_blobs(images: DataFrame) -> DataFrame:
    """Captured rows whose URL is not http(s) or names a private address."""
    url = F.col("source_url")
    return images.where((F.col("status") == "ok") & (~url.rlike("(?i)^https?://") | url.rlike(formats.PRIVATE_URL)))
