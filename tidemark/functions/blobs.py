"""Byte-level columns: image types, digests and the outcomes of fetches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes (hex) and the type they mean.
MAGIC = (
    ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"),
    ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"),
)
INLINE = ("image/png", "image/jpeg", "image/gif", "image/webp", "image/bmp", "image/tiff")


def sniff_mime(data: Column) -> Column:
    """The image type that the bytes are, or null."""
    head = F.hex(F.substring(data, 1, 12))
    webp = (F.substring(head, 1, 8) == "52494646") & (F.substring(head, 17, 8) == "57454250")
    return F.coalesce(*(F.when(head.startswith(m), t) for m, t in MAGIC), F.when(webp, "image/webp"))


def resolve_mime(declared: Column, data: Column) -> Column:
    """A declared image type verbatim, else the sniffed one, else null."""
    trusted = F.trim(F.split_part(declared, F.lit(";"), F.lit(1))).startswith("image/")
    return F.coalesce(F.when(trusted, declared), sniff_mime(data))


def serving_type(data: Column) -> Column:
    """struct(mime, inline) from the bytes alone."""
    mime = sniff_mime(data)
    inline = F.coalesce(mime.isin(*INLINE), F.lit(False))
    return F.struct(F.when(inline, mime).otherwise("application/octet-stream").alias("mime"), inline.alias("inline"))


def digest(data: Column) -> Column:
    return F.sha2(data, 256)


def shard(hex_digest: Column) -> Column:
    return F.concat_ws("/", F.substring(hex_digest, 1, 2), F.substring(hex_digest, 3, 2))


def classify_fetch(http_status: Column, body: Column, transport_error: Column, marker: str = "postBody") -> Column:
    """struct(status, error) of a landed page."""
    http = F.coalesce(http_status.cast("string"), F.lit("?"))
    has_body = F.coalesce(F.contains(body, F.lit(marker)), F.lit(False))
    challenge = F.coalesce(F.contains(body, F.lit("cf_chl")) | F.contains(body, F.lit("Just a moment")), F.lit(False))
    said = F.concat(F.lit("http "), http, F.lit(f", no {marker} in "), F.coalesce(F.length(body), F.lit(0)).cast("string"), F.lit(" bytes"))
    status = (
        F.when(transport_error.isNotNull(), "error").when(http_status == 404, "missing").when((http_status == 200) & has_body, "ok").otherwise("error")
    )
    error = F.when(transport_error.isNotNull(), transport_error).when(
        status == "error", F.when(challenge, "challenge page: this exit is being blocked").otherwise(said)
    )
    return F.struct(status.alias("status"), error.alias("error"))


def classify_capture(verdict: Column, fault: Column, http_status: Column, data: Column, declared: Column) -> Column:
    """struct(status, sha256, mime, bytes) of an image attempt.

    `verdict`: ok, blocked or unresolved; `fault`: null, too_large, blocked or any transport fault.
    """
    mime = resolve_mime(declared, data)
    status = (
        F.when((verdict == "blocked") | (verdict.eqNullSafe("ok") & fault.eqNullSafe("blocked")), "dead")
        .when((verdict == "unresolved") | fault.isNotNull(), "error")
        .when(http_status.isin(404, 410), "dead")
        .when(~http_status.eqNullSafe(200) | (F.coalesce(F.octet_length(data), F.lit(0)) == 0), "error")
        .when(mime.isNull(), "dead")
        .otherwise("ok")
    )
    ok = status == "ok"
    return F.struct(
        status.alias("status"), F.when(ok, digest(data)).alias("sha256"), F.when(ok, mime).alias("mime"),
        F.when(ok, F.octet_length(data)).otherwise(0).cast("bigint").alias("bytes"),
    )


def classify_probe(verdict: Column, fault: Column, http_status: Column, data: Column, declared: Column) -> Column:
    """Host verdict from one probe."""
    image = resolve_mime(declared, data).isNotNull() & (F.octet_length(data) > 0)
    return (
        F.when(verdict == "blocked", "blocked")
        .when(verdict == "unresolved", "nxdomain")
        .when(fault == "blocked", "blocked")
        .when(fault == "too_large", "alive")
        .when(fault.isNotNull(), "unreachable")
        .when((http_status == 200) & image, "alive")
        .when(http_status.isin(404, 410), "gone")
        .when(http_status.between(400, 599), "http-error")
        .otherwise("not-image")
    )


#: Verdicts that allow a host without any capture to be written off.
WRITE_OFF = ("nxdomain", "blocked", "unreachable", "gone", "not-image")


def image_state(status: Column, attempts: Column, sha256: Column, withheld_at: Column, ceiling: int = 5) -> Column:
    """withheld > ok > dead > exhausted > waiting; the first that matches."""
    return (
        F.when(withheld_at.isNotNull(), "withheld")
        .when((status == "ok") & sha256.isNotNull(), "ok")
        .when(status == "dead", "dead")
        .when((status == "error") & (attempts >= ceiling), "exhausted")
        .otherwise("waiting")
    )
