"""Content-addressed web archive.

Payload bytes are stored once per verified SHA-256 digest, exact record headers are stored separately, and the original
records come back through joins of the two.

Defined cases: a null payload counts as empty; a null id or url leaves the header line out and comes back as null, an empty url
as an empty one; line breaks in a url are percent-encoded, and percent signs that would read as such (unescaped() gives the url
back); rows that repeat an id and a payload give one response, the others revisit it; an
empty table gives empty archives. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, save, spread_lookup, utf8

# The base32 alphabet of RFC 4648 and names of the WARC 1.1 format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


@dataclass
class Archive:
    """headers: a row per record with its exact header bytes and its payload's key; payloads: (digest, payload)."""

    headers: DataFrame
    payloads: DataFrame
    least_bytes: int = 0


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest: 20 bits (5 hex digits) make 4 characters."""
    digest = F.sha1(data)
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(31)
            out.append(F.substring(F.lit(BASE32), at + 1, F.lit(1)))
    return F.concat(*out)


def _escaped(url: Column) -> Column:
    """A url fit for a header line: line breaks, and percent signs that stand before what would read as one, are percent-encoded."""
    marked = F.regexp_replace(url, "%(?=(?:25)*(?:0[AaDd]))", "%25")
    return F.replace(F.replace(marked, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def unescaped(uri: Column) -> Column:
    """The url that a record was written for."""
    plain = F.regexp_replace(F.regexp_replace(uri, "%0D", "\r"), "%0A", "\n")
    return F.regexp_replace(plain, "%25(?=(?:25)*(?:0[AaDd]))", "%")


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(EOL))).otherwise(F.lit(""))


def write_archive(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> Archive:
    """Writes a record per row. Of records with equal payloads of at least least_bytes bytes, that with the largest id is
    the response and the others revisit it."""
    source = pages.select(
        F.col(page_id).cast("long").alias("id"), _escaped(F.col(url).cast("string")).alias("uri"), utf8(payload).alias("payload")
    )
    keyed = source.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    rows = save(
        keyed.select(
            F.monotonically_increasing_id().alias("uid"), "id", "uri", "digest", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1")
        ),
        "warc-rows",
    )
    payloads = save(keyed.groupBy("digest").agg(F.first("payload").alias("payload")), "warc-payloads")
    firsts = rows.filter(F.col("n") >= least_bytes).groupBy("digest").agg(
        F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", "uid", "uri")).alias("top"), F.count(F.lit(1)).alias("_count")
    )
    joined = lookup(rows, firsts, ["digest"], "_count", rows.count())
    revisits = F.col("top").isNotNull() & (F.col("top.uid") != F.col("uid"))
    name = lambda i, u: F.concat(F.lit("<urn:x-page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), u.cast("string"), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n").cast("string"), F.lit(EOL + EOL)
    )
    headers = joined.withColumn("revisit", revisits).withColumn("http", http).select(
        "uid",
        "digest",
        "http",
        F.concat(
            F.lit(f"WARC/1.1{EOL}WARC-Type: "),
            F.when(F.col("revisit"), "revisit").otherwise("response"),
            F.lit(EOL),
            _line("WARC-Record-ID", name(F.col("id"), F.col("uid"))),
            _line("WARC-Date", F.lit(date)),
            _line("WARC-Target-URI", F.col("uri")),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            F.when(
                F.col("revisit"),
                F.concat(
                    _line("WARC-Profile", F.lit(PROFILE)),
                    _line("WARC-Refers-To", name(F.col("top.id"), F.col("top.uid"))),
                    _line("WARC-Refers-To-Target-URI", F.col("top.uri")),
                ),
            ).otherwise(F.lit("")),
            _line("Content-Type", F.lit("application/http; msgtype=response")),
            _line("Content-Length", (F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))).cast("string")),
            F.lit(EOL),
        ).alias("header"),
    )
    return Archive(save(headers, "warc-headers"), payloads, least_bytes)


def read_records(archive: Archive) -> DataFrame:
    """The archive's records: uid, header, block (bytes after the header; a revisit's holds no payload)."""
    revisit = F.col("header").contains(f"{EOL}WARC-Type: revisit{EOL}")
    own = archive.headers.filter(~revisit)
    # a payload has one response, but those below least_bytes have as many as rows
    own = spread_lookup(own, archive.payloads, "digest", F.xxhash64("uid")) if archive.least_bytes else own.join(archive.payloads, "digest", "left")
    return own.select("uid", "header", F.concat(F.col("http").cast("binary"), F.col("payload")).alias("block")).unionByName(
        archive.headers.filter(revisit).select("uid", "header", F.col("http").cast("binary").alias("block"))
    )


def warc_bytes() -> Column:
    """A record of read_records() as it stands in a WARC file."""
    return F.concat(F.col("header").cast("binary"), F.col("block"), F.lit(EOL + EOL).cast("binary"))


def parse_records(records: DataFrame) -> DataFrame:
    """Reads fields and payloads out of records and verifies each payload that is there against its header's digest.

    Returns uid, page_id, uri, record_type, payload (null in revisits), payload_bytes, payload_digest, refers_to.
    """
    field = lambda k: F.when(F.col("header").contains(f"{EOL}{k}: "), F.regexp_extract("header", rf"\r\n{k}: ([^\r]*)\r\n", 1))
    page = lambda k: F.nullif(F.regexp_extract("header", rf"\r\n{k}: <urn:x-page:(-?\d*):", 1), F.lit("")).cast("long")
    cut = records.withColumn("_http", F.instr(F.decode(F.substring("block", 1, 256), "ISO-8859-1"), EOL + EOL) + 3)
    http = F.decode(F.expr("substring(block, 1, _http)"), "UTF-8")
    parsed = cut.select(
        "uid", page("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("uri"), field("WARC-Type").alias("record_type"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("named"), page("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(http, r"Content-Length: (\d+)", 1).cast("long").alias("announced"), F.expr("substring(block, _http + 1)").alias("rest"),
    )
    response = F.col("record_type") == "response"
    digest = F.when(response, base32_sha1(F.col("rest"))).otherwise(F.col("named"))
    size = F.when(response, F.octet_length("rest").cast("long")).otherwise(F.col("announced"))
    checked = parsed.withColumn("payload_digest", digest).withColumn("payload_bytes", size)
    wrong = (F.col("payload_digest") != F.col("named")) | (F.col("payload_bytes") != F.col("announced"))
    return checked.select(
        "uid", "page_id", "uri", "record_type", F.when(response, F.col("rest")).alias("payload"), "payload_bytes",
        F.when(wrong, F.raise_error(F.lit("a payload does not match its digest"))).otherwise(F.col("payload_digest")).alias("payload_digest"), "refers_to",
    )


def restore_payloads(parsed: DataFrame) -> DataFrame:
    """Adds to revisits the payload of the response that they name, by its digest."""
    held = parsed.filter("record_type = 'response'").groupBy("payload_digest").agg(F.first("payload").alias("held"))
    return spread_lookup(parsed, held, "payload_digest", F.xxhash64("uid")).withColumn("payload", F.coalesce("payload", "held")).select(*parsed.columns)
