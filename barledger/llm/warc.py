"""A content-addressed WARC archive as two tables.

`payloads` holds every distinct payload once, under its SHA-256, with its length and the
SHA-1 that WARC headers carry. `records` holds each record's exact header bytes and the
address of its payload. The address is verified twice: when equal addresses are merged,
length and SHA-1 must agree, and when the archive is read, the stored bytes are hashed
again. A join on the address gives back original records, byte for byte.

Everything is built-in expressions. Payload bytes are shuffled once, combined per task
before that, so a payload that a third of all pages share crosses the network once a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barledger.llm.tables import published

EOL = "\r\n"
#: Fixed values of the base32 alphabets: RFC 4648, and the digits that conv() writes.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits, taken 60 bits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def payload_store(bodies: DataFrame) -> DataFrame:
    """bodies(record_id, address, payload) -> address, payload, payload_bytes, sha1, keeper.

    One row per address; keeper is its largest record_id (null if all are null). Stops
    when two payloads with one address differ in length or SHA-1.
    """
    rows = bodies.select("record_id", "address", "payload", F.length("payload").cast("long").alias("payload_bytes"),
                         base32_sha1(F.col("payload")).alias("sha1"))
    merged = rows.groupBy("address").agg(
        F.first("payload").alias("payload"), F.min("payload_bytes").alias("payload_bytes"), F.max("payload_bytes").alias("longest"),
        F.min("sha1").alias("sha1"), F.max("sha1").alias("other"), F.max("record_id").alias("keeper"))
    same = (F.col("payload_bytes") == F.col("longest")) & (F.col("sha1") == F.col("other"))
    checked = F.when(same, F.col("payload_bytes")).otherwise(
        F.raise_error(F.concat(F.lit("different payloads under "), F.hex("address"))).cast("long"))
    return merged.select("address", "payload", checked.alias("payload_bytes"), "sha1", "keeper")


def _header(fields: list[tuple[str, Column]]) -> Column:
    """A WARC header block; a field whose value is null is left out."""
    lines = [F.lit("WARC/1.1" + EOL)]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit("")) for name, value in fields]
    return F.concat(*lines, F.lit(EOL))


def record_uri(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), record_id.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """pages(page_id, url, html) -> the published tables (payloads, records).

    A page's payload is its html in UTF-8 (null: no bytes). Of records whose equal payload
    has at least `least_bytes` bytes, that with the largest page_id is the response and
    the others are revisits that refer to it; all smaller ones are responses. A null
    page_id always makes a response and is referred to by nobody. Rows that repeat the
    largest page_id are responses all. A null url leaves out the target field, line
    breaks in a url become %0A and %0D. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    bodies = pages.select(
        F.col("page_id").cast("long").alias("record_id"), F.col("url").cast("string"), payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("address"))
    payloads = published(payload_store(bodies), "warc-payloads")
    headed = bodies.select("record_id", "url", "address").join(
        payloads.select("address", "payload_bytes", "sha1", "keeper"), "address")
    revisit = F.col("record_id").isNotNull() & (F.col("record_id") < F.col("keeper")) & (F.col("payload_bytes") >= least_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK" + EOL + "Content-Type: text/html; charset=utf-8" + EOL + "Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(EOL + EOL))
    block = F.length(F.col("http").cast("binary")) + F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes"))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = _header([
        ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        ("WARC-Record-ID", record_uri(F.col("record_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Refers-To", F.when(F.col("revisit"), record_uri(F.col("keeper")))),
        ("WARC-Profile", F.when(F.col("revisit"), F.lit(REVISIT_PROFILE))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", block.cast("string")),
    ])
    records = headed.withColumn("revisit", revisit).withColumn("http", http).select(
        "record_id", "address", header.cast("binary").alias("header"), F.col("http").cast("binary").alias("http"))
    return payloads, published(records, "warc-records")


def verified_payloads(payloads: DataFrame) -> DataFrame:
    """The payload table as read back: digests and lengths from the stored bytes.

    Stops when the bytes do not hash to the address they are stored under.
    """
    right = F.unhex(F.sha2("payload", 256)) == F.col("address")
    sound = F.when(right, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload under "), F.hex("address"))).cast("binary"))
    return payloads.select("address", sound.alias("payload")).select(
        "address", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def _field(name: str) -> Column:
    text = F.col("header").cast("string")
    return F.nullif(F.regexp_extract(text, rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def read_archive(payloads: DataFrame, records: DataFrame) -> DataFrame:
    """One row per record: what its stored header says, and its verified payload's digest."""
    facts = verified_payloads(payloads).drop("payload")
    target = F.regexp_extract(_field("WARC-Refers-To"), r"^<urn:record:(-?\d+)>$", 1)
    return records.select("record_id", "address", _field("WARC-Type").alias("record_type"),
                          target.cast("long").alias("refers_to"), _field("WARC-Payload-Digest").alias("said")).join(facts, "address").select(
        "record_id", "payload_bytes",
        F.when(F.col("said") == F.concat(F.lit("sha1:"), "payload_digest"), F.col("payload_digest")).otherwise(
            F.raise_error(F.concat(F.lit("header and payload disagree in record "), F.col("record_id").cast("string")))).alias("payload_digest"),
        "record_type", "refers_to")


def original_records(payloads: DataFrame, records: DataFrame) -> DataFrame:
    """record_id, warc: every record's exact bytes, joined from header and payload.

    A revisit's block is its HTTP header alone.
    """
    body = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.join(verified_payloads(payloads).select("address", "payload"), "address").select(
        "record_id", F.concat("header", "http", body, F.lit((EOL + EOL).encode())).alias("warc"))


def split_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw(record_id, warc): foreign HTTP response records -> the published (payloads, records).

    Header bytes up to the end of the HTTP header are kept as they are; the rest but the
    closing two line ends is the payload. Rows without both headers stop the job.
    """
    latin = raw.select("record_id", "warc", F.decode("warc", "ISO-8859-1").alias("text"))
    first = F.position(F.lit(EOL + EOL), F.col("text"))
    second = F.position(F.lit(EOL + EOL), F.col("text"), first + 4)
    parts = latin.withColumn("first", first).withColumn("second", F.when(second > 0, second).otherwise(
        F.raise_error(F.lit("a record without two headers")).cast("int")))
    bodies = parts.select(
        F.col("record_id").cast("long"),
        F.expr("substring(warc, 1, first + 3)").alias("header"), F.expr("substring(warc, first + 4, second - first)").alias("http"),
        F.expr("substring(warc, second + 4, length(warc) - second - 7)").alias("payload"))
    bodies = bodies.withColumn("address", F.unhex(F.sha2("payload", 256)))
    return published(payload_store(bodies), "warc-payloads"), published(bodies.select("record_id", "address", "header", "http"), "warc-records")
