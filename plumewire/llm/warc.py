"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Every derivative refers to its response by record id and keeps the response's target, date, headers and payload
digest.  Record ids follow from the source's id and the derivative's type, so a task that runs again makes the
same records.  A record never leaves its row: all steps are column expressions, but for the character references
outside ``REFERENCES``, which Python decodes.

Defined results: a null page has an empty payload, an empty conversion and digests of the empty string; a null
url is an empty target; a null page_id counts as an empty id; repeated rows give repeated records; an empty
table gives an empty result; a very long page is converted whole, in time proportional to its length whatever its
markup; other columns are ignored.  A "<" opens a tag only before a letter, "/", "!" or "?".  A comment, a silent element
or a tag without an end goes on to the end of the page, as in a browser.  A character reference ends with a semicolon;
what looks like one and is none stays as it is.
"""

from __future__ import annotations

import gzip
import html as entities
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.pages import decode as decode_page
from .common import batch, bound_batches, lean

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: The usual character references, decoded in this order.
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
#: Elements whose content is not text.
SILENT = ("script", "style", "noscript", "template", "title")
BREAKS = "br|/p|/div|/li|/h[1-6]|/tr|/ul|/ol|/table|/article|/section|/header|/footer|/nav|/aside"
#: (pattern, replacement) in order: comments and silent elements, each up to its own end; block ends; other tags.  Names
#: count whole.  Each pattern goes on to the end of the text where there is no end, so that no part is read twice.
_TAG_END = r"[^>]*+(?:>|\z)"
_ELEMENT = r"<{0}(?=[\s/>])[^>]*+(?:>.*?(?:</{0}\s*+>|\z)|\z)"
TAGS = [
    (r"(?is)<!--.*?(?:-->|\z)|" + "|".join(_ELEMENT.format(n) for n in SILENT), " "),
    (rf"(?i)<({BREAKS})(?=[\s/>]){_TAG_END}", "\n"),
    (rf"<(?=[a-zA-Z/!?]){_TAG_END}", " "),
]
#: The first title; the opening tags of links.
_TITLE = r"(?is)<title(?=[\s/>])[^>]*+(?:>(.*?)(?:</title|\z)|\z)"
_LINK = rf"(?i)<a\s{_TAG_END}"
#: A reference outside REFERENCES (Java); every reference (Python).
_OTHER = "&(?!(?:" + "|".join(name[1:] for name, _ in REFERENCES) + "))(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
_REFERENCE = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
SPACING = [(r"[ \t\r\f\x0B]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]


def record_id(source: Column, kind: str) -> Column:
    """<urn:uuid:...> that follows from the source's id and a type."""
    h = F.md5(F.concat(F.lit(f"{kind}|"), source))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)), F.lit(">"))


def digest(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table of pages, which has neither dates nor headers: record_id, target_uri, warc_date (of
    the crawl, given), headers (status, type and length as they follow from the page), body.  Records of WARC files come
    with their own (``responses_of``)."""
    body = F.coalesce("html", F.lit(""))
    source = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"))
    return pages.select(record_id(source, "response").alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("headers"), body.alias("body"))


#: What every record begins with; a record of a longer declared length counts as broken.
_MAGIC = b"WARC/1."
LONGEST = 1 << 30


def _head(raw: bytes) -> tuple[list[tuple[str, str]], int] | None:
    """Fields (names in lower case, in order, repeated ones too) and length of a record's head; None if it isn't whole or
    none.  A line that begins with white space goes on with the line before."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not re.match(rb"WARC/1\.[01]\r\n", raw):
        return None
    fields: list[tuple[str, str]] = []
    for line in raw[:end].decode("utf-8", "replace").split(CRLF)[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip().lower(), value.strip()))
    return fields, end + 4


def records(pieces: list[bytes], last: bool) -> tuple[list[tuple[list, bytes, bool]], list[bytes]]:
    """Records (fields, block, complete) of the pieces of a file between one ``WARC/1.`` and the next, and the pieces of one
    that isn't whole yet.  A block has its declared length, whatever is in it; if what follows is no end of a record, the
    length is broken: the block is that of the first piece, and reading goes on with the next one."""
    out, at = [], 0
    while at < len(pieces):
        raw, used = _MAGIC + pieces[at], 1
        while (found := _head(raw)) is None and re.match(rb"WARC/1\.[01]\r\n", raw) and at + used < len(pieces):
            raw += _MAGIC + pieces[at + used]
            used += 1
        if found is None:
            if not last and at + used == len(pieces):
                break
            out.append(([], pieces[at], False))  # no record's head
            at += 1
            continue
        fields, start = found
        sizes = [v for k, v in fields if k == "content-length" and re.fullmatch("[0-9]{1,18}", v)]
        size = int(sizes[0]) if sizes else -1
        parts, length = [raw], len(raw)
        while 0 <= size <= LONGEST and length < start + size and at + used < len(pieces):
            parts.append(_MAGIC + pieces[at + used])
            length += len(parts[-1])
            used += 1
        if not last and at + used == len(pieces) and 0 <= size <= LONGEST and length < start + size:
            break
        raw = b"".join(parts)
        block, rest = raw[start : start + max(size, 0)], raw[start + max(size, 0) :]
        if 0 <= size <= LONGEST and len(block) == size and not rest.strip(b"\r\n"):
            out.append((fields, block, True))
            at += used
        else:
            whole, used = _head(_MAGIC + pieces[at]), 1
            if whole is None:  # the head itself holds the mark
                whole, used = found, max(1, used)
            own = (_MAGIC + pieces[at])[whole[1] :] if used == 1 else raw[start:]
            out.append((fields, own.removesuffix(b"\r\n\r\n"), False))
            at += used
    return out, pieces[at:]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC/1.0 and 1.1 files, plain or compressed: fields (name in lower case and value, in order, repeated
    ones too), block (bytes) and complete (the block has its declared length).  Spark reads the files up to each
    ``WARC/1.``, a plain file in splits and a compressed one from end to end by one task, never held whole; a task puts
    records together by their lengths.  In a plain file that is split inside a block, a record in that block counts as one.

    Defined results: a record without a usable length is not complete and ends before the next one; bytes that are no
    record come as one without fields; an empty file has no record; a field without a value is an empty string."""
    found = spark.read.option("lineSep", _MAGIC.decode()).text(path)
    rows = found.select(F.concat_ws("|", "_metadata.file_path", F.col("_metadata.file_block_start").cast("string")).alias("place"), F.col("value").cast("binary").alias("piece"))
    pair = pa.struct([("name", pa.string()), ("value", pa.string())])
    schema = pa.schema([("fields", pa.list_(pair)), ("block", pa.binary()), ("complete", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            return batch(schema, [[{"name": k, "value": v} for k, v in f] for f, _, _ in rows], [x for _, x, _ in rows], [c for _, _, c in rows])

        now, held = None, []
        for b in batches:
            for place, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if place != now:
                    if held:
                        yield made(records(held, True)[0])
                    now, held = place, []
                    if not piece.strip():  # before a file's first record
                        continue
                held.append(piece)
            done, held = records(held, False)
            if done:
                yield made(done)
        if held:
            yield made(records(held, True)[0])

    bound_batches(spark)
    return rows.mapInArrow(lean(run), "fields array<struct<name: string, value: string>>, block binary, complete boolean")


def field(name: str) -> Column:
    """The first value of a field of ``read_warc``'s records; null without one."""
    return F.get(F.filter("fields", lambda f: f["name"] == name), 0)["value"]


def responses_of(records: DataFrame) -> DataFrame:
    """The complete HTTP responses among ``read_warc``'s records, as ``responses`` has them: their own ids, targets,
    dates and headers; the body by its charset.  Repeated header lines of one name stay; of a repeated field the first
    value counts.  A response without an id has a null one, without a target an empty one, without a date a null one."""
    r = records.where((field("warc-type") == "response") & F.col("complete"))
    text = F.decode("block", "ISO-8859-1")  # a character a byte
    head = F.substring_index(text, CRLF * 2, 1)
    body = F.substring("block", F.length("head") + 5, F.greatest(F.lit(0), F.octet_length("block") - F.length("head") - 4))
    r = r.select(field("warc-record-id").alias("record_id"), field("warc-target-uri").alias("target_uri"), field("warc-date").alias("warc_date"), head.alias("head"), "block")
    return r.select("record_id", F.coalesce("target_uri", F.lit("")).alias("target_uri"), "warc_date", F.col("head").alias("headers"), F.coalesce(decode_page(body, F.col("head")), F.lit("")).alias("body"))


def _character(m: re.Match) -> str:
    name = m[0][1:]
    found = entities.unescape(m[0]) if name[0] == "#" else html5.get(name, m[0])
    return " " if found == "\xa0" else found


def decode(text: str) -> str:
    """All named and numeric references; a non-breaking one is a space, as in REFERENCES."""
    return _REFERENCE.sub(_character, text)


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(decode, na_action="ignore")


def plain_text(records: DataFrame) -> DataFrame:
    """The records with a column ``text``: the visible text, a line for each block.  Only texts with a reference
    outside REFERENCES go to Python."""
    text = F.col("body")
    for pattern, to in TAGS:
        text = F.regexp_replace(text, pattern, to)
    held = records.withColumn("bare", text)
    held = held.withColumn("rest", _decoded(F.when(F.col("bare").rlike(_OTHER), F.col("bare"))))
    text = F.col("bare")
    for name, to in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(to))
    text = F.coalesce("rest", text)
    for pattern, to in SPACING:
        text = F.regexp_replace(text, pattern, to)
    return held.withColumn("text", text).drop("bare", "rest")


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: warc_type, record_id, refers_to, target_uri, warc_date, content_type, source_headers
    (the response's HTTP headers), block, content_length, block_digest, payload_digest (of the response)."""
    bound_batches(records.sparkSession)
    records = plain_text(records)
    payload = digest(F.col("body"))
    title = F.regexp_extract("body", _TITLE, 1)
    links = F.size(F.filter(F.regexp_extract_all("body", F.lit(_LINK), F.lit(0)), lambda tag: tag.rlike(r"(?i)href\s*=")))
    sources = F.concat_ws(CRLF, F.transform(F.filter(F.split("headers", CRLF), lambda x: x.contains(": ")), lambda x: F.concat(F.lit("source-"), x)))
    about = F.concat_ws(
        CRLF, F.concat(F.lit("refers-to: "), "record_id"), F.concat(F.lit("payload-digest: "), payload), F.concat(F.lit("title: "), F.trim(F.regexp_replace(title, r"\s+", " "))), F.concat(F.lit("outlinks: "), links.cast("string")), sources
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    both = records.select("record_id", "target_uri", "warc_date", F.col("headers").alias("source_headers"), payload.alias("payload_digest"), F.explode(kinds).alias("d"))
    own = F.when(F.col("d.warc_type") == "metadata", record_id(F.col("record_id"), "metadata")).otherwise(record_id(F.col("record_id"), "conversion"))
    return both.select(
        "d.warc_type", own.alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "d.content_type", "source_headers", "d.block", F.octet_length("d.block").cast("long").alias("content_length"), digest(F.col("d.block")).alias("block_digest"), "payload_digest"
    )


_FIELDS = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]


#: A source header line in the derivative's own header.
_SOURCE = "X-Source-"


def serialise(derived: DataFrame) -> DataFrame:
    """One text a record in the WARC/1.0 form; the texts put together are a WARC file.  The source's headers are lines of
    the record's header, its status line among them."""
    lines = F.transform(F.split("source_headers", CRLF), lambda x: F.concat(F.lit(_SOURCE), F.when(x.contains(": "), x).otherwise(F.concat(F.lit("Status: "), x))))
    head = F.concat_ws(CRLF, F.lit("WARC/1.0"), *(F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in _FIELDS), lines)
    return derived.select(F.concat(head, F.lit(CRLF * 2), "block", F.lit(CRLF * 2)).alias("record"))


def parse(records: DataFrame) -> DataFrame:
    """The inverse of ``serialise`` on a column ``record``."""
    at = F.locate(CRLF * 2, "record")
    every = F.split(F.substring("record", F.lit(1), at - 1), CRLF)
    lines = F.slice(every, F.lit(2), F.size(every))
    own = F.filter(lines, lambda x: ~x.startswith(_SOURCE))
    fields = F.map_from_entries(F.transform(own, lambda x: F.struct(F.substring_index(x, ": ", 1), F.substring(x, F.locate(": ", x) + 2, F.length(x)))))
    source = F.transform(F.filter(lines, lambda x: x.startswith(_SOURCE)), lambda x: F.regexp_replace(F.substring(x, F.lit(len(_SOURCE) + 1), F.length(x)), "^Status: ", ""))
    block = F.substring("record", at + 4, F.length("record") - at - 7)
    held = records.select(fields.alias("f"), F.array_join(source, CRLF).alias("source_headers"), block.alias("block"))
    return held.select(*((F.col("f")[name].cast("long") if c == "content_length" else F.col("f")[name]).alias(c) for name, c in _FIELDS), "source_headers", "block")


#: An empty member of a gzip file, which stands between records: Spark's text writer ends each row with it.
_EMPTY = gzip.compress(b"", mtime=0)


def write_warc(derived: DataFrame, path: str) -> None:
    """WARC files, one a partition, with a gzip member for each record, so that a reader can begin at any of them."""
    bound_batches(derived.sparkSession)
    schema = pa.schema([("member", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, [gzip.compress(x, mtime=0) for x in b.column(0).to_pylist()])

    members = serialise(derived).select(F.col("record").cast("binary").alias("record")).mapInArrow(lean(run), "member binary")
    members.select(F.col("member").cast("string").alias("member")).write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("ISO-8859-1")).text(path)
    spark = derived.sparkSession  # the writer knows no such name; a step for each file
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        if (name := status.getPath().getName()).endswith(".txt"):
            files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz"))
