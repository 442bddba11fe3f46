"""Derivatives of WARC responses: a metadata record and a plain-text conversion record for each.

A record is a row of ``record_type, record_id, refers_to, target_uri, warc_date, headers, block``: the
headers by name and value in order, the block as bytes. ``derive`` makes from each response

* a conversion record (text/plain) that refers to the response, where its payload is HTML or plain text;
* a metadata record (application/warc-fields) that refers to the response too: all of the response's
  own headers (``Source-...``), those of HTTP (``HTTP-Header-...``), whether the payload has the digest
  that its header states, the title, the outlinks as written, and the conversion's identifier.

Identifiers are named by what they identify (a hash of the source's), so a task that runs again after a
lost executor makes the same ones and links never break. Every row is handled by itself: nothing is
shuffled, and a task holds one Arrow batch.

Text: comments, scripts, styles, frames and the title are left out; block elements and ``<br>`` end a line,
other tags go without a trace; entities are decoded; white space is one space, lines have none at either
end, empty lines go. The scan is one regular expression without backtracking, linear in the page. A
``>`` inside a quoted value doesn't end a tag; what is not closed reaches to the end.

Defined cases: a null or empty page is a response with an empty payload, which has an empty conversion; a
null address or id counts as empty, and an empty address gives no ``WARC-Target-URI``; repeated rows give
repeated records with equal identifiers; other columns are kept in ``derive`` if named in ``keep`` and
ignored otherwise; an empty table gives no rows. A block that is no HTTP message is all payload, taken
as HTML. Chunked, gzip and deflate bodies are undone; where that fails, the bytes count as they are.
An unknown charset counts as UTF-8 and faulty bytes become U+FFFD. Payloads of other kinds, such as
images, get a metadata record only. New lines and controls in headers become spaces.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = "array<struct<name:string,value:string>>"
RECORD = f"record_type string, record_id string, refers_to string, target_uri string, warc_date string, headers {HEADERS}, block binary"
#: The date of records made from tables that have none.
UNDATED = "1970-01-01T00:00:00Z"
#: Between the fields of a record's header, and after each record.
LINE, RECORD_END = "\r\n", "\r\n\r\n"
VERSION = "WARC/1.1"

# Media types that have text; elements that end a line; elements whose content is no text.
HTML_TYPES = ("", "text/html", "application/xhtml+xml")
PLAIN_TYPES = ("text/plain",)
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = "script style iframe noembed noframes title"

_WS = r"[ \t\n\f\r]"
_REST = rf"""(?:[^>=]++|={_WS}*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|))*+(?:>|\Z)"""
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{RAW.replace(' ', '|')})(?=[ \t\n\f\r/>]){_REST}(?P<inner>.*?)(?:</(?P=raw)(?=[ \t\n\f\r/>])[^>]*+(?:>|\Z)|\Z)"
    rf"|<(?P<slash>/?)(?P<tag>[a-z][^ \t\n\f\r/>]*+)(?P<rest>{_REST})|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I | re.A,
)
HREF = re.compile(rf"""(?:^|[ \t\n\f\r/"'])href{_WS}*+={_WS}*+(?:"([^"]*+)"?|'([^']*+)'?|([^ \t\n\f\r>]++))""", re.I | re.A)
SPACES, BLANKS, HUGE = re.compile(rf"{_WS}+"), re.compile(" {2,}"), re.compile(r"&#[0-9]{1000,};?")
META_CHARSET = re.compile(rb"""<meta[^>]{0,500}?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)
CHARSET = re.compile(r"""charset\s*=\s*["']?\s*([^\s"';]+)""", re.I)


def unescape(text: str) -> str:
    """Entities decoded; numbers beyond any character, however long, become U+FFFD."""
    return html.unescape(HUGE.sub("�", text)) if "&" in text else text


def text_of_html(page: str) -> tuple[str, str, list[str]]:
    """Text, title and outlinks of a page."""
    parts: list[str] = []
    title, links, at = None, [], 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(unescape(SPACES.sub(" ", page[at : m.start()])))
        at = m.end()
        tag = m["tag"]
        if tag:
            tag = tag.lower()
            if tag in BREAKS:
                parts.append("\n")
            elif tag == "a" and not m["slash"] and (href := HREF.search(m["rest"])):
                links.append(unescape(next((x for x in href.groups() if x is not None), "")).strip(" \t\n\f\r"))
        elif m["raw"] and m["raw"].lower() == "title":
            parts.append("\n")
            if title is None:
                title = SPACES.sub(" ", unescape(m["inner"])).strip(" ")
    if at < len(page):
        parts.append(unescape(SPACES.sub(" ", page[at:])))
    lines = (x.strip(" ") for x in BLANKS.sub(" ", "".join(parts)).split("\n"))
    return "\n".join(x for x in lines if x), title or "", links


def lines_of(head: bytes) -> list[str]:
    """The lines of a header, folded ones joined."""
    return re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")))


def fields_of(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values of a header's lines."""
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response; all is body where the block is none."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    cut = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[: cut.start()], block[cut.end() :]) if cut else (block, b"")
    first, *rest = lines_of(head)
    return first, fields_of(rest), body


def unchunked(body: bytes) -> bytes:
    """A chunked body as one; ValueError if it isn't one."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n < 0 or end + 2 + n > len(body):
            raise ValueError("chunk beyond the end")
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def entity(body: bytes, headers: dict[str, str]) -> tuple[bytes, bytes]:
    """The payload without its transfer coding, and also without its content coding."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        try:
            body = unchunked(body)
        except ValueError:  # many crawlers store the body unchunked under the header as sent
            pass
    plain, coding = body, headers.get("content-encoding", "").lower().strip()
    windows = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ())
    for bits in windows:
        try:
            return body, zlib.decompress(body, bits)
        except zlib.error:
            continue
    return body, plain


def decoded(body: bytes, stated: str) -> tuple[str, str]:
    """Text and the charset that was used: of a mark at the start, the header, the page's first 1024 bytes, else UTF-8."""
    found = META_CHARSET.search(body[:1024])
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    name = next((c for b, c in marks if body.startswith(b)), "") or stated or (found[1].decode() if found else "") or "utf-8"
    name = {"iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252"}.get(name.lower(), name.lower())
    try:
        return body.decode(name, "replace").encode("utf-8", "replace").decode("utf-8"), name
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace"), "utf-8"


def digest_check(stated: str, candidates: Sequence[bytes]) -> str:
    """``match``, ``mismatch``, ``absent`` or ``unknown`` (another algorithm); values may be hexadecimal or base 32."""
    algorithm, _, value = stated.partition(":")
    name = algorithm.lower().replace("-", "")
    if not stated:
        return "absent"
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return "unknown"
    digests = [hashlib.new(name, x, usedforsecurity=False).digest() for x in candidates]
    return "match" if any(value.lower() == d.hex() or value.upper().rstrip("=") == base64.b32encode(d).decode().rstrip("=") for d in digests) else "mismatch"


def describe(block: bytes, stated_digest: str) -> dict:
    """What the derived records say of a response's block; ``text`` is None if the payload isn't text."""
    status, headers, body = http_parts(block)
    by_name = {k.lower(): v for k, v in reversed(headers)}
    stored, plain = entity(body, by_name)
    kind = by_name.get("content-type", "")
    media = kind.split(";")[0].strip().lower()
    text, title, links, charset = None, "", [], ""
    if media in HTML_TYPES or media in PLAIN_TYPES:
        stated = CHARSET.search(kind)
        text, charset = decoded(plain, stated[1] if stated else "")
        if media in HTML_TYPES:
            text, title, links = text_of_html(text)
    return {"status": status, "http": [{"name": k, "value": v} for k, v in headers], "text": text, "title": title, "links": links, "charset": charset,
        "digest_check": digest_check(stated_digest, (stored,) if stored is body else (stored, body))}


DESCRIBED = f"status string, http {HEADERS}, text string, title string, links array<string>, charset string, digest_check string"


def identifier(name: Column) -> Column:
    """A version 5 style identifier named by a text."""
    h = F.sha1(name)
    part = lambda at, n: F.substring(h, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def one_line(value: Column) -> Column:
    """A header's value: each run of controls is a space."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x1F\x7F]+", " ")


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def _headers(*pairs: tuple[str, Column | str]) -> Column:
    """Headers in order; null ones are left out."""
    made = [F.struct(F.lit(n).alias("name"), (F.lit(v) if isinstance(v, str) else v).alias("value")) for n, v in pairs]
    return F.filter(F.array(*made), lambda x: x["value"].isNotNull())


def header(name: str, headers: str = "headers") -> Column:
    """The first header of a name in any case, or null."""
    return F.get(F.filter(headers, lambda x: F.lower(x["name"]) == name.lower()), 0)["value"]


def _target(uri: Column) -> Column:
    return F.when(uri != "", uri)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", warc_date: str = UNDATED) -> DataFrame:
    """Pages as response records, with their id."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    body = text(html_col).cast("binary")
    rows = pages.select(F.col(id_col).alias("key"), one_line(text(url_col)).alias("target_uri"), body.alias("body"), digest(body).alias("payload_digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(RECORD_END)).cast("binary")
    rows = rows.withColumn("block", F.concat(http, F.col("body")))
    rows = rows.withColumn("record_id", identifier(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("key").cast("string"), F.lit("")), "payload_digest", "target_uri")))
    headers = _headers(
        ("WARC-Type", "response"), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", warc_date), ("WARC-Target-URI", _target(F.col("target_uri"))),
        ("WARC-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", digest(F.col("block"))),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", F.octet_length("block").cast("string")),
    )
    return rows.select(F.col("key").alias(id_col), F.lit("response").alias("record_type"), "record_id", F.lit(None).cast("string").alias("refers_to"),
        "target_uri", F.lit(warc_date).alias("warc_date"), headers.alias("headers"), "block")


def described(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The responses among ``records`` with what their blocks hold, blocks left out."""
    names = ["record_id", "target_uri", "warc_date", "headers"]
    kept = [F.col(k).alias(f"kept_{i}") for i, k in enumerate(keep)]
    rows = records.where(F.col("record_type") == "response").select(*kept, "record_id", "target_uri", "warc_date", "headers",
        F.coalesce(header("WARC-Payload-Digest"), F.lit("")).alias("stated"), F.coalesce("block", F.lit(b"")).alias("block"))
    passed = [f"kept_{i}" for i in range(len(keep))] + names
    kinds = {x.name: x.dataType.simpleString() for x in rows.schema}

    def run(batches):
        import pyarrow as pa

        label = pa.struct([("name", pa.string()), ("value", pa.string())])
        shape = pa.struct([("status", pa.string()), ("http", pa.list_(label)), ("text", pa.string()), ("title", pa.string()), ("links", pa.list_(pa.string())),
            ("charset", pa.string()), ("digest_check", pa.string())])
        for batch in batches:
            found = pa.array([describe(b.as_py(), s.as_py()) for b, s in zip(batch.column("block"), batch.column("stated"), strict=True)], shape)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in passed), *found.flatten()], [*passed, *(x.name for x in shape)])

    return rows.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in passed) + f", {DESCRIBED}")


def derive(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The derived records of every response, after the columns ``keep`` of it, ``source_payload_digest`` and ``digest_check``."""
    rows = described(records, keep).withColumns({
        "metadata_id": identifier(F.concat(F.lit("metadata|"), F.col("record_id"))),
        "conversion_id": F.when(F.col("text").isNotNull(), identifier(F.concat(F.lit("conversion|"), F.col("record_id")))),
    })
    line = lambda name, value: F.concat(F.lit(f"{name}: "), one_line(value), F.lit(LINE))
    lines = lambda prefix, name: F.array_join(F.transform(name, lambda x: F.concat(F.lit(prefix), one_line(x["name"]), F.lit(": "), one_line(x["value"]), F.lit(LINE))), "")
    optional = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", line(name, value)).otherwise("")
    fields = F.concat(
        lines("Source-", "headers"), optional("HTTP-Status", F.col("status")), lines("HTTP-Header-", "http"),
        line("Payload-Digest-Check", F.col("digest_check")), optional("Charset", F.col("charset")),
        optional("Title", F.col("title")), optional("Conversion-Record-ID", F.col("conversion_id")), F.array_join(F.transform("links", lambda x: line("Outlink", x)), ""),
    )

    def record(kind: str, media: str, own_id: Column, block: Column) -> Column:
        data = block.cast("binary")
        headers = _headers(
            ("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", F.col("warc_date")), ("WARC-Refers-To", F.col("record_id")), ("WARC-Target-URI", _target(F.col("target_uri"))),
            ("WARC-Block-Digest", digest(data)), ("Content-Type", media), ("Content-Length", F.octet_length(data).cast("string")),
        )
        return F.struct(F.lit(kind).alias("record_type"), own_id.alias("record_id"), F.col("record_id").alias("refers_to"), F.col("target_uri"),
            F.col("warc_date"), headers.alias("headers"), data.alias("block"))

    both = F.filter(F.array(record("metadata", "application/warc-fields", F.col("metadata_id"), F.col("fields")),
        record("conversion", "text/plain; charset=utf-8", F.col("conversion_id"), F.col("text"))), lambda r: r["record_id"].isNotNull())
    rows = rows.withColumn("fields", fields)
    named = [F.col(f"kept_{i}").alias(k) for i, k in enumerate(keep)]
    return rows.select(*named, header("WARC-Payload-Digest").alias("source_payload_digest"), "digest_check", F.inline(both))


def rendered(records: DataFrame) -> Column:
    """A record as it stands in a file, but for the RECORD_END after it; a block's bytes stay as they are."""
    head = F.array_join(F.transform("headers", lambda x: F.concat(x["name"], F.lit(": "), x["value"], F.lit(LINE))), "")
    return F.concat(F.lit(VERSION + LINE), head, F.lit(LINE), records["block"].cast("string"))


def write(records: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Records as gzip WARC files of at most ``per_file`` records each, by Spark's own writer, so that lost tasks leave no parts."""
    records.select(rendered(records).alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def inflated(data: bytes) -> bytes:
    """All members of a gzip file, or the data itself."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out = []
    while data.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def parsed(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record; ValueError where there is none."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = fields_of(lines_of(data[at:end])[1:])
        length = int(next(v for k, v in headers if k.lower() == "content-length"))
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length
        while data.startswith(b"\r\n", at):
            at += 2


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, plain or gzip, of any host; a file is read by one task, so files should be of a usual size (1 GB at most)."""
    fields = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date")
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def run(batches):
        import pyarrow as pa

        shape = pa.schema([*((n, pa.string()) for n in names[:5]), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for headers, block in parsed(inflated(content.as_py())):
                    by_name = {k.lower(): v for k, v in reversed(headers)}
                    got = [by_name.get(n.lower()) for n in fields]
                    rows.append(dict(zip(names, [*got[:3], got[3] or "", got[4], [{"name": k, "value": v} for k, v in headers], block], strict=True)))
                    held += len(block)
                    if held > 16_000_000:
                        yield pa.RecordBatch.from_pylist(rows, shape)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)
