"""Derived WARC records against the standard library's parser, exact round trips and hand-made responses."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import pytest
from helpers import clashing
from pyspark.sql import functions as F

from quillon.llm import warc
from quillon.llm.common import table

PAGES = "page_id long, url string, html string"
AWKWARD = [(1, None, None), (2, "", ""), (3, "http://a/", " \t\n"), (4, "http://a/\r\nX-Bad: 1", "<p>a<p>b"), (5, "http://b/", "<p>same"), (5, "http://b/", "<p>same"), (None, "http://c/", "no tags"), (7, "u", "long <b>word</b> " * 60_000), (8, "u", "x" * 400_000), (9, "ü", "\r\n\r\nWARC/1.1\r\n\r\n<p>Ünï 漢字 😀 \x00"), (10, "u", "<a href='x\ny'>q</a><title>\n</title>")]


class Plain(HTMLParser):
    """Text, title and links by another parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.titles, self.hidden = [], [], [], ""
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.hidden = tag
            if tag == "title":
                self.titles.append("")
        if tag in warc.BREAKS or tag == "title":
            self.parts.append("\n")
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"].strip())

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.hidden = ""

    def handle_endtag(self, tag):
        self.hidden = ""
        if tag in warc.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.hidden == "title":
            self.titles[-1] += data
        elif not self.hidden:
            self.parts.append(re.sub(r"[ \t\n\f\r]+", " ", data))

    def result(self):
        lines = (re.sub(" +", " ", x).strip(" ") for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x), " ".join(self.titles[0].split()) if self.titles else "", self.links


def test_pages_against_the_standard_parser(spark, sf_dir):
    pages = [r["html"] for r in table(spark, sf_dir, "pages").collect()]
    whole = [p for p in pages if p.endswith("</html>")]
    assert len(whole) > 40
    for p in whole:
        assert warc.text_of_html(p) == Plain(p).result()


def test_random_pages_against_the_standard_parser():
    random.seed(11)
    bits = ["<p>", "</p>", "<b>", "</b>", "<br/>", "<BR>", " ", "\n", "a", "b c", "&amp;", "&lt", "&eacute;", "&#233;", "&#xe9;", "&unknown;", "<!-- x > y -->", "<script>if (a<b) '</p>'</script>", "<style>p{}</style >", '<a href="/x?a=1&amp;b=2">', "<a class=k href='/y>z'>", "</a>", '<img alt="a > b">', "<td>", "1 < 2", "<h2 id=q>", "<title>A &amp; \nB</title>", "😀"]
    for _ in range(3000):
        page = "".join(random.choices(bits, k=14))
        assert warc.text_of_html(page) == Plain(page).result(), page


@pytest.mark.parametrize(
    "page,text",  # the standard parser reads tags inside titles, which HTML does not; they are text here
    [("<!-->a", "a"), ("a<!-- b", "a"), ("a<script>b", "a"), ("a<p title='b", "a"), ("a < b <3", "a < b <3"), ("x<br>y<b>z</b>w", "x\nyzw"), ("a&nbsp;&nbsp;b", "a\xa0\xa0b"), ("<p don't>a</p>b", "a\nb"), ("a&#10;b", "a\nb"), (f"&#{'9' * 5000};", "�"), ("<scripty>a</scripty>", "a"), ("<iframe><p>no</iframe>yes", "yes"), ("", "")],
)
def test_edges(page, text):
    assert warc.text_of_html(page)[0] == text


@pytest.mark.parametrize("bit", ["<", "<a ", "<a href=\"", "<!--", "<script>", "&", "&#1", "<p '", "</", "<a =", "<a href=", "= '", "<title>", "<a href= ' "])
def test_linear_time(bit):
    began = time.time()
    warc.text_of_html(bit * 200_000)
    assert time.time() - began < 5


def rows_of(derived):
    return {(r["record_type"], r["refers_to"]): r for r in derived.collect()}


def response(spark, block, url="http://x/", **headers):
    given = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), *((k.replace("_", "-"), v) for k, v in headers.items())]
    return spark.createDataFrame([("response", "<urn:uuid:1>", None, url, "2020-02-02T02:02:02Z", given, block)], warc.RECORD)


def block_text(row):
    return bytes(row["block"]).decode()


def test_links_digests_and_whole_tables(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    source = {r["record_id"]: r for r in warc.responses(pages).collect()}
    derived = warc.derive(warc.responses(clashing(pages).withColumn("key", F.lit(1)).withColumn("block", F.lit("x"))), ["page_id"]).collect()
    assert Counter(r["record_type"] for r in derived) == {"metadata": len(source), "conversion": len(source)} and len(source) == pages.count()
    ids = [r["record_id"] for r in derived]
    assert len({*ids, *source}) == 3 * len(source) and all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", x) for x in ids)
    conversions = {r["refers_to"]: r["record_id"] for r in derived if r["record_type"] == "conversion"}
    for r in derived:
        of, headers = source[r["refers_to"]], {x["name"]: x["value"] for x in r["headers"]}
        assert of["page_id"] == r["page_id"] and of["target_uri"] == r["target_uri"] == headers["WARC-Target-URI"]
        assert headers["WARC-Refers-To"] == r["refers_to"] and r["digest_check"] == "match"
        assert headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r["block"]).hexdigest() and int(headers["Content-Length"]) == len(r["block"])
        if r["record_type"] == "metadata":
            fields = block_text(r).split("\r\n")
            assert all(f"Source-{x['name']}: {x['value']}" in fields for x in of["headers"])
            assert f"Conversion-Record-ID: {conversions[r['refers_to']]}" in fields
            assert r["source_payload_digest"] == "sha256:" + hashlib.sha256(bytes(of["block"]).split(b"\r\n\r\n", 1)[1]).hexdigest()


def test_awkward_rows(spark):
    pages = clashing(spark.createDataFrame(AWKWARD, PAGES))
    derived = warc.derive(warc.responses(pages), ["page_id"])
    got = derived.collect()
    assert Counter((r["page_id"], r["record_type"]) for r in got) == Counter((i, k) for i, _, _ in AWKWARD for k in ("metadata", "conversion"))
    text = {r["page_id"]: block_text(r) for r in got if r["record_type"] == "conversion"}
    assert [text[k] for k in (1, 2, 3, 4, 5, None)] == ["", "", "", "a\nb", "same", "no tags"]
    assert text[7] == ("long word " * 60_000).strip() and text[8] == "x" * 400_000
    assert all("\nX-Bad" not in r["target_uri"] for r in got)
    assert len({r["record_id"] for r in got if r["page_id"] == 5}) == 2
    assert next("WARC-Target-URI" not in {x["name"] for x in r["headers"]} for r in got if r["page_id"] == 1)
    assert {r["record_id"] for r in derived.collect()} == {r["record_id"] for r in got}
    empty = warc.derive(warc.responses(spark.createDataFrame([], PAGES)), ["page_id"])
    assert empty.count() == 0 and empty.schema == derived.schema


def test_files_round_trip(spark, tmp_path):
    every = warc.responses(spark.createDataFrame(AWKWARD, PAGES)).drop("page_id")
    derived = warc.derive(every).drop("source_payload_digest", "digest_check")
    records = every.unionByName(derived)
    warc.write(records, str(tmp_path / "w"), per_file=5)
    files = list((tmp_path / "w").glob("*.gz"))
    assert len(files) > 5
    key = lambda r: (r["record_type"], r["record_id"], r["refers_to"], r["target_uri"], r["warc_date"], tuple((x["name"], x["value"]) for x in r["headers"]), bytes(r["block"]))
    assert Counter(map(key, warc.read(spark, str(tmp_path / "w" / "*.gz")).collect())) == Counter(map(key, records.collect()))


def test_members_and_faults():
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: warcinfo\r\ncontent-length: 0\r\n\r\n\r\n\r\n"
    assert [b for _, b in warc.parsed(warc.inflated(gzip.compress(one) + gzip.compress(two)))] == [b"abc", b""]
    with pytest.raises(ValueError):
        list(warc.parsed(one + b"junk\r\n\r\n"))


def test_codings_and_charsets(spark):
    page = "<title>É</title><p>é €".encode("cp1252")
    packed = gzip.compress(page)
    chunked = b"%x\r\n%s\r\n4;x=y\r\n%s\r\n%x\r\n%s\r\n0\r\n\r\n" % (10, packed[:10], packed[10:14], len(packed) - 14, packed[14:])
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nSet-Cookie: a\r\nSet-Cookie: b\r\nX-Folded: one\r\n two\r\n\r\n"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(packed).digest()).decode()
    got = rows_of(warc.derive(response(spark, head + chunked, WARC_Payload_Digest=digest, X_Own="kept")))
    assert block_text(got["conversion", "<urn:uuid:1>"]) == "é €"
    fields = block_text(got["metadata", "<urn:uuid:1>"]).split("\r\n")
    assert {"Title: É", "Charset: cp1252", "HTTP-Header-Set-Cookie: a", "HTTP-Header-Set-Cookie: b", "HTTP-Header-X-Folded: one two", "Source-X-Own: kept", f"Source-WARC-Payload-Digest: {digest}", "Payload-Digest-Check: match"} <= {*fields}
    for coding, body in (("gzip", b"no gzip"), ("deflate", zlib.compress(b"no gzip")), ("deflate", zlib.compress(b"no gzip", wbits=-15)), ("br", b"no gzip")):
        got = rows_of(warc.derive(response(spark, f"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nTransfer-Encoding: chunked\r\nContent-Encoding: {coding}\r\n\r\n".encode() + body, WARC_Payload_Digest="sha1:" + "A" * 32)))
        assert block_text(got["conversion", "<urn:uuid:1>"]) == "no gzip" and got["conversion", "<urn:uuid:1>"]["digest_check"] == "mismatch"


def test_other_payloads(spark):
    image = rows_of(warc.derive(response(spark, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG\xff", WARC_Payload_Digest="blake3:0")))
    assert [k for k, _ in image] == ["metadata"] and "Conversion-Record-ID" not in block_text(image["metadata", "<urn:uuid:1>"])
    assert image["metadata", "<urn:uuid:1>"]["digest_check"] == "unknown"
    for block in (b"<p>bare", None, b"HTTP/1.1 204 No Content\r\nContent-Type: text/html"):
        got = rows_of(warc.derive(response(spark, block)))
        assert block_text(got["conversion", "<urn:uuid:1>"]) == ("bare" if block and b"bare" in block else "") and got["conversion", "<urn:uuid:1>"]["digest_check"] == "absent"
    for charset in ("rot13", "base64", "no-such", "utf-7", "undefined"):
        assert warc.decoded("é".encode(), charset)[0]
    others = response(spark, b"x").withColumn("record_type", F.lit("request"))
    assert warc.derive(others).count() == 0
    assert html.unescape("&amp") == "&"
