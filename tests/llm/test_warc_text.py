"""Character references in conversion records, against values written out by hand."""

import gzip

from pyspark.sql import functions as F

from stridemill.llm import warc_derivatives

CASES = {
    "&copy; 2024 &middot; caf&eacute; &hellip;": "© 2024 · café …",
    "&#169;&#xA9;&#Xa9; &#8364; &#x1F600;": "©©© € 😀",
    "a&nbsp;b&#160;c&#xa0;&nbsp;d": "a b c d",
    "&amp;lt; &amp;copy; &#38;amp; &lt;b&gt; &quot;&apos;&#39;": "&lt; &copy; &amp; <b> \"''",
    "&NotEqualTilde; &CounterClockwiseContourIntegral; &fjlig;": "≂̸ ∳ fj",
    "R&D a && b &unknown; & &; &#; AT&T?x=1&y=2": "R&D a && b &unknown; & &; &#; AT&T?x=1&y=2",
    "&copy 2024": "© 2024",
    "&#0;&#xD800;&#x110000;": "���",
}


def test_every_character_reference_is_decoded_once(spark):
    pages = spark.createDataFrame([(k, f"<p>{page}</p>") for k, page in enumerate(CASES)], "k int, page string")
    got = {r["k"]: r["text"] for r in pages.select("k", warc_derivatives.plain_text(F.col("page")).alias("text")).collect()}
    assert got == dict(enumerate(CASES.values()))


def test_links_in_any_quoting(spark):
    html = """<a href="/1">a</a><A class=x HREF='/2?a="b"'>b</A><a\nhref=/3>c</a><a data-href="/no">d</a><a id=5 href = "/5" title=">">e</a><abbr href="/no">f</abbr><a href="">g</a>"""
    pages = spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")
    rows = {r["warc_type"]: r for r in warc_derivatives.derivatives(warc_derivatives.responses(pages, "x")).collect()}
    assert [x for x in rows["metadata"]["block"].split("\r\n") if x.startswith("outlink")] == ["outlink: /1", 'outlink: /2?a="b"', "outlink: /3", "outlink: /5", "outlink: "]
    assert "assumed: date, http-headers\r\n" in rows["metadata"]["block"]
    assert rows["conversion"]["source_headers"] == rows["metadata"]["source_headers"] == warc_derivatives.HTTP_HEADERS


def test_written_records_keep_headers_and_are_read_in_bounded_parts(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://{k}/", f"<p>{'text ' * (5000 * k)}</p>") for k in range(6)], "page_id long, url string, html string")
    derived = warc_derivatives.derivatives(warc_derivatives.responses(pages, "2024-01-01T00:00:00Z"))
    warc_derivatives.write(derived.coalesce(1), str(tmp_path / "w"))
    back = warc_derivatives.read(spark, str(tmp_path / "w/*.gz"), most=10_000).collect()
    assert len(back) == 12
    want = {r["record_id"]: r for r in derived.collect()}
    for r in back:
        own = want[r["headers"]["warc-record-id"]]
        assert bytes(r["block"]).decode() == own["block"] and r["headers"]["warc-source-block-digest"] == own["source_block_digest"]
        assert "text/html" in r["headers"]["warc-source-http-headers"] and r["headers"]["warc-refers-to"] == own["refers_to"]
    one = b"WARC/1.1\r\nContent-Length: 5\r\nA: b\r\n\r\nab\r\nc\r\n\r\n"
    members = gzip.compress(one) + gzip.compress(one * 2)
    for size in (1, 7, 10_000):
        assert list(warc_derivatives.parse(warc_derivatives.unzipped(members, size))) == [({"content-length": "5", "a": "b"}, b"ab\r\nc")] * 3
        assert list(warc_derivatives.parse(warc_derivatives.unzipped(one, size))) == [({"content-length": "5", "a": "b"}, b"ab\r\nc")]


PAGES = {
    "<head><title>x</title><body><p>Hello</p><header>h</header><p>after</p>": "Hello\nh\nafter",
    "<html><HEAD >\n<title>x</title></Head\n><p>a</p>": "a",
    "<head><title>x</title><p>no body</p>": "no body",
    "<p>a</p><script>var x = '<p>';": "a",
    "<p>a</p><script src=x>1 < 2</script ><b>c</b><style>p {}</style>d": "a\nc d",
    "<p>a<!-- <head> --></p><headline>b</headline>": "a\nb",
    "<noscript><p>n</p></noscript><template>t</template><scripted>s</scripted>": "s",
    "<header>only</header>": "only",
    "<head>" + "<meta a=b>" * 20_000 + "</head>z": "z",
    "": "",
}


def test_heads_and_unclosed_elements(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "k int, page string")
    got = {r["k"]: r["text"] for r in pages.select("k", warc_derivatives.plain_text(F.col("page")).alias("text")).collect()}
    assert got == dict(enumerate(PAGES.values()))


def test_a_round_trip_from_response_files(spark, tmp_path):
    import hashlib

    def record(headers, block):
        return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n"
    page = "<head><title>caf\xe9</title><body><p>ol\xe9 &amp; a</p><a href='/1'>b</a>".encode("latin-1")
    own = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a/", "WARC-Date": "2020-02-02T00:00:00Z"}
    stored = [record(own, http + page), record({"WARC-Type": "warcinfo"}, b"x"), record({"WARC-Type": "response", "WARC-Target-URI": "http://b/"}, b"no headers \xff"), record({"WARC-Type": "request"}, b"")]
    (tmp_path / "in.warc.gz").write_bytes(b"".join(map(gzip.compress, stored)))
    records = warc_derivatives.stored_responses(warc_derivatives.read(spark, str(tmp_path / "in.warc.gz")))
    derived = warc_derivatives.derivatives(records)
    rows = {(r["target_uri"], r["warc_type"]): r for r in derived.collect()}
    conversion, metadata = rows["http://a/", "conversion"], rows["http://a/", "metadata"]
    assert conversion["block"] == "ol\xe9 & a\nb"
    assert conversion["refers_to"] == metadata["refers_to"] == "<urn:uuid:1>" and conversion["date"] == "2020-02-02T00:00:00Z"
    assert conversion["source_payload_digest"] == f"sha256:{hashlib.sha256(page).hexdigest()}" and metadata["source_block_digest"] == f"sha256:{hashlib.sha256(http + page).hexdigest()}"
    assert "title: caf\xe9\r\n" in metadata["block"] and "assumed" not in metadata["block"] and "charset=iso-8859-1" in metadata["source_headers"]
    bare = rows["http://b/", "metadata"]
    assert "assumed: date, http-headers, record-id\r\n" in bare["block"] and rows["http://b/", "conversion"]["block"] == "no headers �"
    out = str(tmp_path / "out")
    warc_derivatives.write(derived.repartition(2), out)
    back = warc_derivatives.read(spark, f"{out}/*.gz").collect()
    assert {(r["headers"]["warc-record-id"], bytes(r["block"]).decode()) for r in back} == {(r["record_id"], r["block"]) for r in rows.values()}
    import os
    import zlib

    members = 0
    for name in os.listdir(out):
        raw = open(f"{out}/{name}", "rb").read()
        while raw:
            one = zlib.decompressobj(31)
            assert len(list(warc_derivatives.parse(iter([one.decompress(raw)])))) == 1
            raw, members = one.unused_data, members + 1
    assert members == 4 and not [n for n in os.listdir(out) if n.startswith("_")]


def test_a_failed_write_leaves_no_files(spark, tmp_path):
    import os

    import pytest

    pages = spark.createDataFrame([(k, "http://a/", "<p>x</p>") for k in range(9)], "page_id long, url string, html string").repartition(3)
    derived = warc_derivatives.derivatives(warc_derivatives.responses(pages, "x"))
    bad = derived.withColumn("block", F.when(F.col("source_id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("block")))
    with pytest.raises(Exception, match="lost"):
        warc_derivatives.write(bad, str(tmp_path / "w"))
    left = os.listdir(tmp_path / "w") if (tmp_path / "w").exists() else []
    assert [n for n in left if n.endswith(".gz")] == []
