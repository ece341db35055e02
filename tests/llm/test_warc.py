import base64
import hashlib

import pytest

from meshwright.llm import warc as W

PAGES = [(5, "http://a.b/c d", "same"), (3, "http://ü.x/", "same"), (9, None, None), (2, "u", ""), (7, "v", "é" * 50_000), (None, "w", "same"), (8, "x", "line\r\n\r\nline\n"), (8, "x", "line\r\n\r\nline\n")]


def want(pages):
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out, told = [], set()
    for p, _, h in pages:
        data = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and (f != p or h in told)
        told |= {h} if f == p else set()
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pages_come_back(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumnRenamed("x", "y")
    arc = W.to_arc(pages.withColumn("digest", pages.url))
    assert rows(W.read_warc(W.to_warc(W.read_arc(arc)))) == want(PAGES)
    assert W.read_warc(W.to_warc(W.read_arc(W.to_arc(pages.limit(0))))).collect() == []


def test_small_payloads_can_be_left_alone(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = W.read_warc(W.to_warc(W.read_arc(W.to_arc(pages)), least_bytes=5)).collect()
    assert {r.record_type for r in got if r.payload_bytes < 5} == {"response"}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    content = W.arc_archive("x.arc", version, [("http://a b/", b"payload\nwith lines\n"), (None, b"")])
    (fields, body), (_, empty) = W.parse_arc(content)
    assert list(fields) == W.ARC_FIELDS[version].split(" ") and fields["URL"] == "http://a%20b/"
    assert W.split_http(body)[2] == b"payload\nwith lines\n" and W.split_http(empty)[2] == b""


def test_revisits_follow_record_ids_and_digests(spark):
    pages = spark.createDataFrame([(i, "u", "same" if i % 3 else f"own {i}") for i in range(40)], "page_id long, url string, html string").repartition(6)
    archives = W.to_warc(W.read_arc(W.to_arc(pages)))
    got = {r.page_id: r for r in W.read_warc(archives).collect()}
    assert [k for k, r in got.items() if r.record_type == "response" and k % 3] == [1] and {r.refers_to for k, r in got.items() if k % 3 and k > 1} == {1}
    # without the archive that holds the response, and with a declared digest that is another, the revisits can't be read
    records = W.parse_archives(archives).collect()
    assert {r.record for r in records if r.kind == "revisit"} < {r.record for r in records if r.kind == "response"}
    spoil = lambda change: archives.rdd.map(lambda r: (r.archive, b"".join(W.member(change(m)) for m in W.members(r.content)), r.pages)).toDF("archive string, content binary, pages array<long>")
    for change in (lambda m: m.replace(b"WARC-Refers-To: <urn:uuid:", b"WARC-Refers-To: <urn:none:"), lambda m: m.replace(b"sha1:", b"sha1:X") if b"WARC-Type: revisit" in m else m):
        with pytest.raises(Exception, match="is not there or differs"):
            W.read_warc(spoil(change)).collect()


def test_wrong_lengths_are_noticed():
    block = W.member(b"filedesc://x 0.0.0.0 20240101000000 text/plain 5\nshort")
    with pytest.raises(ValueError):
        list(W.parse_arc(W.member(b"filedesc://x 0.0.0.0 20240101000000 text/plain 500\nshort")))
    with pytest.raises(ValueError):
        list(W.parse_arc(block))


def test_query(spark):
    got = rows(W.op9_arc_to_warc(spark, "/root/testdata/sf0.001"))
    assert got == want([tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()])
