import gzip
import json
import zlib

import pytest

from attestra.llm import html_text, warc

PAGES = [(1, "http://a.example/x", "<title>T</title><p>One <a href='/y?a=1&amp;b'>two</a><img src=p.png>\r\n\r\nthree"), (2, None, None), (3, "http://b.example/\r\nbad", "é日本"), (None, "http://c", ""), (1, "http://a.example/x", "<p>WARC/1.1\r\n\r\n<p>WARC/1.1 again\r\n\r\n")]
SCHEMA = "page_id bigint, url string, html string, block string"
FIELDS = [x.split()[0] for x in warc.RECORD.split(", ")]


@pytest.fixture(scope="module")
def responses(spark):
    return warc.responses(spark.createDataFrame([(*p, "b") for p in PAGES], SCHEMA))


def crawled(block, *more, name="<urn:x>"):
    """A response record as another program would write it."""
    head = "\r\n".join(["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: {name}", "WARC-Target-URI: http://d.example/", "WARC-Date: 2024-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"])
    return head, block


ODD = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Odd: caf\xe9\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>caf\xe9 \xff\x00" + warc.MEMBER + b"WARC/1.0\r\n<title>caf\xe9</title>"


def test_responses(responses):
    for r in responses.collect():
        fields = dict(warc.header_fields(r.headers))
        assert int(fields["Content-Length"]) == len(r.block)
        assert fields["WARC-Block-Digest"] == warc.digest(bytes(r.block))
        assert fields["WARC-Payload-Digest"] == warc.digest(bytes(r.block).partition(b"\r\n\r\n")[2])
        assert fields["WARC-Record-ID"] == r.record_id


def brute_derive(head, block):
    """What the records must hold, read off the source by plain string handling."""
    lines = head.split("\r\n")[1:]
    named = [tuple(x.strip() for x in line.split(":", 1)) for line in lines if ":" in line]
    first = lambda pairs, name: next((v for n, v in pairs if n.lower() == name), "")
    http, _, body = block.partition(b"\r\n\r\n")
    http_lines = http.decode("latin-1").split("\r\n")[1:]
    http_named = [tuple(x.strip() for x in line.split(":", 1)) for line in http_lines if ":" in line]
    kind = first(http_named, "content-type")
    page = body.decode("latin-1" if "8859" in kind else "utf-8", "replace")
    text = html_text.to_text(page) if kind.startswith("text/html") or not kind else ""
    return {"refers": first(named, "warc-record-id"), "target": first(named, "warc-target-uri"), "date": first(named, "warc-date"), "text": text, "headers": named, "http": http_named, "payload": warc.digest(body), "block": warc.digest(block)}


def test_derivatives_equal_the_brute_force(spark, responses):
    extra = [("q", "response", "http://d.example/", "", *crawled(ODD, "WARC-IP-Address: 1.2.3.4", "X-Twice: 1", "X-Twice: 2"))]
    whole = responses.select(*FIELDS).unionByName(spark.createDataFrame(extra, warc.RECORD))
    sources = {r.record_id if r.record_id != "q" else "<urn:x>": brute_derive(r.headers, bytes(r.block)) for r in whole.collect()}
    made = warc.derive(whole.withColumn("page_id", warc.F.lit(1))).collect()
    assert len(made) == 2 * len(sources) == 2 * (len(PAGES) + 1)
    by = {}
    for r in made:
        fields = dict(warc.header_fields(r.headers))
        assert fields["WARC-Block-Digest"] == warc.digest(bytes(r.block)) and int(fields["Content-Length"]) == len(r.block)
        by.setdefault(fields["WARC-Refers-To"], {})[r.record_type] = (r, fields)
    assert by.keys() == sources.keys()
    for name, pair in by.items():
        want, (meta, m), (text, t) = sources[name], pair["metadata"], pair["conversion"]
        assert m["WARC-Concurrent-To"] == text.record_id and t["WARC-Concurrent-To"] == meta.record_id
        assert {(x["WARC-Target-URI"], x["WARC-Date"]) for x in (m, t)} == {(want["target"], want["date"])}
        assert bytes(text.block).decode() == want["text"]
        envelope = json.loads(bytes(meta.block))["Envelope"]
        assert [(x["name"], x["value"]) for x in envelope["WARC-Header-Metadata"]] == want["headers"]
        payload = envelope["Payload-Metadata"]
        assert [(x["name"], x["value"]) for x in payload["HTTP-Response-Metadata"]["Headers"]] == want["http"]
        assert (payload["Actual-Payload-Digest"], payload["Actual-Block-Digest"]) == (want["payload"], want["block"])
    html = json.loads(bytes(next(v for v in by.values() if b"two" in v["conversion"][0].block)["metadata"][0].block))["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert html["HTML-Metadata"] == {"Head": {"Title": "T"}, "Links": [{"path": "A@/href", "url": "/y?a=1&b"}, {"path": "IMG@/src", "url": "p.png"}]}


def test_repeated_headers_and_other_character_sets():
    meta, text = warc.derive_one(*crawled(ODD))
    headers = json.loads(meta[5])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]
    assert [x["value"] for x in headers if x["name"] == "Set-Cookie"] == ["a=1", "b=2"]
    assert {"name": "X-Odd", "value": "café"} in headers and text[5].decode().startswith("café")


def test_files_round_trip(spark, responses, tmp_path):
    odd = [("<urn:x>", "response", "http://d.example/", "2024-01-01T00:00:00Z", *crawled(ODD)), ("<urn:big>", "response", "http://d.example/", "2024-01-01T00:00:00Z", *crawled(bytes(range(256)) * (17 << 12), name="<urn:big>"))]
    whole = responses.drop("page_id").unionByName(warc.derive(responses).drop("page_id")).unionByName(spark.createDataFrame(odd, warc.RECORD))
    none = spark.createDataFrame([("n", "response", "u", "d", None, b"z")], warc.RECORD)
    warc.write_files(whole.unionByName(none).repartition(2), str(tmp_path / "w"), records_a_file=4)
    back = warc.read_files(spark, str(tmp_path / "w"))
    key = lambda r: (r[0], bytes(r[-1]))
    assert sorted(map(tuple, back.drop("file", "target_uri").collect()), key=key) == sorted(map(tuple, whole.drop("target_uri").collect()), key=key)
    sizes = [len(gzip.decompress(x.read_bytes())) for x in (tmp_path / "w").glob("*.txt")]  # plain gzip files
    assert sum(sizes) == sum(len(r.headers.encode()) + len(r.block) + 8 for r in whole.collect())


def test_large_files_are_read_in_splits(spark, tmp_path):
    rows = [(f"<{k}>", "response", "u", "d", *crawled(zlib.compress(str(k).encode() * 50) + bytes([k % 256]) * (k % 900), name=f"<{k}>")) for k in range(3000)]
    warc.write_files(spark.createDataFrame(rows, warc.RECORD).coalesce(1), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        back = warc.read_files(spark, str(tmp_path / "w"))
        assert back.rdd.getNumPartitions() > 8
        assert {r.record_id: bytes(r.block) for r in back.collect()} == {r[0]: r[5] for r in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_of_other_programs(spark, tmp_path):
    inner = crawled(b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nWARC/1.0\r\n\r\n", name="<urn:y>")
    records = [x[0].encode() + warc.END + x[1] + warc.END for x in (crawled(ODD), inner, crawled(b"", name="<urn:z>"))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in records))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "c.warc").write_bytes(b"".join(records))
    got = warc.read_files(spark, str(tmp_path)).collect()
    assert len(got) == 9
    for name, block in (("<urn:x>", ODD), ("<urn:y>", inner[1]), ("<urn:z>", b"")):
        assert [bytes(r.block) for r in got if r.record_id == name] == [block] * 3


def test_broken_files_fail(spark, responses, tmp_path):
    r = responses.first()
    record = r.headers.encode() + warc.END + bytes(r.block) + warc.END
    for name, data in (("cut", record + record[:-40]), ("junk", record + b"junk" + record)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(data))
        with pytest.raises(Exception, match="no WARC record|cut short"):
            warc.read_files(spark, str(tmp_path / name)).collect()
    (tmp_path / "own").mkdir()
    one = warc.member(r.headers, bytes(r.block))
    (tmp_path / "own" / "a.txt").write_bytes(one + one[:-9])
    with pytest.raises(Exception, match="cut short"):
        warc.read_files(spark, str(tmp_path / "own")).collect()
    (tmp_path / "own" / "a.txt").write_bytes(one + one)
    assert warc.read_files(spark, str(tmp_path / "own")).count() == 2


def test_edges(spark, responses):
    odd = spark.createDataFrame([("x", "warcinfo", "", "", "WARC/1.1\r\nA: b", b"z"), ("y", "response", "", "", None, b"z"), ("z", "response", "u", "d", "WARC/1.1\r\nWARC-Record-ID: <q>\r\n and more", None)], warc.RECORD).withColumn("page_id", warc.F.lit(1))
    made = warc.derive(odd).collect()
    assert len(made) == 2 and {bytes(r.block) for r in made if r.record_type == "conversion"} == {b""}
    assert warc.derive(responses.limit(0)).collect() == []
    long = warc.derive_one(*crawled(b"HTTP/1.1 200 OK\r\n\r\n<p>" + b"word " * 200_000))
    assert long[1][5].decode().split() == ["word"] * 200_000
