"""op7: archives are read back as written."""

import gzip
import io
import hashlib

from weighbridge.llm.warc import captures, page_number, parse, records, round_trip, write_archives

COLUMNS = "page_id long, url string, html string, digest string, size int, first long, type string"


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "d", 1, 2, "t") for r in rows], COLUMNS)


def brute_force(rows):
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if same and len(data) >= 100 else None
        again = first is not None and (page is None or page > first)
        out.append((page, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def result(df):
    rows = df.withColumn("page", page_number(df.capture)).withColumn("to", page_number(df.response.refers_to)).collect()
    out = []
    for r in rows:
        size = int(r.metadata.block.split(": ")[1])
        if r.response.type == "response":
            assert r.response.payload_bytes == size and hashlib.sha256(bytes(r.response.payload)).hexdigest() == r.response.digest
        assert r.request.block.startswith("GET ")
        out.append((r.page, r.response.uri, size, r.response.digest, r.response.type, r.to))
    return sorted(out, key=str)


BODY = "<p>some payload that is long enough to be referred to</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" * 2


def test_round_trip(spark):
    rows = [(5, "http://a/x?y", BODY), (3, "http://b/", BODY), (9, None, BODY), (1, "http://c/", "short"), (2, "http://d/", "short"),
            (4, "http://e/", None), (6, "http://f/", ""), (7, "bad\r\nX: y", "é😀" * 100), (8, "not a url", "\r\n\r\n"), (10, "http://g/", "z" * 300_000), (11, "http://g/", "z" * 300_000)]
    assert result(round_trip(pages(spark, *rows))) == sorted([(p, u.replace("\r", "%0D").replace("\n", "%0A") if u else u, *rest) for p, u, *rest in brute_force(rows)], key=str)


def test_edge_rows(spark):
    rows = [(1, "u", BODY), (1, "u", BODY), (None, "v", BODY), (None, "w", "short"), (2, "u", "x" * 99), (3, "u", "x" * 99), (4, "u", "y" * 100), (5, "u", "y" * 100)]
    assert result(round_trip(pages(spark, *rows))) == brute_force(rows)
    assert round_trip(pages(spark, *rows).limit(0)).collect() == []


def test_archives_are_warc(spark, tmp_path):
    write_archives(pages(spark, *[(i, "http://a/", f"page {i} " * 40) for i in range(30)]), str(tmp_path / "w"))
    kinds = []
    for f in (tmp_path / "w").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        assert not data or data.startswith(b"WARC/1.1\r\nWARC-Type: request\r\n")
        for fields, block in parse(io.BytesIO(data)):
            kinds.append(fields["warc-type"])
            assert len(block) == int(fields["content-length"])
    assert sorted(kinds) == ["metadata"] * 30 + ["request"] * 30 + ["response"] * 30
    assert captures(spark, str(tmp_path / "w")).count() == 30
    assert records(pages(spark)).count() == 0


def test_every_row_is_a_capture(spark):
    import __spark_entry__  # noqa: F401
    from weighbridge.llm.warc import page_number, round_trip

    html = "<p>" + "x" * 200
    rows = [(None, "http://a/1", None), (None, "http://a/2", None), (None, "http://a/2", None), (5, "http://a/5", html), (5, "http://b/5", html),
            (5, "http://b/5", html), (6, "http://a/6", html)]
    got = round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = sorted(((page_number(got.capture), r) and (r.capture.split(":")[2], r.response.type, r.request is not None, r.metadata is not None) for r in got.collect()))
    assert found == [("5", "response", True, True)] * 3 + [("6", "revisit", True, True)] + [("none", "response", True, True)] * 3
    refers = [r[0] for r in got.filter("response.type = 'revisit'").select(page_number(got.response.refers_to)).collect()]
    ids = {r.capture for r in got.collect()}
    assert refers == [5] and got.filter("response.type = 'revisit'").first().response.refers_to in ids
