import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from varicube.llm import archive


def brute(rows):
    """rows: (page_id, payload text) -> result rows"""
    groups = defaultdict(list)
    for page_id, html in rows:
        groups[html or ""].append(page_id)
    out = []
    for text, ids in groups.items():
        data = text.encode()
        known = [i for i in ids if i is not None]
        for i in ids:
            refers = max(known) if known and i is not None and i != max(known) else None
            out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "html").collect()]
    more = spark.createDataFrame(
        [(1000 + i, "http://x.example/a?b=1", html) for i, html in enumerate([None, "", "same\r\n\r\nWARC/1.1\r\n", "same\r\n\r\nWARC/1.1\r\n", rows[0][1], "é\U0001f600"])]
        + [(None, None, "same\r\n\r\nWARC/1.1\r\n"), (1001, "http://x.example/a?b=1", ""), (1007, "http://bad host:x/\n?q", "odd"), (1008, None, "long " * 300_000)],
        "page_id long, url string, html string",
    )
    both = pages.select("page_id", "url", "html").union(more).selectExpr("*", "1 AS digest", "2 AS payload", "3 AS block")
    want = brute([tuple(r) for r in both.select("page_id", "html").collect()])
    got = archive.round_trip(both, str(tmp_path / "w")).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert archive.round_trip(both.limit(0), str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("lines", [1, 3, 1000])
def test_two_level_lookup(spark, tmp_path, lines):
    keys = [(f"http://h{i % 5}.example/{i % 7}", i // 2) for i in range(60)]
    captures = spark.createDataFrame(
        [(archive.surt(u), p, "f", i, 1) for i, (u, p) in enumerate(keys)], "key string, page_id long, file string, offset long, length long"
    )
    index = archive.write_index(captures, str(tmp_path / "i"), lines)
    if lines == 1:
        assert len(index.first) == 60
    assert list(index.first) == sorted(index.first)
    wanted = spark.createDataFrame(keys[10:30] + [("http://none.example/", 1), (None, None)], "url string, page_id long")
    got = sorted(r["offset"] for r in archive.lookup(index, wanted).collect())
    asked = set(keys[10:30])
    assert got == [i for i, k in enumerate(keys) if k in asked]


def test_members_are_single_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://e.example/{i}", "x" * i) for i in range(50)], "page_id long, url string, html string")
    captures = archive.write_archives(pages, str(tmp_path / "a"), file_bytes=2000).collect()
    assert len({r["file"] for r in captures}) > 2
    for r in captures:
        data = (tmp_path / "a" / r["file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        fields, http, payload = archive.parse_record(gzip.decompress(data))
        assert fields["warc-type"] == "response" and payload == b"x" * r["page_id"] and fields["warc-target-uri"].endswith(str(r["page_id"]))
    whole = b"".join(gzip.decompress((tmp_path / "a" / f).read_bytes()) for f in {r["file"] for r in captures})
    assert whole.count(b"WARC/1.1\r\n") == 50


def test_keys_reverse_hosts():
    assert archive.surt("http://WWW.A.example.org:8080/P?q=1") == "org,example,a,www:8080)/p?q=1"
    assert archive.surt("https://a.b/") == "b,a)/" and archive.surt(None) == ""
