"""Archives and URL rules against plain Python versions."""

import gzip
import hashlib
import tempfile

import pytest

from assayer.llm import urls, warc
from assayer.llm.shared import table

PAGES = [
    (5, "http://a.com/x", "y" * 100), (3, "http://b.com/\r\n%0Dz", "y" * 100), (4, None, "y" * 100), (None, "http://c", "y" * 100),
    (7, "http://d", "é" * 49), (8, "http://d", "é" * 49), (9, "http://d", None), (10, "http://d", ""), (11, "u", "é" * 50), (12, "u", "é" * 50),
    (13, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 20), (14, "u", "long " * 400_000), (14, "u", "long " * 400_000), (15, "u", "\r\n" * 100), (16, "u", "\n"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload_digest string")


def test_archives_give_back_every_record(spark, pages):
    path = tempfile.mkdtemp(prefix="warc-", dir="/tmp") + "/out"
    rows = warc.archive(pages, path).collect()
    assert len(rows) == len(PAGES)
    smallest = {}
    for i, _, h in PAGES:
        data = (h or "").encode()
        if len(data) >= 100 and i is not None:
            smallest[data] = min(i, smallest.get(data, i))
    want = []
    for i, u, h in PAGES:
        data = (h or "").encode()
        first = smallest.get(data)
        again = first is not None and first != i
        want.append((i, u, "revisit" if again else "response", first if again else None, hashlib.sha256(data).hexdigest(), len(data), None if again else data))
    got = [(r.page_id, r.url, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, r.payload and bytes(r.payload) if r.payload is not None else None) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_archive_files_are_records(spark, pages):
    path = tempfile.mkdtemp(prefix="warc-", dir="/tmp") + "/out"
    warc.write_archives(warc.resolved(warc.headers(pages)), path, records_per_file=4)
    files = [r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").collect()]
    files = [f for f in files if gzip.decompress(f)]  # Spark writes a file for a table's first part, also if that is empty
    assert len(files) >= 4 and all(gzip.decompress(f).startswith(b"WARC/1.1\r\nWARC-Type: ") and gzip.decompress(f).endswith(b"\r\n\r\n") for f in files)
    assert warc.read_archives(spark, path).count() == len(PAGES)


def test_empty_archive(spark, pages):
    assert warc.archive(pages.limit(0), tempfile.mkdtemp(prefix="warc-", dir="/tmp") + "/out").count() == 0


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "a.b.example.com", "/e"),
         ("allow", "tie.org", "/x"), ("block", "tie.org", "/x"), ("block", "org", ""), (None, "com", "/q"), ("block", "", "/"), ("block", "Upper.COM", "/")]
URLS = [None, "", "no scheme.com/en/", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en", "http://example.com/en/", "ftp://notexample.com/en/",
        "http://x.example.com/en/?a", "http://a.b.example.com/everything", "https://a.net/es/1", "http://net/es/", "http://tie.org/xyz", "http://q.tie.org", "http://com", "http://com/",
        "a://b://c.com/en/", "http://example.com?/en/", "http://example.com#/en/", "http://.com/", "http://..com/q", "http://ex.com:80/en/", "http://upper.com/z", "http://a.b.c.d.e.f.g.com/" + "p/" * 5000,
        "http://" + "s." * 3000 + "com/", "http://ÄÖ.com/É"]


def plain(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate({i: i + 32 for i in range(65, 91)})
    tail = rest[cut:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for action, h, p in RULES:
        h = h.lower()
        if action and h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(filter(None, (best, (len(h) + len(p), len(h), action == "block", action, h + p))))
    return host, path, best and best[4], best[3] if best else "allow"


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)] + [(None, "http://example.com/en/", "x")], "page_id long, url string, host string")
    got = [tuple(r) for r in urls.judge(df, urls.rule_table(spark, RULES)).collect()]
    want = [(r.page_id, *plain(r.url)) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert urls.judge(df.limit(0), urls.rule_table(spark, RULES)).count() == 0
    assert {r.verdict for r in urls.judge(df, urls.rule_table(spark, RULES).limit(0), default="block").collect()} == {"block"}


def test_no_python_on_the_way(spark, sf):
    plan = urls.judge(table(spark, sf, "pages"), urls.rule_table(spark, RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
