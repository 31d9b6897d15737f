import gzip
import hashlib
from collections import Counter

from quadrat.llm import warc


def test_round_trip(spark):
    big, other = "<p>é</p>" * 200, "x" * 1000
    rows = [(1, "http://a.org/x y", big), (2, None, big), (3, "nonsense\r\nX: y", other), (4, "https://b/", other), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "", None), (8, "u", ""), (9, "u", big), (9, "v", "different" * 200), (4, "again", other), (4, "again", other), (2, None, big), (2, None, big), (5, "u", "x" * 999), (9, "u", big), (10, "http://c", "line\r\n\r\nWARC/1.1\r\n" * 90), (None, "u", big)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, holder int").repartition(3)
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        holder = max((j for j, _, h in rows if h == html and j is not None), default=None)
        revisit = len(raw) >= 1000 and i is not None and holder != i
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", holder if revisit else None)] += 1
    got = warc.page_captures(df).collect()
    assert Counter(tuple(r) for r in got) == want
    ids = [r.record_id for r in warc.read_records(warc.write_archives(df, warc.fresh_path(spark, "test-warc"))).collect()]
    assert len(ids) == len(set(ids))


def test_archives_are_gzip_members_and_nested_rows_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.org/p?q=1", "<html>one</html>"), (2, "http://a.org/2", "<html>two</html>")], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(df, f"file://{tmp_path}")
    path = files.first().path.removeprefix("file://")
    text = gzip.open(path).read().decode()
    assert text.count("WARC/1.1\r\n") == 7 and files.first().records == 7
    rows = {dict(r.metadata.fields)["page-id"]: r for r in warc.assemble(warc.read_records(files)).collect()}
    assert bytes(rows["2"].response.payload) == b"<html>two</html>"
    assert rows["1"].request.fields == {"request": "GET /p?q=1 HTTP/1.1"} and rows["1"].request.target_uri == "http://a.org/p?q=1"


def test_empty(spark):
    assert warc.page_captures(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
