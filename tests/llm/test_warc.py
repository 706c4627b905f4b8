import hashlib
import random

import pytest

from meridian.llm import warc


def test_loser_tree():
    r = random.Random(1)
    for _ in range(300):
        runs = [sorted([r.randint(0, 9)] for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 9))]
        assert list(warc.loser_tree(runs, lambda x: x[0])) == sorted(x for run in runs for x in run)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    html = ["é" * 50, "b" * 100, "c" * 99, "", None]
    out = [(i, f"http://h{r.randrange(5)}.example.com/p/{r.randrange(4)}?q", r.choice(html) if r.random() < 0.8 else f"page {i} " * 20) for i in range(200)]
    return out + [(None, None, "b" * 100), (5, "http://dup.example.org:81/", "b" * 100), (300, "not a url\r\nX: y", "d\r\n\r\n" * 40)]


def test_archives(spark, rows):
    pages = spark.createDataFrame([(*x, "a", 1, 2) for x in rows], "page_id long, url string, html string, payload_digest string, size int, first int").repartition(4)
    manifest = warc.write_archives(pages, archive_bytes=8000)
    assert manifest.count() > 4
    index = warc.index(manifest)
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index.collect())
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        rev = len(data) >= 100 and p is not None and p != first[h]
        want.append((-1 if p is None else p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if rev else "response", first[h] if rev else None))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2], x[3], x[4] or 0))


def test_history_is_in_order(spark, rows):
    index = warc.index(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)))
    parts = index.rdd.mapPartitions(lambda it: [[(r["urlkey"], r["timestamp"]) for r in it]]).collect()
    flat = [x for p in parts for x in p]
    assert flat == sorted(flat) and len(flat) == len(rows)


def test_history_survives_a_write(spark, rows, tmp_path):
    index = warc.index(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), archive_bytes=8000))
    index.repartition(7, "payload_digest").write.parquet(str(tmp_path / "index"))
    got = spark.read.parquet(str(tmp_path / "index")).collect()
    assert len({(r["history"], r["place"]) for r in got}) == len(got) == len(rows) and len({r["history"] for r in got}) > 1
    keys = [(r["urlkey"], r["timestamp"], r["page_id"] is not None, r["page_id"] or 0) for r in sorted(got, key=lambda r: (r["history"], r["place"]))]
    assert keys == sorted(keys)


@pytest.mark.parametrize("most", [7, 50])
def test_merge_in_files(spark, rows, most, monkeypatch):
    """With few captures held, runs are merged by way of files, which are deleted, and the history is the same."""
    import os

    from meridian.llm import common

    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), archive_bytes=4000)
    want = sorted(map(repr, warc.index(manifest).collect()))
    monkeypatch.setattr(warc, "MERGE_ROWS", most)
    got = warc.index(manifest).collect()
    assert sorted(map(repr, got)) == want
    root = common.shared_root(spark).removeprefix("file://") + "/meridian"
    left = [os.listdir(f"{root}/{x}") for x in os.listdir(root) if x.startswith("warc-merges")]
    assert left and not any(left)


def test_a_long_page(spark):
    html = "<p>" + "word " * 2_000_000
    r = warc.index(warc.write_archives(spark.createDataFrame([(1, "http://a/", html), (2, "http://b/" + "x" * 100_000, html)], "page_id long, url string, html string"))).orderBy("page_id").collect()
    assert [(x["payload_bytes"], x["record_type"], x["refers_to"]) for x in r] == [(len(html), "response", None), (len(html), "revisit", 1)]


def test_no_pages(spark):
    index = warc.index(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string")))
    assert index.count() == 0


def test_damage_is_found():
    content = warc.record(1, "http://a/", "2024-01-01T00:00:00Z", "0" * 64, 3, b"abc", None)
    with pytest.raises(ValueError):
        warc.capture("x", 0, 1, content)


def test_url_key():
    assert warc.url_key("HTTP://News.Example.com:8080/A?b") == "com,example,news:8080)/a?b"
    assert warc.url_key("http://[x/") == "http://[x/"
