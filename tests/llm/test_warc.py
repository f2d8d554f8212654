import glob
import gzip
import hashlib

import pytest

from queryscore.llm import warc

PAGE = "page_id long, url string, html string"


def _rows(spark, pages, tmp_path, range_bytes):
    path = str(tmp_path / "archive")
    warc.write_archives(spark.createDataFrame(pages, PAGE), path)
    return path, warc.read_archives(spark, path, range_bytes).collect()


@pytest.mark.parametrize("range_bytes", [64, 1000, 4 << 20])
def test_round_trip_whatever_the_ranges(spark, tmp_path, range_bytes):
    long = "é" * 60
    pages = [(i, f"http://e/{i}", f"<p>{i}</p>" * 30) for i in range(40)]
    pages += [(100, "u", None), (101, "u", ""), (102, "u\r\nv", long), (103, None, long), (103, None, long), (None, "u", long), (104, "s", "short"), (105, "s", "short")]
    path, rows = _rows(spark, pages, tmp_path, range_bytes)
    assert len(rows) == len(pages)
    content = {p: (h or "").encode() for p, _, h in pages}
    for r in rows:
        assert r.payload_digest == hashlib.sha256(content[r.page_id]).hexdigest() and r.payload_bytes == len(content[r.page_id])
        assert r.payload == (content[r.page_id] if r.record_type == "response" else None)
    revisits = sorted(((r.page_id, r.refers_to) for r in rows if r.record_type == "revisit"), key=str)
    assert revisits == [(103, 102), (103, 102), (None, 102)]
    # any gzip reader can read the archives
    text = b"".join(gzip.open(f).read() for f in glob.glob(path + "/part-*"))
    assert text.count(b"WARC/1.1\r\n") == len(pages)


def test_magic_bytes_and_large_records_do_not_mislead(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(7)
    noisy = "".join(chr(rng.randrange(0x20, 0x2000)) for _ in range(60_000)) + "\x1f\x8b\x08WARC/1.1\r\n"
    pages = [(1, "u", noisy), (2, "u", "a" * ((1 << 24) + 5)), (3, "u", noisy + "x")]
    _, rows = _rows(spark, pages, tmp_path, 700)
    assert sorted((r.page_id, r.payload_bytes) for r in rows) == sorted((p, len(h.encode())) for p, _, h in pages)


def test_empty_table_and_extra_columns(spark, tmp_path):
    assert _rows(spark, [], tmp_path, 1000)[1] == []
    extra = spark.createDataFrame([(1, "u", "h" * 200, "x"), (2, "u", "h" * 200, "y")], PAGE + ", first_id string")
    warc.write_archives(extra, str(tmp_path / "b"))
    assert sorted(r.record_type for r in warc.read_archives(spark, str(tmp_path / "b")).collect()) == ["response", "revisit"]


def test_a_damaged_archive_is_an_error(spark, tmp_path):
    path, _ = _rows(spark, [(1, "u", "h" * 5000)], tmp_path, 1000)
    (name,) = [f for f in glob.glob(path + "/part-*") if gzip.open(f).read()]
    data = open(name, "rb").read()
    target = tmp_path / "cut"
    target.mkdir()
    (target / "a.warc.gz").write_bytes(data[:-20])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archives(spark, str(target)).collect()


def test_ranges_have_tasks_of_their_own_and_bytes_are_read_once(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    pages = [(i, f"http://e/{i}", "".join(chr(rng.randrange(0x20, 0x2000)) for _ in range(900))) for i in range(800)]
    path = str(tmp_path / "archive")
    warc.write_archives(spark.createDataFrame(pages, PAGE).coalesce(1), path)
    read = warc.read_archives(spark, path, 64 << 10)
    counts = [r["count"] for r in read.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(counts) == len(pages) and len(counts) > 10 and max(counts) < 200
    name = max(glob.glob(path + "/part-*"), key=lambda f: len(open(f, "rb").read()))
    size = len(open(name, "rb").read())
    for step in (size, 300_000):
        total = found = 0
        for first in range(0, size, step):
            with open(name, "rb") as file:
                source = warc._Source(file, size)
                found += len(list(warc.records(source, first, min(first + step, size))))
                total += source.bytes_read
        assert found == len(pages) and total <= size + -(-size // step) * 2 * warc._READ
