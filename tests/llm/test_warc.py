import gzip
import hashlib
import os
import uuid

import pytest

from shelfkin.llm import warc

SCHEMA = "page_id long, url string, html string, payload int"


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def plain(rows):
    out = []
    first = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= 100:
            first[data] = min(first.get(data, i), i)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and first.get(data) != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first.get(data) if again else None))
    return out


def test_round_trip(spark, folder):
    rows = [(i, f"http://a.b/{i}", ("été " * (i % 7) * 10) + "x" * (i % 3), 1) for i in range(120)]
    rows += [(500, None, None, 1), (501, "http://a\r\nb", "", 1), (None, "u", "z" * 100, 1), (-3, "u", "z" * 100, 1), (-3, "u", "z" * 100, 1),
             (700, "u", "WARC/1.1\r\n\r\n" * 50, 1), (701, "u", "y" * 3_000_000, 1), (702, "u", "z" * 99, 1), (703, "u", "z" * 99, 1)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = warc.round_trip(pages, folder).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)


def test_empty(spark, folder):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_conditions_reach_the_scan(spark, folder):
    rows = [(i, f"http://a.b/{i}", "t" * 200 if i % 2 else f"{i}" * 100, 1) for i in range(20)]
    warc.write(warc.typed_records(spark.createDataFrame(rows, SCHEMA)), folder)
    some = warc.read(spark, folder).filter("record_type = 'revisit'")
    assert some.count() == 9 and ") Filter" not in some._jdf.queryExecution().executedPlan().toString()
    reader = warc.WarcReader(folder, True)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.In(("target_uri",), ("http://a.b/2", "http://a.b/3")),
                                    warc.EqualTo(("payload_bytes",), 200)]))
    assert len(left) == 1
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_id"] for r in found] == ["<urn:page:2>"] and found[0]["payload"] == b"2" * 100


def test_unwanted_blocks_are_not_decoded(spark, folder, monkeypatch):
    rows = [(i, "u", f"{i:03}" * 60, 1) for i in range(12)]
    warc.write(warc.typed_records(spark.createDataFrame(rows, SCHEMA)), folder)
    calls = []
    monkeypatch.setattr(warc.gzip, "decompress", lambda b: calls.append(b) or b"")
    reader = warc.WarcReader(folder, True)
    list(reader.pushFilters([warc.EqualTo(("record_id",), "<urn:page:5>")]))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1 and len(calls) == 1
    reader = warc.WarcReader(folder, False)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 12 and len(calls) == 1


def test_files_outside_the_manifest_are_not_read(spark, folder):
    page = spark.createDataFrame([(1, "u", "a" * 150, 1)], SCHEMA)
    warc.write(warc.typed_records(page), folder)
    local = folder.removeprefix("file://")
    with open(os.path.join(local, "left-behind.warc"), "wb") as f:
        f.write(warc.record("response", "<urn:page:9>", None, "u", "0", b"x", 1))
    assert warc.read(spark, folder).count() == 1
    warc.write(warc.typed_records(page), folder)
    assert warc.read(spark, folder, payload=False).filter("payload is null").count() == 2


def test_record_is_plain_warc():
    data = warc.record("response", "<urn:page:1>", None, "http://a/", "ab", b"hello", 5)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert data.startswith(b"WARC/1.1\r\n") and len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
    assert gzip.decompress(rest[:-4].partition(b"\r\n\r\n")[2]) == b"hello"
