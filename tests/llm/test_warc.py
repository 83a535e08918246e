"""Archives: exact round trip, the public container format, record types against brute force."""

import hashlib
import struct

import pyarrow.fs as fs
import pytest
import zstandard

from ordersight.llm import warc as W

BIG = "<html>" + "é x " * 60 + "</html>"
PAGES = [(1, "http://a/1", BIG), (5, "http://a/5\r\nX: y", BIG), (3, None, BIG), (9, "http://é/ 9", "small"),
         (8, "http://a/8", "small"), (7, "u", None), (6, "u", ""), (2, "u", "a" * 99), (4, "u", "a" * 99),
         (11, "u", "b" * 100), (10, "u", "b" * 100), (None, "u", BIG), (12, "u", "\r\n\r\nWARC/1.1\r\n" * 40_000),
         (1, "http://a/1", BIG)]


def brute(rows):
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        refers = first.get(html) if page is not None and first.get(html) != page else None
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame([(*r, "x", 2) for r in PAGES],
                               "page_id long, url string, html string, digest string, first int").repartition(2)
    return W.write(df, str(tmp_path_factory.mktemp("warc")), frame_bytes=600).cache()


def test_round_trip(spark, index):
    rows = W.read_back(index).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)
    assert got == brute(PAGES)
    html = {p: h or "" for p, _, h in PAGES}
    assert all(r.payload == html[r.page_id] for r in rows if r.record_type == "response")
    assert all(r.payload is None for r in rows if r.record_type == "revisit")


def test_read_back_without_payloads_uses_a_set_number_of_tasks(spark, index):
    read = W.read_back(index, payloads=False, task_bytes=200)
    n_bytes = sum(r.length for r in index.collect())
    assert read.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-n_bytes // 200))
    rows = read.collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)
    assert got == brute(PAGES) and all(r.payload is None for r in rows)


def test_index_reads_one_record(spark, index):
    for r in index.collect():
        head, payload = W.read_record(r.archive, r.frame, r.offset)
        assert W._page(head["WARC-Record-ID"]) == r.page_id
        if head["WARC-Type"] == "response":
            assert hashlib.sha256(payload).hexdigest() == head["WARC-Payload-Digest"].partition(":")[2]


def test_container_is_plain_zstandard_with_seek_table(index):
    for name in {r.archive for r in index.collect()}:
        system, path = fs.FileSystem.from_uri(name)
        raw = system.open_input_file(path).read()
        n, flags, magic = struct.unpack("<IBI", raw[-9:])
        assert (flags, magic) == (0, 0x8F92EAB1) and n >= 1
        table = raw[-9 - 8 * n:-9]
        assert struct.unpack("<II", raw[-17 - 8 * n:-9 - 8 * n]) == (0x184D2A5E, 8 * n + 9)
        sizes = list(struct.iter_unpack("<II", table))
        assert sum(c for c, _ in sizes) == len(raw) - 17 - 8 * n
        at = 0
        for packed, unpacked in sizes:  # each frame stands alone
            data = zstandard.decompress(raw[at:at + packed])
            assert len(data) == unpacked and data.startswith(b"WARC/1.1\r\n")
            at += packed


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index = W.write(df, str(tmp_path))
    assert index.count() == 0 and W.read_back(index).count() == 0


def test_query_equals_sql(spark):
    from tests.llm.oracle import same_rows
    assert same_rows(spark, "op6_warc")
