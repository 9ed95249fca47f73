import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.oracle import duckdb_rows, spark_rows

from concord.llm import warc as w


def stream(records):
    return b"".join(w.record_header(i, "http://x/ y", "d", None, False, len(p)) + p + b"\r\n\r\n" for i, p in records)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=6), st.integers(1, 50), st.booleans())
def test_streams_cut_anywhere_give_their_records(payloads, cut, gzip):
    """Payloads may hold what looks like headers and record ends."""
    payloads = [p + b"\r\n\r\nWARC/1.1\r\n" * (len(p) % 3 == 0) for p in payloads]
    data = stream(enumerate(payloads))
    if gzip:
        parts = [stream([(i, p)]) for i, p in enumerate(payloads)]
        data = b"".join(c.compress(x) + c.flush() for x in parts for c in [zlib.compressobj(1, wbits=31)])
    parser, got, own = w.Parser(), [], b""
    for k in range(0, len(data), cut):
        for header, number, piece, size, digest, last in (parser.read if gzip else parser.feed)(data[k : k + cut]):
            own = bytes(piece) if number == 0 else own + bytes(piece)
            assert size == len(own) and digest == hashlib.sha256(own).hexdigest()
            if last:
                got.append((header["warc-record-id"], own))
    assert got == [(f"<{w.ID_PREFIX}{i}>", p) for i, p in enumerate(payloads)]


def test_damaged_streams_are_refused():
    data = bytearray(stream([(1, b"abc"), (2, b"def")]))
    with pytest.raises(ValueError):
        list(w.Parser().feed(data.replace(b"Content-Length: 3", b"Content-Length: 2", 1)))
    with pytest.raises(ValueError):
        list(w.Parser().feed(b"no record at all\r\n\r\n"))


BIG = "x" * 150
ROWS = [(5, "u5", BIG), (3, "u3", BIG), (9, "u9", BIG), (4, "u", "small"), (2, None, "small"), (6, "u6", None), (7, "u7", ""), (3, "u3", BIG), (None, "n", BIG), (8, "ü", "é" * 50), (10, "u10", "é" * 50), (11, "long", "y" * 700_000)]


def plain(rows):
    first = {}
    for i, _, p in rows:
        if i is not None and len((p or "").encode()) >= 100:
            first[p] = min(first.get(p, i), i)
    out, seen = [], set()
    for i, _, p in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (p or "").encode()
        lead = len(data) < 100 or first[p] == i and p not in seen
        seen.add(p)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if lead else "revisit", None if lead else first[p]))
    return sorted(out, key=str)


def test_archives_hold_nulls_copies_ties_and_long_payloads(spark, monkeypatch):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string")
    got = w.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == plain(ROWS)
    monkeypatch.setattr(w, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, w.archived(pages).select(*got.columns).collect()), key=str) == plain(ROWS)


def test_ids_of_any_characters_come_back(spark):
    ids = ["", " ", "a b", "line\r\nbreak: x", "<>%25", "ü/#", "plain", "null", None, None]
    pages = spark.createDataFrame([(i, "u", "y" * 200) for i in ids] + [(i, "u", f"z{k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    rows = w.archived(pages).collect()
    assert sorted(str(r["page_id"]) for r in rows) == sorted(str(i) for i in ids * 2) and sum(r["page_id"] is None for r in rows) == 4
    big = [r for r in rows if r["payload_bytes"] == 200]
    assert [r["page_id"] for r in big if r["record_type"] == "response"] == [""] and all(r["refers_to"] == "" for r in big if r["record_type"] == "revisit")
    alone = spark.createDataFrame([(None, "u", "y" * 200)] * 2, "page_id string, url string, html string")
    assert [(r["record_type"], r["refers_to"]) for r in w.archived(alone).collect()] == [("response", None)] * 2


def test_chunk_rows_carry_running_digests(spark):
    pages = spark.createDataFrame([(1, "u", "z" * 1_000_000), (2, "v", "")], "page_id long, url string, html string")
    rows = w.record_chunks(w.write_archives(w.planned(pages).coalesce(1))).orderBy("record", "chunk").collect()
    assert max(len(r["payload"]) for r in rows) <= w.CHUNK
    for i in ("1", "2"):
        data = b""
        for k, r in enumerate(r for r in rows if r["record_id"] == i):
            data += r["payload"]
            assert r["chunk"] == k and r["bytes_so_far"] == len(data) and r["digest_so_far"] == hashlib.sha256(data).hexdigest()
        assert data == (b"z" * 1_000_000 if i == "1" else b"") and r["last"]


def test_archives_close_by_size(spark):
    rng = random.Random(1)
    pages = spark.createDataFrame([(i, "u", rng.randbytes(40_000).hex()) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    rows = w.planned(pages).coalesce(1)
    chunks = rows.mapInArrow(lambda b: w.write_chunks(b, 50_000, 300_000), "archive long, chunk long, data binary").persist()
    assert chunks.select("archive").distinct().count() > 1 and chunks.agg(F.max(F.length("data"))).first()[0] <= 50_000
    got = w.record_chunks(chunks, False, True)
    assert sorted(int(r["record_id"]) for r in got.collect()) == list(range(30)) and got.where("digest_so_far <> payload_digest").count() == 0


def test_empty_table(spark):
    assert w.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_matches_its_sql(spark):
    from concord.llm.queries import OP9_SQL, op9_warc

    d = "/root/testdata/sf0.001"
    assert spark_rows(op9_warc(spark, d)) == duckdb_rows(OP9_SQL, d)
