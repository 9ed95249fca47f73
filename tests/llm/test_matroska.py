import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import matroska as m


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=700), st.integers(0, 60))
def test_round_trip(data, times):
    payload = m.padded(data * times)
    assert len(payload) % 64 == 0 and payload[: len(data) * times] == data * times and payload
    file = m.store(payload)
    found = m.parse(file)
    assert b"".join(file[p[7] : p[7] + p[8]] for p in found.packets) == payload
    assert found.doc_type == "matroska" and found.tracks == {1: (2, "A_PCM/INT/LIT")}
    assert [p[4] for p in found.packets] == [k * 64_000_000 for k in range(len(found.packets))]
    assert [c[2] for c in found.cues] == found.clusters and all(file[c : c + 4] == b"\x1f\x43\xb6\x75" for c in found.clusters)
    assert all(c[0] == min(p[4] for p in found.packets if p[0] == c[2]) for c in found.cues)


@pytest.mark.parametrize("lacing", m.LACINGS)
def test_lacings(lacing):
    frames = [bytes([k]) * n for k, n in enumerate([300, 5, 255, 1000, 0, 7] if lacing in ("xiph", "ebml") else [40, 40, 40] if lacing == "fixed" else [99])]
    cluster = m.element(m.CLUSTER, m.uint(m.CLUSTER_TIMESTAMP, 1000), m.laced_block(frames, -5, lacing))
    file = m.HEAD + m.element(m.SEGMENT, m.element(m.INFO, m.uint(m.TIMESTAMP_SCALE, 500_000)), cluster)
    packets = m.parse(file).packets
    assert [file[p[7] : p[7] + p[8]] for p in packets] == frames
    assert {(p[3], p[4], p[5], p[6]) for p in packets} == {(1, 995 * 500_000, lacing, True)}


def test_unknown_sizes_and_block_groups():
    block = m.laced_block([b"abc"], 7, "none")
    body = block[2:] if block[1] & 0x80 else block
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, body[0:] if body[:1] == b"\x81" else block[2:]))
    unknown = lambda ident: ident.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    file = m.HEAD + unknown(m.SEGMENT) + unknown(m.CLUSTER) + m.uint(m.CLUSTER_TIMESTAMP, 1) + group + unknown(m.CLUSTER) + m.uint(m.CLUSTER_TIMESTAMP, 20) + m.element(0xEC, b"void") + block
    found = m.parse(file)
    assert len(found.clusters) == 2 and [(p[4], p[6]) for p in found.packets] == [(8_000_000, None), (27_000_000, True)]


def test_variable_length_integers():
    for value in (0, 1, 126, 127, 128, 16382, 16383, 2**40, 2**56 - 2):
        data = m.vint(value)
        assert m.read_vint(data, 0, False) == (value, len(data), False)
    assert m.read_vint(b"\x01" + b"\xff" * 7, 0, False)[2]


def test_damaged_files_are_refused():
    file = m.store(m.padded(b"abc" * 500))
    for bad in (b"", b"\x00abc", file[:-3], file[:60], b"plain text"):
        with pytest.raises((ValueError, IndexError, struct.error)):
            m.parse(bad)


def test_packet_table(spark):
    rows = [(1, m.store(m.padded(b"q" * 5000))), (2, None), (3, b"junk"), (4, b""), (1, m.store(m.padded(b"")))]
    media = spark.createDataFrame([(*r, "x") for r in rows], "id long, media binary, track string")
    got = m.packet_table(media, "id", "media").collect()
    assert {r["id"] for r in got} == {1, 3, 4} and all(r["error"] for r in got if r["id"] in (3, 4))
    own = sorted((r["offset"], r["size"]) for r in got if r["id"] == 1)
    assert sum(n for _, n in own) == 5056 + 64 and [r["offset"] for r in got if r["cue"]] == [r["offset"] for r in got if r["id"] == 1 and r["block"] == r["frame"] == 0]


TEXTS = [(1, "hello"), (2, "hello"), (3, None), (4, ""), (5, "é" * 40_000), (5, "x" * 64), (None, "y")]


def test_features_of_texts(spark):
    docs = spark.createDataFrame([(*r, 1) for r in TEXTS], "doc_id long, text string, n_bytes long")
    got = sorted(map(tuple, m.media_features(docs).collect()), key=str)
    want = []
    for i, text in TEXTS:
        raw = (text or "").encode()
        payload = raw + bytes((-len(raw)) % 64) if raw else bytes(64)
        file = m.store(payload)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), m.features(payload, m.parse(file))))
    assert got == sorted(want, key=str)
    assert m.media_features(docs.limit(0)).count() == 0


def test_query_covers_the_whole_table(spark):
    from concord.llm.queries import op5_matroska

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op5_matroska(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["n_bytes"] == len(raw) and r["payload_sha256"] == hashlib.sha256(m.padded(raw)).hexdigest()
