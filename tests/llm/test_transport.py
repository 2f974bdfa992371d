import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from streamwin.llm import transport as T


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000))
def test_exact_round_trip(payload):
    stream = T.mux(payload)
    found = T.demux(stream)
    assert len(stream) % T.PACKET == 0 and b"".join(u[3] for u in found["units"]) == payload
    assert [found[k] for k in ("counter_errors", "section_errors", "unit_errors", "lost_sync", "trailing_bytes")] == [0] * 5


def test_tables_timestamps_and_points():
    found = T.demux(T.mux(bytes(T.UNIT_BYTES * 20)))
    assert found["programs"] == {1: T.PMT_PID} and found["streams"] == {T.DATA_PID: 6}
    assert [u[1] for u in found["units"]] == [i * T.UNIT_TICKS for i in range(20)]
    assert [i for i, u in enumerate(found["units"]) if u[2]] == [0, 8, 16]


def test_checksum_of_a_known_table():
    # A program association table with one program (1, table at PID 0x1000), as in common streams.
    section = bytes.fromhex("00b00d0001c100000001f000")
    assert T.crc32_mpeg2(section).to_bytes(4, "big").hex() == "2ab104b2"
    assert T.crc32_mpeg2(b"123456789") == 0x0376E6E7


def test_damage_is_counted():
    stream = T.mux(bytes(range(256)) * 64)
    lost = stream[: T.PACKET * 5] + stream[T.PACKET * 6 :]
    assert T.demux(lost)["counter_errors"] == 1
    broken = bytearray(stream)
    broken[T.PACKET * 4] = 0
    assert T.demux(bytes(broken))["lost_sync"] == 1
    broken = bytearray(stream)
    broken[10] ^= 1
    assert T.demux(bytes(broken))["section_errors"] >= 1
    twice = stream[: T.PACKET * 5] + stream[T.PACKET * 4 : T.PACKET * 5] + stream[T.PACKET * 5 :]
    assert T.demux(twice)["counter_errors"] == 0 and T.demux(twice)["units"] == T.demux(stream)["units"]
    assert T.demux(stream + b"\x47\x01")["trailing_bytes"] == 2
    for odd in (b"", b"\x47", b"\x47" * 188, b"\x00" * 376):
        assert T.demux(odd)["units"] == []


def test_digests(odd_docs):
    rows = T.media_digests(T.with_media(odd_docs)).collect()
    want = {}
    for r in odd_docs.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.setdefault(r.doc_id, []).append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32))
    assert got == want
    same = {r.payload_sha256: set() for r in rows}
    for r in rows:
        same[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())
    # The points are those of the index of units.
    units = T.media_units(T.with_media(odd_docs)).where("random_access and doc_id = 8").orderBy("unit").collect()
    assert next([(p.pts, p.byte_offset) for p in r.points] for r in rows if r.doc_id == 8) == [(u.pts, u.byte_offset) for u in units] and units


def test_stored_streams_are_the_streams(spark, documents, sf_dir):
    from streamwin.llm import catalog

    plain = T.media_digests(T.with_media(documents))
    assert catalog.op1_transport_stream(spark, sf_dir).exceptAll(plain).isEmpty() and plain.count() == documents.count()


def test_units(odd_docs):
    rows = T.media_units(T.with_media(odd_docs)).where("doc_id = 8").orderBy("unit").collect()
    assert [r.byte_offset for r in rows] == [i * T.UNIT_BYTES for i in range(len(rows))] and rows[0].random_access
    assert T.with_media(odd_docs.limit(0)).isEmpty()
