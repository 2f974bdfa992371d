"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``mux`` stores a payload as a single-program transport stream: a program
association table, a program map table and one elementary stream of private
data, cut into access units with presentation timestamps; every few units there
is a random-access point with a clock reference. ``demux`` reads any transport
stream: it parses the program tables, checks section checksums and continuity
counters, reassembles elementary packets and finds timestamps and random-access
points.

Null payloads count as empty. Damaged streams don't raise: packets without the
sync byte and bytes after the last whole packet are counted and skipped, gaps in
a continuity counter are counted, and an elementary packet without a valid
header is counted and left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, texts

# Fixed values of the format.
PACKET = 188
BODY = 184
SYNC = 0x47
PAT_PID = 0x0000
NULL_PID = 0x1FFF
PRIVATE_DATA_STREAM_TYPE = 0x06
PRIVATE_STREAM_1 = 0xBD
CLOCK_HZ = 90_000

# Our choices.
PMT_PID = 0x1000
DATA_PID = 0x0101
UNIT_BYTES = 4096
UNIT_TICKS = CLOCK_HZ // 25
UNITS_PER_POINT = 8
ALIGN = 64


_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def crc32_mpeg2(data: bytes) -> int:
    """The sections' checksum: zlib's polynomial, bits in the other order, not inverted at the end."""
    return int(f"{zlib.crc32(data.translate(_REVERSED)) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _section(table_id: int, number: int, entries: bytes) -> bytes:
    """A long-form section of version 0, with its checksum."""
    head = bytes([table_id]) + (0xB000 | (5 + len(entries) + 4)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + entries + crc32_mpeg2(head + entries).to_bytes(4, "big")


_PAT = _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(0x02, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA_STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter]) + b"\x00" + section).ljust(PACKET, b"\xff")


def _timestamp(ticks: int) -> bytes:
    """The 33 bits of a presentation timestamp, with marker bits."""
    return bytes([0x21 | (ticks >> 29) & 0x0E, (ticks >> 22) & 0xFF, 0x01 | (ticks >> 14) & 0xFE, (ticks >> 7) & 0xFF, 0x01 | (ticks << 1) & 0xFE])


def _clock(ticks: int) -> bytes:
    """The adaptation field's flags (random access, clock) and clock reference."""
    return b"\x50" + ((ticks << 15) | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """``payload`` as a transport stream."""
    out = []
    counter = tables = 0
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        ticks = unit * UNIT_TICKS % (1 << 33)
        field = b""
        if unit % UNITS_PER_POINT == 0:
            out += [_table_packet(PAT_PID, tables, _PAT), _table_packet(PMT_PID, tables, _PMT)]
            tables = (tables + 1) % 16
            field = _clock(ticks)
        piece = payload[at : at + UNIT_BYTES]
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (8 + len(piece)).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(ticks) + piece
        first = BODY - (1 + len(field) if field else 0)
        bodies = [data[:first], *(data[i : i + BODY] for i in range(first, len(data), BODY))]
        for i, body in enumerate(bodies):
            adapt = field if i == 0 else b""
            room = BODY - len(body)
            if room:  # an adaptation field takes the room: its length byte, flags if any, then stuffing
                stuffed = (adapt or b"\x00")[: room - 1]
                adaptation = bytes([room - 1]) + stuffed.ljust(room - 1, b"\xff")
            else:
                adaptation = b""
            out.append(bytes([SYNC, (0x40 if i == 0 else 0) | DATA_PID >> 8, DATA_PID & 0xFF, (0x30 if adaptation else 0x10) | counter]) + adaptation + body)
            counter = (counter + 1) % 16
    return b"".join(out)


def _sections(packets: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], int]:
    """Whole sections that begin in the given packets of one PID, and the number with a bad checksum."""
    whole, bad = [], 0
    tail = b""
    for packet, begins, offset in zip(packets, starts, offsets):
        body = packet[offset:].tobytes()
        if begins:
            pointer = body[0] if body else 0
            tail, body = body[1 + pointer :], b""
        tail += body
        while len(tail) >= 3 and tail[0] != 0xFF:
            size = 3 + (int.from_bytes(tail[1:3], "big") & 0x0FFF)
            if len(tail) < size:
                break
            section, tail = tail[:size], tail[size:]
            if size >= 12 and crc32_mpeg2(section) == 0:
                whole.append(section)
            else:
                bad += 1
    return list(dict.fromkeys(whole)), bad


def _pes_units(body: bytes) -> tuple[int | None, bytes] | None:
    """Timestamp and data of one elementary packet; None if it has no valid header."""
    if len(body) < 9 or body[:3] != b"\x00\x00\x01" or body[6] & 0xC0 != 0x80:
        return None
    size, head = int.from_bytes(body[4:6], "big"), 9 + body[8]
    end = 6 + size if size else len(body)
    if end > len(body) or head > end:
        return None
    ticks = None
    if body[7] & 0x80 and body[8] >= 5:
        b = body[9:14]
        ticks = (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1
    return ticks, body[head:end]


def demux(stream: bytes) -> dict:
    """What a transport stream holds.

    programs: {program: table PID}; streams: {PID: stream type}; units: list of
    (PID, timestamp or None, random access, data); packets, lost_sync,
    trailing_bytes, counter_errors, section_errors, unit_errors: counts.
    """
    whole = len(stream) // PACKET
    every = np.frombuffer(stream, np.uint8, whole * PACKET).reshape(whole, PACKET)
    packets = every[every[:, 0] == SYNC]
    out = {"programs": {}, "streams": {}, "units": [], "packets": len(packets), "lost_sync": whole - len(packets), "trailing_bytes": len(stream) - whole * PACKET, "counter_errors": 0, "section_errors": 0, "unit_errors": 0}
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    starts = (packets[:, 1] & 0x40) != 0
    adapted, filled = (packets[:, 3] & 0x20) != 0, (packets[:, 3] & 0x10) != 0
    offsets = np.minimum(np.where(adapted, 5 + packets[:, 4].astype(np.int32), 4), PACKET)
    flags = np.where(adapted & (packets[:, 4] > 0), packets[:, 5], 0)
    rows = {}
    for pid in np.unique(pids).tolist():
        at = np.flatnonzero((pids == pid) & filled)
        if pid == NULL_PID or not len(at):
            continue
        step = np.diff((packets[at, 3] & 0x0F).astype(np.int32)) % 16
        if len(at) > 1:
            again = (step == 0) & (packets[at[1:], 1:] == packets[at[:-1], 1:]).all(axis=1)  # a packet may be sent twice
            jump = (flags[at[1:]] & 0x80) != 0  # announced
            out["counter_errors"] += int(((step != 1) & ~again & ~jump).sum())
            at = np.concatenate([at[:1], at[1:][~again]])
        rows[pid] = at
    if PAT_PID in rows:
        at = rows[PAT_PID]
        found, bad = _sections(packets[at], starts[at], offsets[at])
        out["section_errors"] += bad
        for s in found:
            for i in range(8, len(s) - 4, 4):
                if number := int.from_bytes(s[i : i + 2], "big"):
                    out["programs"][number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    for pid in dict.fromkeys(out["programs"].values()):
        if (at := rows.get(pid)) is None:
            continue
        found, bad = _sections(packets[at], starts[at], offsets[at])
        out["section_errors"] += bad
        for s in found:
            i = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
            while i + 5 <= len(s) - 4:
                out["streams"][int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0x0FFF)
    columns = np.arange(PACKET)
    for pid in out["streams"]:
        at = rows.get(pid)
        if at is None:
            continue
        begins = np.flatnonzero(starts[at])
        if not len(begins):
            continue
        at = at[begins[0] :]
        begins = begins - begins[0]
        data = packets[at][columns >= offsets[at][:, None]]
        ends = np.cumsum(PACKET - offsets[at])
        cuts = np.concatenate([[0], ends])[begins].tolist() + [len(data)]
        points = (flags[at[begins]] & 0x40) != 0
        for a, b, point in zip(cuts, cuts[1:], points.tolist()):
            unit = _pes_units(data[a:b].tobytes())
            if unit is None:
                out["unit_errors"] += 1
            else:
                out["units"].append((pid, unit[0], point, unit[1]))
    return out


def padded(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    data = text.encode()
    return data.ljust(max(1, -(-len(data) // ALIGN)) * ALIGN, b"\x00")


def feature(found: dict) -> str:
    """One line on a stream: its tables, counts, timestamps and random-access points."""
    times = [u[1] for u in found["units"] if u[1] is not None]
    points = [u[1] for u in found["units"] if u[2]]
    return (
        f"programs={','.join(f'{n}:{p}' for n, p in sorted(found['programs'].items()))}"
        f" streams={','.join(f'{p}:{t}' for p, t in sorted(found['streams'].items()))}"
        f" packets={found['packets']} units={len(found['units'])}"
        f" counter_errors={found['counter_errors']} section_errors={found['section_errors']}"
        f" unit_errors={found['unit_errors']} lost_sync={found['lost_sync']} trailing_bytes={found['trailing_bytes']}"
        f" first_pts={times[0] if times else '-'} last_pts={times[-1] if times else '-'}"
        f" random_access={len(points)} last_point={points[-1] if points else '-'}"
    )


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text, padded, as a transport stream."""

    def make() -> Callable[..., Iterable[tuple]]:
        return lambda doc_id, text: [(doc_id, len(text.encode()), mux(padded(text)))]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(texts(docs, id_col, text_col), make, f"doc_id {kind}, n_bytes long, media binary")


def media_units(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each elementary packet of each stream: its place, timestamp
    (ticks and seconds), random-access flag, and where its data lie in the payload."""

    def make() -> Callable[..., Iterable[tuple]]:
        def each(doc_id, stream):
            at: dict[int, int] = {}
            for n, (pid, ticks, point, data) in enumerate(demux(stream or b"")["units"]):
                yield doc_id, n, pid, ticks, None if ticks is None else ticks / CLOCK_HZ, point, at.get(pid, 0), len(data)
                at[pid] = at.get(pid, 0) + len(data)

        return each

    kind = media.schema[id_col].dataType.simpleString()
    return map_rows(media.select(id_col, media_col), make, f"doc_id {kind}, unit int, pid int, pts long, seconds double, random_access boolean, byte_offset long, n_bytes long")


def media_digests(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored stream gives back: size and digests
    of payload and stream, the feature line, and the random-access points with
    their timestamps and places in the payload."""

    def make() -> Callable[..., Iterable[tuple]]:
        def each(doc_id, n_bytes, stream):
            found = demux(stream)
            payload = b"".join(u[3] for u in found["units"])
            points, at = [], 0
            for _, ticks, point, data in found["units"]:
                if point:
                    points.append({"pts": ticks, "byte_offset": at})
                at += len(data)
            yield (
                doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]),
                len(stream), hashlib.sha256(stream).hexdigest(), feature(found), points,
            )

        return each

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_rows(media, make, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, points array<struct<pts: bigint, byte_offset: bigint>>")
