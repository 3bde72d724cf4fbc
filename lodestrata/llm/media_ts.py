"""Media columns: MPEG transport streams.

mux() stores bytes as the one elementary stream of a program: access units of UNIT bytes become PES packets with
presentation times, PES packets become 188-byte transport packets, and program tables (PAT, PMT) stand before each
random-access point.  demux() reads such a stream: it parses the tables, checks continuity counters of every packet
identifier, drops repeated packets, reassembles the elementary stream's PES packets and gives the payload with the
timestamps and random-access points.

Cases: bytes that are no multiple of 188, or a packet without its sync byte, are skipped and counted (sync_errors); a PES
packet before the first start, or without a table that names its stream, is dropped; empty payloads give a stream of
tables only.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PACKET, BODY = 188, 184
PMT_PID, STREAM_PID, PROGRAM, PRIVATE_DATA, PES_ID = 0x1000, 0x0100, 1, 0x06, 0xBD
UNIT, TICKS, RAP_EVERY, PAD = 1 << 14, 3600, 4, 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    n = 5 + len(body) + 4
    head = bytes([table, 0xB0 | n >> 8, n & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))), _table_packet(
    PMT_PID, _section(2, PROGRAM, bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0, PRIVATE_DATA, 0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0]))
)


def _stamp(kind: int, t: int) -> bytes:
    return bytes([kind << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def mux(payload: bytes, unit: int = UNIT, rap_every: int = RAP_EVERY) -> bytes:
    """A transport stream that holds payload; equal payloads give equal streams."""
    out, counter, tables = [], 0, 0
    for k, start in enumerate(range(0, len(payload), unit)):
        data = payload[start : start + unit]
        time = (k + 1) * TICKS
        rap = k % rap_every == 0
        if rap:
            for packet in _TABLES:
                out.append(packet[:3] + bytes([0x10 | tables & 15]) + packet[4:])
            tables += 1
        pes = b"\x00\x00\x01" + bytes([PES_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, time) + data
        # the first packet has the flags, and the clock at a random-access point
        clock = (time << 15 | 0x7E << 8).to_bytes(6, "big") if rap else b""
        field_ = bytes([0x50 if rap else 0]) + clock
        room = BODY - 1 - len(field_)
        first, rest = pes[:room], pes[room:]
        field_ += b"\xff" * (room - len(first))
        out.append(bytes([0x47, 0x40 | STREAM_PID >> 8, STREAM_PID & 255, 0x30 | counter & 15, len(field_)]) + field_ + first)
        counter += 1
        whole = len(rest) // BODY
        if whole:
            block = np.empty((whole, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
            block[:, 3] = 0x10 | (np.arange(counter, counter + whole) & 15)
            block[:, 4:] = np.frombuffer(rest, np.uint8, whole * BODY).reshape(whole, BODY)
            out.append(block.tobytes())
            counter += whole
        if tail := rest[whole * BODY :]:
            stuff = BODY - len(tail) - 1
            field_ = bytes([stuff]) + (b"\x00" + b"\xff" * (stuff - 1) if stuff else b"")
            out.append(bytes([0x47, STREAM_PID >> 8, STREAM_PID & 255, 0x30 | counter & 15]) + field_ + tail)
            counter += 1
    return b"".join(out) or b"".join(_TABLES)


@dataclass
class Stream:
    payload: bytes = b""
    programs: int = 0
    streams: int = 0
    packets: int = 0
    sync_errors: int = 0
    continuity_errors: int = 0
    crc_errors: int = 0
    stamps: list = field(default_factory=list)  # presentation time of each access unit
    starts: list = field(default_factory=list)  # where it begins in the payload
    random_access: list = field(default_factory=list)  # numbers of the access units to which a reader can jump

    def feature(self) -> str:
        first, last = (self.stamps[0], self.stamps[-1]) if self.stamps else (-1, -1)
        return (
            f"programs={self.programs};streams={self.streams};packets={self.packets};units={len(self.stamps)};pts={first}-{last};"
            f"rap={','.join(map(str, self.random_access))};cc={self.continuity_errors};crc={self.crc_errors};sync={self.sync_errors}"
        )


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _sections(grid: np.ndarray, begin: np.ndarray, rows: np.ndarray, out: Stream) -> list[bytes]:
    """Distinct whole sections of the packets in rows that start one."""
    found = {}
    for i in rows:
        data = grid[i].tobytes()[begin[i] :]
        if not grid[i, 1] & 0x40 or not data:
            continue
        section = data[1 + data[0] :]
        n = 3 + ((section[1] & 15) << 8 | section[2]) if len(section) > 3 else 0
        if n < 12 or len(section) < n or section_crc(section[:n]):
            out.crc_errors += 1
            continue
        found[section[:n]] = None
    return list(found)


def demux(data: bytes) -> Stream:
    """What a transport stream holds."""
    out = Stream()
    n = len(data) // PACKET
    out.sync_errors += len(data) != n * PACKET
    grid = np.frombuffer(data, np.uint8, n * PACKET).reshape(n, PACKET)
    good = grid[:, 0] == 0x47
    if not good.all():
        out.sync_errors += int((~good).sum())
        grid = grid[good]
    out.packets = len(grid)
    pid = (grid[:, 1].astype(np.int32) & 31) << 8 | grid[:, 2]
    has = grid[:, 3] >> 4 & 3
    begin = np.where(has & 2, 5 + grid[:, 4].astype(np.int32), 4)
    begin[(has & 1) == 0] = PACKET
    np.minimum(begin, PACKET, out=begin)
    keep = np.ones(len(grid), bool)
    for p in np.unique(pid):
        at = np.flatnonzero((pid == p) & (has & 1 == 1))
        step = np.diff(grid[at, 3] & 15) & 15
        again = np.flatnonzero(step == 0) + 1
        again = again[(grid[at[again], 4:] == grid[at[again - 1], 4:]).all(axis=1)] if len(again) else again
        keep[at[again]] = False
        out.continuity_errors += int((step != 1).sum()) - len(again)
    maps = {}
    for s in _sections(grid, begin, np.flatnonzero(pid == 0), out):
        for i in range(8, len(s) - 4, 4):
            if number := s[i] << 8 | s[i + 1]:
                maps[number] = (s[i + 2] & 31) << 8 | s[i + 3]
    out.programs = len(maps)
    streams = {}
    for p in maps.values():
        for s in _sections(grid, begin, np.flatnonzero(pid == p), out):
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while i + 5 <= len(s) - 4:
                streams[(s[i + 1] & 31) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    out.streams = len(streams)
    parts, size = [], 0
    for p in streams:
        rows = np.flatnonzero((pid == p) & keep)
        own, first = grid[rows], begin[rows]
        joined = own[np.arange(PACKET)[None, :] >= first[:, None]].tobytes()
        ends = np.cumsum(PACKET - first)
        heads = np.flatnonzero(own[:, 1] & 0x40)
        limits = [int(ends[i] - (PACKET - first[i])) for i in heads] + [len(joined)]
        for j, i in enumerate(heads):
            pes = joined[limits[j] : limits[j + 1]]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                continue
            told = pes[4] << 8 | pes[5]
            unit = pes[9 + pes[8] : 6 + told if told else None]
            out.stamps.append(_read_stamp(pes[9:14]) if pes[7] & 0x80 else -1)
            out.starts.append(size)
            if own[i, 3] & 0x20 and own[i, 4] and own[i, 5] & 0x40:
                out.random_access.append(len(out.stamps) - 1)
            parts.append(unit)
            size += len(unit)
    out.payload = b"".join(parts)
    return out


def padded(text: bytes, pad: int = PAD) -> bytes:
    """text with bytes 0 appended up to a positive multiple of pad."""
    return text + b"\x00" * (max(1, -(-len(text) // pad)) * pad - len(text))


def media_column(text: Column) -> Column:
    """binary: the padded text as a transport stream; a null text is an empty one."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([mux(padded((x.as_py() or "").encode("utf-8", "replace"))) for x in texts], pa.binary())

    return F.arrow_udf(run, "binary")(text)


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pts array<bigint>, random_access array<bigint>"


def features_column(media: Column) -> Column:
    """What a stored stream holds, read back from its bytes; null media is an empty stream."""
    kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())
    fields = [pa.field(x.split()[0], k) for x, k in zip(FEATURES.split(", "), kinds)]

    def run(streams: pa.Array) -> pa.Array:
        rows = []
        for x in streams:
            data = x.as_py() or b""
            s = demux(data)
            rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), s.feature(), s.stamps, s.random_access))
        cols = list(zip(*rows)) if rows else [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], fields=fields)

    return F.arrow_udf(run, f"struct<{', '.join(x.replace(' ', ': ', 1) for x in FEATURES.split(', '))}>")(media)
