"""MPEG-2 transport streams as a media column: a writer, and a reader that trusts nothing but the packets.

The writer carries a payload as one private elementary stream: PES packets of at
most ``UNIT`` bytes, each with a presentation timestamp, cut into 188-byte transport
packets. Every ``RANDOM_ACCESS``-th unit is a random-access point, announced by a
PAT and a PMT and flagged, with a clock reference, in its adaptation field. The
reader finds the stream through the program tables, whose sections may span packets,
checks their CRCs and the continuity counters of tables and stream, drops packets sent
twice, reassembles the PES packets and lists their timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import batch_of, lean, text_buffers

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID = 188, 0x47, 0x0000
PRIVATE_STREAM_1, PRIVATE_DATA = 0xBD, 0x06
CLOCK = 90_000

# Choices of this writer.
PMT_PID, ES_PID, PROGRAM, STREAM_ID = 0x1000, 0x0100, 1, 1
UNIT, RANDOM_ACCESS, TICKS = 16_384, 8, 3_600
#: Payloads are padded with bytes 0 to a positive multiple of this.
ALIGN = 64


class MediaError(ValueError):
    """The bytes are no transport stream that this reader can follow."""


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytearray:
    """With continuity counter 0; the writer sets the counter of each copy."""
    return bytearray(bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0x00, STREAM_ID, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def _pcr_bytes(pts: int) -> bytes:
    return ((pts << 15) | 0x7E00).to_bytes(6, "big")


def write_ts(payload: bytes) -> bytes:
    """The transport stream that carries ``payload``."""
    out, cc, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], k * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + unit
        access = k % RANDOM_ACCESS == 0
        if access:
            for table in (_PAT, _PMT):
                table[3] = 0x10 | tables & 15
                out.append(bytes(table))
            tables += 1
        first = min(len(pes), 176 if access else 184)
        field_ = b"\x50" + _pcr_bytes(pts) if access else b""
        fill = 184 - first
        if fill:
            field_ = (field_ or (b"\x00" if fill > 1 else b"")).ljust(fill - 1, b"\xff")
            field_ = bytes([len(field_)]) + field_
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, (0x30 if fill else 0x10) | cc & 15]) + field_ + pes[:first])
        cc += 1
        rest = len(pes) - first
        if full := rest // 184:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
            packets[:, 3] = 0x10 | (cc + np.arange(full)) & 15
            packets[:, 4:] = np.frombuffer(pes, np.uint8, full * 184, first).reshape(full, 184)
            out.append(packets.tobytes())
            cc += full
        if tail := rest - full * 184:
            fill = 184 - tail
            stuffing = bytes([fill - 1]) + (b"\x00" if fill > 1 else b"").ljust(fill - 1, b"\xff")
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x30 | cc & 15]) + stuffing + pes[-tail:])
            cc += 1
    return b"".join(out)


@dataclass
class Stream:
    """What the reader found. ``random_access``: (pts, packet number) of each entry point."""

    payload: bytes
    packets: int
    es_pid: int
    stream_type: int
    continuity_errors: int
    pts: list[int] = field(default_factory=list)
    random_access: list[tuple[int, int]] = field(default_factory=list)

    def feature(self) -> str:
        span = f"{self.pts[0]}-{self.pts[-1]}" if self.pts else "-"
        return f"packets={self.packets};pid={self.es_pid};type={self.stream_type};units={len(self.pts)};pts={span};random_access={len(self.random_access)};continuity_errors={self.continuity_errors}"


def _payload_starts(packets: np.ndarray) -> np.ndarray:
    """The byte at which each packet's payload begins."""
    at = 4 + np.where(packets[:, 3] & 0x20, 1 + packets[:, 4].astype(np.int16), 0)
    if (at > PACKET).any():
        raise MediaError("an adaptation field leaves its packet")
    return at


def _flags(packets: np.ndarray) -> np.ndarray:
    """The flags of each packet's adaptation field, 0 where it has none."""
    return np.where((packets[:, 3] & 0x20 > 0) & (packets[:, 4] > 0), packets[:, 5], 0)


def in_order(packets: np.ndarray) -> tuple[np.ndarray, int]:
    """Which packets with payload of one pid are no duplicates, and the continuity errors among them.

    A packet may be sent twice in a row: same counter, same bytes but for a clock reference.
    Where a packet is flagged as a discontinuity, its counter may be any.
    """
    counters = (packets[:, 3] & 15).astype(np.int16)
    step = np.diff(counters) % 16
    keep = np.ones(len(packets), bool)
    for i in np.flatnonzero(step == 0) + 1:
        a, b = packets[i - 1].copy(), packets[i].copy()
        if _flags(packets[i : i + 1])[0] & 0x10:
            a[6:12] = b[6:12] = 0
        keep[i] = not (keep[i - 1] and (a == b).all())
    free = _flags(packets)[1:] & 0x80 > 0
    return keep, int(((step != 1) & keep[1:] & ~free).sum())


def _sections(packets: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The whole sections of a table's pid, in order, each checked by its CRC; a repeated one is listed once."""
    out, pending = {}, None
    for packet, at in zip(packets[keep], _payload_starts(packets[keep])):
        data = packet[at:].tobytes()
        if packet[1] & 0x40:
            if not data or 1 + data[0] > len(data):
                raise MediaError("a program table leaves its packet")
            # What stands before the pointed-to byte ends the section that is under way.
            parts = [(pending + data[1 : 1 + data[0]]) if pending else b"", data[1 + data[0] :]]
        else:
            parts = [pending + data if pending else b""]
        for data in parts:
            pending = None
            while data and data[0] != 0xFF:
                size = 3 + ((data[1] & 0x0F) << 8 | data[2]) if len(data) >= 3 else PACKET
                if size > len(data):
                    pending = data
                    break
                if crc32_mpeg(data[:size]) != 0:
                    raise MediaError("a program table fails its CRC")
                out[data[:size]] = None
                data = data[size:]
    return list(out)


def read_ts(media: bytes) -> Stream:
    """Follow PAT and PMT to the first elementary stream and reassemble it."""
    if not media or len(media) % PACKET:
        raise MediaError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any() or (packets[:, 1] & 0x80).any():
        raise MediaError("sync lost, or a packet is marked as damaged")
    pids = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    errors = 0

    def table(pid: int, kind: int) -> list[bytes]:
        nonlocal errors
        own = packets[(pids == pid) & (packets[:, 3] & 0x10 > 0)]
        keep, wrong = in_order(own) if len(own) else (np.zeros(0, bool), 0)
        errors += wrong
        # Tables that are announced for later don't count yet.
        return [x for x in _sections(own, keep) if x[0] == kind and x[5] & 1]

    programs = [x[i : i + 4] for x in table(PAT_PID, 0x00) for i in range(8, len(x) - 4, 4)]
    if not programs:
        raise MediaError("no program association table")
    number, pmt_pid = next(((p[:2], int.from_bytes(p[2:], "big") & 0x1FFF) for p in programs if p[:2] != b"\0\0"), (b"", -1))
    pmt = next((x for x in table(pmt_pid, 0x02) if x[3:5] == number), None)
    if pmt is None:
        raise MediaError("no program map table")
    at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    if at + 5 > len(pmt) - 4:
        raise MediaError("the program has no stream")
    kind, es_pid = pmt[at], (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]

    numbers = np.flatnonzero((pids == es_pid) & (packets[:, 3] & 0x10 > 0))
    if len(numbers):
        keep, wrong = in_order(packets[numbers])
        errors, numbers = errors + wrong, numbers[keep]
    es = packets[numbers]
    control = es[:, 3] >> 4 & 3
    begin = _payload_starts(es) - 4
    body = es[:, 4:][np.arange(184) >= begin[:, None]].tobytes()
    ends = np.cumsum(184 - begin)
    heads = np.flatnonzero(es[:, 1] & 0x40)
    at = [int(ends[i] - 184 + begin[i]) for i in heads] + [len(body)]
    out = Stream(b"", len(packets), es_pid, kind, errors)
    units = []
    if len(body) and (not len(heads) or heads[0]):
        raise MediaError("the stream begins inside a unit")
    for i, lo, hi in zip(heads, at, at[1:]):
        if body[lo : lo + 3] != b"\0\0\1":
            raise MediaError("no PES start code at a unit start")
        size, skip = int.from_bytes(body[lo + 4 : lo + 6], "big"), 9 + body[lo + 8]
        if size and 6 + size > hi - lo:
            raise MediaError("a PES packet is cut short")
        units.append(body[lo + skip : lo + 6 + size if size else hi])
        if body[lo + 7] & 0x80:
            p = body[lo + 9 : lo + 14]
            pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
            out.pts.append(pts)
            if control[i] & 2 and es[i, 4] and es[i, 5] & 0x40:
                out.random_access.append((pts, int(numbers[i])))
    out.payload = b"".join(units)
    return out


_MEDIA = "doc_id long, n_bytes long, media binary"
_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, continuity_errors long, pts array<long>, random_access array<struct<pts: long, packet: long>>, error string"


def _write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    for batch in batches:
        raw, at = text_buffers(batch.column(1))
        for lo in range(0, batch.num_rows, 500):
            hi = min(batch.num_rows, lo + 500)
            media, sizes = [], np.diff(at[lo : hi + 1])
            for a, n in zip(at[lo:hi], sizes):
                n = int(n)
                media.append(write_ts(raw[a : a + n].tobytes().ljust(max(ALIGN, -(-n // ALIGN) * ALIGN), b"\0")))
            yield batch_of(schema, batch.column(0).slice(lo, hi - lo), sizes, media)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entry = pa.struct([("pts", pa.int64()), ("packet", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("continuity_errors", pa.int64()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(entry)), ("error", pa.string())])
    for batch in batches:
        rows = []
        for media in batch.column(2):
            view = media.as_buffer().to_pybytes() if media.is_valid else b""
            form = (len(view), hashlib.sha256(view).hexdigest())
            try:
                s = read_ts(view)
            except MediaError as wrong:
                rows.append((None, None, None, *form, None, None, None, None, str(wrong)))
                continue
            rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-ALIGN:]), *form, s.feature(), s.continuity_errors, s.pts, [{"pts": p, "packet": k} for p, k in s.random_access], None))
        yield batch_of(schema, batch.column(0), batch.column(1), *(list(c) for c in zip(*rows))) if rows else batch_of(schema, *([] for _ in schema))


def to_transport_streams(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's text as UTF-8, padded with bytes 0 to a positive multiple of 64, in a transport stream.

    Returns doc_id, n_bytes (before padding), media. Null and empty text: 64 bytes 0. A very
    long text makes a stream of its own length and a fiftieth.
    One row out for each row in, repeated and null keys too; other columns, whatever their
    names, are not read; an empty table gives no rows.
    """
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it: lean(_write_batches(it)), _MEDIA)


def read_transport_streams(df: DataFrame) -> DataFrame:
    """Demultiplex a ``media`` column: digests of what it carries, timestamps and random-access points.

    A stream that is damaged beyond its continuity counters has its reason in error and null
    in what depends on its payload; other rows' error is null. Counted discontinuities are in
    continuity_errors. One row out for each row in, null and repeated keys too; a null stream
    counts as empty; an empty table gives no rows.
    """
    return df.select("doc_id", "n_bytes", "media").mapInArrow(lambda it: lean(_read_batches(it)), _READ)
