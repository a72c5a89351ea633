"""MPEG transport streams (ISO/IEC 13818-1): multiplexing payloads and reading streams back.

`demux` finds packet sync, parses program association and map tables with their CRC, checks continuity counters,
reassembles elementary packets and keeps their timestamps and random-access points. `mux` writes one program with one
private-data stream, losslessly: the reassembled elementary packets are the payload.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.store import pieces

PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
PMT_PID, DATA_PID, PROGRAM, PRIVATE = 0x1000, 0x0100, 1, 0x06
PRIVATE_STREAM_1 = 0xBD
#: Payload bytes of an access unit, ticks of the 90 kHz clock between units, units from one random-access point to the next.
UNIT, TICKS, RANDOM_ACCESS = 16_384, 3_600, 8
#: A payload is padded with bytes 0 up to a positive multiple of this.
ALIGN = 64
WRAP = 1 << 33


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2; over a section with its CRC it gives 0."""
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ x]
    return c


# ---- writing ----


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(mark: int, t: int) -> bytes:
    t %= WRAP
    return bytes([mark << 4 | (t >> 29) & 0x0E | 1, (t >> 22) & 0xFF, (t >> 14) & 0xFE | 1, (t >> 7) & 0xFF, (t << 1) & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """One program that carries payload on one stream: tables, then an elementary packet for each UNIT bytes."""
    out, cc = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        part, pts, entry = payload[at : at + UNIT], k * TICKS, k % RANDOM_ACCESS == 0
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + part
        base = (pts * 1) % WRAP
        field_ = (bytes([0x50 if entry else 0x10]) + (base << 15 | 0x7E00).to_bytes(6, "big")) if entry or k == 0 else b""
        pos, first = 0, True
        while pos < len(pes):
            extra = field_ if first else b""
            room = PACKET - 4 - (len(extra) + 1 if extra else 0)
            take = min(room, len(pes) - pos)
            head = bytes([SYNC, (0x40 if first else 0) | DATA_PID >> 8, DATA_PID & 0xFF])
            if take == PACKET - 4:
                out.append(head + bytes([0x10 | cc]) + pes[pos : pos + take])
            else:
                length = PACKET - 5 - take
                fill = (extra or b"\x00")[:length].ljust(length, b"\xff") if length else b""
                out.append(head + bytes([0x30 | cc, length]) + fill + pes[pos : pos + take])
            cc, pos, first = (cc + 1) & 15, pos + take, False
    return b"".join(out)


# ---- reading ----


@dataclass
class Unit:
    """An elementary packet: its stream's PID, stamps (None if it has none), whether decoding can start at it, its bytes."""

    pid: int
    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes
    whole: bool = True


@dataclass
class Stream:
    """What a transport stream holds. programs: number -> {"pmt": pid, "pcr": pid, "streams": {pid: type}}."""

    programs: dict = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    cc_errors: int = 0
    duplicates: int = 0
    transport_errors: int = 0
    crc_errors: int = 0
    scrambled: int = 0
    skipped_bytes: int = 0
    pcrs: list[tuple[int, int]] = field(default_factory=list)


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _unit(pid: int, raw: bytes, entry: bool) -> Unit | None:
    if len(raw) < 9 or raw[:3] != b"\x00\x00\x01":
        return None
    length, stamps, start = int.from_bytes(raw[4:6], "big"), raw[7] >> 6, 9 + raw[8]
    pts = _read_stamp(raw[9:14]) if stamps & 2 and len(raw) >= 14 else None
    dts = _read_stamp(raw[14:19]) if stamps == 3 and len(raw) >= 19 else None
    end = 6 + length if length else len(raw)
    return Unit(pid, pts, dts, entry, raw[start:end], len(raw) >= end)


def _sync(data: bytes, at: int) -> int:
    """The first offset from `at` where packets begin: sync bytes there and at the next packet, if that is inside."""
    while (at := data.find(SYNC, at)) >= 0:
        if at + PACKET >= len(data) or data[at + PACKET] == SYNC:
            return at
        at += 1
    return len(data)


def demux(data: bytes) -> Stream:
    """Parse a transport stream. Garbage between packets is skipped and counted; packets marked as damaged are left out;
    a packet sent twice counts once; a jump of a continuity counter is an error unless a discontinuity is announced, and ends
    the elementary packet it falls into (whole=False). Sections may span packets. Empty data give an empty Stream."""
    s, at, pmts, streams = Stream(), 0, {}, set()
    counter: dict[int, tuple[int, bytes]] = {}
    sections: dict[int, bytearray] = {}
    open_: dict[int, tuple[list[bytes], bool]] = {}

    def close(pid: int, whole: bool = True) -> None:
        parts, entry = open_.pop(pid, ([], False))
        if parts and (u := _unit(pid, b"".join(parts), entry)):
            u.whole &= whole
            s.units.append(u)

    def section(pid: int, x: bytes) -> None:
        if crc32_mpeg(x):
            s.crc_errors += 1
        elif x[0] == 0 and pid == 0:
            for i in range(8, len(x) - 4, 4):
                number, to = int.from_bytes(x[i : i + 2], "big"), int.from_bytes(x[i + 2 : i + 4], "big") & 0x1FFF
                if number:
                    pmts[to] = number
                    s.programs.setdefault(number, {"pmt": to, "pcr": None, "streams": {}})
        elif x[0] == 2 and pid in pmts:
            program = s.programs[pmts[pid]]
            program["pcr"] = int.from_bytes(x[8:10], "big") & 0x1FFF
            i = 12 + (int.from_bytes(x[10:12], "big") & 0x0FFF)
            while i + 5 <= len(x) - 4:
                es = int.from_bytes(x[i + 1 : i + 3], "big") & 0x1FFF
                program["streams"][es] = x[i]
                streams.add(es)
                i += 5 + (int.from_bytes(x[i + 3 : i + 5], "big") & 0x0FFF)

    while at + PACKET <= len(data):
        if data[at] != SYNC:
            new = _sync(data, at)
            s.skipped_bytes += new - at
            at = new
            continue
        p = data[at : at + PACKET]
        at += PACKET
        s.packets += 1
        pid = (p[1] & 0x1F) << 8 | p[2]
        if p[1] & 0x80:
            s.transport_errors += 1
            continue
        if pid == NULL_PID:
            continue
        control, cc, start, jump, entry = p[3] >> 4 & 3, p[3] & 15, 4, False, False
        if control & 2:
            start = 5 + p[4]
            if p[4]:
                jump, entry = bool(p[5] & 0x80), bool(p[5] & 0x40)
                if p[5] & 0x10 and p[4] >= 7:
                    s.pcrs.append((pid, int.from_bytes(p[6:11], "big") >> 7))
        if not control & 1:
            continue
        last = counter.get(pid)
        if last and not jump:
            if cc == last[0] and p == last[1]:
                s.duplicates += 1
                continue
            if cc != (last[0] + 1) & 15:
                s.cc_errors += 1
                close(pid, False)
                sections.pop(pid, None)
        counter[pid] = (cc, p)
        if p[3] >> 6:
            s.scrambled += 1
            continue
        unit_start, body = p[1] & 0x40, p[start:]
        if pid == 0 or pid in pmts:
            if unit_start and body:
                body, rest = body[1 + body[0] :], body[1 : 1 + body[0]]
                if pid in sections:
                    sections[pid] += rest
                    if len(sections[pid]) >= 3 and len(sections[pid]) >= (n := 3 + (int.from_bytes(sections[pid][1:3], "big") & 0x0FFF)):
                        section(pid, bytes(sections[pid][:n]))
                sections[pid] = bytearray()
            elif pid not in sections:
                continue
            held = sections[pid]
            held += body
            while len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)):
                section(pid, bytes(held[:n]))
                del held[:n]
            if not held or held[0] == 0xFF:
                sections.pop(pid)
        elif pid in streams:
            if unit_start:
                close(pid)
                open_[pid] = ([body], entry)
            elif pid in open_:
                open_[pid][0].append(body)
    for pid in list(open_):
        close(pid)
    s.skipped_bytes += len(data) - at
    return s


def damage(s: Stream) -> dict[str, int]:
    """What is wrong with a stream, counted; all 0 for a sound one."""
    return {
        "continuity": s.cc_errors, "transport": s.transport_errors, "crc": s.crc_errors, "scrambled": s.scrambled, "skipped_bytes": s.skipped_bytes,
        "broken_units": sum(not u.whole for u in s.units), "no_program": int(s.packets > 0 and not s.programs),
    }


def features(s: Stream) -> str:
    """Programs and streams, counts, damage, first and last stamps and random-access points as unit:pts, in one line."""
    programs = ",".join(f"{n}@{p['pmt']}:" + "+".join(f"{pid}/{kind}" for pid, kind in sorted(p["streams"].items())) for n, p in sorted(s.programs.items()))
    stamps = [u.pts for u in s.units if u.pts is not None]
    entries = ",".join(f"{i}:{u.pts}" for i, u in enumerate(s.units) if u.random_access)
    return f"programs={programs};packets={s.packets};units={len(s.units)};damage={','.join(f'{k}:{n}' for k, n in damage(s).items() if n)};pts={stamps[0] if stamps else ''}-{stamps[-1] if stamps else ''};entries={entries}"


def padded(text: bytes) -> bytes:
    return text.ljust(max(ALIGN, -(-len(text) // ALIGN) * ALIGN), b"\0")


def _mux_batches(batches):
    for b in pieces(batches, "text"):
        texts = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"]
        )


def _probe_batches(batches):
    for b in pieces(batches, "media"):
        rows = []
        for doc_id, n, media in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            media = media or b""
            s = demux(media)
            data = b"".join(u.data for u in s.units)
            rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), features(s), [u.pts for u in s.units], [u.dts for u in s.units], [i for i, u in enumerate(s.units) if u.random_access], sum(damage(s).values())))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _PROBE)


_PROBE = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "dts", "random_access", "damage"]


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text (null: empty) as a transport stream. Ties and repeated rows stay; an empty
    table gives no rows; columns other than doc_id and text are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_mux_batches, "doc_id long, n_bytes long, media binary")


def probed(media: DataFrame) -> DataFrame:
    """Digests and features of each row of (doc_id, n_bytes, media), from what the streams hold: pts and dts of each elementary packet (null if it
    has none), the numbers of those at which decoding can start, and the count of all damage, 0 for a sound stream. Null media are an empty stream."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _probe_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, dts array<long>, random_access array<int>, damage long"
    )
