import hashlib
import os
import zlib

import pytest

from tallyglass.llm import mpegts


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 150, 170, 176, 184, 1000, 16_384, 16_385, 70_000])
def test_round_trip(n):
    payload = mpegts.padded(os.urandom(n))
    media = mpegts.mux(payload)
    s = mpegts.demux(media)
    assert b"".join(u.data for u in s.units) == payload
    assert len(media) % mpegts.PACKET == 0 and s.packets == len(media) // mpegts.PACKET
    assert (s.cc_errors, s.crc_errors, s.skipped_bytes, s.duplicates) == (0, 0, 0, 0)
    assert [u.pts for u in s.units] == [k * mpegts.TICKS for k in range(len(s.units))]
    assert [u.random_access for u in s.units] == [k % mpegts.RANDOM_ACCESS == 0 for k in range(len(s.units))]
    assert s.programs == {1: {"pmt": mpegts.PMT_PID, "pcr": mpegts.DATA_PID, "streams": {mpegts.DATA_PID: mpegts.PRIVATE}}}


def packets(media):
    return [media[i : i + 188] for i in range(0, len(media), 188)]


def test_a_lost_packet_is_seen_and_spoils_its_unit_only():
    payload = os.urandom(mpegts.UNIT * 3)
    p = packets(mpegts.mux(payload))
    s = mpegts.demux(b"".join(p[:50] + p[51:]))
    assert s.cc_errors == 1
    assert [u.whole for u in s.units] == [False, True, True]
    assert s.units[1].data + s.units[2].data == payload[mpegts.UNIT :]


def test_garbage_duplicates_and_damage():
    payload = os.urandom(5_000)
    p = packets(mpegts.mux(payload))
    bad = bytearray(p[5])
    bad[1] |= 0x80
    s = mpegts.demux(b"\x00junk" + b"".join(p[:5]) + bytes(bad) + p[5] + p[6] + p[6] + b"".join(p[7:]) + b"tail")
    assert b"".join(u.data for u in s.units) == payload
    assert (s.skipped_bytes, s.transport_errors, s.duplicates, s.cc_errors) == (9, 1, 1, 0)


def test_broken_tables_are_not_believed():
    p = packets(mpegts.mux(b"x" * 64))
    table = bytearray(p[0])
    table[10] ^= 1
    s = mpegts.demux(bytes(table) + b"".join(p[1:]))
    assert s.crc_errors == 1 and not s.programs and not s.units
    assert mpegts.demux(b"").packets == 0


def test_timestamps_wrap():
    assert mpegts._read_stamp(mpegts._stamp(2, mpegts.WRAP + 5)) == 5
    assert mpegts._read_stamp(mpegts._stamp(2, mpegts.WRAP - 1)) == mpegts.WRAP - 1


def test_query_columns_against_the_texts(clash):
    rows = mpegts.probed(mpegts.stored(clash)).collect()
    want = []
    for r in clash.collect():
        raw = (r["text"] or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.append((r["doc_id"] or -1, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((r["doc_id"] or -1, *r[1:5]) for r in rows) == sorted(want)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_stamps_entry_points_and_damage_are_columns(spark):
    payload = os.urandom(mpegts.UNIT * 20 + 5)
    sound = mpegts.mux(payload)
    p = packets(sound)
    bad, table, secret = bytearray(p[5]), bytearray(p[0]), bytearray(p[9])
    bad[1] |= 0x80
    table[10] ^= 1
    secret[3] |= 0x80
    cases = {
        "": sound, "transport:1": b"".join([*p[:5], bytes(bad), *p[5:]]), "crc:1,no_program:1": b"".join([bytes(table), *p[1:]]), "continuity:1,broken_units:1": b"".join([*p[:50], *p[51:]]),
        "scrambled:1,broken_units:1": b"".join([*p[:9], bytes(secret), *p[10:]]), "skipped_bytes:4": sound + b"tail",
    }
    rows = mpegts.probed(spark.createDataFrame([(i, 0, bytearray(m)) for i, m in enumerate(cases.values())] + [(99, 0, None)], "doc_id long, n_bytes long, media binary")).collect()
    by = {r["doc_id"]: r for r in rows}
    for i, name in enumerate(cases):
        assert f";damage={name};" in by[i]["feature"]
        assert (by[i]["damage"] == 0) == (name == "")
    assert by[0]["pts"] == [k * mpegts.TICKS for k in range(21)] and by[0]["dts"] == [None] * 21 and by[0]["random_access"] == [0, 8, 16]
    assert (by[99]["payload_bytes"], by[99]["pts"]) == (0, [])


def test_nothing(no_docs):
    assert mpegts.probed(mpegts.stored(no_docs)).count() == 0
