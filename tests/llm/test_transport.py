import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from helixframe.llm import transport as ts


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, *range(150, 190), 350, 8180, 8192, 8193, 140_000])
def test_round_trip(size):
    data = ts.padded(os.urandom(size))
    stream = ts.write_stream(data)
    read = ts.read_stream(stream)
    units = -(-len(data) // ts.UNIT_BYTES)
    assert read["payload"] == data and len(stream) % ts.PACKET == 0
    assert (read["sync_errors"], read["continuity_errors"], read["programs"]) == (0, 0, 1)
    assert [u["pts"] for u in read["units"]] == [i * ts.TICKS for i in range(units)]
    assert [u["offset"] for u in read["units"]] == [i * ts.UNIT_BYTES for i in range(units)]
    assert all(u["random_access"] for u in read["units"])


def test_counters_and_damage():
    data = os.urandom(50_000)
    stream = ts.write_stream(data)
    cut = lambda a, b: stream[: a * ts.PACKET] + stream[b * ts.PACKET :]
    lost = ts.read_stream(cut(20, 21))
    assert lost["continuity_errors"] == 1 and len(lost["payload"]) < len(data)
    assert ts.read_stream(cut(21, 20))["payload"] == data  # a repeated packet counts once
    assert ts.read_stream(b"")["units"] == []
    assert ts.read_stream(b"x" * 1000) | {"packets": 0} == {
        "payload": b"", "packets": 0, "programs": 0, "continuity_errors": 0, "section_errors": 0, "units": [], "sync_errors": 6}
    broken_table = bytearray(stream)
    broken_table[12] ^= 1
    assert ts.read_stream(bytes(broken_table[: 17 * ts.PACKET]))["programs"] == 0


def foreign(tables, payload=b"p" * 300, stream=0x0123):
    """A stream with the packets of its tables as given, written by hand: (PID, begins, body)."""
    unit = b"\0\0\1\xbd" + (3 + len(payload)).to_bytes(2, "big") + b"\x80\0\0" + payload
    parts = [(stream, not at, unit[at : at + 184]) for at in range(0, len(unit), 184)]
    counters, out = {}, b""
    for pid, begins, body in [*tables, *parts]:
        counter = counters[pid] = (counters.get(pid, -1) + 1) % 16
        head = bytes([0x47, (0x40 if begins else 0) | pid >> 8, pid & 255])
        fill = 184 - len(body)
        field = b"" if not fill else bytes([fill - 1]) + (b"\0" + b"\xff" * (fill - 2) if fill > 1 else b"")
        out += head + bytes([(0x30 if fill else 0x10) | counter]) + field + body
    return out


def section(table, body, broken=False):
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\0\1\xc1\0\0"
    crc = 0xFFFFFFFF
    for byte in head + body:
        for bit in range(7, -1, -1):
            crc = crc << 1 & 0xFFFFFFFF ^ (0x04C11DB7 if crc >> 31 ^ byte >> bit & 1 else 0)
    return head + body + (crc ^ broken).to_bytes(4, "big")


PAT = (0, True, b"\0" + section(0, (1).to_bytes(2, "big") + (0xE000 | 0x50).to_bytes(2, "big")))
# One program map of a private stream behind 40 streams that carry nothing.
LONG_MAP = section(2, b"\xe1\x23\xf0\0" + b"".join(b"\x06" + (0xE200 + i).to_bytes(2, "big") + b"\xf0\0" for i in range(40)) + b"\x06\xe1\x23\xf0\0")


def test_a_map_over_two_packets():
    assert 184 < len(LONG_MAP) < 360
    body = b"\0" + LONG_MAP
    read = ts.read_stream(foreign([PAT, (0x50, True, body[:184]), (0x50, False, body[184:])]))
    assert (read["payload"], read["programs"], read["section_errors"]) == (b"p" * 300, 1, 0)


def test_two_sections_in_one_packet_and_one_that_begins_behind_another():
    small = section(2, b"\xe1\x23\xf0\0" + b"\x06\xe1\x23\xf0\0")
    other = section(0x42, b"x" * 20)
    assert ts.read_stream(foreign([PAT, (0x50, True, b"\0" + other + small)]))["payload"] == b"p" * 300
    # The pointer leads over the rest of the section before.
    long = section(0x42, b"y" * 200)
    rest = long[183:]
    read = ts.read_stream(foreign([PAT, (0x50, True, b"\0" + long[:183]), (0x50, True, bytes([len(rest)]) + rest + small)]))
    assert (read["payload"], read["section_errors"]) == (b"p" * 300, 0)


def test_broken_and_unfinished_sections_are_counted():
    body = b"\0" + LONG_MAP
    changed = bytearray(body[184:])
    changed[3] ^= 1
    read = ts.read_stream(foreign([PAT, (0x50, True, body[:184]), (0x50, False, bytes(changed))]))
    assert (read["payload"], read["programs"], read["section_errors"]) == (b"", 1, 1)
    assert ts.read_stream(foreign([PAT, (0x50, True, body[:184])]))["section_errors"] == 1
    assert ts.read_stream(foreign([(0, True, b"\0" + section(0, b"\0\1\xe0\x50", broken=True))]))["section_errors"] == 1


def test_known_bytes():
    """A stream written out by hand: two packets of tables, one unit with a time stamp and a random-access flag."""
    pes = b"\0\0\1\xbd" + (8 + 4).to_bytes(2, "big") + b"\x80\x80\x05" + b"\x21\0\1\0\x0b" + b"data"
    small = section(2, b"\xe1\x23\xf0\0" + b"\x06\xe1\x23\xf0\0")
    stream = foreign([PAT, (0x50, True, b"\0" + small)])[: 2 * 188]
    fill = 184 - len(pes)
    stream += bytes([0x47, 0x41, 0x23, 0x30, fill - 1, 0x40]) + b"\xff" * (fill - 2) + pes
    assert stream[:4] == b"\x47\x40\0\x30" and len(stream) == 3 * 188
    read = ts.read_stream(stream)
    assert read["payload"] == b"data" and read["units"] == [{"pts": 5, "offset": 0, "packet": 2, "random_access": True}]


def test_counter_wraps_and_tables_repeat():
    stream = ts.write_stream(os.urandom(ts.UNIT_BYTES * (ts.TABLES_EVERY * 2 + 1)))
    pids = [(stream[i + 1] & 31) << 8 | stream[i + 2] for i in range(0, len(stream), ts.PACKET)]
    assert pids.count(ts.PAT_PID) == pids.count(ts.PMT_PID) == 3
    assert ts.read_stream(stream)["continuity_errors"] == 0


def test_columns_nulls_and_clashes(spark):
    draw = random.Random(1)
    texts = [None, "", "é" * 40, "x" * 64, "".join(draw.choice("abc \n") for _ in range(60_000)), "x" * 64]
    docs = spark.createDataFrame([(i, t, "m", 5) for i, t in enumerate(texts)], "doc_id long, text string, media string, units int")
    rows = ts.demux(ts.mux(docs)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        data = (texts[row["doc_id"]] or "").encode()
        assert bytes(row["payload"]) == ts.padded(data) and row["n_bytes"] == len(data)
    assert rows[3]["media"] == rows[5]["media"]
    other = spark.createDataFrame([(None,), (bytearray(b"junk"),)], "media binary")
    assert [r["payload"] for r in ts.demux(other).collect()] == [None, b""]
    assert ts.demux(ts.mux(docs.limit(0))).collect() == []


def test_query(spark, tmp_path):
    texts = [None, "", "abc" * 5000, "ü"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in ts.op3(spark, str(tmp_path)).collect():
        data = (texts[row["doc_id"]] or "").encode()
        payload = ts.padded(data)
        assert row["n_bytes"] == len(data) and row["payload_bytes"] == len(payload)
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-64:])
        stream = ts.write_stream(payload)
        assert (row["media_bytes"], row["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
