"""Media columns as MPEG transport streams.

``mux`` stores a byte payload as a transport stream of 188-byte packets: program
association and program map tables (repeated before every ``TABLES_EVERY``
units), then the payload as packetised elementary stream (PES) units of
``UNIT_BYTES`` bytes on one private-data stream.  Every unit has a presentation
time stamp; its first packet carries the random-access flag and the clock
reference, its last one is filled up with adaptation-field stuffing.

``demux`` reads such bytes back, also those from elsewhere: it finds the stream
through the tables (all sections, also those over several packets or several in
one; those that fail are counted in ``section_errors``), checks continuity
counters, joins the packets into units and returns payload, time stamps and random-access points.

Results: a null or empty text is a payload of 64 zero bytes.  A null stream has
no payload (null) and no units; bytes that are no transport stream give an empty
payload and count in ``sync_errors``.  A repeated packet (same counter and
bytes) counts once; a gap in the counter is counted and the bytes go on.  Equal
texts give equal streams.  Empty tables give empty results; other columns pass
through, new columns replace those of the same name.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from helixframe.llm.common import query, slices, table, texts_of

PACKET, BODY = 188, 184
UNIT_BYTES = 8192
TABLES_EVERY = 16
#: Clock ticks (90 kHz) between units: 25 a second.
TICKS = 3600
# Fixed values of the transport stream format.
SYNC, PAT_PID, STREAM_TYPE_PRIVATE, PRIVATE_STREAM_1 = 0x47, 0x0000, 0x06, 0xBD
# Free choices of this writer.
PMT_PID, STREAM_PID, PROGRAM = 0x0100, 0x0101, 1

UNIT = T.StructType([
    T.StructField("pts", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("packet", T.LongType()),
    T.StructField("random_access", T.BooleanType()),
])
READ = [
    T.StructField("payload", T.BinaryType()), T.StructField("packets", T.LongType()), T.StructField("programs", T.IntegerType()),
    T.StructField("sync_errors", T.LongType()), T.StructField("continuity_errors", T.LongType()),
    T.StructField("section_errors", T.LongType()), T.StructField("units", T.ArrayType(UNIT)),
]


def padded(data: bytes, block: int = 64) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``block``."""
    return data.ljust(max(1, -(-len(data) // block)) * block, b"\0")


@lru_cache(maxsize=1024)  # tables repeat
def _section_crc(data: bytes) -> int:
    """The most-significant-bit-first CRC-32 of table sections."""
    register = 0xFFFFFFFF
    for byte in data:
        register ^= byte << 24
        for _ in range(8):
            register = (register << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if register & 0x80000000 else register << 1
    return register


def _section(table_id: int, key: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, key, 0xC1, 0, 0)
    return head + body + struct.pack(">I", _section_crc(head + body))


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0)
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(PAT_PID, _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
_PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, STREAM_TYPE_PRIVATE, 0xE000 | STREAM_PID, 0xF000)))


def _time_stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 29) & 0x0E, (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1)


def write_stream(payload: bytes) -> bytes:
    """The transport stream of one payload."""
    packets, counter = [], 0
    for number, begin in enumerate(range(0, len(payload), UNIT_BYTES)):
        if number % TABLES_EVERY == 0:
            for packet in (_PAT, _PMT):
                copy = packet.copy()
                copy[3] |= number // TABLES_EVERY & 15
                packets.append(copy[None])
        data, clock = payload[begin : begin + UNIT_BYTES], number * TICKS & (1 << 33) - 1
        unit = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM_1, len(data) + 8, 0x84, 0x80, 5) + _time_stamp(clock) + data
        # Adaptation field of the first packet: random access, clock reference.
        field = struct.pack(">BBIH", 7, 0x50, clock >> 1, (clock & 1) << 15 | 0x7E00)
        rest = len(unit) - (BODY - len(field))
        if rest <= 0:
            field = bytes([BODY - len(unit) - 1]) + field[1:].ljust(BODY - len(unit) - 1, b"\xff")
            rest = 0
        count, over = 1 + -(-rest // BODY), rest % BODY
        block = np.empty((count, PACKET), np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
        block[:, 3] = 0x10 | (counter + np.arange(count)) & 15
        counter += count
        block[0, 1] |= 0x40
        block[0, 3] |= 0x20
        first = field + unit[: BODY - len(field)]
        block[0, 4:] = np.frombuffer(first, np.uint8)
        if count > 1:
            tail = np.frombuffer(unit, np.uint8)[BODY - len(field) :]
            full = len(tail) // BODY
            block[1 : 1 + full, 4:] = tail[: full * BODY].reshape(full, BODY)
            if over:
                stuffing = BODY - over  # one byte for the field's length, one for its flags, the rest filling
                block[-1, 3] |= 0x20
                block[-1, 4] = stuffing - 1
                block[-1, 5 : 4 + stuffing] = 0xFF
                if stuffing > 1:
                    block[-1, 5] = 0
                block[-1, 4 + stuffing :] = tail[full * BODY :]
        packets.append(block)
    return np.concatenate(packets).tobytes() if packets else b""


def _sections(packets: list[tuple[bool, int, bytes]], table_id: int) -> tuple[list[bytes], int]:
    """Bodies of the current sections of one table, and how many sections fail their checksum or stay unfinished.

    ``packets`` are those of the table's PID with a body, in order: whether a section begins there, counter, body.
    A section may go on over several packets, and several may stand in one.
    """
    found: dict[bytes, None] = {}
    errors, held, before = 0, None, None

    def take(data: bytes) -> bytes | None:
        """Reads the whole sections; returns the beginning of an unfinished one."""
        nonlocal errors
        while data and data[0] != 0xFF:  # filling
            size = 3 + (struct.unpack(">H", data[1:3])[0] & 0x0FFF) if len(data) >= 3 else len(data) + 1
            if len(data) < size:
                return data
            section, data = data[:size], data[size:]
            if section[0] == table_id:
                if size < 12 or _section_crc(section):
                    errors += 1
                elif section[5] & 1:  # not one that is yet to come
                    found[section[8:-4]] = None
        return None

    for begins, counter, body in packets:
        if before == (counter, body):
            continue  # repeated
        lost = before is not None and counter != before[0] + 1 & 15
        before = (counter, body)
        if lost and held is not None:
            errors, held = errors + 1, None
        if begins:
            ahead = 1 + body[0] if body else 0
            if held is not None and take(held + body[1:ahead]) is not None:
                errors += 1
            held = take(body[ahead:])
        elif held is not None:
            held = take(held + body)
    return list(found), errors + (held is not None)


def read_stream(data: bytes) -> dict:
    """Payload, units and errors of one transport stream; see the module's text."""
    count = len(data) // PACKET
    grid = np.frombuffer(data, np.uint8, count * PACKET).reshape(count, PACKET)
    good = grid[:, 0] == SYNC
    out = {
        "payload": b"", "packets": count, "programs": 0, "continuity_errors": 0, "section_errors": 0, "units": [],
        "sync_errors": int((~good).sum()) + (len(data) % PACKET > 0),
    }
    number = np.flatnonzero(good & (grid[:, 1] & 0x80 == 0))  # without packets marked as damaged
    grid = grid[number]
    pid = (grid[:, 1] & 0x1F).astype(np.int64) << 8 | grid[:, 2]
    control = grid[:, 3] >> 4 & 3
    begins = np.where(control & 2 > 0, 5 + grid[:, 4].astype(np.int64), 4)
    begins = np.where(control & 1 > 0, np.minimum(begins, PACKET), PACKET)

    def sections(wanted: int, table_id: int) -> list[bytes]:
        at = np.flatnonzero((pid == wanted) & (control & 1 > 0))
        packets = [(bool(grid[i, 1] & 0x40), int(grid[i, 3] & 15), grid[i, begins[i] :].tobytes()) for i in at]
        bodies, errors = _sections(packets, table_id)
        out["section_errors"] += errors
        return bodies

    streams, maps = [], []
    for association in sections(PAT_PID, 0x00):
        for program, map_pid in struct.iter_unpack(">HH", association[: len(association) // 4 * 4]):
            if program:
                out["programs"] += 1
                maps.append(map_pid & 0x1FFF)
    for map_pid in dict.fromkeys(maps):
        for body in sections(map_pid, 0x02):
            at = 4 + (struct.unpack(">H", body[2:4])[0] & 0x0FFF)
            while at + 5 <= len(body):
                _, stream, info = struct.unpack(">BHH", body[at : at + 5])
                streams.append(stream & 0x1FFF)
                at += 5 + (info & 0x0FFF)
    payload = []
    held = 0
    for stream in dict.fromkeys(streams):
        own = np.flatnonzero((pid == stream) & (control & 1 > 0))
        if not len(own):
            continue
        rows, counters = grid[own], grid[own, 3] & 15
        step = (np.diff(counters.astype(np.int64)) & 15) if len(own) > 1 else np.zeros(0, np.int64)
        same = np.concatenate([[False], (step == 0) & (rows[1:] == rows[:-1]).all(axis=1)]) if len(own) > 1 else np.array([False])
        jump = np.concatenate([[False], step != 1]) if len(own) > 1 else np.array([False])
        announced = (control[own] & 2 > 0) & (rows[:, 4] > 0) & (rows[:, 5] & 0x80 > 0)
        out["continuity_errors"] += int((jump & ~same & ~announced).sum())
        keep = ~same
        own, rows = own[keep], rows[keep]
        begin = begins[own]
        mask = np.arange(PACKET) >= begin[:, None]
        flat = rows[mask].tobytes()
        sizes = PACKET - begin
        ends = np.cumsum(sizes)
        opens = np.flatnonzero(rows[:, 1] & 0x40 > 0)
        edges = [*(ends[opens] - sizes[opens]).tolist(), len(flat)]
        for i, (left, right) in enumerate(zip(edges, edges[1:])):
            unit = flat[left:right]
            if len(unit) < 9 or unit[:3] != b"\0\0\1":
                continue
            size, flags, head = struct.unpack(">H", unit[4:6])[0], unit[7], unit[8]
            body = unit[9 + head : 6 + size if size else len(unit)]
            pts = None
            if flags & 0x80 and len(unit) >= 14:
                a, b, c = struct.unpack(">BHH", unit[9:14])
                pts = (a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1
            row = opens[i]
            flagged = bool(control[own[row]] & 2) and rows[row, 4] > 0 and bool(rows[row, 5] & 0x40)
            out["units"].append({"pts": pts, "offset": held, "packet": int(number[own[row]]), "random_access": flagged})
            payload.append(body)
            held += len(body)
    out["payload"] = b"".join(payload)
    return out


def _passed(df: DataFrame, new: set[str], drop: set[str] = frozenset()):
    fields = [f for f in df.schema.fields if f.name not in new | drop]
    return fields, [f.name for f in fields]


def mux(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``n_bytes`` (UTF-8 bytes of the text) and ``media`` (its transport stream)."""
    kept, names = _passed(docs, {"n_bytes", "media"}, set() if keep_text else {text})

    def run(batches):
        for part in slices(batches, text):
            data = [t.encode() for t in texts_of(part, text)]
            media = [write_stream(padded(d)) for d in data]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in names], pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary())],
                [*names, "n_bytes", "media"],
            )

    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def demux(streams: DataFrame, media: str = "media") -> DataFrame:
    """Add ``payload, packets, programs, sync_errors, continuity_errors, section_errors, units`` of each stream."""
    kept, names = _passed(streams, {f.name for f in READ})
    units = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_())]))
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), units]

    def run(batches):
        for part in slices(batches, media):
            read = [None if d is None else read_stream(d) for d in part.column(media).to_pylist()]
            columns = [pa.array([None if r is None else r[f.name] for r in read], k) for f, k in zip(READ, kinds)]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *columns], [*names, *[f.name for f in READ]])

    return streams.select(*names).mapInArrow(run, T.StructType([*kept, *READ]))


@query("op3_transport_stream")
def op3(spark, sf_dir):
    """Every document as a stored stream and read back."""
    read = demux(mux(table(spark, sf_dir, "documents").select("doc_id", "text")))
    points = F.filter("units", lambda u: u["random_access"])
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            " ",
            F.format_string("packets=%d programs=%d units=%d", "packets", "programs", F.size("units")),
            F.format_string("errors=%d", F.col("sync_errors") + F.col("continuity_errors") + F.col("section_errors")),
            F.format_string("random_access=%d last_pts=%d", F.size(points), F.coalesce(F.array_max("units.pts"), F.lit(-1))),
        ).alias("feature"),
        "packets",
        "continuity_errors",
        F.size(points).alias("random_access_points"),
    )
