"""Media columns of MPEG transport streams: a writer for samples and a reader of whole streams.

Formats follow ISO/IEC 13818-1: 188-byte packets, program association and map tables with their
checksums, packetised elementary streams with time stamps on a 90 kHz clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bounded_batches, text_or_empty

# fixed values of the format
PACKET, SYNC, NULL_PID, STUFFING = 188, 0x47, 0x1FFF, 0xFF
PRIVATE_STREAM_1, PRIVATE_DATA = 0xBD, 0x06
#: What the writer uses: program, its table's pid, its elementary stream's pid.
PROGRAM, TABLE_PID, DATA_PID = 1, 0x1000, 0x100
#: Sample bytes of an elementary packet, its length on the 90 kHz clock, and packets between random-access points.
UNIT, UNIT_TICKS, ACCESS_EVERY = 32_000, 3_600, 8
#: Payloads are padded to a positive multiple of so many bytes.
PAD = 64

READ = (
    "struct<n_packets:bigint,programs:array<struct<program:int,pid:int,pcr_pid:int,streams:array<struct<pid:int,stream_type:int>>>>,"
    "continuity_errors:bigint,lost_sync:bigint,bad_tables:bigint,"
    "units:array<struct<pid:int,stream_id:int,pts:bigint,dts:bigint,random_access:boolean,packet:bigint,size:bigint>>,data:binary>"
)


@cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1 ^ (0x04C11DB7 if value & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(value)
    return tuple(out)


def crc32_mpeg(data: bytes) -> int:
    value, table = 0xFFFFFFFF, _crc_table()
    for byte in data:
        value = (value << 8 & 0xFFFFFFFF) ^ table[value >> 24 ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@cache
def _table_packets() -> bytes:
    """The association table and the map table, a packet each."""
    pat = _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | TABLE_PID >> 8, TABLE_PID & 0xFF]))
    pmt = _section(2, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, PRIVATE_DATA, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0]))
    packets = (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section for pid, section in ((0, pat), (TABLE_PID, pmt)))
    return b"".join(p.ljust(PACKET, bytes([STUFFING])) for p in packets)


def _stamp(mark: int, ticks: int) -> bytes:
    return bytes([mark << 4 | (ticks >> 30 & 7) << 1 | 1, ticks >> 22 & 0xFF, (ticks >> 15 & 0x7F) << 1 | 1, ticks >> 7 & 0xFF, (ticks & 0x7F) << 1 | 1])


def write_stream(payload: bytes) -> bytes:
    """8-bit samples as a stream of one program with one private stream, UNIT samples to an elementary packet."""
    out, counter = [_table_packets()], 0
    for unit, start in enumerate(range(0, len(payload), UNIT)):
        part = payload[start : start + UNIT]
        ticks = unit * UNIT_TICKS
        body = np.frombuffer(bytes([0, 0, 1, PRIVATE_STREAM_1, (len(part) + 8) >> 8, (len(part) + 8) & 0xFF, 0x80, 0x80, 5]) + _stamp(2, ticks) + part, np.uint8)
        field = bytes([7, 0x50 if unit % ACCESS_EVERY == 0 else 0x10, ticks >> 25 & 0xFF, ticks >> 17 & 0xFF, ticks >> 9 & 0xFF, ticks >> 1 & 0xFF, (ticks & 1) << 7 | 0x7E, 0])
        room = PACKET - 4
        count = max(1, -(-(len(body) + len(field)) // room))
        packets = np.full((count, PACKET), STUFFING, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(count)) & 15
        packets[0, 3] |= 0x20
        packets[0, 4 : 4 + len(field)] = np.frombuffer(field, np.uint8)
        spare = count * room - len(field) - len(body)
        last = count - 1
        begin = np.full(count, 4)
        begin[0] += len(field)
        if spare and last == 0:
            packets[0, 4] += spare
            begin[0] += spare
        elif spare:
            packets[last, 3] |= 0x20
            packets[last, 4] = spare - 1
            if spare > 1:
                packets[last, 5] = 0
            begin[last] += spare
        packets[np.arange(PACKET)[None, :] >= begin[:, None]] = body
        counter += count
        out.append(packets.tobytes())
    return b"".join(out)


def _ticks(p: bytes) -> int:
    return (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1


def _sections(payloads: list[bytes], starts: list[bool]) -> Iterator[bytes]:
    """Table sections from the payloads of one pid; a section may run over several packets."""
    held = b""
    for payload, start in zip(payloads, starts, strict=True):
        if start and payload:
            held += payload[1 : 1 + payload[0]]
            if len(held) >= 3 and len(held) >= (need := 3 + ((held[1] & 15) << 8 | held[2])):
                yield held[:need]
            held = payload[1 + payload[0] :]
        else:
            held += payload
        while len(held) >= 3 and held[0] != STUFFING and len(held) >= (need := 3 + ((held[1] & 15) << 8 | held[2])):
            yield held[:need]
            held = held[need:]
        if held[:1] == bytes([STUFFING]):
            held = b""


def read_stream(media: bytes) -> dict:
    """Parse a stream; a null or empty one has nothing, bytes out of step with the packets count as lost sync.

    Continuity counters are checked per pid over packets with payload: a counter must follow the
    one before, may stand still once (a repeated packet, which is left out), and is free after a
    discontinuity mark. Elementary packets of all streams that the map tables name are reassembled;
    data holds their payloads in order of their starts.
    """
    whole = len(media) // PACKET
    p = np.frombuffer(media, np.uint8, whole * PACKET).reshape(whole, PACKET)
    good = p[:, 0] == SYNC
    lost = int((~good).sum()) + bool(len(media) % PACKET)
    numbers = np.flatnonzero(good & (p[:, 1] & 0x80 == 0))
    p = p[numbers]
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    start, counter = p[:, 1] & 0x40 != 0, (p[:, 3] & 15).astype(np.int64)
    field, filled = p[:, 3] & 0x20 != 0, p[:, 3] & 0x10 != 0
    size = np.where(field, p[:, 4].astype(np.int64) + 1, 0)
    flags = np.where(field & (size > 1), p[:, 5], 0)
    begin = np.minimum(4 + size, PACKET)
    errors, repeated = 0, np.zeros(len(p), bool)
    pids = [int(x) for x in np.unique(pid) if x != NULL_PID]
    of = {x: np.flatnonzero((pid == x) & filled) for x in pids}
    for x, at in of.items():
        step = (counter[at[1:]] - counter[at[:-1]]) & 15
        free = flags[at[1:]] & 0x80 != 0
        same = (step == 0) & ~free
        twice = same & np.concatenate(([False], ~same[:-1])) if len(same) else same
        twice[:1] = same[:1]
        errors += int((~free & (step != 1) & ~twice).sum())
        repeated[at[1:][twice]] = True
        of[x] = at[~repeated[at]]

    def payloads(x: int) -> tuple[list[bytes], list[bool]]:
        at = of.get(x, np.zeros(0, np.int64))
        return [p[i, begin[i] :].tobytes() for i in at], start[at].tolist()

    tables, programs, bad = {}, [], 0
    for section in _sections(*payloads(0)):
        if crc32_mpeg(section):
            bad += 1
        elif section[0] == 0:
            tables |= {section[i] << 8 | section[i + 1]: (section[i + 2] & 0x1F) << 8 | section[i + 3] for i in range(8, len(section) - 4, 4)}
    for program, table in sorted(tables.items()):
        if not program:
            continue
        for section in _sections(*payloads(table)):
            if crc32_mpeg(section):
                bad += 1
                continue
            if section[0] != 2 or (section[3] << 8 | section[4]) != program:
                continue
            streams, i = [], 12 + ((section[10] & 15) << 8 | section[11])
            while i + 5 <= len(section) - 4:
                streams.append({"pid": (section[i + 1] & 0x1F) << 8 | section[i + 2], "stream_type": section[i]})
                i += 5 + ((section[i + 3] & 15) << 8 | section[i + 4])
            found = {"program": program, "pid": table, "pcr_pid": (section[8] & 0x1F) << 8 | section[9], "streams": streams}
            if found not in programs:
                programs.append(found)
    units, parts = [], []
    for x in sorted({s["pid"] for program in programs for s in program["streams"]}):
        at = of.get(x, np.zeros(0, np.int64))
        heads = np.flatnonzero(start[at]).tolist()
        for h, end in pairwise([*heads, len(at)]):
            own = at[h:end]
            body = p[own][np.arange(PACKET)[None, :] >= begin[own][:, None]].tobytes()
            if len(body) < 9 or body[:3] != b"\x00\x00\x01":
                continue
            length = body[4] << 8 | body[5]
            body = body[: 6 + length] if length else body
            pts = _ticks(body[9:14]) if body[7] & 0x80 and len(body) >= 14 else None
            dts = _ticks(body[14:19]) if body[7] & 0xC0 == 0xC0 and len(body) >= 19 else pts
            data = body[9 + body[8] :]
            units.append({"pid": x, "stream_id": body[3], "pts": pts, "dts": dts, "random_access": bool(flags[own[0]] & 0x40), "packet": int(numbers[own[0]]), "size": len(data)})
            parts.append((int(numbers[own[0]]), data))
    data = b"".join(d for _, d in sorted(parts, key=lambda x: x[0]))
    return {"n_packets": whole, "programs": programs, "continuity_errors": errors, "lost_sync": lost, "bad_tables": bad, "units": units, "data": data}


def _written(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for payloads in batches:
        yield pa.array([None if x is None else write_stream(x) for x in payloads.to_pylist()], pa.binary())


_UNIT = pa.struct([("pid", pa.int32()), ("stream_id", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("packet", pa.int64()), ("size", pa.int64())])
_PROGRAM = pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("pcr_pid", pa.int32()), ("streams", pa.list_(pa.struct([("pid", pa.int32()), ("stream_type", pa.int32())])))])
_READ = pa.struct(
    [("n_packets", pa.int64()), ("programs", pa.list_(_PROGRAM)), ("continuity_errors", pa.int64()), ("lost_sync", pa.int64()), ("bad_tables", pa.int64()), ("units", pa.list_(_UNIT)), ("data", pa.binary())]
)


def _read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for media in batches:
        yield pa.array([read_stream(x or b"") for x in media.to_pylist()], _READ)


def padded(text: str = "text") -> Column:
    """A text as UTF-8 with zero bytes up to a positive multiple of PAD; null is empty."""
    data = text_or_empty(text).cast("binary")
    size = F.octet_length(data)
    whole = F.greatest(F.ceil(size / PAD), F.lit(1)) * PAD
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), (whole - size).cast("int"))))


def with_stream(docs: DataFrame, payload: str = "payload", name: str = "media") -> DataFrame:
    """docs with the transport stream of a column of 8-bit samples; null stays null, no samples give tables only."""
    bounded_batches(docs.sparkSession, 500)
    return docs.withColumn(name, F.arrow_udf(_written, "binary")(F.col(payload)))


def with_stream_read(docs: DataFrame, media: str = "media", name: str = "stream") -> DataFrame:
    """docs with a struct of what read_stream finds in a media column (a column of that name is replaced)."""
    bounded_batches(docs.sparkSession, 500)
    return docs.withColumn(name, F.arrow_udf(_read, READ)(F.col(media)))


def stream_feature(stream: str = "stream") -> Column:
    """A stream's facts as text: packets, programs, streams, errors, units, first and last time stamp, random-access points."""
    s = F.col(stream)
    units = s["units"]
    access = F.size(F.filter(units, lambda u: u["random_access"]))
    facts = {
        "packets": s["n_packets"],
        "programs": F.size(s["programs"]),
        "streams": F.aggregate(s["programs"], F.lit(0), lambda n, p: n + F.size(p["streams"])),
        "errors": s["continuity_errors"] + s["lost_sync"] + s["bad_tables"],
        "units": F.size(units),
        "first_pts": F.array_min(F.transform(units, lambda u: u["pts"])),
        "last_pts": F.array_max(F.transform(units, lambda u: u["pts"])),
        "access": access,
    }
    return F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("-"))) for k, v in facts.items()))
