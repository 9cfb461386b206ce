"""MPEG transport streams: multiplexing a payload, and parsing it back.

A stream is 188-byte packets. The program association table (PID 0) names the program map table,
which names the elementary stream. The payload travels in PES packets with timestamps, 90 kHz
ticks; the packet that begins one carries an adaptation field with the random-access indicator and
the clock reference. The reader checks sync bytes, table CRCs and continuity counters, reassembles
the elementary packets, and keeps for each its timestamp, its size, and whether it is a
random-access point.

A null or empty payload is stored as any other, and repeated rows alike. A packet with the counter of
the one before is a duplicate, and dropped, only if their bytes are equal but for the clock reference;
another one with that counter, or one with a counter out of turn, means lost packets, unless its
discontinuity indicator says otherwise. A unit with packets lost is kept and named among the damaged.
Scrambled or faulty packets are passed over and counted.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.text import documents, frugal

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 1, 0x06, 0xBD
#: Bytes of payload in a PES packet, ticks between two, and each how many of them is a random-access point.
UNIT, TICKS, RANDOM_EVERY = 16384, 3003, 4
_crc = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1
    _crc[_i] = _c & 0xFFFFFFFF


def crc32_mpeg(data: bytes) -> int:
    c, table = 0xFFFFFFFF, _crc
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ int(table[(c >> 24) ^ b])
    return c


def section(table: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), ident, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def table_packet(pid: int, sect: bytes, counter: int = 0) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | counter) + b"\0" + sect).ljust(PACKET, b"\xff")


TABLES = table_packet(0, section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + table_packet(
    PMT_PID, section(2, PROGRAM, struct.pack(">HH", 0xE000 | ES_PID, 0xF000) + struct.pack(">BHH", STREAM_TYPE, 0xE000 | ES_PID, 0xF000))
)


def timestamp(t: int) -> bytes:
    return bytes((0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE))


def mux(payload: bytes) -> bytes:
    """A transport stream of one program with the payload as its private elementary stream."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, t = payload[at : at + UNIT], k * TICKS
        pes = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(unit) + 8, 0x84, 0x80, 5) + timestamp(t) + unit
        first = bytes((0x50 if k % RANDOM_EVERY == 0 else 0x10,)) + struct.pack(">IH", t >> 1, (t & 1) << 15 | 0x7E00)
        room = PACKET - 4 - 1 - len(first)
        body = pes[room:]
        pad = max(0, room - len(pes))
        out.append(struct.pack(">BHBB", SYNC, 0x4000 | ES_PID, 0x30 | counter, len(first) + pad) + first + b"\xff" * pad + pes[:room])
        counter = (counter + 1) & 15
        whole, rest = divmod(len(body), PACKET - 4)
        if whole:
            rows = np.empty((whole, PACKET), np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
            rows[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            rows[:, 4:] = np.frombuffer(body, np.uint8, whole * (PACKET - 4)).reshape(whole, -1)
            out.append(rows.tobytes())
            counter = (counter + whole) & 15
        if rest:
            pad = PACKET - 4 - rest
            field = bytes((pad - 1,)) + (b"\0" + b"\xff" * (pad - 2) if pad > 1 else b"")
            out.append(struct.pack(">BHB", SYNC, ES_PID, 0x30 | counter) + field + body[-rest:])
            counter = (counter + 1) & 15
    return b"".join(out)


_sound: dict[bytes, bool] = {}


def sound(sect: bytes) -> bool:
    """Whether a section's length and CRC are right."""
    if sect not in _sound:
        if len(_sound) > 1000:
            _sound.clear()
        _sound[sect] = len(sect) >= 12 and crc32_mpeg(sect) == 0
    return _sound[sect]


def join_sections(packets):
    """Sections of one PID from (counter, begins, payload) of its packets in order, None for each that is cut."""
    rest, last = b"", None
    for counter, begins, data in packets:
        if (counter, begins, data) == last and not (begins and not rest):
            continue  # sent twice
        if rest and last is not None and counter != (last[0] + 1) & 15:
            rest = b""
            yield None
        last = (counter, begins, data)
        if begins:
            at = 1 + data[0]
            if at > len(data):
                rest = b""
                yield None
                continue
            parts = [(rest + data[1:at], True)] if rest else []
            parts.append((data[at:], False))
        elif rest:
            parts = [(rest + data, False)]
        else:
            continue
        rest = b""
        for part, ends in parts:
            while part and part[0] != 0xFF:
                size = 3 + (struct.unpack_from(">H", part, 1)[0] & 0x0FFF) if len(part) >= 3 else 3
                if len(part) < max(size, 3) or size == 3:
                    if ends or (size == 3 and len(part) >= 3):
                        yield None
                    else:
                        rest = part
                    break
                yield part[:size]
                part = part[size:]
    if rest:
        yield None


def equal_packets(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two packets are one sent twice; the clock reference of a copy may differ."""
    a, b = a.copy(), b.copy()
    for x in (a, b):
        if x[3] & 0x20 and x[4] >= 7 and x[5] & 0x10:
            x[6:12] = 0
    return bool((a == b).all())


def demux(stream: bytes) -> dict:
    """pids of the program, elementary packets (bytes, timestamp, random access), the numbers of those damaged, and counts of faults."""
    n = len(stream) // PACKET
    p = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    faults = {"sync": int((p[:, 0] != SYNC).sum()), "lost": 0, "repeated": 0, "crc": 0, "trailing": len(stream) - n * PACKET}
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    good = (p[:, 0] == SYNC) & (p[:, 1] & 0x80 == 0) & (p[:, 3] & 0xC0 == 0)
    control = p[:, 3] >> 4 & 3
    head = np.where(control & 2, 5 + p[:, 4].astype(np.int32), 4)
    begins = p[:, 1] & 0x40 != 0

    def sections(of):
        at = np.flatnonzero(good & (pid == of) & (control & 1 != 0) & (head < PACKET))
        for sect in join_sections((int(p[i, 3]) & 15, bool(begins[i]), p[i, head[i] :].tobytes()) for i in at):
            if sect is None or not sound(sect):
                faults["crc"] += 1
            else:
                yield sect

    programs, streams = {}, {}
    for sect in sections(0):
        for at in range(8, len(sect) - 4, 4):
            number, of = struct.unpack_from(">HH", sect, at)
            if number:
                programs[number] = of & 0x1FFF
    for number, of in programs.items():
        for sect in sections(of):
            at = 12 + (struct.unpack_from(">H", sect, 10)[0] & 0x0FFF)
            while at + 5 <= len(sect) - 4:
                kind, es, more = struct.unpack_from(">BHH", sect, at)
                streams[es & 0x1FFF] = (number, kind)
                at += 5 + (more & 0x0FFF)
    units, damaged = [], []
    for es in streams:
        at = np.flatnonzero(good & (pid == es) & (control & 1 != 0) & (head < PACKET))
        counter = p[at, 3] & 15
        step = (np.diff(counter.astype(np.int32)) & 15) if len(at) else np.zeros(0, np.int32)
        same = np.zeros(len(at), bool)
        again = np.flatnonzero(step == 0) + 1
        same[again] = [equal_packets(p[at[i - 1]], p[at[i]]) for i in again.tolist()]
        announced = (control[at] & 2 != 0) & (p[at, 4] > 0) & (p[at, 5] & 0x80 != 0)
        gap = np.append(False, step != 1) & ~same & ~announced
        faults["repeated"] += int(same.sum())
        faults["lost"] += int(gap.sum())
        at, gap = at[~same], gap[~same]
        edge = np.flatnonzero(begins[at])
        for a, b in zip(edge, np.append(edge[1:], len(at)), strict=True):
            own = at[a:b]
            plain = head[own] == 4
            if len(own) > 2 and plain[1:-1].all():
                raw = p[own[0], head[own[0]] :].tobytes() + p[own[1:-1], 4:].tobytes() + p[own[-1], head[own[-1]] :].tobytes()
            else:
                raw = b"".join(p[i, head[i] :].tobytes() for i in own)
            if raw[:3] != b"\0\0\1" or len(raw) < 9:
                faults["sync"] += 1
                continue
            size = struct.unpack_from(">H", raw, 4)[0]
            t = None
            if raw[7] & 0x80 and len(raw) >= 14:
                x = raw[9:14]
                t = (x[0] >> 1 & 7) << 30 | x[1] << 22 | x[2] >> 1 << 15 | x[3] << 7 | x[4] >> 1
            if gap[a + 1 : b].any() or (b < len(at) and gap[b]):
                damaged.append(len(units))
            random = bool(head[own[0]] > 5 and p[own[0], 5] & 0x40)
            data = raw[9 + raw[8] : 6 + size if size else None]
            units.append((es, data, t, random))
    return {"programs": programs, "streams": streams, "units": units, "damaged": damaged, "faults": faults, "packets": n}


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and their number before."""
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def feature(parsed: dict) -> str:
    u = parsed["units"]
    times = [t for _, _, t, _ in u if t is not None]
    points = [i for i, x in enumerate(u) if x[3]]
    spread = np.bincount(np.frombuffer(b"".join(x[1] for x in u), np.uint8) >> 4, minlength=16)
    return (
        f"packets={parsed['packets']};pes={len(u)};first_pts={times[0] if times else -1};last_pts={times[-1] if times else -1};"
        f"random_access={len(points)};lost={parsed['faults']['lost']};nibbles={','.join(map(str, spread.tolist()))}"
    )


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Each text as a transport stream: digests of payload and stream, its features, the timestamps of its units and
    the numbers of those that are random-access points, and with keep the stream. A narrow map; other columns are not read."""
    kind = df.schema[id_col].dataType.simpleString()
    more = ", pts array<long>, random_access array<int>" + ", media binary" * keep

    def run(frames):
        frugal()
        for batch in frames:
            rows = []
            for text in batch.column("text"):
                payload, n = payload_of(text.as_py())
                media = mux(payload)
                parsed = demux(media)
                back = b"".join(x[1] for x in parsed["units"])
                row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(parsed))
                rows.append((*row, [x[2] for x in parsed["units"]], [i for i, x in enumerate(parsed["units"]) if x[3]], *([media] if keep else [])))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()][: 10 if keep else 9]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access", "media"]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["id", *names[: len(types)]])

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string{more}"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op7_media(spark, sf_dir: str) -> DataFrame:
    return store(documents(spark, sf_dir), keep=False)
