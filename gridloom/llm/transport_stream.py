"""Media columns: MPEG transport streams (operator 5).

``mux`` stores bytes losslessly as the elementary stream of a one-program transport stream:
188-byte packets, a program association table (PID 0) and a program map table before every
random-access point, PES packets with 33-bit presentation timestamps, a program clock reference
and the random-access indicator in adaptation fields, continuity counters, and stuffing.

``demux`` reads any such stream: it parses the program tables with their checksums, checks the
continuity counters of each PID (a packet sent twice counts once), reassembles the elementary
packets, and lists timestamps with random-access points. All packets of a stream are parsed at
once with numpy.

Defined results: null and empty texts are one block of blanks; equal texts give equal streams;
repeated rows are streams of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, restored, stage, texts_of

PACKET, BODY, SYNC = 188, 184, 0x47
PMT_PID, ES_PID, PRIVATE_DATA, PRIVATE_STREAM = 0x1000, 0x0100, 0x06, 0xBD
BLOCK, UNIT_BYTES, UNIT_TICKS, RANDOM_ACCESS_EVERY = 192, 192 * 64, 3000, 8
MEDIA = "doc_id long, n_bytes long, media binary"
PARSED = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, programs int, streams int, packets long, continuity_errors long, pts array<long>, random_access array<struct<packet:long,pts:long>>"


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def mpeg_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", mpeg_crc(head))


PAT = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
PMT = _section(2, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_DATA, 0xE000 | ES_PID, 0xF000))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | (counter & 15)) + b"\0" + section).ljust(PACKET, b"\xff")


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def mux(payload: bytes) -> bytes:
    """A transport stream that carries the payload, one access unit for each UNIT_BYTES bytes."""
    out, counter, tables = [], 0, 0
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        part, pts = payload[at : at + UNIT_BYTES], (unit * UNIT_TICKS) & ((1 << 33) - 1)
        entry = unit % RANDOM_ACCESS_EVERY == 0
        if entry:
            out += [_table_packet(0, PAT, tables), _table_packet(PMT_PID, PMT, tables)]
            tables += 1
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(part) + 8, 0x84, 0x80, 5) + _pts_bytes(pts) + part
        adaptation = b""
        if entry:  # random access, clock reference
            adaptation = struct.pack(">BBIH", 7, 0x50, pts >> 1, (pts & 1) << 15 | 0x7E00)
        room = BODY - len(adaptation)
        first, rest = pes[:room], np.frombuffer(pes, np.uint8)[room:]
        full, tail = divmod(len(rest), BODY)
        n = 1 + full + (tail > 0)
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
        counter += n
        if len(first) < room:  # all in one packet: stuffing goes into its adaptation field
            adaptation = _stuffed(adaptation, BODY - len(first))
        if adaptation:
            packets[0, 3] |= 0x20
            packets[0, 4 : 4 + len(adaptation)] = np.frombuffer(adaptation, np.uint8)
        packets[0, 4 + len(adaptation) :] = np.frombuffer(first, np.uint8)
        packets[1 : 1 + full, 4:] = rest[: full * BODY].reshape(full, BODY)
        if tail:
            filler = _stuffed(b"", BODY - tail)
            packets[-1, 3] |= 0x20
            packets[-1, 4 : 4 + len(filler)] = np.frombuffer(filler, np.uint8)
            packets[-1, PACKET - tail :] = rest[full * BODY :]
        out.append(packets.tobytes())
    return b"".join(out)


def _stuffed(adaptation: bytes, size: int) -> bytes:
    """An adaptation field of exactly so many bytes, its length byte among them."""
    if size == 1:
        return b"\0"
    body = adaptation[1:] or b"\0"
    return bytes([size - 1]) + body.ljust(size - 1, b"\xff")


@dataclass
class Stream:
    payload: bytes
    programs: int
    streams: int
    packets: int
    continuity_errors: int
    pts: list[int]
    random_access: list[tuple[int, int]]


def demux(media: bytes) -> Stream:
    """Parses a transport stream; the payload is that of the elementary streams, by PID."""
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    begins, counter = (p[:, 1] & 0x40) > 0, p[:, 3] & 15
    has_field, has_body = (p[:, 3] & 0x20) > 0, (p[:, 3] & 0x10) > 0
    length = np.where(has_field, p[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(has_field & (length > 1), p[:, 5], 0)
    start = 4 + length

    def table(rows: np.ndarray, table_id: int) -> set[bytes]:
        found = set()
        for i in rows[begins[rows]].tolist():
            body = p[i, start[i] :].tobytes()
            body = body[1 + body[0] :]
            size = (body[1] & 15) << 8 | body[2]
            section = body[: 3 + size]
            if section[0] == table_id:
                if mpeg_crc(section) != 0:
                    raise ValueError("a program table's checksum doesn't match")
                found.add(section)
        return found

    programs: dict[int, int] = {}
    for s in table(np.flatnonzero(pid == 0), 0):
        for i in range(8, len(s) - 4, 4):
            number, where = struct.unpack_from(">HH", s, i)
            if number:
                programs[number] = where & 0x1FFF
    elementary: dict[int, int] = {}
    for where in set(programs.values()):
        for s in table(np.flatnonzero(pid == where), 2):
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while i < len(s) - 4:
                kind, es, info = struct.unpack_from(">BHH", s, i)
                elementary[es & 0x1FFF] = kind
                i += 5 + (info & 0xFFF)
    errors, payload, pts, entries = 0, [], [], []
    for where in {0, *programs.values(), *elementary}:
        rows = np.flatnonzero((pid == where) & has_body)
        if len(rows) > 1:
            step = (counter[rows[1:]].astype(np.int32) - counter[rows[:-1]]) & 15
            twice = (step == 0) & (p[rows[1:]] == p[rows[:-1]]).all(axis=1)
            errors += int(((step != 1) & ~twice & ~((flags[rows[1:]] & 0x80) > 0)).sum())
            rows = rows[np.concatenate([[True], ~twice])]
        if where not in elementary or not len(rows):
            continue
        q, s = p[rows], start[rows]
        flat = q[np.arange(PACKET)[None, :] >= s[:, None]]
        ends = np.cumsum(PACKET - s)
        heads = np.flatnonzero(begins[rows])
        at = (ends - (PACKET - s))[heads].tolist() + [len(flat)]
        for k, (a, b) in enumerate(zip(at, at[1:])):
            pes = flat[a:b]
            if pes[:3].tobytes() != b"\0\0\1":
                raise ValueError("a packet doesn't begin with a start code")
            size = int(pes[4]) << 8 | int(pes[5])
            stamp = None
            if pes[7] & 0x80:
                t = pes[9:14].astype(np.int64).tolist()
                stamp = (t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1
                pts.append(stamp)
            row = int(rows[heads[k]])
            if flags[row] & 0x40:
                entries.append((row, -1 if stamp is None else stamp))
            payload.append(pes[9 + int(pes[8]) : 6 + size if size else None].tobytes())
    return Stream(b"".join(payload), len(programs), len(elementary), len(p), errors, pts, entries)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded to a block, as a transport stream."""

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts, keys = pdf["text"].tolist(), pdf["doc_id"]
            for a, b in batches(texts, 4_000_000):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
                media = [mux(r + b" " * (max(BLOCK, -(-len(r) // BLOCK) * BLOCK) - len(r))) for r in raw]
                yield pd.DataFrame({"doc_id": keys.iloc[a:b].to_numpy(), "n_bytes": [len(r) for r in raw], "media": media})

    return texts_of(docs, id_col, text_col).mapInPandas(encode, MEDIA)


def parse_media(media: DataFrame) -> DataFrame:
    """What demux finds in each row's stream, with the payload."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                s = [demux(m) for m in part["media"]]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "n_bytes": part["n_bytes"].to_numpy(), "payload": [x.payload for x in s], "media_bytes": [len(m) for m in part["media"]],
                    "media_sha256": [hashlib.sha256(m).hexdigest() for m in part["media"]], "programs": [x.programs for x in s], "streams": [x.streams for x in s], "packets": [x.packets for x in s],
                    "continuity_errors": [x.continuity_errors for x in s], "pts": [x.pts for x in s], "random_access": [[{"packet": a, "pts": b} for a, b in x.random_access] for x in s],
                })

    return media.mapInPandas(decode, PARSED)


def describe(parsed: DataFrame) -> DataFrame:
    """Digest columns and a feature string of parsed media."""

    def entropy(payload: pd.Series) -> pd.Series:
        out = []
        for b in payload:
            n = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
            q = n[n > 0] / max(len(b), 1)
            out.append(float(-(q * np.log2(q)).sum()))
        return pd.Series(out, dtype=float)

    bits = F.pandas_udf(entropy, "double")
    tail = F.pandas_udf(lambda s: s.map(lambda b: zlib.crc32(b[-16:])), "long")
    feature = F.format_string(
        "ts;programs=%d;streams=%d;packets=%d;units=%d;entries=%d;pts=%d..%d;continuity_errors=%d;entropy=%.4f",
        "programs", "streams", "packets", F.size("pts"), F.size("random_access"), F.array_min("pts"), F.array_max("pts"), "continuity_errors", bits("payload"),
    )
    return restored(parsed).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail("payload").alias("tail_crc32"),
        "media_bytes", "media_sha256", feature.alias("feature"), "pts", "random_access",
    )


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a stream in a table, reads the table, and describes what comes back."""
    stored = stage(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return describe(parse_media(stored)).drop("pts", "random_access")
