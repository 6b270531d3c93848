"""Media columns: Matroska files written and parsed into packet tables.

A payload becomes one PCM track: frames of 8-bit samples, laced into blocks, blocks in clusters, a cue
for each cluster. The parser reads variable-length EBML elements, clusters, all three lacings and cues into
packets with track, time and byte range, so payload bytes are read where they lie.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import fresh, query, small_batches, table, whole

# Element ids of the Matroska specification.
EBML, VOID, CRC = 0x1A45DFA3, 0xEC, 0xBF
DOC_HEAD = {"version": 0x4286, "read_version": 0x42F7, "max_id": 0x42F2, "max_size": 0x42F3, "type": 0x4282, "type_version": 0x4287, "type_read": 0x4285}
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, KIND, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE, GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACES = ("none", "xiph", "fixed", "ebml")  # by the two bits of a block's flags

SAMPLES_PER_SECOND = 8000
FRAME = 512              # samples, 64 ms
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 32  # 16.4 s; a block's time in its cluster has 16 bits of ms


def vint(value: int, size: int = 0) -> bytes:
    """A length as a variable-length integer."""
    size = size or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * size).to_bytes(size, "big")


def read_vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int]:
    """(value, size in bytes); size 0 where none can be read, value -1 for 'unknown length'."""
    if at >= len(data) or not data[at]:
        return 0, 0
    size = 9 - data[at].bit_length()
    if at + size > len(data):
        return 0, 0
    value = int.from_bytes(data[at:at + size], "big")
    if keep_mark:
        return value, size
    value &= (1 << 7 * size) - 1
    return (-1 if value == (1 << 7 * size) - 1 else value), size


def element(id_: int, body: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(id_: int, value: int) -> bytes:
    return element(id_, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], kind: int) -> bytes:
    """The frames of a block behind their lace head."""
    if kind == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3:
        head += vint(sizes[0])
        for before, size in zip(sizes[:-2], sizes[1:-1]):
            step = size - before
            width = next(n for n in range(1, 9) if abs(step) < 1 << 7 * n - 1)
            head += vint(step + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file with the payload as 8-bit mono samples. Blocks take turns in how they are laced."""
    head = element(EBML, number(DOC_HEAD["version"], 1) + number(DOC_HEAD["read_version"], 1) + number(DOC_HEAD["max_id"], 4) + number(DOC_HEAD["max_size"], 8)
                   + element(DOC_HEAD["type"], b"matroska") + number(DOC_HEAD["type_version"], 4) + number(DOC_HEAD["type_read"], 2))
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLES_PER_SECOND))
                   + element(MUXER, b"tidyshelf") + element(WRITER, b"tidyshelf"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLES_PER_SECOND)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    frames = [payload[at:at + FRAME] for at in range(0, len(payload), FRAME)]
    parts, cues, position = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, len(frames), FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER):
        base = first * FRAME * 1000 // SAMPLES_PER_SECOND
        body = [number(TIME, base)]
        for k, at in enumerate(range(first, min(len(frames), first + FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER), FRAMES_PER_BLOCK)):
            some = frames[at:at + FRAMES_PER_BLOCK]
            even = len(some[-1]) == len(some[0])
            kind = 0 if len(some) == 1 else (2, 1, 3)[k % 3] if even else (1, 3)[k % 2]
            time = at * FRAME * 1000 // SAMPLES_PER_SECOND - base
            body.append(element(SIMPLE, vint(1) + struct.pack(">hB", time, 0x80 | kind << 1) + laced(some, kind)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(POINT, number(CUE_TIME, base) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, position))))
        parts.append(cluster)
        position += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


#: Elements that hold elements, with the parents that an element of unknown length ends at.
HOLDERS = frozenset({SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS})
TOP = frozenset({INFO, TRACKS, CLUSTER, CUES})


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its body), holders before what they hold. Stops at bytes that are no element."""
    while at < end:
        id_, wide = read_vint(data, at, True)
        size, long = read_vint(data, at + wide)
        if not wide or not long:
            return
        start = at + wide + long
        stop = end if size < 0 else start + size
        if size >= 0 and stop > end and id_ not in HOLDERS:
            return  # cut off
        stop = min(stop, end)
        yield id_, at, start, stop
        if id_ in HOLDERS:
            if size < 0 and id_ == CLUSTER:  # a live cluster lasts until the next element of its level
                at = start
                end_here = end
                while at < end_here:
                    inner, wide = read_vint(data, at, True)
                    if not wide or inner in TOP:
                        break
                    size, long = read_vint(data, at + wide)
                    if not long or size < 0 or at + wide + long + size > end_here:
                        return
                    yield from elements(data, at, at + wide + long + size)
                    at += wide + long + size
                continue
            yield from elements(data, start, stop)
        at = stop


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[int, list[int]]:
    """(start of the first frame, sizes of the frames) of a block's content."""
    if kind == 0:
        return at, [end - at]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        return at, [(end - at) // count] * count
    for k in range(count - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            value, wide = read_vint(data, at)
            at += wide
            if k:
                full = (1 << 7 * wide) - 1 if value < 0 else value
                size = sizes[-1] + full - ((1 << 7 * wide - 1) - 1)
            else:
                size = value
        sizes.append(size)
    return at, [*sizes, end - at - sum(sizes)]


def packets(data: bytes) -> tuple[list[tuple], int]:
    """Packets (track, time_ns, cluster, block, part, lacing, key, offset, size) in file order, and the number of cues that point at a cluster.

    Broken or cut-off files give what can be read before the break.
    """
    scale, out, clusters, cues, time, block, base = 1_000_000, [], {}, [], 0, -1, 0
    for id_, begin, start, stop in elements(data, 0, len(data)):
        if id_ == SEGMENT:
            base = start
        elif id_ == SCALE:
            scale = int.from_bytes(data[start:stop], "big")
        elif id_ == CLUSTER:
            clusters[begin - base] = len(clusters)
        elif id_ == TIME:
            time = int.from_bytes(data[start:stop], "big")
        elif id_ == CUE_CLUSTER:
            cues.append(int.from_bytes(data[start:stop], "big"))
        elif id_ in (SIMPLE, BLOCK):
            track, wide = read_vint(data, start)
            if not wide or start + wide + 3 > stop:
                continue
            offset, flags = struct.unpack_from(">hB", data, start + wide)
            kind = flags >> 1 & 3
            try:
                at, sizes = frame_sizes(data, start + wide + 3, stop, kind)
            except IndexError:
                continue
            block += 1
            for k, size in enumerate(sizes):
                if size < 0 or at + size > stop:
                    break
                # frames of a lace follow each other; only the block has a time of its own
                out.append((track, (time + offset) * scale, len(clusters) - 1, block, k, LACES[kind], bool(flags & 0x80) or id_ == BLOCK, at, size))
                at += size
    return out, sum(c in clusters for c in cues)


PACKET = "struct<track: int, time_ns: bigint, cluster: int, block: int, part: int, lacing: string, key: boolean, offset: bigint, size: bigint>"


def muxed(payload: pd.Series) -> pd.Series:
    return payload.map(lambda p: mux(bytes(p)))


def demuxed(media: pd.Series) -> pd.DataFrame:
    names = ["track", "time_ns", "cluster", "block", "part", "lacing", "key", "offset", "size"]
    rows = []
    for value in media:
        data = bytes(value) if value is not None else b""
        found, cues = packets(data)
        rows.append(([dict(zip(names, p)) for p in found], cues, b"".join(data[p[7]:p[7] + p[8]] for p in found)))
    return pd.DataFrame(rows, columns=["packets", "cues", "payload"])


def padded(text: str, unit: int = 64) -> Column:
    """The text's UTF-8 bytes and zero bytes up to a positive multiple of ``unit``."""
    raw = whole(text).cast("binary")
    size = F.octet_length(whole(text))
    short = F.when(size == 0, unit).otherwise(F.pmod(-size, F.lit(unit)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), short)))


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """All columns of ``docs`` and the text's bytes as a Matroska file. Null is the empty text; equal texts give equal files."""
    return small_batches(docs).withColumn(media, F.pandas_udf(muxed, "binary")(padded(text)))


def read(media: DataFrame, column: str = "media", packets: str = "packets", cues: str = "cues", payload: str = "payload") -> DataFrame:
    """All columns and the packets of the file, the number of its cues that lead to a cluster, and the frames' bytes one after another.

    A null file has none of them; a broken one has those before the break.
    """
    made, = fresh(media, "__demuxed")
    return small_batches(media).withColumn(made, F.pandas_udf(demuxed, f"packets array<{PACKET}>, cues int, payload binary")(F.col(column))).withColumns({packets: F.col(f"{made}.packets"), cues: F.col(f"{made}.cues"), payload: F.col(f"{made}.payload")}).drop(made)


def packet_table(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """A row for each packet: the file's key, number in the file, and the packet's fields."""
    return read(media.select(key, column), column).select(key, F.posexplode("packets").alias("packet", "__p")).select(key, "packet", "__p.*")


def feature(packets: str = "packets", cues: str = "cues") -> Column:
    """What the packets show, in one line: counts, end of the last block's time, how many packets by lacing."""
    p = F.col(packets)

    def by(name: str) -> Column:
        return F.concat(F.lit(f" {name}="), F.size(F.filter(p, lambda x: x["lacing"] == name)).cast("string"))

    return F.concat(F.lit("packets="), F.size(p).cast("string"), F.lit(" clusters="), F.coalesce(F.try_element_at(p, F.lit(-1))["cluster"] + 1, F.lit(0)).cast("string"),
                    F.lit(" blocks="), F.coalesce(F.try_element_at(p, F.lit(-1))["block"] + 1, F.lit(0)).cast("string"), F.lit(" cues="), F.col(cues).cast("string"),
                    F.lit(" last_ms="), F.coalesce(F.expr(f"try_element_at({packets}, -1).time_ns div 1000000"), F.lit(0)).cast("string"), *[by(name) for name in LACES])


@query("op8_matroska")
def op8_matroska(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    stored = read(store(docs).select("doc_id", F.octet_length(whole("text")).cast("long").alias("n_bytes"), "media"))
    size = F.octet_length("payload")
    return stored.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature().alias("feature"))
