"""Media columns: Ogg pages with two logical streams, written and read back.

A text's payload becomes 8-bit samples in packets of one stream; a second stream
carries the envelope (least and greatest sample) of each packet. Packets have
unlike lengths: small ones share a page, large ones span pages, and a page goes out
when it is full, so pages of the streams come as they fill. Reading verifies every
page's checksum, joins packets from lacing values, separates the streams by serial
number, and derives the time at which each packet ends from granule positions: a
page tells that of the last packet that ends on it, packets before it are reckoned
back from there.

Cases: a null text is an empty one; an empty payload is padded to 64 zero bytes;
equal texts give equal bytes. A stored form that is null or damaged gives a null
payload and the reason in the error column; it doesn't stop the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from itertools import accumulate, cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.llm import common

SAMPLE_RATE = 8000
#: Samples of a stream's packets, in turn; the last one has what is left. One of over 65,025 bytes has more segments than a page.
PACKET_SAMPLES = (800, 1600, 2400, 80_000)
#: Bytes from which on a page goes out when a packet ends.
PAGE_BYTES = 4096
#: Serial numbers of the two logical streams.
SAMPLES, ENVELOPE = 1, 2
#: The format's header: capture pattern, version, flags, granule position, serial, sequence, checksum, segments. Fixed values.
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MOST_SEGMENTS = 255

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """The format's CRC (polynomial 04c11db7, unreflected, from 0), by zlib's reflected one on reversed bits."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(n: int) -> bytes:
    """Lacing values of a packet of n bytes: 255 for each full segment, then the rest, 0 to 254."""
    return b"\xff" * (n // 255) + bytes([n % 255])


class Stream:
    """Pages of one logical stream, as packets fill them."""

    def __init__(self, serial: int) -> None:
        self.serial, self.sequence = serial, 0
        self.values, self.body = bytearray(), bytearray()
        #: Whether the page continues a packet, whether its last packet goes on, and where the last packet that ends on it ends.
        self.continued, self.open, self.granule = False, False, -1

    def page(self, last: bool = False) -> bytes:
        flags = (CONTINUED if self.continued else 0) | (FIRST if not self.sequence else 0) | (LAST if last else 0)
        page = bytearray(HEADER.pack(b"OggS", 0, flags, self.granule, self.serial, self.sequence, 0, len(self.values)) + self.values + self.body)
        page[22:26] = struct.pack("<I", checksum(bytes(page)))
        self.sequence += 1
        self.continued, self.granule = self.open, -1
        self.values.clear()
        self.body.clear()
        return bytes(page)

    def put(self, packet: bytes, granule: int):
        """Add a packet that ends at a granule position; yields the pages that are full before."""
        values, k, at = lacing(len(packet)), 0, 0
        while k < len(values):
            if len(self.values) == MOST_SEGMENTS or (not self.open and len(self.body) >= PAGE_BYTES):
                yield self.page()
            part = values[k : k + MOST_SEGMENTS - len(self.values)]
            size = sum(part)
            self.values += part
            self.body += packet[at : at + size]
            k, at = k + len(part), at + size
            self.open = k < len(values)
        self.granule = granule


def pad(raw: bytes, unit: int = 64) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def write(payload: bytes, raw_bytes: int) -> bytes:
    """Payload as samples of an Ogg file. raw_bytes: its length without padding, kept in the first packet."""
    sound, shape = Stream(SAMPLES), Stream(ENVELOPE)
    out = [*sound.put(b"u8pcm\0" + struct.pack("<IQ", SAMPLE_RATE, raw_bytes), 0), sound.page()]
    out += [*shape.put(b"shape\0", 0), shape.page()]
    at, sizes = 0, cycle(PACKET_SAMPLES)
    while at < len(payload):
        packet = payload[at : at + next(sizes)]
        at += len(packet)
        out += sound.put(packet, at)
        out += shape.put(bytes([min(packet), max(packet)]), at)
    return b"".join([*out, sound.page(last=True), shape.page(last=True)])


class Damaged(ValueError):
    """A stored form that breaks the format's rules."""


def read(media: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Packets of each logical stream, with the granule position at which each one ends; None where a page doesn't tell, as another packet ends after it."""
    streams: dict[int, list] = {}
    pending: dict[int, bytes] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise Damaged("cut in a page header")
        mark, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(media, at)
        values = media[at + HEADER.size : at + HEADER.size + n]
        body = at + HEADER.size + n
        stop = body + sum(values)
        if mark != b"OggS" or version or len(values) < n or stop > len(media):
            raise Damaged("no whole page")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : stop]) != crc:
            raise Damaged("checksum")
        if bool(flags & FIRST) == (serial in streams) or sequence != expected.get(serial, 0) or serial in ended:
            raise Damaged("page order")
        if bool(flags & CONTINUED) != (serial in pending):
            raise Damaged("continued packet")
        packets = streams.setdefault(serial, [])
        expected[serial] = sequence + 1
        part, size, had = pending.pop(serial, b""), 0, len(packets)
        for k, v in enumerate(values):
            size += v
            if v < 255:
                packets.append((part + media[body : body + size], None))
                body, part, size = body + size, b"", 0
            elif k == n - 1:
                pending[serial] = part + media[body:stop]
        if (granule >= 0) != (len(packets) > had):
            raise Damaged("granule position")
        if granule >= 0:
            packets[-1] = (packets[-1][0], granule)
        if flags & LAST:
            ended.add(serial)
        at = stop
    if pending or ended != set(streams):
        raise Damaged("stream without end")
    return streams


def ends(granules: list[int | None], durations: list[int]) -> list[int]:
    """Where each packet ends, in samples, from the granule positions that pages tell and the packets' durations."""
    out = list(granules)
    for i in range(len(out) - 2, -1, -1):
        if out[i] is None:
            out[i] = out[i + 1] - durations[i + 1]
    if any(a != b for a, b in zip(out, accumulate(durations), strict=True)):
        raise Damaged("granule position")
    return out


def features(media: bytes) -> tuple[bytes, int, str, list[int]]:
    """Payload, unpadded length, features, and the milliseconds at which each packet ends, all from the stored bytes."""
    streams = read(media)
    if set(streams) != {SAMPLES, ENVELOPE}:
        raise Damaged("streams")
    sound, shape = streams[SAMPLES], streams[ENVELOPE]
    if sound[0][0][:6] != b"u8pcm\0" or len(sound[0][0]) != 18 or len(sound) != len(shape):
        raise Damaged("first packet")
    rate, raw = struct.unpack("<IQ", sound[0][0][6:])
    packets = [p for p, _ in sound[1:]]
    durations = [len(p) for p in packets]
    done = ends([g for _, g in sound[1:]], durations)
    if done != ends([g for _, g in shape[1:]], durations) or any(x != bytes([min(p), max(p)]) for (x, _), p in zip(shape[1:], packets)):
        raise Damaged("envelope")
    payload = b"".join(packets)
    times = [d * 1000 // rate for d in done]
    x = np.frombuffer(payload, dtype=np.uint8)
    signed = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero((signed[1:] < 0) != (signed[:-1] < 0)))
    feature = f"ms={times[-1]};packets={len(packets)};low={int(x.min())};high={int(x.max())};sum={int(x.sum(dtype=np.int64))};crossings={crossings}"
    return payload, raw, feature, times


def attach(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and media (binary): each text stored as an Ogg file."""

    def run(batches):
        for part in common.rows(batches):
            raw = [(x or "").encode() for x in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([write(pad(x), len(x)) for x in raw], pa.binary())], names=[*keep, "media"])

    kept = df.select(F.col(text_col).alias("_text"), *keep)
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return common.map_arrow(kept, run, f"{schema}, media binary")


#: What describe() returns beside the kept columns.
DESCRIBED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packet_ms array<long>, error string"


def describe(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Read stored media back: sizes, digests, features and times (packet_ms) of what the pages hold."""
    names = [*keep, *(x.split()[0] for x in DESCRIBED.split(", "))]

    def run(batches):
        for part in common.rows(batches):
            out = []
            for media in part.column(0).to_pylist():
                size, digest = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
                try:
                    if media is None:
                        raise Damaged("null")
                    payload, raw, feature, times = features(media)
                    out.append((raw, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), size, digest, feature, times, None))
                except ValueError as e:
                    out.append((None, None, None, None, size, digest, None, None, str(e)))
            columns = zip(*out) if out else [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=names)

    kept = df.select(F.col(media_col).alias("_media"), *keep)
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return common.map_arrow(kept, run, f"{schema}, {DESCRIBED}")
