"""Media columns in Ogg: bytes as 8-bit samples, written in pages of two logical streams and read back.

Reading verifies the checksum of every page, puts packets together from the lacing values, tells the
streams apart by serial number, and takes times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 8_000  # samples a second
BLOCK = 64  # payloads are padded to a multiple
SAMPLES, MARKS = 1, 2  # serial numbers
_PAGE = struct.Struct("<4sBBqIIIB")
_HEAD = struct.Struct("<8sIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_SEGMENTS = 64  # lacing values a page is filled to
_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """Ogg's CRC-32: polynomial 0x04C11DB7, most significant bit first, register 0 at the start, no final turn.

    It is zlib's CRC over bytes with their bits turned, with the register turned at the end.
    """
    register = zlib.crc32(data.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_TURNED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


class _Writer:
    def __init__(self, serial: int) -> None:
        self.serial, self.number = serial, 0

    def write(self, packets: list[tuple[bytes, int]], first: bool = False, last: bool = False) -> list[bytes]:
        """Pages of packets (bytes, granule position at their end); a page on which none ends has position -1."""
        pieces = []  # (lacing value, bytes, granule if the packet ends here)
        for packet, granule in packets:
            for at in range(0, len(packet) + 1, 255):
                part = packet[at : at + 255]
                pieces.append((len(part), part, granule if len(part) < 255 else -1))
        pages, open_packet = [], False
        for at in range(0, len(pieces), _SEGMENTS):
            own = pieces[at : at + _SEGMENTS]
            flags = _CONTINUED * open_packet | _FIRST * (first and at == 0) | _LAST * (last and at + _SEGMENTS >= len(pieces))
            granule = max(g for _, _, g in own)
            pages.append(_page(flags, granule, self.serial, self.number, bytes(n for n, _, _ in own), b"".join(p for _, p, _ in own)))
            self.number += 1
            open_packet = own[-1][0] == 255
        return pages


def pad(payload: bytes, block: int = BLOCK) -> bytes:
    """Bytes 0 up to a positive multiple of ``block``."""
    return payload + bytes(block if not payload else -len(payload) % block)


def encode(payload: bytes) -> bytes:
    """An Ogg file: the samples in packets of one second, and beside them a stream with a mark for each second."""
    samples, marks = _Writer(SAMPLES), _Writer(MARKS)
    pages = samples.write([(_HEAD.pack(b"mr-pcm8\0", RATE, 1), 0)], first=True) + marks.write([(_HEAD.pack(b"mr-mark\0", RATE, 1), 0)], first=True)
    for at in range(0, len(payload), RATE):
        part, end = payload[at : at + RATE], min(len(payload), at + RATE)
        last = end == len(payload)
        pages += samples.write([(part, end)], last=last)
        pages += marks.write([(struct.pack("<I", zlib.crc32(part)), end)], last=last)
    return b"".join(pages)


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream with the granule position at their end; raises ValueError on any damage."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    numbers: dict[int, int] = {}
    pending: dict[int, bytearray] = {}
    ended: set[int] = set()
    at = 0
    while at < len(media):
        if len(media) - at < _PAGE.size:
            raise ValueError("page header is cut off")
        magic, version, flags, granule, serial, number, crc, count = _PAGE.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError("no page where one is due")
        lacing = media[at + _PAGE.size : at + _PAGE.size + count]
        end = at + _PAGE.size + count + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise ValueError("page is cut off")
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError("page checksum differs")
        if number != numbers.get(serial, 0) or bool(flags & _FIRST) != (serial not in streams) or serial in ended:
            raise ValueError("page is missing or out of order")
        numbers[serial] = number + 1
        own = streams.setdefault(serial, [])
        held = pending.setdefault(serial, bytearray())
        if bool(flags & _CONTINUED) != bool(held):
            raise ValueError("packet is not continued")
        place, finished = at + _PAGE.size + count, []
        for n in lacing:
            held += media[place : place + n]
            place += n
            if n < 255:
                finished.append(bytes(held))
                held.clear()
        own += [(packet, granule) for packet in finished]
        if flags & _LAST:
            ended.add(serial)
        at = end
    if ended != set(streams) or any(pending.values()):
        raise ValueError("a stream does not end")
    return streams


def decode(media: bytes) -> tuple[bytes, dict[str, float]]:
    """The payload and what was measured on the way; every second is held against its mark."""
    streams = demultiplex(media)
    (head, _), *blocks = streams[SAMPLES]
    kind, rate, _ = _HEAD.unpack(head)
    marks = streams[MARKS][1:]
    if kind != b"mr-pcm8\0" or len(marks) != len(blocks):
        raise ValueError("not a file of samples and marks")
    done = 0
    for (part, end), (mark, at) in zip(blocks, marks, strict=True):
        done += len(part)
        if end != done or at != end or struct.unpack("<I", mark)[0] != zlib.crc32(part):
            raise ValueError("granule position or mark differs")
    payload = b"".join(part for part, _ in blocks)
    wave = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    turns = np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)) if len(wave) > 1 else 0
    return payload, {"streams": len(streams), "packets": sum(map(len, streams.values())), "seconds": done / rate, "mean": wave.mean() if len(wave) else 0.0, "rms": float(np.sqrt((wave**2).mean())) if len(wave) else 0.0, "turns": turns}


@F.arrow_udf(T.BinaryType())
def _store(payloads: pa.Array) -> pa.Array:
    return pa.array([encode(pad(p.as_py() or b"")) for p in payloads.cast(pa.binary())], type=pa.binary())


_NUMBERS = ("payload_bytes", "tail_crc32", "media_bytes")
_FIELDS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType() if n in _NUMBERS else T.StringType()) for n in _FIELDS]))
def _read(media: pa.Array) -> pa.Array:
    rows = []
    for m in media:
        stored = m.as_py()
        if stored is None:
            rows.append(None)
            continue
        payload, seen = decode(stored)
        feature = "streams={streams};packets={packets};seconds={seconds:.3f};mean={mean:.4f};rms={rms:.4f};turns={turns}".format(**seen)
        rows.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature})
    return pa.array(rows, type=pa.struct([(n, pa.int64() if n in _NUMBERS else pa.string()) for n in _FIELDS]))


@F.arrow_udf(T.BinaryType())
def _payload(media: pa.Array) -> pa.Array:
    return pa.array([None if m.as_py() is None else decode(m.as_py())[0] for m in media], type=pa.binary())


def stored(payload: Column) -> Column:
    """The media column: a payload (text or bytes, null as empty), padded with zero bytes, as an Ogg file.

    Payloads of any length are stored whole, one at a time; equal payloads give equal files, an empty table an empty
    column. A column function: other columns, whatever their names, are not looked at.
    """
    return _store(F.coalesce(payload, F.lit("").cast("string")))


def read_back(media: Column) -> Column:
    """What the stored bytes hold: lengths, digests and features of payload and file. Damage fails the job, null gives null.

    Features are the number of streams and packets, the seconds of the last granule position, and mean, root mean
    square and zero crossings of the samples around 128.
    """
    return _read(media)


def payload(media: Column) -> Column:
    """The padded payload itself."""
    return _payload(media)
