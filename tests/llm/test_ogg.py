import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ogg, queries
from millrace.session import table


def plain_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def test_checksum():
    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == plain_checksum(data)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 254, 255, 256, 510, 7999, 8000, 8001, 16000, 200_000])
def test_round_trip(size):
    data = ogg.pad(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes())
    assert len(data) % 64 == 0 and len(data) >= 64
    payload, seen = ogg.decode(ogg.encode(data))
    assert payload == data and seen["streams"] == 2 and seen["seconds"] == len(data) / 8000


def test_packets_span_pages_and_end_on_full_segments():
    writer = ogg._Writer(9)
    packets = [(b"a" * 255, 1), (b"", 2), (b"b" * 255 * 70, 3), (b"c" * 40_000, 4)]
    pages = writer.write(packets, first=True, last=True)
    assert len(pages) > 3 and any(p[5] & 1 for p in pages)
    assert [p for p, _ in ogg.demultiplex(b"".join(pages))[9]] == [p for p, _ in packets]


def test_damage_is_found():
    media = ogg.encode(ogg.pad(b"some payload " * 2000))
    for at in range(0, len(media), 997):
        with pytest.raises(ValueError):
            ogg.decode(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    for cut in (1, 30, len(media) // 2, len(media) - 1):
        with pytest.raises(ValueError):
            ogg.decode(media[:cut])


def test_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = queries.op5_media_columns(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = ogg.pad(texts[r.doc_id].encode())
        media = ogg.encode(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_media_column_and_odd_rows(odd_docs):
    kept = odd_docs.withColumn("media", ogg.stored(F.col("text")))
    for r in kept.select("text", ogg.payload(F.col("media")).alias("back")).collect():
        assert bytes(r.back) == ogg.pad((r.text or "").encode())
    assert odd_docs.limit(0).select(ogg.read_back(ogg.stored(F.col("text")))).count() == 0


def test_features_from_the_bytes_alone(spark, sf):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in queries.op5_media_columns(spark, sf).collect():
        data = ogg.pad(texts[r.doc_id].encode())
        seconds = -(-len(data) // 8000)
        signs = [b < 128 for b in data]
        want = {"streams": 2, "packets": 2 * (1 + seconds), "seconds": len(data) / 8000, "mean": sum(data) / len(data) - 128, "rms": (sum((b - 128) ** 2 for b in data) / len(data)) ** 0.5, "turns": sum(a != b for a, b in zip(signs, signs[1:], strict=False))}
        got = dict(f.split("=") for f in r.feature.split(";"))
        assert got.keys() == want.keys() and all(float(got[k]) == pytest.approx(want[k], abs=1e-3) for k in want)


def test_null_media_and_clashing_columns(odd_docs):
    none = odd_docs.select(ogg.read_back(F.lit(None).cast("binary")).alias("r"), ogg.payload(F.lit(None).cast("binary")).alias("p")).collect()
    assert all(r.r is None and r.p is None for r in none)
    docs = odd_docs.withColumns({n: F.lit(1) for n in ("payload_bytes", "media", "feature")})
    assert docs.select("*", ogg.read_back(ogg.stored(F.col("text"))).alias("r")).select("doc_id", "feature", "r.media_bytes").count() == odd_docs.count()
