import struct
import zlib

import numpy as np

from pictorium.functions.geometry import with_transform_plan
from pictorium.functions.keys import hamming, hash_bits
from pictorium.operators import images
from pyspark.sql import functions as F


def picture(width=60, height=40, seed=0):
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 256, (5, 6, 3))
    return np.clip(images.resized(coarse, width, height), 0, 255).astype(np.uint8)


def filtered_png(pixels, kind):
    """A PNG whose rows all use one filter, written here by the definition."""
    h, w, c = pixels.shape
    p = np.zeros((h + 1, w + 1, c), np.int32)
    p[1:, 1:] = pixels
    here, left, up, corner = p[1:, 1:], p[1:, :-1], p[:-1, 1:], p[:-1, :-1]
    near = left + up - corner
    choice = np.where((abs(near - left) <= abs(near - up)) & (abs(near - left) <= abs(near - corner)), left, np.where(abs(near - up) <= abs(near - corner), up, corner))
    guess = [np.zeros_like(here), left, up, (left + up) // 2, choice][kind]
    body = ((here - guess) & 255).astype(np.uint8).reshape(h, -1)
    raw = b"".join(bytes([kind]) + row.tobytes() for row in body)
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_round_trip_with_every_filter():
    p = picture()
    assert (images.decode(images.encode_png(p)) == p).all()
    for kind in range(5):
        assert (images.decode(filtered_png(p, kind)) == p).all(), kind


def test_headers():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 50) + b"\x03" + b"\0" * 20
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + b"\0\0\0\0"
    turned = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + jpeg[8:]
    gif = b"GIF89a" + struct.pack("<HHBBB", 20, 10, 0, 0, 0) + (b"\x2c" + b"\0" * 9 + b"\x02\x01a\0") * 2 + b"\x3b"
    webp = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0" + b"\x02\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    got = [images.header(x) for x in (images.encode_png(picture(9, 7)), jpeg, turned, gif, webp)]
    assert [(g.kind, g.width, g.height, g.animated) for g in got] == [("png", 9, 7, False), ("jpeg", 50, 30, False), ("jpeg", 30, 50, False), ("gif", 20, 10, True), ("webp", 100, 50, True)]


def test_audit_and_features(spark, tmp_path):
    from pictorium.sources.readers import read_files

    whole = images.encode_png(picture(90, 60))
    small = images.encode_png(picture(45, 30))
    for name, body in {"a.png": whole, "b.png": small, "c.png": whole[:60], "d.jpg": b"no image", "e.png": images.encode_png(picture(90, 60, seed=9)), "f.png": images.encode_png(picture(5, 60)), "g.png": b""}.items():
        (tmp_path / name).write_bytes(body)
    files = read_files(spark, str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1))
    audit = {r.path: r for r in images.image_audit(files).collect()}
    assert [n for n, r in sorted(audit.items()) if r.ok] == ["a.png", "b.png", "e.png"]
    assert audit["a.png"].width == 90 and audit["f.png"].error == "smaller than 8" and audit["d.jpg"].error == "no known image format" and audit["c.png"].error
    found = images.image_features(files)
    hashes = {r.path: r.phash for r in found.collect()}
    assert hashes["c.png"] is None and hashes["d.jpg"] is None
    gap = found.where("path = 'a.png'").crossJoin(found.where("path in ('b.png', 'e.png')").select(F.col("path").alias("other"), F.col("phash").alias("o")))
    gap = {r.other: r.d for r in gap.select("other", hamming(hash_bits(F.col("phash")), hash_bits(F.col("o"))).alias("d")).collect()}
    assert gap["b.png"] <= 6 < gap["e.png"]
    flat = spark.createDataFrame([("x", images.encode_png(np.full((9, 9, 3), 7, np.uint8)))], "path string, content binary")
    assert images.image_features(flat).first().spread == 0.0


def test_standard_images(spark):
    wide = np.zeros((40, 200, 3), np.uint8)
    wide[:, 100:] = 200
    df = spark.createDataFrame([("x", images.encode_png(wide), 200, 40), ("y", b"?", 200, 40), ("z", images.encode_png(wide), 0, 40)], "path string, content binary, w int, h int")
    rows = {r.path: r for r in images.standard_images(with_transform_plan(df, "w", "h", "p"), "path", "content", "p").collect()}
    out = images.decode(bytes(rows["x"].png))
    assert out.shape == (448, 448, 3) and out[224, 20].tolist() == [0, 0, 0] and out[224, 430].tolist() == [200, 200, 200] and out[10, 430].sum() == 0
    assert rows["y"].png is None and rows["y"].error and rows["z"].png is None
