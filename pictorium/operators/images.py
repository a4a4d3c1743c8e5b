"""Image files: headers, decoding, hashing and standardising, an Arrow batch at a time.

Sizes come from the header of PNG, JPEG, GIF and WebP files.  Pixels of PNG
files are decoded here; other formats need Pillow and are an error of their row
where that isn't installed.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEAST_SIDE = 8


@dataclass
class Header:
    kind: str
    width: int
    height: int
    animated: bool = False


def _png_chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        if at + 12 + size > len(content):
            raise ValueError("the file ends within a chunk")
        yield name, content[at + 8 : at + 8 + size]
        at += 12 + size


def _jpeg(content: bytes) -> Header:
    at, turned = 2, False
    while at + 9 < len(content):
        if content[at] != 0xFF:
            raise ValueError("no marker where one must be")
        mark = content[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if mark == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            turned = _orientation(content[at + 10 : at + 2 + size]) >= 5
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", content[at + 5 : at + 9])
            return Header("jpeg", *((height, width) if turned else (width, height)))
        at += 2 + size
    raise ValueError("no frame header")


def _orientation(tiff: bytes) -> int:
    order = "<" if tiff[:2] == b"II" else ">"
    try:
        at = struct.unpack(order + "I", tiff[4:8])[0]
        for k in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
            tag, _, _, value = struct.unpack(order + "HHIH", tiff[at + 2 + 12 * k : at + 12 + 12 * k])
            if tag == 0x0112:
                return value
    except struct.error:
        pass
    return 1


def _gif(content: bytes) -> Header:
    width, height, flags = struct.unpack("<HHB", content[6:11])
    at = 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    frames = 0
    while at < len(content) and content[at] != 0x3B and frames < 2:
        if content[at] == 0x2C:
            frames += 1
            own = content[at + 9]
            at += 11 + (3 << ((own & 7) + 1) if own & 0x80 else 0)
        else:
            at += 2
        while at < len(content) and content[at]:
            at += content[at] + 1
        at += 1
    return Header("gif", width, height, frames > 1)


def _webp(content: bytes) -> Header:
    kind, body = content[12:16], content[20:]
    if kind == b"VP8X":
        return Header("webp", 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little"), bool(body[0] & 2))
    if kind == b"VP8L":
        bits = int.from_bytes(body[1:5], "little")
        return Header("webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
    width, height = struct.unpack("<HH", body[6:10])
    return Header("webp", width & 0x3FFF, height & 0x3FFF)


def header(content: bytes) -> Header:
    """Kind, size as shown, and whether the image is animated; ValueError for anything else."""
    try:
        if content[:8] == SIGNATURE:
            chunks = dict(_png_chunks(content))
            return Header("png", *struct.unpack(">II", chunks[b"IHDR"][:8]), b"acTL" in chunks)
        if content[:2] == b"\xff\xd8":
            return _jpeg(content)
        if content[:6] in (b"GIF87a", b"GIF89a"):
            return _gif(content)
        if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            return _webp(content)
    except (struct.error, IndexError, KeyError) as error:
        raise ValueError("the file is damaged") from error
    raise ValueError("no known image format")


def decode(content: bytes) -> np.ndarray:
    """Pixels (height, width, 3) of 8 bits."""
    if content[:8] == SIGNATURE:
        chunks: dict[bytes, bytes] = {}
        for name, body in _png_chunks(content):
            chunks[name] = chunks.get(name, b"") + body
        width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
        if depth == 8 and not laced and colour in (0, 2, 3, 4, 6):
            return _coloured(_unfiltered(zlib.decompress(chunks[b"IDAT"]), width, height, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]), colour, chunks.get(b"PLTE", b""))
    try:
        from PIL import Image, ImageOps
    except ImportError as missing:
        raise ValueError("this format needs Pillow") from missing
    with Image.open(io.BytesIO(content)) as image:
        return np.asarray(ImageOps.exif_transpose(image).convert("RGB"))


def _unfiltered(raw: bytes, width: int, height: int, channels: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, (width + 1) * channels), np.int32)  # a blank row above and a blank pixel before
    for y in range(height):
        kind, line, above, own = rows[y, 0], rows[y, 1:].astype(np.int32), out[y], out[y + 1]
        if kind == 0:
            own[channels:] = line
        elif kind == 2:
            own[channels:] = (line + above[channels:]) & 255
        elif kind == 1:
            own[channels:] = np.cumsum(line.reshape(width, channels), axis=0).ravel() & 255
        else:
            for x in range(channels, len(own)):
                left, up, corner = own[x - channels], above[x], above[x - channels]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
                own[x] = (line[x - channels] + guess) & 255
    return out[1:, channels:].reshape(height, width, channels).astype(np.uint8)


def _coloured(pixels: np.ndarray, colour: int, palette: bytes) -> np.ndarray:
    if colour == 3:
        return np.frombuffer(palette, np.uint8).reshape(-1, 3)[pixels[:, :, 0]]
    return pixels[:, :, :3] if colour in (2, 6) else np.repeat(pixels[:, :, :1], 3, axis=2)


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _weights(size: int, wanted: int) -> np.ndarray:
    """(wanted, size): triangles as wide as the scale, so that shrinking averages."""
    scale = size / wanted
    centre = (np.arange(wanted) + 0.5) * scale
    w = np.maximum(0.0, 1 - np.abs(np.arange(size)[None, :] + 0.5 - centre[:, None]) / max(1.0, scale))
    return w / w.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    rows = np.tensordot(_weights(pixels.shape[0], height), pixels.astype(float), axes=1)
    return np.tensordot(_weights(pixels.shape[1], width), rows.swapaxes(0, 1), axes=1).swapaxes(0, 1)


def perceptual_hash(pixels: np.ndarray) -> str:
    """64 bits as hexadecimal: which of the 8 x 8 lowest cosine frequencies of the grey image exceed their median."""
    grey = pixels.astype(float) @ np.array([0.299, 0.587, 0.114])
    small = resized(grey[:, :, None], 32, 32)[:, :, 0]
    k = np.arange(32)
    cosines = np.cos(np.pi * (2 * k[None, :] + 1) * k[:8, None] / 64)
    low = cosines @ small @ cosines.T
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def standardised(pixels: np.ndarray, plan: dict, size: int = 448) -> np.ndarray:
    """Cropped, resized and padded with black by a plan of ``geometry.with_transform_plan``."""
    height, width, _ = pixels.shape
    cut = pixels[plan["crop_top"] : height - plan["crop_bottom"], plan["crop_left"] : width - plan["crop_right"]]
    small = np.clip(np.rint(resized(cut, plan["resized_width"], plan["resized_height"])), 0, 255).astype(np.uint8)
    out = np.zeros((size, size, 3), np.uint8)
    out[plan["pad_top"] : plan["pad_top"] + small.shape[0], plan["pad_left"] : plan["pad_left"] + small.shape[1]] = small
    return out


def image_audit(files: DataFrame, path: str = "path", content: str = "content", least: int = LEAST_SIDE) -> DataFrame:
    """(path, ok, kind, width, height, animated, error) of every file; a damaged or too small one is a row, not a failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for name, body in zip(frame[path], frame[content]):
                try:
                    h = header(bytes(body or b""))
                    small = min(h.width, h.height) < least
                    out.append((name, not small, h.kind, h.width, h.height, h.animated, f"smaller than {least}" if small else None))
                except ValueError as error:
                    out.append((name, False, None, None, None, None, str(error)))
            yield pd.DataFrame(out, columns=["path", "ok", "kind", "width", "height", "animated", "error"]).astype({"width": "Int64", "height": "Int64"})

    return files.select(path, content).mapInPandas(run, "path string, ok boolean, kind string, width bigint, height bigint, animated boolean, error string")


def image_features(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, phash, spread, error): perceptual hash and the largest standard deviation of a channel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for name, body in zip(frame[path], frame[content]):
                try:
                    pixels = decode(bytes(body or b""))
                    out.append((name, perceptual_hash(pixels), float(pixels.reshape(-1, 3).std(axis=0).max()), None))
                except (ValueError, KeyError, struct.error, zlib.error, OSError) as error:
                    out.append((name, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["path", "phash", "spread", "error"])

    return files.select(path, content).mapInPandas(run, "path string, phash string, spread double, error string")


def standard_images(works: DataFrame, path: str, content: str, plan: str) -> DataFrame:
    """(path, png, error): each image by the plan in its row, as the bytes of a PNG file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for name, body, how in zip(frame[path], frame[content], frame[plan]):
                try:
                    how = how if isinstance(how, dict) else how.asDict()
                    out.append((name, encode_png(standardised(decode(bytes(body or b"")), how)), None))
                except (ValueError, KeyError, AttributeError, struct.error, zlib.error, OSError) as error:
                    out.append((name, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["path", "png", "error"])

    return works.select(path, content, plan).mapInPandas(run, "path string, png binary, error string")
