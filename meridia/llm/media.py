"""Media columns: Netpbm and BMP images to numpy arrays, area-resized, tiled as NPY, with difference hashes.

``decode`` reads PBM, PGM and PPM (text and raw, 8 and 16 bit) and BMP (1, 4, 8, 24 and 32 bit, either row
order). ``area_resize`` averages over fractional boxes by an integral image that is built band by band, so a very
tall image needs no second copy of itself. ``media_tiles`` is the operator over a column of image bytes.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meridia.llm._shared import read_table, text_slices

WIDTH = 64
TILE = 64
BAND = 8192

# ------------------------------------------------------------------- encoders


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette, rows from the top (negative height), each padded to 4 bytes."""
    height, width = samples.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), dtype=np.uint8)
    rows[:, :width] = samples
    level = np.arange(256, dtype=np.uint8)
    palette = np.stack([level, level, level, np.zeros_like(level)], axis=1).tobytes()
    start = 14 + 40 + len(palette)
    head = b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, -height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette + rows.tobytes()


# ------------------------------------------------------------------- decoders


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width) or (height, width, 3); comments may stand in the header."""
    kind = data[1] - 48
    fields, at = [], 2
    need = 2 if kind in (1, 4) else 3
    while len(fields) < need:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("damaged Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top = *fields[:2], fields[2] if need == 3 else 1
    if not (width and height and 0 < top < 65536):
        raise ValueError("Netpbm image without samples, or with a largest value out of range")
    depth = 3 if kind in (3, 6) else 1
    if kind == 1:
        bits = re.sub(rb"#[^\n]*|\s", b"", data[at:])
        flat = 1 - (np.frombuffer(bits, dtype=np.uint8)[: width * height].astype(np.int64) - 48)
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: width * height * depth], dtype=np.int64)
    elif kind == 4:
        stride = -(-width // 8)
        packed = np.frombuffer(data, dtype=np.uint8, count=stride * height, offset=at + 1).reshape(height, stride)
        flat = 1 - np.unpackbits(packed, axis=1)[:, :width].ravel()
    elif kind in (5, 6):
        sample = np.dtype(np.uint8 if top < 256 else ">u2")
        flat = np.frombuffer(data, dtype=sample, count=width * height * depth, offset=at + 1)
    else:
        raise ValueError(f"no such Netpbm kind: P{kind}")
    if flat.size != width * height * depth:
        raise ValueError("Netpbm samples are missing")
    if flat.min() < 0 or flat.max() > top:
        raise ValueError("Netpbm samples beyond the largest value")
    flat = flat.astype(np.uint8 if top < 256 else np.uint16, copy=False)
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP as (height, width) where the palette is grey, else (height, width, 3) in RGB.

    Headers of 40 bytes and more, and the older one of 12 bytes, whose palette has three bytes a colour.
    """
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if size == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
        packing = used = 0
    elif size >= 40:
        width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
        used = struct.unpack_from("<I", data, 46)[0]
    else:
        raise ValueError(f"BMP with a header of {size} bytes is not supported")
    if packing or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP with {bits} bits and compression {packing} is not supported")
    if width <= 0 or height == 0 or used > 1 << bits:
        raise ValueError("BMP without samples, or with too many colours")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    pixels = np.frombuffer(data, dtype=np.uint8, count=stride * rows, offset=start).reshape(rows, stride)
    if height > 0:
        pixels = pixels[::-1]
    if bits >= 24:
        step = bits // 8
        return pixels[:, : width * step].reshape(rows, width, step)[:, :, 2::-1]
    if bits < 8:
        split = np.unpackbits(pixels, axis=1).reshape(rows, -1, bits)
        pixels = np.packbits(split, axis=2, bitorder="big")[:, :, 0] >> (8 - bits)
    index = pixels[:, :width]
    colour = 3 if size == 12 else 4
    palette = np.frombuffer(data, dtype=np.uint8, count=colour * (used or 1 << bits), offset=14 + size).reshape(-1, colour)
    if index.max() >= len(palette):
        raise ValueError("BMP samples beyond the palette")
    grey = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
    if grey and len(palette) == 256 and (palette[:, 0] == np.arange(256)).all():
        return index
    return palette[index, 0] if grey else palette[index][:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


# ------------------------------------------------------------------- features


def to_grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(image.dtype)


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each fractional box, from the integral image at the boxes' corners."""
    rows, columns = grey.shape
    ys, xs = np.linspace(0, rows, height + 1), np.linspace(0, columns, width + 1)
    x0 = np.minimum(xs.astype(np.int64), columns - 1)
    fx = xs - x0
    at = np.zeros((height + 1, width + 1))
    above = np.zeros(columns + 1)
    for top in range(0, rows, BAND):
        band = grey[top : top + BAND]
        integral = np.zeros((len(band) + 1, columns + 1))
        np.cumsum(np.cumsum(band, axis=0, dtype=np.int64), axis=1, out=integral[1:, 1:])
        integral += above
        inside = np.flatnonzero((ys >= top) & ((ys < top + len(band)) | ((ys == rows) & (top + len(band) == rows))))
        y0 = np.minimum(ys[inside].astype(np.int64) - top, len(band) - 1)
        fy = (ys[inside] - top - y0)[:, None]
        line = integral[y0] * (1 - fy) + integral[y0 + 1] * fy
        at[inside] = line[:, x0] * (1 - fx) + line[:, x0 + 1] * fx
        above = integral[-1]
    boxes = np.diff(np.diff(at, axis=0), axis=1)
    return boxes / ((rows / height) * (columns / width))


def difference_hash(grey: np.ndarray) -> str:
    """64 bits: is each of 8 x 9 area means smaller than its right neighbour?"""
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tiles(image: np.ndarray, tile: int = TILE) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of each tile, from the top left; tiles at the edges may be smaller."""
    for y in range(0, image.shape[0], tile):
        for x in range(0, image.shape[1], tile):
            out = io.BytesIO()
            np.lib.format.write_array(out, np.ascontiguousarray(image[y : y + tile, x : x + tile]), version=(1, 0))
            yield y // tile, x // tile, out.getvalue()


# ------------------------------------------------------------------- operators

TILES_SCHEMA = "id long, height int, width int, channels int, dhash string, tile_row int, tile_column int, npy binary, error string"


def media_tiles(df: DataFrame, id_column: str, image_column: str, tile: int = TILE) -> DataFrame:
    """Decode a column of Netpbm or BMP bytes: one row per NPY tile, with the image's shape and difference hash.

    A null, empty or damaged image gives one row with ``error`` set and no tile; empty tables give no rows. Only
    the two named columns are read. Rows are streamed, so an image is all that a task holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    image = decode(data or b"")
                    channels = 1 if image.ndim == 2 else image.shape[2]
                    mark = difference_hash(to_grey(image))
                    rows = [
                        (key, image.shape[0], image.shape[1], channels, mark, y, x, npy, None)
                        for y, x, npy in npy_tiles(image, tile)
                    ]
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(key, None, None, None, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_pylist([dict(zip(TILE_NAMES, r, strict=True)) for r in rows], schema=TILE_ARROW)

    return df.select(id_column, image_column).mapInArrow(run, TILES_SCHEMA)


TILE_NAMES = [x.split()[0] for x in TILES_SCHEMA.split(", ")]
TILE_ARROW = pa.schema(
    [("id", pa.int64())]
    + [(x, pa.int32()) for x in ("height", "width", "channels")]
    + [("dhash", pa.string()), ("tile_row", pa.int32()), ("tile_column", pa.int32()), ("npy", pa.binary()), ("error", pa.string())]
)


def text_media(text: bytes) -> tuple[bytes, bytes]:
    """(payload, stored image): the text padded to a positive multiple of 64 bytes, as rows of 64 grey samples.

    An odd number of rows is stored as BMP, an even one as PGM, so both formats carry real data.
    """
    size = max(WIDTH, -(-len(text) // WIDTH) * WIDTH)
    payload = text.ljust(size, b"\0")
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    return payload, encode_bmp(samples) if len(samples) % 2 else encode_pgm(samples)


def media_features(stored: bytes) -> tuple[bytes, str]:
    """(samples read back, feature): format, shape, difference hash, number and CRC of the NPY tiles."""
    image = decode(stored)
    crc, n = 0, 0
    for _, _, npy in npy_tiles(image):
        crc, n = zlib.crc32(npy, crc), n + 1
    kind = "bmp" if stored[:2] == b"BM" else "netpbm"
    shape = "x".join(map(str, image.shape))
    return image.tobytes(), f"{kind}:{shape}:{difference_hash(to_grey(image))}:{n}:{crc:08x}"


DIGEST_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def document_media(docs: DataFrame) -> DataFrame:
    """Store every text as an image, read it back and digest it.

    A null text is empty, an empty text is one row of 64 zero samples; repeated rows give repeated results, equal
    texts equal values; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1)):
                rows = []
                for key, text in zip(keys[a:b], texts, strict=True):
                    _, stored = text_media(text)
                    back, feature = media_features(stored)
                    rows.append(
                        (key, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored),
                         hashlib.sha256(stored).hexdigest(), feature)
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), DIGEST_ARROW, strict=True)], schema=DIGEST_ARROW
                )

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST_SCHEMA)


DIGEST_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
     ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(read_table(spark, sf_dir, "documents"))
