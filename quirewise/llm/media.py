"""Media columns: images as bytes, decoded to arrays, resized, tiled and hashed.

A payload of bytes is stored losslessly as the samples of a 24-pixel wide image:
binary PGM, binary PPM or 8-bit BMP, taken in turn by the image's height.  The
stored bytes are parsed again to a numpy array; its area-average resize by
integral images gives a fixed grid, from which the difference hash is taken; the
array is cut into tiles that are written as NPY bytes.

Rows: a null text is stored as an empty one (one block of padding); equal texts
have equal values; repeated rows are stored each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, record_batch, text_or_empty

WIDTH = 24
#: Samples of one block: a whole number of rows in each of the formats.
BLOCK = 576
PAD = 255
#: Rows and columns of the grid that is hashed; each row gives one bit less.
GRID = (8, 9)
TILE = 24


def pad(raw: bytes) -> bytes:
    """The bytes, padded to a positive multiple of BLOCK."""
    return raw + bytes([PAD]) * ((-len(raw)) % BLOCK if raw else BLOCK)


def store(payload: bytes) -> bytes:
    """The image file that holds a padded payload."""
    kind = len(payload) // BLOCK % 3
    if kind == 0:
        return bmp(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))
    if kind == 1:
        return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload
    return b"P6\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH // 3) + payload


def bmp(pixels: np.ndarray) -> bytes:
    """An 8-bit greyscale BMP: rows from the bottom up, each padded to four bytes."""
    height, width = pixels.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = pixels[::-1]
    palette = np.zeros((256, 4), np.uint8)
    palette[:, :3] = np.arange(256, dtype=np.uint8)[:, None]
    offset = 14 + 40 + palette.size
    head = struct.pack("<2sIHHI", b"BM", offset + rows.size, 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette.tobytes() + rows.tobytes()


def decode(media: bytes) -> np.ndarray:
    """The samples of a stored image as (height, width, channels)."""
    if media[:2] == b"BM":
        return _decode_bmp(media)
    if media[:2] in (b"P2", b"P3", b"P5", b"P6"):
        return _decode_netpbm(media)
    raise ValueError("neither Netpbm nor BMP")


def _decode_bmp(media: bytes) -> np.ndarray:
    (offset,) = struct.unpack_from("<I", media, 10)
    size, width, height, _, depth, packing, _, _, _, colours, _ = struct.unpack_from("<IiiHHIIiiII", media, 14)
    if packing or depth not in (8, 24):
        raise ValueError("only plain BMP of 8 or 24 bits")
    stride = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(media, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if depth == 24:
        return rows[:, : 3 * width].reshape(abs(height), width, 3)[:, :, ::-1]
    palette = np.frombuffer(media, np.uint8, 4 * (colours or 256), 14 + size).reshape(-1, 4)[:, 2::-1]
    pixels = palette[rows[:, :width]]
    grey = (palette == palette[:, :1]).all()
    return pixels[:, :, :1] if grey else pixels


def _decode_netpbm(media: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while media[at : at + 1].isspace():
            at += 1
        if media[at : at + 1] == b"#":
            at = media.index(b"\n", at)
            continue
        end = at
        while end < len(media) and not media[end : end + 1].isspace():
            end += 1
        fields.append(int(media[at:end]))
        at = end
    width, height, most = fields
    channels = 3 if media[1:2] in b"36" else 1
    if most > 255:
        raise ValueError("only 8-bit samples")
    count = width * height * channels
    if media[1:2] in b"23":
        samples = np.array(media[at:].split()[:count], np.uint8)
    else:
        samples = np.frombuffer(media, np.uint8, count, at + 1)
    return samples.reshape(height, width, channels)


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages of a (h, w) array, exact for fractional boxes, by its integral image."""
    integral = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    integral[1:, 1:] = grey.cumsum(0, dtype=np.float64).cumsum(1)

    def at_edges(table: np.ndarray, n: int) -> np.ndarray:
        edges = np.arange(n + 1) * ((table.shape[0] - 1) / n)
        low = np.minimum(edges.astype(int), table.shape[0] - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    sums = at_edges(at_edges(integral, height).T, width).T
    boxes = sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]
    return boxes / (grey.shape[0] / height * grey.shape[1] / width)


def difference_hash(pixels: np.ndarray) -> str:
    """Bits of which neighbours grow brighter in the resized image, as hex digits."""
    small = np.round(area_resize(pixels.mean(axis=2), *GRID), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tiles(pixels: np.ndarray, tile: int = TILE) -> list[bytes]:
    """The image cut into tiles, each as the bytes of an NPY file."""
    out = []
    for top in range(0, pixels.shape[0], tile):
        for left in range(0, pixels.shape[1], tile):
            file = io.BytesIO()
            np.save(file, np.ascontiguousarray(pixels[top : top + tile, left : left + tile]), allow_pickle=False)
            out.append(file.getvalue())
    return out


def to_media(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, media`` of every row: the text's bytes stored as an image."""
    kind = docs.schema[key].dataType.simpleString()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(1).to_pylist()
        made = record_batch(n=(map(len, raw), pa.int64()), m=([store(pad(r)) for r in raw], pa.binary()))
        return pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=[key, "n_bytes", "media"])

    rows = docs.select(key, text_or_empty().cast("binary").alias("_raw"))
    return map_batches(rows, per_batch, f"`{key}` {kind}, n_bytes bigint, media binary")


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, payload, media, tiles, difference_hash`` from stored images."""
    kind = media.schema[key].dataType.simpleString()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        pixels = [decode(m) for m in batch.column("media").to_pylist()]
        made = record_batch(
            payload=([p.tobytes() for p in pixels], pa.binary()),
            tiles=([npy_tiles(p) for p in pixels], pa.list_(pa.binary())),
            difference_hash=([difference_hash(p) for p in pixels], pa.string()),
        )
        names = [key, "n_bytes", "media", *made.schema.names]
        return pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_bytes"), batch.column("media"), *made.columns], names=names)

    schema = f"`{key}` {kind}, n_bytes bigint, media binary, payload binary, tiles array<binary>, difference_hash string"
    return map_batches(media.select(key, "n_bytes", "media"), per_batch, schema)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored images of the whole documents table."""
    found = features(to_media(read(spark, sf_dir, "documents")))
    size = F.octet_length("payload")
    tiles = F.sha2(F.array_join(F.transform("tiles", lambda t: F.md5(t)), ","), 256)
    return found.select(
        "doc_id",
        "n_bytes",
        size.cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "difference_hash", F.size("tiles").cast("string"), F.substring(tiles, 1, 16)).alias("feature"),
    )
