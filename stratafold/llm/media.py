"""Media columns: Netpbm and BMP images as numpy arrays, tiles and hashes.

Decoders cover Netpbm P1 to P6 (8 and 16 bit) and uncompressed BMP of 1, 4, 8, 24 and
32 bits.  Resizing is by area through integral images, so every source sample counts
once; tiles are NPY bytes and hashes compare neighbours of a small resized image.

Defined results: null media gives null outputs; media that do not decode give a null
array and the reason in ``error``; for texts as payloads, null is empty; repeated
rows give equal values; a payload of any length is one image, whose planes take some twenty
times its bytes in memory; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A payload unit fills rows of an 8 wide RGB image and of a 24 wide grey one.
UNIT = 576
PAD = 255
TILE = 64


class MediaError(ValueError):
    """The bytes are not an image that these decoders read."""


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Whitespace separated header numbers of a Netpbm file, past its comments."""
    values, at = [], 2
    while len(values) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                stop = data.find(b"\n", at)
                at = len(data) if stop < 0 else stop
            else:
                at += 1
        begin = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if begin == at:
            raise MediaError("bad Netpbm header")
        values.append(int(data[begin:at]))
    return values, at


def decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise MediaError("not Netpbm")
    mask, plain, colour = kind in b"14", kind in b"123", kind in b"36"
    header, at = _header(data, 2 if mask else 3)
    width, height, top = header[0], header[1], 1 if mask else header[2]
    if not width or not height or not 0 < top < 65536:
        raise MediaError("bad Netpbm size")
    shape = (height, width, 3) if colour else (height, width)
    n = width * height * (3 if colour else 1)
    if plain:
        body = data[at:]
        text = b" ".join(line.split(b"#")[0] for line in body.split(b"\n"))
        items = [c for c in text if c in b"01"] if mask else text.split()
        values = np.array([c - 48 for c in items[:n]] if mask else [int(x) for x in items[:n]], np.uint16)
        if len(values) < n:
            raise MediaError("short Netpbm data")
    else:
        at += 1
        if mask:
            stride = -(-width // 8)
            if len(data) < at + stride * height:
                raise MediaError("short Netpbm data")
            rows = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
            values = np.unpackbits(rows, axis=1)[:, :width].ravel()
        else:
            kind_of = np.dtype(np.uint8 if top < 256 else ">u2")
            if len(data) < at + n * kind_of.itemsize:
                raise MediaError("short Netpbm data")
            values = np.frombuffer(data, kind_of, n, at)
    if mask:
        values = (1 - values) * 255
    if values.max(initial=0) > (255 if mask else top):
        raise MediaError("sample above the maximum")
    return values.astype(np.uint8 if mask or top < 256 else np.uint16).reshape(shape)


def encode_netpbm(image: np.ndarray) -> bytes:
    """Raw PGM or PPM of an 8-bit grey or RGB array."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not BMP")
    start, header, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    flipped, height = height > 0, abs(height)
    if packing or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height or header < 40:
        raise MediaError("a BMP kind that is not read")
    stride = -(-width * bits // 32) * 4
    if len(data) < start + stride * height:
        raise MediaError("short BMP data")
    rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
    if bits <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        if len(data) < 14 + header + 4 * used:
            raise MediaError("short BMP palette")
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + header).reshape(used, 4)[:, 2::-1]
        index = rows if bits == 8 else np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], 2).reshape(height, -1)
        index = index[:, :width]
        if index.max(initial=0) >= used:
            raise MediaError("index above the palette")
        image = palette[index]
    else:
        deep = bits // 8
        image = rows[:, : width * deep].reshape(height, width, deep)[:, :, 2::-1]
    return np.ascontiguousarray(image[::-1] if flipped else image)


def encode_bmp(image: np.ndarray) -> bytes:
    """A 24-bit BMP of an RGB array."""
    height, width = image.shape[:2]
    stride = -(-width * 24 // 32) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    """Integer luma (fixed weights 299, 587, 114 of 1000)."""
    if image.ndim == 2:
        return image.astype(np.int64)
    return (image.astype(np.int64) @ np.array([299, 587, 114])) // 1000


def area_resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target sample, from an integral image that
    is read between samples by linear interpolation.  Exact for any ratio."""
    rows, cols = plane.shape
    total = np.zeros((rows + 1, cols + 1))
    np.cumsum(plane, axis=0, out=total[1:, 1:], dtype=np.float64)
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum(edges.astype(np.int64), size - 1)
        return low, edges - low

    y, fy = at(np.arange(height + 1) * rows / height, rows)
    x, fx = at(np.arange(width + 1) * cols / width, cols)
    by_row = total[y] + (total[y + 1] - total[y]) * fy[:, None]
    corner = by_row[:, x] + (by_row[:, x + 1] - by_row[:, x]) * fx
    return np.diff(np.diff(corner, axis=0), axis=1) / (rows / height * cols / width)


def difference_hash(plane: np.ndarray) -> str:
    """64 bits: each sample of an 8 by 9 resize against its right neighbour."""
    small = np.round(area_resize(plane, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def tile(plane: np.ndarray, side: int = TILE) -> bytes:
    """NPY bytes of the image area-resized to a square of 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(plane, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def store_payload(payload: bytes) -> bytes:
    """A payload of whole units as an image file: grey, RGB or BMP by its length."""
    samples, units = np.frombuffer(payload, np.uint8), len(payload) // UNIT
    if units % 3 == 0:
        return encode_netpbm(samples.reshape(-1, 24))
    image = samples.reshape(-1, 8, 3)
    return encode_netpbm(image) if units % 3 == 1 else encode_bmp(image)


def media_columns(media: DataFrame, id_col: str, data_col: str, side: int = TILE) -> DataFrame:
    """Rows (id, height, width, channels, tile, dhash, error): the decoded media of a
    binary column; ``tile`` holds NPY bytes, ready to be written as files or Parquet."""
    kind = dict(media.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # arrays of few images at a time
                part = batch.slice(at, 64)
                rows = []
                for data in part.column(1):
                    row: list = [None] * 6
                    if data.is_valid:
                        try:
                            image = decode(data.as_py())
                        except (ValueError, OverflowError, struct.error) as e:
                            row[5] = str(e) or type(e).__name__
                        else:
                            plane = grey(image) >> (8 if image.dtype == np.uint16 else 0)
                            row = [*image.shape[:2], image.shape[2] if image.ndim == 3 else 1, tile(plane, side), difference_hash(plane), None]
                    rows.append(row)
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["id", "height", "width", "channels", "tile", "dhash", "error"])

    return media.select(id_col, data_col).mapInArrow(run, f"id {kind}, height int, width int, channels int, tile binary, dhash string, error string")


def write_tiles(columns: DataFrame, path: str) -> None:
    """The tiles as a Parquet table of NPY bytes by id, through Spark's own writer."""
    columns.where("tile is not null").select("id", "tile", "dhash").write.parquet(path)


def payload_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = TILE) -> DataFrame:
    """Texts as media: each is padded, stored as an image, read back and measured."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                units = max(1, -(-len(raw) // UNIT))
                stored = store_payload(raw + bytes([PAD]) * (units * UNIT - len(raw)))
                image = decode(stored)
                back, plane = image.tobytes(), grey(image)
                feature = f"{difference_hash(plane)}:{hashlib.sha256(tile(plane, side)).hexdigest()[:16]}"
                out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["doc_id", *names])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return payload_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
