"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes.

Nulls and undecodable bytes give null features and a reason in `media_error`; empty images cannot occur (both formats need width and
height of 1 or more). Rows are independent: ties, repeated rows and empty tables need no rule. Extra columns pass through; columns of
the input named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, raw, schema_with, slices, with_columns

UNIT, WIDTH = 192, 64


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm (P6 for three channels, P5 for one)."""
    h, w, c = pixels.shape
    return b"P%d\n%d %d\n255\n" % (6 if c == 3 else 5, w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit bottom-up BMP."""
    h, w, _ = pixels.shape
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, fields, at = data[1] - 48, [], 2
    while len(fields) < (2 if kind in (1, 4) else 3):
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        start = at
        while data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise ValueError("bad Netpbm header")
        fields.append(int(data[start:at]))
    w, h = fields[:2]
    top = fields[2] if kind not in (1, 4) else 1
    c = 3 if kind in (3, 6) else 1
    if not (w and h and 0 < top < 65536):
        raise ValueError("bad Netpbm size")
    if kind <= 3:
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        values = np.frombuffer(body.translate(None, b" \t\n\r\v\f"), np.uint8) - 48 if kind == 1 else np.array(body.split(), np.int64)
        if values.size < w * h * c:
            raise ValueError("truncated")
        pixels = values[: w * h * c].reshape(h, w, c)
    elif kind == 4:
        stride = (w + 7) // 8
        rows = np.frombuffer(data, np.uint8, h * stride, at + 1).reshape(h, stride)
        pixels = np.unpackbits(rows, axis=1)[:, :w, None]
    else:
        pixels = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * c, at + 1).reshape(h, w, c)
    if kind in (1, 4):
        return ((1 - pixels) * 255).astype(np.uint8)
    return pixels.astype(np.uint8) if top == 255 else (pixels.astype(np.float64) * 255 / top + 0.5).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    offset, header, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    colours = struct.unpack_from("<I", data, 46)[0]
    if packing or w <= 0 or not h or bits not in (1, 4, 8, 24, 32):
        raise ValueError("unsupported BMP")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, offset).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    table = np.frombuffer(data, np.uint8, 4 * (colours or 1 << bits), 14 + header).reshape(-1, 4)[:, 2::-1]
    if bits < 8:
        places = np.unpackbits(rows, axis=1).reshape(abs(h), -1, bits)
        rows = np.packbits(places, axis=2).reshape(abs(h), -1) >> (8 - bits)
    return table[rows[:, :w]]


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels, 8 bits. Netpbm P1 to P6 (plain or binary, any maxval), uncompressed BMP of 1 to 32 bits."""
    if len(data) > 2 and data[:1] == b"P" and data[1] in b"123456":
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _bounds(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.arange(parts + 1) * (n / parts)
    whole = np.minimum(edges.astype(np.int64), n)
    return whole, edges - whole


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each output cell's area, from the integral image; its rows are only built where a cell's edge lies, so memory is one row's."""
    h, w = pixels.shape[:2]
    (rows, part_y), (cols, part_x) = _bounds(h, height), _bounds(w, width)
    table = np.empty((height + 1, w + 1, pixels.shape[2]))
    above, last = np.zeros((w, pixels.shape[2])), 0
    for i, (y, part) in enumerate(zip(rows, part_y, strict=True)):
        above = above + pixels[last:y].sum(axis=0, dtype=np.uint64)
        last = y
        line = above + part * pixels[y] if part > 0 and y < h else above
        table[i, 0] = 0
        np.cumsum(line, axis=0, out=table[i, 1:])
    at = table[:, cols]
    step = table[:, np.minimum(cols + 1, w)] - at
    at = at + part_x[None, :, None] * step
    cells = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return cells / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 grey cells is darker than its right neighbour."""
    return _hash(grey(area_resize(pixels, 8, 9)))


def grey(cells: np.ndarray) -> np.ndarray:
    return cells[..., 0] if cells.shape[2] == 1 else cells[..., :3] @ np.array([0.299, 0.587, 0.114])


def _hash(tile: np.ndarray) -> str:
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    np.save(out := io.BytesIO(), np.ascontiguousarray(tile), allow_pickle=False)
    return out.getvalue()


#: What `media_columns` adds; the digests are of the decoded samples (payload) and of the stored bytes (media).
ADDED = {"width": "int", "height": "int", "channels": "int", "tile_npy": "binary", "dhash": "string", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "media_error": "string"}
ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def media_columns(df: DataFrame, column: str = "media", tile: tuple[int, int] = (8, 8)) -> DataFrame:
    """The column's images, each decoded once: adds ADDED (tile_npy: the area-resized 8-bit tile as NPY) and drops the column.

    Null and damaged images have null columns and a media_error.
    """
    kept = df.drop(column)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            out: dict[str, list] = {k: [] for k in ADDED}
            for data in raw(b.column(b.schema.names.index(column))):
                try:
                    if data is None:
                        raise ValueError("null")
                    p = decode(data)
                    small, payload = (area_resize(p, *tile) + 0.5).astype(np.uint8), p.tobytes()
                    values = (p.shape[1], p.shape[0], p.shape[2], npy(small), difference_hash(p), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), None)
                except (ValueError, IndexError, struct.error) as e:
                    values = (None,) * (len(ADDED) - 1) + (str(e)[:80] or "bad",)
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            yield with_columns(b.select(names), {k: pa.array(v, ARROW[ADDED[k]]) for k, v in out.items()})

    return df.mapInArrow(run, schema_with(kept, **ADDED))


def as_pixels(text: bytes | None) -> np.ndarray:
    """The text's bytes, with spaces up to a positive multiple of 192, as rows of 64 RGB samples."""
    data = text or b""
    data += b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))
    return np.frombuffer(data, np.uint8).reshape(-1, WIDTH, 3)


def pack_text(df: DataFrame, form: str = "ppm") -> DataFrame:
    """doc_id, n_bytes and media: each whole text (null: empty) as a lossless image; form: 'ppm' or 'bmp'."""
    encode = {"ppm": encode_ppm, "bmp": encode_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts = raw(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([encode(as_pixels(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tile_digests(df: DataFrame) -> DataFrame:
    """Adds tile_sha256: the digest of the NPY tile's shape and samples, as numpy reads them from the stored bytes (null where there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            tiles = [None if t is None else np.load(io.BytesIO(t), allow_pickle=False) for t in raw(b.column(b.schema.names.index("tile_npy")))]
            yield with_columns(b, {"tile_sha256": pa.array([None if t is None else hashlib.sha256(b"%d %d %d " % t.shape + t.tobytes()).hexdigest() for t in tiles], pa.string())})

    return df.mapInArrow(run, schema_with(df, tile_sha256="string"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document stored as a Netpbm image in the shared folder, read back, digested, resized and hashed; the NPY tiles are stored and read back too."""
    ws = Workspace(spark)
    stored = ws.stage(pack_text(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    tiled = ws.stage(media_columns(stored).drop("media_error"), "tiles")
    ws.drop(stored)
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("dhash").alias("feature"), "tile_sha256")
    return tile_digests(tiled).select(*columns)
