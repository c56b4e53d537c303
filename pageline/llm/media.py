"""Media columns: Netpbm and BMP images become arrays, are area-resized by integral images and kept as NPY tiles with difference hashes.

Cases. A null image or text counts as empty. An image that is no Netpbm or BMP file, is cut short, or has samples above its largest one
gives null tiles and an ``error`` text instead of a failed job. Equal bytes give equal results. Rows are handled one at a time, so repeated rows, ties and
empty tables need no care; columns besides those named are passed through untouched.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageline.llm.common import documents, slices, written

#: Rows of one NPY tile, and the width of the images that hold payloads.
TILE_ROWS = 1024
WIDTH = 64
_COMMENT = re.compile(rb"#[^\n]*")


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Numbers after the magic, comments skipped, and where the raster begins."""
    found, at = [], 2
    while len(found) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            at = data.index(b"\n", at) + 1 if data[at] == 35 else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as rows x columns, or rows x columns x 3 (P3, P6); bitmaps as 0 and 1, samples over 255 as 16 bits."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap, planes = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    head, at = _netpbm_header(data, 2 if bitmap else 3)
    width, height = head[:2]
    top = 1 if bitmap else head[2]
    if not 0 < top < 1 << 16:
        raise ValueError(f"largest sample {top}")
    n = width * height * planes
    if kind == b"P4":
        line = -(-width // 8)
        raw = np.frombuffer(data, np.uint8, line * height, at).reshape(height, line)
        out = np.unpackbits(raw, axis=1)[:, :width]
    elif kind in (b"P5", b"P6"):
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at)
        out = out if top < 256 else out.astype(np.uint16)
    elif kind == b"P1":
        out = np.frombuffer(_COMMENT.sub(b"", data[at - 1 :]).translate(None, b" \t\n\x0b\f\r"), np.uint8) - 48
    else:
        out = np.array(_COMMENT.sub(b" ", data[at - 1 :]).split()[:n], np.int64)
    if out.size < n:
        raise ValueError("the raster is cut short")
    if n and (int(out.reshape(-1)[:n].max()) > top or int(out.reshape(-1)[:n].min()) < 0):
        raise ValueError(f"a sample is not from 0 to {top}")
    if kind in (b"P2", b"P3"):
        out = out.astype(np.uint8 if top < 256 else np.uint16)
    out = out.reshape(-1)[:n]
    return out.reshape(height, width, 3) if planes == 3 else out.reshape(height, width)


def encode_pgm(pixels: np.ndarray) -> bytes:
    """8-bit rows x columns as a binary greymap (P5)."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as rows x columns x 3, top row first."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}")
    rows, line = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, rows * line, start).reshape(rows, line)
    if height > 0:
        raw = raw[::-1]
    if bits == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
        return palette[raw[:, :width]]
    return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each cell of a height x width grid, from an integral image read at fractional corners.

    The integral image is kept for a strip of ``TILE_ROWS`` rows at a time and carried on, so memory does not grow with the image.
    """
    rows, cols = pixels.shape
    if not rows or not cols:
        return np.zeros((height, width))
    x, y = np.arange(width + 1) * cols / width, np.arange(height + 1) * rows / height
    xi, yi = np.minimum(x.astype(np.int64), cols - 1), np.minimum(y.astype(np.int64), rows - 1)
    corner = np.zeros((height + 1, width + 1))
    carried = np.zeros(cols + 1)
    for top in range(0, rows, TILE_ROWS):
        strip = pixels[top : top + TILE_ROWS]
        total = np.zeros((len(strip) + 1, cols + 1))
        np.cumsum(np.cumsum(strip, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:], dtype=np.float64)
        total += carried
        for k in np.flatnonzero((yi >= top) & (yi < top + len(strip))):
            line = total[yi[k] - top] + (total[yi[k] - top + 1] - total[yi[k] - top]) * (y[k] - yi[k])
            corner[k] = line[xi] + (line[xi + 1] - line[xi]) * (x - xi)
        carried = total[-1].copy()
    cells = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return cells / (rows * cols / (height * width))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: for an 8 x 9 reduction, whether each cell is darker than its right neighbour."""
    grey = pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_tiles(pixels: np.ndarray) -> bytes:
    """NPY files one after another, each of at most ``TILE_ROWS`` rows."""
    out = io.BytesIO()
    for top in range(0, max(1, len(pixels)), TILE_ROWS):
        np.lib.format.write_array(out, np.ascontiguousarray(pixels[top : top + TILE_ROWS]), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_tiles(data: bytes) -> np.ndarray:
    src, parts = io.BytesIO(data), []
    while src.tell() < len(data):
        parts.append(np.lib.format.read_array(src, allow_pickle=False))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def media_tiles(df: DataFrame, image: str = "image", resize: tuple[int, int] | None = None) -> DataFrame:
    """``df`` with columns ``tiles`` (NPY), ``dhash``, ``height``, ``width`` and ``error`` in place of the binary column ``image``.

    ``resize``: (height, width) to reduce to before the tiles are written; None keeps every sample.
    """
    kept = [c for c in df.columns if c != image and c not in ("tiles", "dhash", "height", "width", "error")]
    out = df.select(*kept).schema.add("tiles", "binary").add("dhash", "string").add("height", "integer").add("width", "integer").add("error", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, image):
            cols: dict[str, list] = {k: [] for k in ("tiles", "dhash", "height", "width", "error")}
            for data in batch.column(batch.schema.get_field_index(image)).to_pylist():
                try:
                    px = decode(data or b"")
                    if resize:
                        planes = px[:, :, None] if px.ndim == 2 else px
                        px = np.stack([np.round(area_resize(planes[:, :, k], *resize)) for k in range(planes.shape[2])], -1).astype(px.dtype)
                        px = px[:, :, 0] if px.shape[2] == 1 else px
                    row = (to_tiles(px), difference_hash(px), px.shape[0], px.shape[1], None)
                except (ValueError, OverflowError, MemoryError, struct.error, IndexError) as e:
                    row = (None, None, None, None, str(e))
                for k, v in zip(cols, row, strict=True):
                    cols[k].append(v)
            types = {"tiles": pa.binary(), "height": pa.int32(), "width": pa.int32()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(v, types.get(k, pa.string())) for k, v in cols.items()], [*kept, *cols]
            )

    return df.select(*kept, image).mapInArrow(work, out)


def text_image(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a greymap ``image`` whose samples are the UTF-8 bytes of the text, padded with 0 to a multiple of 64."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, images = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                raw = text or b""
                rows = max(1, -(-len(raw) // WIDTH))
                sizes.append(len(raw))
                images.append(b"P5\n%d %d\n255\n" % (WIDTH, rows) + raw + bytes(rows * WIDTH - len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "image"])

    return df.select("doc_id", "text").mapInArrow(work, "doc_id long, n_bytes long, image binary")


def read_digests(media: DataFrame) -> DataFrame:
    """What the stored tiles hold, read back: payload and media digests and the difference hash of the stored samples."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tiles"):
            rows = []
            for data in batch.column(2).to_pylist():
                px = from_tiles(data)
                payload = px.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(px)))
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.select("doc_id", "n_bytes", "tiles").mapInArrow(
        work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op8_media_tiles(spark, sf_dir: str) -> DataFrame:
    """Every whole text as a greymap, decoded, written as NPY tiles in the shared folder, read back and digested. No shuffle."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tiles = media_tiles(text_image(docs)).select("doc_id", "n_bytes", "tiles")
    return read_digests(written(tiles, "media"))
