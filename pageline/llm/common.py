"""What the operators share: tables, word rules, the shared folder, stable hashes."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageline.sources.scratch import forget, reading, shared_dir, written  # noqa: F401

#: ASCII white space, between which words stand: the pattern of one word and of one gap.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]++"
#: Rows handled together in Python: a batch is cut when its texts pass so many bytes.
SLICE_BYTES = 4 << 20
#: Rows that Spark sends to Python at once, unless the session says otherwise.
ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that their Python finds it wherever the driver runs."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        # whole texts are long: Spark's own default would hold some 100 MB of them at once
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    context = spark.sparkContext
    if getattr(context, "_pageline_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="pageline-")) / "pageline.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(str(path))
    context._pageline_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Words of a text (runs without ASCII white space); 0 for null. One split: fields less the empty ones at either end."""
    fields = F.split(F.coalesce(text, F.lit("")), GAP, -1)
    return (F.size(fields) - (F.element_at(fields, 1) == "").cast("int") - ((F.element_at(fields, -1) == "") & (F.size(fields) > 1)).cast("int")).cast("long")


def give_back() -> None:
    """Freed memory goes back to the system: workers live on from stage to stage, and what one stage freed another process may need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of one piece stay under ``limit`` bytes (a single longer text stands alone).

    Before the first and after the last one the worker hands back what it had freed.
    """
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, held = 0, 0
        for i, n in enumerate(size):
            if held + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Base of the window hashes (odd), and bytes that are hashed together.
_BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE_BYTES = 1 << 19
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of more bytes are hashed one by one.
LONG = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


_SIZES = mix64(np.arange(LONG + 2, dtype=np.uint64) * _BASE)


def _stir(held: np.ndarray, more: np.ndarray) -> np.ndarray:
    """``more`` mixed into ``held``."""
    x = held ^ more
    x *= np.uint64(0xD1342543DE82EF95)
    x += np.uint64(0x2545F4914F6CDD1D)
    return mix64(x)


def _hash_piece(raw: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw``: eight bytes at a time are mixed into what is there already, by steps that are not linear."""
    gap = gaps[raw]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = _stir(_SIZES[np.minimum(size, LONG + 1)], eight[starts] & _MASKS[np.minimum(size, 8)])
    left = np.flatnonzero(size > 8)
    for done in range(8, LONG, 8):
        if not len(left):
            return out, starts, ends
        more = size[left] - done
        out[left] = _stir(out[left], eight[starts[left] + done] & _MASKS[np.minimum(more, 8)])
        left = left[more > 8]
    for k in left.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out, starts, ends


#: All ASCII bytes but letters and digits.
PLAIN_GAPS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_hashes(texts: list[bytes | None], lower: bool = False, gaps: np.ndarray = _IS_GAP) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in turn, and where each text's words begin (one more entry than texts).

    ``lower``: A-Z count as a-z. ``gaps``: which bytes stand between words; a line end must be among them. Work goes by pieces, cut at white space, so a very long text needs no very long temporaries.
    """
    data = b"\n".join(t or b"" for t in texts)
    raw = np.frombuffer(data, np.uint8)
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = min(at + PIECE_BYTES, len(raw))
        while end < len(raw) and not gaps[raw[end]]:
            end = min(end + 4096, len(raw))
            found = np.flatnonzero(gaps[raw[max(at, end - 4096) : end]])
            if len(found):
                end = max(at, end - 4096) + int(found[-1])
                break
        h, starts, _ = _hash_piece(_LOWER[raw[at:end]] if lower else raw[at:end], gaps)
        hashes.append(h)
        places.append(starts + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    begin = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    return h, np.searchsorted(place, begin)


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` values (of the whole array; windows over a text's end are for the caller to drop)."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out *= _BASE
        out += h[k : len(h) - size + 1 + k]
    return mix64(out)
