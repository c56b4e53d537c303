"""Substring dedup by prefix-partitioned suffix trees.

The suffixes of all documents, one for each word that begins ``WINDOW`` words or more, are split into groups by variable-length
prefixes. All suffixes are counted by their first word, first three and first six words (in hash buckets). A prefix with at most
``GROUP`` suffixes makes a group (small ones are put together); one with more is prolonged to the next length, and where six words do
not suffice, whole windows are dealt by their hash, so each group fits a task's memory. Within a group the suffixes are sorted by the
label of their path down to depth ``WINDOW`` (a 56-bit hash besides the group): runs of equal labels are the tree's deep internal nodes,
the repeats. A maximal repeat is a chain of such nodes at consecutive words; the spans of removed words are unions of these chains.

A node's first holder is its smallest doc_id; in all other documents its words are removed. Before the shuffle each batch of documents
settles what it can: only the smallest document of a batch is sent for a path, the others are known to be repeats, so a passage that a
third of all documents share is no hot group.

Cases. Null and empty texts have no words. A null doc_id is neither smaller nor larger than others: its document is left whole and
removes nothing. Rows that repeat a doc_id are one document: none removes words from the other. Documents shorter than a window are
left whole. Very long texts are hashed by pieces. Empty tables give no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageline.llm.common import documents, mix64, rolling, slices, word_hashes
from pageline.llm.jaccard import _id_filter, _passes

WINDOW = 13
#: Suffixes of one group, about; and of one batch that settles its own repeats.
GROUP = 1_000_000
BATCH = 1_000_000
#: Words and hash bits of the prefixes that are counted.
LEVELS = ((1, 12), (3, 14), (6, 14))
#: Bytes of text of one bucket of documents, when removed windows meet their texts.
BUCKET_BYTES = 8 << 20
PIECE = 1 << 20
LABEL = np.uint64((1 << 56) - 1)


def _windows(texts: list[bytes | None], size: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows in turn: path hash, bucket at each level, index of the text, first word; and the words of each text."""
    h, begin = word_hashes(texts)
    n = np.diff(begin)
    count = np.maximum(0, n - size + 1)
    of = np.repeat(np.arange(len(texts)), count)
    pos = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[:-1][of] + pos
    path = rolling(h, size)[at] if len(of) else np.zeros(0, np.uint64)
    levels = [(rolling(h, words)[at] >> np.uint64(64 - bits)).astype(np.int64) if len(of) else np.zeros(0, np.int64) for words, bits in LEVELS]
    return path, levels, of, pos, n


class Groups:
    """Which group a suffix belongs to, by the shortest prefix that is rare enough."""

    def __init__(self, counts: list[np.ndarray], group: int, least_groups: int):
        total = int(counts[0].sum())
        group = max(1, min(group, -(-total // max(1, least_groups))))
        self.tables, first = [], 0
        for n in counts[:-1]:
            held = np.where(n <= group, n, 0)
            table = np.where(n <= group, first + np.cumsum(held) // group, -1)
            first = int(table.max(initial=first - 1)) + 1
            self.tables.append(table.astype(np.int32))
        last = counts[-1]
        self.split = np.maximum(1, -(-last // group))
        weight = np.where(last <= group, last, 0)
        at = np.cumsum(weight) // group
        wide = np.where(last > group, self.split, 0)
        self.first = np.where(last <= group, first + at, first + int(at.max(initial=0)) + 1 + np.cumsum(wide) - wide)

    def of(self, path: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        out = self.first[levels[-1]] + (mix64(path) % self.split[levels[-1]].astype(np.uint64)).astype(np.int64)
        for table, level in zip(self.tables[::-1], levels[-2::-1], strict=True):
            known = table[level]
            out = np.where(known >= 0, known, out)
        return out


def prefix_counts(df: DataFrame, window: int = WINDOW) -> tuple[list[np.ndarray], int]:
    """Suffixes by prefix bucket at each level, over all documents, and the bytes of all texts; the driver holds one number a bucket."""
    sizes = [1 << bits for _, bits in LEVELS]
    edges = np.cumsum([0, *sizes])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(edges[-1] + 1, np.int64)
        for batch in slices(batches, limit=PIECE):
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            total[-1] += sum(len(t or b"") for t in texts)
            for level, size, edge in zip(_windows(texts, window)[1], sizes, edges[:-1], strict=True):
                total[edge : edge + size] += np.bincount(level, minlength=size)
        at = np.arange(0, len(total), 1024)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([total[a : a + 1024].tobytes() for a in at], pa.binary())], ["at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(data, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["at", "counts"])

    found = df.select("text").mapInArrow(work, "at int, counts binary").repartition(40, "at").mapInArrow(add, "at int, counts binary").collect()
    total = np.zeros(edges[-1] + 1, np.int64)
    for r in found:
        part = np.frombuffer(r.counts, np.int64)
        total[r.at : r.at + len(part)] = part
    return [total[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], int(total[-1])


def _repeated(docs: DataFrame) -> np.ndarray:
    """A filter of the doc_ids that rows share; only their rows need marks."""
    return _id_filter(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))


def _marks(ids: pa.Array, texts: list[bytes | None], repeated: np.ndarray) -> np.ndarray:
    """128 bits of the text for rows that may repeat a doc_id, which tell them apart; zeros for all others, which pack to nothing."""
    import xxhash

    out = np.zeros((len(texts), 2), np.uint64)
    for k in np.flatnonzero(_passes(repeated, ids)).tolist():
        out[k] = np.frombuffer(xxhash.xxh3_128_digest(texts[k] or b""), "<u8")
    return out


def _apart(x: np.ndarray, dtype: str) -> bytes:
    """Integers with all their first bytes first, then all second ones: high bytes that seldom change pack to almost nothing."""
    return np.ascontiguousarray(x.astype(dtype)).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _together(data: bytes, at: int, n: int, dtype: str) -> tuple[np.ndarray, int]:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(dtype).reshape(-1), at + n * width


def _pack_docs(ids: np.ndarray, marks: np.ndarray, n: np.ndarray, pos: np.ndarray) -> bytes:
    """Documents (id, mark if any has one, how many windows) and the first words of their windows, as steps within a document."""
    first = np.cumsum(n) - n
    step = np.diff(pos, prepend=0)
    step[first] = pos[first]
    marked = bool(marks.any())
    told = b"".join(_apart(marks[:, k], "<u8") for k in range(2)) if marked else b""
    return struct.pack("<II?", len(ids), len(pos), marked) + _apart(np.diff(ids, prepend=0), "<i8") + told + _apart(n, "<u4") + _apart(step, "<u4")


def _unpack_docs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of each window its document's id and mark, and its first word; and where the data behind begins."""
    docs, m, marked = struct.unpack_from("<II?", data)
    steps, at = _together(data, 9, docs, "<i8")
    marks = np.zeros((docs, 2), np.uint64)
    for k in range(2 * marked):
        marks[:, k], at = _together(data, at, docs, "<u8")
    n, at = _together(data, at, docs, "<u4")
    step, at = _together(data, at, m, "<u4")
    n, run = n.astype(np.int64), np.cumsum(step.astype(np.int64))
    first = np.cumsum(n) - n
    return np.repeat(np.cumsum(steps), n), np.repeat(marks, n, axis=0), run - np.repeat(run[first] - step[first], n), at


def _new(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where another document begins."""
    return np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]).any(axis=1)]))


def _pack_flags(ids: np.ndarray, marks: np.ndarray, pos: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Removed windows by bucket of documents: documents (id, mark), windows of each, first words."""
    bucket = (mix64(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((pos, *((marks[:, 1], marks[:, 0]) if marks.any() else ()), ids, bucket))
    bucket, ids, marks, pos = bucket[order], ids[order], marks[order], pos[order]
    names, blobs = [], []
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for first, last in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True):
        i, d, p = ids[first:last], marks[first:last], pos[first:last]
        new = _new(i, d)
        names.append(int(bucket[first]))
        blobs.append(_pack_docs(i[new], d[new], np.diff(np.append(new, len(i))), p))
    return names, blobs


#: Rows of the shuffles: suffixes for a group (kind 0) or removed windows for a bucket of documents (kind 1).
_SENT = "kind int, place int, data binary"


def _sent(kind: int, places: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(places), pa.int32()), pa.array(places, pa.int32()), pa.array(blobs, pa.binary())], ["kind", "place", "data"])


def _suffixes(df: DataFrame, groups: Groups, buckets: int, window: int, repeated) -> DataFrame:
    """One pass over the texts: batches settle their own repeats and send the first document of each path to the path's group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            path, part, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            ids, told = np.array(names, np.int64), np.concatenate(marks)
            rank = np.empty(len(ids), np.int64)
            rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            order = np.argsort(rank[doc], kind="stable")
            order = order[np.argsort(path[order], kind="stable")]
            of, key = doc[order], path[order]
            new_path = np.concatenate([[True], key[1:] != key[:-1]])
            new_doc = new_path | np.concatenate([[True], of[1:] != of[:-1]])
            smallest = np.repeat(ids[of[new_path]], np.diff(np.append(np.flatnonzero(new_path), len(key))))
            local = order[new_doc & (ids[of] > smallest)]
            if len(local):
                yield _sent(1, *_pack_flags(ids[doc[local]], told[doc[local]], pos[local], buckets))
            go = np.sort(order[new_doc & (ids[of] == smallest)])
            go = go[np.argsort(part[go], kind="stable")]
            cut = np.flatnonzero(np.diff(part[go], prepend=-1))
            blobs = []
            for first, last in zip(cut.tolist(), [*cut[1:].tolist(), len(go)], strict=True):
                mine = go[first:last]
                new = np.flatnonzero(np.diff(doc[mine], prepend=-1))
                used = doc[mine[new]]
                label = np.ascontiguousarray((path[mine] & LABEL).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7])
                blobs.append(_pack_docs(ids[used], told[used], np.diff(np.append(new, len(mine))), pos[mine]) + label.tobytes())
            yield _sent(0, part[go[cut]].tolist(), blobs)

        held, names, marks, count = [], [], [], 0
        for batch in slices(batches, limit=PIECE):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            path, levels, of, pos, n = _windows(texts, window)
            if not len(path):
                continue
            held.append((path, groups.of(path, levels), of + len(names), pos))
            names += batch.column(0).to_pylist()
            marks.append(_marks(batch.column(0), texts, repeated.value))
            count += len(path)
            if count >= BATCH:
                yield from flush()
                held, names, marks, count = [], [], [], 0
        if held:
            yield from flush()

    return df.filter("doc_id is not null").mapInArrow(work, _SENT)


def _nodes(sent: DataFrame, buckets: int) -> DataFrame:
    """Each group's tree at depth ``WINDOW``: the windows of all but the first holder of a node. A task holds one group at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle() -> Iterator[pa.RecordBatch]:
            ids, marks, pos, labels = [], [], [], []
            for data in held:
                own, mark, at, end = _unpack_docs(data)
                ids.append(own)
                marks.append(mark)
                pos.append(at)
                label = np.zeros((len(own), 8), np.uint8)
                label[:, :7] = np.frombuffer(data, np.uint8, offset=end).reshape(len(own), 7)
                labels.append(label.view("<u8").reshape(-1))
            key = np.concatenate(labels)
            order = np.argsort(key)
            key = key[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(new, len(key)))
            inner = np.repeat(n > 1, n)
            if inner.any():
                order = order[inner]
                own = np.concatenate(ids)[order]
                count = n[n > 1]
                smallest = np.minimum.reduceat(own, np.cumsum(count) - count)
                gone = own > np.repeat(smallest, count)
                if gone.any():
                    at = order[gone]
                    yield _sent(1, *_pack_flags(own[gone], np.concatenate(marks)[at], np.concatenate(pos)[at], buckets))

        held, now = [], None
        for batch in batches:
            for kind, place, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if kind == 1:
                    yield _sent(1, [place], [data])
                    continue
                if place != now and held:
                    yield from settle()
                    held = []
                now = place
                held.append(data)
        if held:
            yield from settle()

    # what batches settled goes along, spread by its bucket
    return sent.repartition("kind", "place").sortWithinPartitions("kind", "place").mapInArrow(work, _SENT)


def dedup_substrings(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and spans (first and one past the last removed word)."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts, size = prefix_counts(docs, window)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-size // BUCKET_BYTES))
    groups = Groups(counts, GROUP, partitions)
    repeated = df.sparkSession.sparkContext.broadcast(_repeated(docs))
    flags = _nodes(_suffixes(docs, groups, buckets, window, repeated), buckets).select("place", F.lit(0).alias("role"), F.lit(None).cast("long").alias("doc_id"), "data")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            ids = batch.column(0)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            place = (mix64(known.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            packed = [press.compress(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.ones(len(ids), np.int32)), ids, pa.array(packed, pa.binary())], ["place", "role", "doc_id", "data"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now, gone = zstandard.ZstdDecompressor(), None, {}
        for batch in slices(batches, "data", PIECE):
            place, role, ids, data = (batch.column(k).to_pylist() for k in range(4))
            out = []
            for p, r, doc, x in zip(place, role, ids, data, strict=True):
                if p != now:
                    now, gone = p, {}
                if r == 0:
                    i, d, at, _ = _unpack_docs(x)
                    new = _new(i, d)
                    for first, last in zip(new.tolist(), [*new[1:].tolist(), len(i)], strict=True):
                        gone.setdefault((int(i[first]), d[first].tobytes()), []).append(at[first:last])
                    continue
                text = open_.decompress(x)
                words = text.split()
                found = gone.get((doc, _marks(pa.array([doc], pa.int64()), [text], repeated.value).tobytes())) if doc is not None and gone else None
                if found:
                    path = rolling(word_hashes([text])[0], window)
                    starts = np.flatnonzero(np.isin(path, path[np.concatenate(found)]))
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[starts] += 1
                    edge[starts + window] -= 1
                    covered = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    out.append((doc, len(words), int(covered.sum()), b" ".join(compress(words, (~covered).tolist())).decode(), turn.reshape(-1, 2).tolist()))
                else:
                    out.append((doc, len(words), 0, b" ".join(words).decode(), []))
            if out:
                cols = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    texts = docs.mapInArrow(pack, "place int, role int, doc_id long, data binary")
    met = flags.unionByName(texts).repartition("place").sortWithinPartitions("place", "role")
    return met.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept string, spans array<array<long>>")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that begin in documents with smaller ids."""
    return dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM s
), m AS (
  SELECT g, min(doc_id) AS first FROM g GROUP BY g
), r AS (
  SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN m USING (g) WHERE m.first < g.doc_id
), k AS (
  SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id
), t AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS c,
         CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept
  FROM d LEFT JOIN k USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(c AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM t
"""
