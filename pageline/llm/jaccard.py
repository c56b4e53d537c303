"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct 5-word shingles. Shingles are ordered rare class first, then by hash. Two sets of Jaccard
similarity t or more share at least one shingle among the first n - ceil(t n) + 1 of each (n: the set's size). If the first one that
they share is of the rare class, both index it by itself. If not, all they share are frequent; then each prefix is extended by g
places, the frequent shingles in it are dealt by hash into g parts, and since 1 + g shared ones are among them, some part holds two:
each pair within a part is indexed. g follows the size of the set; as similar sets differ in size by a factor of at most 1 / t, a
document indexes its pairs for its own size class and the next, and no link is lost. Documents with fewer than t n frequent shingles
index no pairs: what they share with a similar set would all be frequent, and too little.

Which shingles are frequent is read from counts of all shingles in hash buckets (about ``BUCKET_LOAD`` shingles in each): those in
buckets that stand out from the mean by ``STANDOUT`` standard deviations. A wrong class costs time, never a link.

Documents that meet under an index entry are candidates: all pairs of a small group, but for large groups only the lowest id with each
other one. How many single shingles a pair shares in its prefixes bounds the whole overlap from above: what is not counted lies behind
the prefix that ends first, or in large groups. Candidates that the bound leaves are verified exactly, over the words of their whole
texts; only texts of documents in such a pair travel. Then, for large groups that still span several components, the pairs across
components follow, so that no link between them is missed. Equal sets (equal in size and 128 bits) are linked without being compared.

Cases. A null doc_id is linked with nothing; its component_id is null. Null and empty texts have no shingle, are linked with nothing and are their own component. Fewer than five words are one
shingle, that of the whole sequence. Repeated rows and ids fall together. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageline.llm.common import documents, forget, mix64, rolling, slices, word_hashes, written
from pageline.llm.graph import components

WORDS = 5
#: Least similarity in hundredths.
LEAST = 75
#: Shingles of one hash bucket in which they are counted, about, and the most buckets (as a power of two).
BUCKET_LOAD = 16
MOST_BITS = 24
STANDOUT = 8
#: Documents under one index entry of which all pairs are candidates at once.
SMALL = 64
#: Documents and shingles of one block of a family, about.
BLOCK_DOCS = 512
BLOCK_SHINGLES = 500_000
#: Index entries that one task sorts at a time, about, and members that one task compares with a hub.
PART_ENTRIES = 1_000_000
COMPARED = 256
#: Stands for no component.
_NONE = -(1 << 63)
#: Copies are set apart before the index is made where at least one in so many documents is one.
COPIES = 20
#: Texts of one piece of work.
PIECE = 1 << 20
#: Most bits of the filter of ids whose texts travel, as a power of two (16 MB).
MOST_FILTER_BITS = 27


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    h, begin = word_hashes(texts, lower=True)
    rolled = rolling(h, words)
    out = []
    for first, last in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        n = last - first
        if n >= words:
            out.append(np.unique(rolled[first : last - words + 1]))
        elif n:
            out.append(mix64(rolling(h[first:last], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def alike(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """Whether two sorted sets have Jaccard similarity ``least`` hundredths or more."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= least * (len(a) + len(b) - both)


def shingle_words(text: bytes, words: int = WORDS) -> set[bytes]:
    """The distinct shingles of a text as words."""
    w = text.lower().split()  # ASCII letters and ASCII white space alone, as these are bytes
    return {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def truly_alike(a: set[bytes], b: set[bytes], least: int = LEAST) -> bool:
    both = len(a & b)
    return 100 * both >= least * (len(a) + len(b) - both) and both > 0


def _size_class(n: int, least: int) -> int:
    """Classes grow by 100 / least, so similar sets are in the same or in neighbouring ones."""
    k, top = 0, 1.0
    while top * (1 + 1e-12) < n:
        top *= 100 / least
        k += 1
    return k


def index_entries(shingles: np.ndarray, frequent: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, int, int]:
    """The entries of one set: single rare shingles first, then pairs of frequent ones; how many singles; and where these end.

    Singles that are all of the rare class end at infinity (the largest hash).
    """
    n = len(shingles)
    need = -(-least * n // 100)
    if n == 1 or not frequent.any():
        single = shingles[: n - need + 1]
        return single, len(single), int(single[-1]) if len(single) < n else -1
    rare, common = shingles[~frequent], shingles[frequent]
    single = rare[: n - need + 1]
    out = [single]
    own = _size_class(n, least)
    for size_class in (own, own + 1) if len(common) >= need else ():
        smallest = max(2.0, (100 / least) ** (size_class - 2))
        parts = max(1, min(int(smallest / 16), -(-least * int(smallest) // 100) - 1))
        held = common[: max(0, n - need + 1 + parts - len(rare))]
        part = (held >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        held, part = held[order], part[order]
        edges = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 62), append=np.uint64(1 << 62)))
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            x = held[first:last]
            i, j = np.triu_indices(len(x), 1)
            out.append(mix64(x[i] * np.uint64(0x9E3779B97F4A7C15) + mix64(x[j] + np.uint64(size_class))))
    return np.concatenate(out), len(single), int(single[-1]) if len(single) < len(rare) else -1


def _counted(df: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """Each document's set size and digest, the frequent buckets, and how many shingles there are.

    Two passes: the first tells how many shingles there are, the second counts them in as many buckets as that asks for.
    """
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # five bytes or more to a word and its gap, about
    bits = max(16, min(MOST_BITS, int(size / 5 / BUCKET_LOAD).bit_length()))
    shift = np.uint64(64 - bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint8)  # a task's share; counts over 255 stay there
        for batch in slices(batches, limit=PIECE):
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())
            if any(map(len, sets)):
                at, n = np.unique((np.concatenate(sets) >> shift).astype(np.int64), return_counts=True)
                total[at] = np.minimum(255, total[at] + n)
            yield _rows(batch.column(0), [len(s) for s in sets], [_digest(s) for s in sets], [None] * len(sets), [None] * len(sets))
        press = zstandard.ZstdCompressor(level=1)  # a task's counts are small numbers
        for at in range(0, len(total), 1 << 14):
            yield _rows(pa.array([None], pa.int64()), [None], [None], [at >> 14], [press.compress(total[at : at + (1 << 14)].tobytes())])

    def _rows(ids, n, digest, block, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(block, pa.int32()), pa.array(counts, pa.binary())], ["doc_id", "n", "digest", "block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, unpack = {}, zstandard.ZstdDecompressor()
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(unpack.decompress(data), np.uint8).astype(np.uint32)
                sums[block] = sums[block] + got if block in sums else got
        blocks = list(sums)
        mean = [float(sums[b].mean()) for b in blocks]
        bitmap = [np.packbits(sums[b] > m + STANDOUT * max(1.0, m**0.5)).tobytes() for b, m in zip(blocks, mean, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(bitmap, pa.binary())], ["block", "bitmap"])

    both = written(df.mapInArrow(work, "doc_id long, n long, digest binary, block int, counts binary"), "shingle-counts")
    narrow = both.filter("block is null").select("doc_id", "n", "digest")
    counts = both.filter("block is not null").select("block", "counts").repartition("block").mapInArrow(add, "block int, bitmap binary")
    hot = np.zeros(1 << bits, bool)
    for r in counts.collect():  # one bit a bucket, 2 MB at most
        hot[r.block << 14 : (r.block + 1) << 14] = np.unpackbits(np.frombuffer(r.bitmap, np.uint8)).astype(bool)
    # the counts are many times the rows that are still to be read
    narrow = written(narrow, "set-sizes")
    forget(both)
    return narrow, hot, int(narrow.agg(F.sum("n")).first()[0] or 0)


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    return struct.pack("<QQ", int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix64(s + np.uint64(0x632BE59BD9B4E019)))) if len(s) else 0)


def _bytes_apart(x: np.ndarray) -> bytes:
    """Little-endian bytes of integers, all first bytes first: high bytes of small numbers then pack to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _bytes_together(data: bytes, at: int, n: int, dtype: str) -> tuple[np.ndarray, int]:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(dtype).reshape(-1), at + n * width


def _index(df: DataFrame, frequent: np.ndarray, parts: int, least: int, small: int) -> DataFrame:
    """Packed index entries, rows part and data: of each document its id, size, digest, entries; pairs carry the lowest bit, and the
    next one says that the document stands for more of its batch.

    Rows of negative parts tell of each document its id, size, number of singles and where these end (D), or of entries that a batch has
    often the entry, its lowest document and another, and whether it is a single (S).
    """
    packed_bits = np.packbits(frequent).tobytes()
    shift = np.uint64(64 - (len(frequent).bit_length() - 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(np.frombuffer(packed_bits, np.uint8)).astype(bool)
        docs: list[tuple[int, ...]] = []
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        count = 0

        def flush() -> pa.RecordBatch:
            entries = np.concatenate(held)
            of = np.repeat(np.arange(len(docs), dtype=np.uint32), [len(x) for x in held])
            ids = np.array([x[0] for x in docs], "<i8")
            _, group, often = np.unique(entries, return_inverse=True, return_counts=True)
            hot_rows = np.flatnonzero(often[group] > small)
            stars = b""
            if len(hot_rows):
                hot_rows = hot_rows[np.lexsort((ids[of[hot_rows]], group[hot_rows]))]
                first = np.flatnonzero(np.diff(group[hot_rows], prepend=-1))
                lead = np.repeat(first, np.diff(np.append(first, len(hot_rows))))
                rest = np.setdiff1d(np.arange(len(hot_rows)), first)
                star = np.stack([entries[hot_rows].view("<i8"), ids[of[hot_rows[lead]]], ids[of[hot_rows]], (entries[hot_rows] & np.uint64(1)) == 0], 1)
                stars = b"S" + struct.pack("<I", len(star)) + star.astype("<i8").tobytes()
                keep = np.ones(len(entries), bool)
                keep[hot_rows[rest]] = False
                entries[hot_rows[first]] |= np.uint64(2)
                entries, of = entries[keep], of[keep]
            part = (mix64(entries & ~np.uint64(2)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            entries, of, part = entries[order], of[order], part[order]
            ids, sizes, digests, singles, ends, common = (np.array(x, t) for x, t in zip(zip(*docs, strict=True), ("<i8", "<u4", "<u8", "<u4", "<i8", "<u4"), strict=True))
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            names, blobs = [-1 - int(ids[0]) % parts], [b"D" + struct.pack("<I", len(ids)) + ids.tobytes() + sizes.tobytes() + singles.tobytes() + ends.tobytes() + common.tobytes()]
            if stars:
                names.append(names[0])
                blobs.append(stars)
            for first, last in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True):
                new = first + np.flatnonzero(np.diff(of[first:last].astype(np.int64), prepend=-1))
                used, n = of[new], np.diff(np.append(new, last)).astype("<u4")
                names.append(int(part[first]))
                blobs.append(struct.pack("<II", len(used), last - first) + _bytes_apart(ids[used]) + _bytes_apart(sizes[used]) + _bytes_apart(common[used]) + _bytes_apart(n) + digests[used].tobytes() + _six(entries[first:last]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["part", "data"])

        for batch in slices(batches, limit=PIECE):
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                digest = _digest(s)
                if doc is None or not len(s) or digest in seen:
                    continue
                seen.add(digest)
                is_hot = hot[(s >> shift).astype(np.int64)]
                entries, single, end = index_entries(s, is_hot, least)
                entries = (entries >> np.uint64(16)) & ~np.uint64(3)
                entries[single:] |= np.uint64(1)
                held.append(entries)
                docs.append((doc, len(s), int.from_bytes(digest[:8], "little"), single, end >> 1 if end >= 0 else (1 << 63) - 1, int(is_hot.sum())))
                count += len(entries)
                if count >= 1_000_000:
                    yield flush()
                    docs, held, seen, count = [], [], set(), 0
        if docs:
            yield flush()

    return df.mapInArrow(work, "part int, data binary")


def _six(entries: np.ndarray) -> bytes:
    """The six low bytes of each entry, which is all it has: two entries that agree in these by chance lead to candidates, not to links."""
    return np.ascontiguousarray(entries.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
    return out.view("<u8").reshape(-1)


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    docs, m = struct.unpack_from("<II", data)
    ids, at = _bytes_together(data, 8, docs, "<i8")
    sizes, at = _bytes_together(data, at, docs, "<u4")
    common, at = _bytes_together(data, at, docs, "<u4")
    n, at = _bytes_together(data, at, docs, "<u4")
    digests = np.frombuffer(data, "<u8", docs, at)
    return np.repeat(ids, n), np.repeat(sizes, n), np.repeat(common, n), np.repeat(digests, n), _from_six(data, m, at + 8 * docs)


def _groups(blobs: list[bytes], least: int, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of small groups (lower id first) with how many singles they share here; of large groups the lowest id, a document
    and of how many of them that are singles it is a member: these two are a candidate pair that no other row tells."""
    ids, sizes, common, digests, entries = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
    stands, entries = (entries & np.uint64(2)) != 0, entries & ~np.uint64(2)
    crowded = np.unique(entries[stands])
    # of equal sets under an entry the lowest id stays: they are linked elsewhere
    by = np.lexsort((ids, digests, entries))
    ids, sizes, common, digests, entries = ids[by], sizes[by].astype(np.int64), common[by].astype(np.int64), digests[by], entries[by]
    new = np.concatenate([[True], (entries[1:] != entries[:-1]) | (digests[1:] != digests[:-1])])
    ids, sizes, common, entries = ids[new], sizes[new], common[new], entries[new]
    first = np.flatnonzero(np.concatenate([[True], entries[1:] != entries[:-1]]))
    n = np.diff(np.append(first, len(entries)))
    keep = np.repeat(n > 1, n)
    ids, sizes, common, entries, n = ids[keep], sizes[keep], common[keep], entries[keep], n[n > 1]
    order = np.lexsort((ids, entries))
    ids, sizes, common, entries = ids[order], sizes[order], common[order], entries[order]
    first = np.cumsum(n) - n
    nth = np.arange(len(entries)) - np.repeat(first, n)
    size_of_group, single = np.repeat(n, n), (entries & np.uint64(1)) == 0
    size_of_group[np.isin(entries, crowded)] += small  # it is larger than what was sent
    pairs = [np.zeros((0, 3), np.int64)]

    def meet(at: np.ndarray, to: np.ndarray, counts: np.ndarray) -> None:
        # sizes must fit; a pair of frequent shingles is for sets that share no rare one
        fits = 100 * np.minimum(sizes[at], sizes[to]) >= least * np.maximum(sizes[at], sizes[to])
        fits &= single[at] | ((100 + least) * np.minimum(common[at], common[to]) >= least * (sizes[at] + sizes[to]))
        pairs.append(np.stack([ids[to][fits], ids[at][fits], counts[fits]], 1))

    open_ = np.flatnonzero(size_of_group <= small)
    for back in range(1, small):
        open_ = open_[nth[open_] >= back]
        if not len(open_):
            break
        meet(open_, open_ - back, single[open_].astype(np.int64))
    large = size_of_group > small
    both = np.concatenate(pairs)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (both[1:, :2] != both[:-1, :2]).any(axis=1)])) if len(both) else np.zeros(0, np.int64)
    shared = np.add.reduceat(both[:, 2], new) if len(both) else both[:, 2]
    return np.column_stack([both[new, :2], shared]), _members(np.repeat(ids[first], n)[large], ids[large], single[large])


def _members(lead: np.ndarray, ids: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Each lead and document once, with the number of singles: a group is told by its lead, so no join on entries has to find it again."""
    rows, at = np.unique(np.stack([lead, ids], 1), axis=0, return_inverse=True)
    return np.column_stack([rows, np.bincount(at.reshape(-1), single, len(rows)).astype(np.int64)])


def _candidates(index: DataFrame, least: int, small: int) -> DataFrame:
    """kind 0: pairs a, b, singles shared; kind 1: members of large groups (lowest id, document, singles); kind 2: documents (id, size
    and frequent shingles in one number, singles, and in d where these end). A task holds one part at a time."""

    def rows(kind: int, x: np.ndarray, d: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(x), 100_000):
            y = x[at : at + 100_000]
            more = np.zeros(len(y), np.int64) if d is None else d[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), kind, np.int32)), *(pa.array(y[:, k].copy()) for k in range(3)), pa.array(more)], ["kind", "a", "b", "c", "d"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            for kind, x in enumerate(_groups(held, least, small)):
                yield from rows(kind, x)

        held, now = [], None
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part < 0 and data[:1] == b"S":
                    star = np.frombuffer(data, "<i8", offset=5).reshape(-1, 4)
                    yield from rows(1, _members(star[:, 1], star[:, 2], star[:, 3]))
                    continue
                if part < 0:
                    n = struct.unpack_from("<I", data, 1)[0]
                    cols = [np.frombuffer(data, t, n, 5 + k * n).astype(np.int64) for t, k in (("<i8", 0), ("<u4", 8), ("<u4", 12), ("<i8", 16), ("<u4", 24))]
                    yield from rows(2, np.stack([cols[0], cols[1] << 31 | cols[4], cols[2]], 1), cols[3])
                    continue
                if part != now and held:
                    yield from found()
                    held = []
                now = part
                held.append(data)
        if held:
            yield from found()

    return index.repartition("part").sortWithinPartitions("part").mapInArrow(work, "kind int, a long, b long, c long, d long")


def _possible(pairs: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b, c singles shared) whose overlap can reach what ``least`` asks for.

    Uncounted are at most the shingles of the document whose singles end first that are no singles, or singles of large groups.
    """
    for side in ("a", "b"):
        pairs = pairs.join(docs.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "rest", "end", "common"))), side)
    asked = F.ceil(F.lit(least) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + least))
    rest = F.when(F.col("end_a") < F.col("end_b"), F.col("rest_a")).when(F.col("end_a") > F.col("end_b"), F.col("rest_b")).otherwise(F.least("rest_a", "rest_b"))
    fits = 100 * F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")
    return pairs.filter(fits & (F.col("c") + rest >= asked) & ((F.col("c") > 0) | (F.least("common_a", "common_b") >= asked))).select("a", "b")


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A filter of the ids (column doc_id), one bit each of some 16 a stored id: packed bits, ``MOST_FILTER_BITS`` at most.

    It lets all stored ids pass, and few others; were it ever too full, it would only let more pass.
    """
    bits = max(16, min(MOST_FILTER_BITS, (16 * ids.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << bits, bool)
        for batch in batches:
            found[_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits)] = True
        packed = np.packbits(found)
        block = [k for k in range(0, len(packed), 1 << 13) if packed[k : k + (1 << 13)].any()]
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([packed[k : k + (1 << 13)].tobytes() for k in block], pa.binary())], ["at", "bits"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[at] = held[at] | np.frombuffer(data, np.uint8) if at in held else np.frombuffer(data, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["at", "bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in ids.select("doc_id").mapInArrow(mark, "at int, bits binary").repartition("at").mapInArrow(both, "at int, bits binary").collect():
        out[r["at"] : r["at"] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _passes(known: np.ndarray, ids: pa.Array) -> np.ndarray:
    at = _places(ids.to_numpy(zero_copy_only=False).astype(np.int64), (8 * len(known)).bit_length() - 1)
    return (known[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _packed_texts(df: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and the text, compressed, for shuffles that carry texts: of the documents in ``ids`` and the few others that its filter
    lets pass."""
    wanted = df.sparkSession.sparkContext.broadcast(_id_filter(ids))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, known = zstandard.ZstdCompressor(level=1), wanted.value
        for batch in batches:
            kept = batch.filter(pa.array(_passes(known, batch.column(0))))
            for piece in slices([kept]):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([press.compress(t or b"") for t in piece.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["doc_id", "packed"])

    return df.filter("doc_id is not null").mapInArrow(work, "doc_id long, packed binary")


def _first_of_equals(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Of equal sets the document of the lowest id, which links as all of them do, and the few others that the filter of these ids lets
    pass. All documents where copies are few."""
    all_, firsts = kinds.agg(F.sum("copies"), F.count("*")).first()
    if not firsts or (all_ - firsts) * COPIES < all_:
        return docs
    wanted = docs.sparkSession.sparkContext.broadcast(_id_filter(kinds.select(F.col("first").alias("doc_id"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_passes(wanted.value, batch.column(0))))

    return docs.filter("doc_id is not null").mapInArrow(work, docs.schema)


def verified(pairs: DataFrame, texts: DataFrame, least: int = LEAST) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose texts (doc_id, packed) are alike. The members of a hub are dealt over many tasks."""
    hubs = pairs.groupBy("a").agg(F.count("*").alias("members")).withColumn("deals", F.ceil(F.col("members") / COMPARED).cast("int"))
    dealt = pairs.join(hubs, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("deals")).cast("int").alias("deal"), F.lit(1).alias("role"))
    own = hubs.select(F.col("a").alias("doc_id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("role"))
    sent = texts.join(dealt.unionByName(own), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, hub, mine, said = zstandard.ZstdDecompressor(), None, None, set()
        for batch in slices(batches, "packed", PIECE):
            docs, roles = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            texts = [open_.decompress(x) for x in batch.column(4).to_pylist()]
            a, b = [], []
            for doc, of, role, s, text in zip(docs, batch.column(0).to_pylist(), roles, shingle_sets(texts), texts, strict=True):
                if role == 0:
                    hub, mine, said = of, s, shingle_words(text)
                elif hub == of and alike(mine, s, least) and truly_alike(said, shingle_words(text), least):
                    a.append(of)
                    b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = sent.select("hub", "doc_id", "deal", "role", "packed").repartition("hub", "deal").sortWithinPartitions("hub", "deal", "role")
    return rows.mapInArrow(work, "a long, b long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, from incidence matrices over some shingles at a time."""
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    out, wide = np.zeros((len(sets), len(sets)), np.float32), 4096
    for low in range(0, len(tokens), wide):
        first, last = np.searchsorted(at, (low, low + wide))
        m = np.zeros((len(sets), wide), np.float32)
        m[of[first:last], at[first:last] - low] = 1
        out += m @ m.T
    return out


def _forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links connect."""
    left, out = set(range(len(ids))), []
    while left:
        todo = [left.pop()]
        while todo:
            k = todo.pop()
            for j in np.flatnonzero(linked[k]).tolist():
                if j in left:
                    left.discard(j)
                    out.append((int(ids[k]), int(ids[j])))
                    todo.append(j)
    return out


def _families(member: DataFrame, about: DataFrame, labels: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Links (a, b) within families that span several components, from blocks that are compared in full.

    A block holds documents of one class of size, and of one component if that fills blocks alone. Blocks meet if their classes are the
    same or next to each other and not all their documents are linked already: a large component meets what is outside, not itself.
    """
    ties = member.select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).filter("a <> b").distinct()
    family = components(ties).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    family = family.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").join(about.select("doc_id", "n"), "doc_id")
    # a class grows by a little more than similar sizes may differ, so these are in the same or in neighbouring classes
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / least * 1.000001)).cast("int")
    family = written(family.select("doc_id", "family", "n", size_class.alias("size_class"), F.coalesce("component", "doc_id").alias("component")), "families")
    open_ = family.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("family")
    held = family.join(open_, "family")
    counts = held.groupBy("family", "size_class", "component").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    big = (F.col("docs") >= BLOCK_DOCS) | (F.col("shingles") >= BLOCK_SHINGLES)
    counts = counts.withColumn("one", F.when(big, F.col("component")).otherwise(F.lit(_NONE)))
    key = ["family", "size_class", "one"]
    groups = counts.groupBy(*key).agg(F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles"))
    groups = written(groups.select(*key, F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "family-groups")
    dealt = held.join(counts.select(*key, "component"), ["family", "size_class", "component"]).join(groups, key)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).select("doc_id", "family", F.struct("size_class", "one", "block").alias("unit"))
    units = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("unit", F.struct("size_class", "one", "block"))
    left = units.select("family", F.col("unit").alias("x"), F.explode(F.array("size_class", F.col("size_class") + 1)).alias("size_class"))
    meet = left.join(units.select("family", "size_class", F.col("unit").alias("y")), ["family", "size_class"])
    meet = meet.filter((F.col("x.size_class") < F.col("y.size_class")) | (F.col("x") <= F.col("y")))
    meet = meet.filter((F.col("x.one") != F.col("y.one")) | (F.col("x.one") == _NONE)).select("family", "x", "y").distinct()
    sides = meet.select("family", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("unit"))
    dealt = dealt.join(sides, ["family", "unit"]).select("doc_id", F.hash("family").alias("family"), F.xxhash64("family", "x").alias("one"), F.xxhash64("family", "y").alias("two"))
    sent = _packed_texts(docs, held.select("doc_id")).join(dealt, "doc_id").repartition("family", "one", "two").sortWithinPartitions("family", "one", "two")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def compared() -> pa.RecordBatch:
            ids, sets = np.array([x[0] for x in held]), [x[1] for x in held]
            both, n = _overlaps(sets), np.array([len(x) for x in sets])
            pairs = _forest(ids, 100 * both >= least * (n[:, None] + n[None, :] - both))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], ["a", "b"])

        held, now = [], None
        for batch in slices(batches, "packed", PIECE):
            ids, data, *key = (batch.column(k).to_pylist() for k in range(5))
            for doc, s, at in zip(ids, shingle_sets([unpack.decompress(x) for x in data]), zip(*key, strict=True), strict=True):
                if at != now and held:
                    yield compared()
                    held = []
                now = at
                held.append((doc, s))
        if held:
            yield compared()

    return sent.select("doc_id", "packed", "family", "one", "two").mapInArrow(work, "a long, b long")


def link_documents(df: DataFrame, least: int = LEAST, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles and component_id of each document of ``df`` (doc_id, text)."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    narrow, frequent, total = _counted(docs)
    # a pair is told once in each part where it meets: parts follow the entries and the cores, not the number of shuffle partitions
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-total * (101 - least) // (100 * PART_ENTRIES)))
    some = narrow.filter("n > 0 and doc_id is not null")
    kinds = written(some.groupBy("digest", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "equal-sets")
    found = written(_candidates(_index(_first_of_equals(docs, kinds), frequent, parts, least, small), least, small), "candidates")
    same = some.join(kinds.filter("copies > 1").select("digest", "first"), "digest")
    same = same.filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    member = found.filter("kind = 1").select(F.col("a").alias("lead"), F.col("b").alias("doc_id"), F.col("c").alias("single"))
    apart = member.groupBy("doc_id").agg(F.sum("single").alias("apart"))
    about = found.filter("kind = 2").groupBy(F.col("a").alias("doc_id")).agg(F.max("b").alias("sizes"), F.min("c").alias("singles"), F.min("d").alias("end"))
    about = about.withColumns({"n": F.shiftright("sizes", 31), "common": F.col("sizes").bitwiseAND((1 << 31) - 1)})
    about = written(about.join(apart, "doc_id", "left").select("doc_id", "n", "common", (F.col("n") - F.col("singles") + F.coalesce("apart", F.lit(0))).alias("rest"), "end"), "documents")
    met = found.filter("kind = 0 or kind = 1 and a <> b").groupBy("a", "b").agg(F.sum(F.when(F.col("kind") == 0, F.col("c")).otherwise(0)).alias("c"))
    pairs = written(_possible(met, about, least), "pairs")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    links = written(verified(pairs, _packed_texts(docs, paired), least).unionByName(same), "links")
    labels = components(links)
    if not member.isEmpty():
        more = written(_families(member, about, labels, docs, least), "family-links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    forget(found, about, pairs, links, kinds)
    labels = labels.select(F.col("node").alias("doc_id"), "component")
    return narrow.join(labels, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Set sizes and linked components of all documents."""
    return link_documents(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d
), n AS (SELECT doc_id, coalesce(len(g), 0) AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY ALL
"""
