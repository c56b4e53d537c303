"""Token ids in a binary format: canonical length-limited Huffman codes from global counts, in independent blocks that a table decodes.

Writing. Texts are tokenized once, into a table of packed ids. All of these are counted; package-merge gives code lengths of at most
``LIMIT`` bits. The ids are then range-partitioned and
sorted by doc_id, and each partition becomes one file: a row of Parquet for each block, so Spark's commit protocol keeps lost executors
from leaving halves behind. A block holds whole documents, about ``BLOCK_IDS`` ids, and can be decoded alone:

    magic "PLHB", documents, ids, ids between checkpoints (little-endian u32 each)
    ids of each document (u32 each)
    bits from one checkpoint to the next (u16 each)
    the codes, highest bit first

Reading. Segments between checkpoints are decoded side by side: each step looks up one code of every segment in a table of 2 ** limit
entries. The code lengths of all ids, one byte each, are a row of their own (part -1).

Cases. Null and empty texts are the end id alone. Null doc_ids come first, repeated ids stay next to each other. An empty table gives no
rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageline.llm.common import documents, forget, slices, written

TOKENIZER = "word_bpe_49k.json"
END = 1
LIMIT = 16
BLOCK_IDS = 1 << 16
#: Packed ids of one file, about.
FILE_BYTES = 128 << 20
EVERY = 64
MAGIC = b"PLHB"
#: Words whose ids a worker remembers; a full memory is emptied.
REMEMBERED = 800_000
#: Unseen words that are tokenized in one call.
TOGETHER = 512
#: The vocabulary's mark of a word's last token.
WORD_END = "</w>"
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
_MADE: dict[str, ChunkTokenizer] = {}


class ChunkTokenizer:
    """The tokenizer applied to runs without ASCII white space, each run once.

    Its normalizer and pre-tokenizer never look across ASCII white space (NFC and lower-casing work by character there, white space is
    dropped, BPE runs within pre-tokens), so the ids of a text are those of its runs in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[k for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        self.remembered = REMEMBERED

    @staticmethod
    def of(path: str) -> ChunkTokenizer:
        if path not in _MADE:
            _MADE[path] = ChunkTokenizer(path)
        return _MADE[path]

    def _learn(self, runs: set[bytes]) -> None:
        new = runs.difference(self.known)
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = runs
        if len(self.stems) > self.remembered:
            self.stems.clear()
        # a word and the punctuation behind it are tokenized apart and in lower case; special tokens are looked for before that
        split, missing, known, stems = [], set(), self.known, self.stems
        for run in new:
            low = run if b"<|" in run else run.lower()
            ids = stems.get(low)
            if ids is not None:
                known[run] = ids
                continue
            stem = low if low is run and b"<|" in run else low.rstrip(PUNCTUATION)
            if stem and not stem[-1:].isalnum() and not unicodedata.normalize("NFC", stem.decode()).lower()[-1].isalnum():
                stem = low  # marks would join what follows
            tail = low[len(stem) :]
            split.append((run, stem, tail))
            if stem not in stems:
                missing.add(stem)
            if tail not in stems:
                missing.add(tail)
        letters, other = [], []
        for x in missing:
            text = x.decode()
            (letters if text.isalpha() else other).append((x, text))
        for at in range(0, len(letters), TOGETHER):
            self._learn_letters(letters[at : at + TOGETHER])
        for x, text in other:
            self._learn_one(x, text)
        for run, stem, tail in split:
            known[run] = stems[stem] + stems[tail]

    def _learn_one(self, x: bytes, text: str) -> None:
        self.stems[x] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn_letters(self, part: list[tuple[bytes, str]]) -> None:
        """Many words in one call: a word of letters is one pre-token, and only its last token carries the word's end."""
        got = np.array(self.tokenizer.encode_batch_fast([" ".join([t for _, t in part])], add_special_tokens=False)[0].ids, self.dtype)
        cut = np.flatnonzero(self.ends[got]) + 1
        if len(cut) != len(part):
            for x, text in part:
                self._learn_one(x, text)
            return
        data, edges = got.tobytes(), (cut * self.dtype.itemsize).tolist()
        for (x, _), first, last in zip(part, [0, *edges], edges, strict=False):
            self.stems[x] = data[first:last]

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each UTF-8 text, with the end id."""
        end = np.array([END], self.dtype).tobytes()
        runs = [(t or b"").split() for t in texts]
        self._learn(set().union(*runs))
        known = self.known
        return [np.frombuffer(b"".join(map(known.__getitem__, r)) + end, self.dtype) for r in runs]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Package-merge: the code lengths (0 where the count is 0) that need the fewest bits with none above ``limit``."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, leaf_first = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        leaf_first.append(at < len(leaves))
    take, length = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(leaf_first):
        n = int(is_leaf[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[order] = length
    return out


class Code:
    """A canonical code from code lengths: codes by (length, id), and the table that decodes them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        ids = np.flatnonzero(self.lengths)
        self.ids = ids[np.argsort(self.lengths[ids], kind="stable")]
        n = self.lengths[self.ids].astype(np.int64)
        self.limit = int(n.max(initial=1))
        spans = np.int64(1) << (self.limit - n)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.ids] = ((np.cumsum(spans) - spans) >> (self.limit - n)).astype(np.uint64)
        table = np.repeat((self.ids.astype(np.uint32) << np.uint32(5)) | n.astype(np.uint32), spans)
        self.table = np.concatenate([table, np.full((1 << self.limit) - len(table), 1, np.uint32)])

    def encode(self, docs: list[np.ndarray], every: int = EVERY) -> bytes:
        """One block."""
        ids = np.concatenate(docs)
        n = self.lengths[ids].astype(np.int64)
        code, ends = self.codes[ids], np.cumsum(n)
        at = ends - n
        word, shift = at >> 6, 64 - (at & 63) - n
        out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        left = code << np.maximum(shift, 0).astype(np.uint64) >> np.maximum(-shift, 0).astype(np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(left, first)
        over = np.flatnonzero(shift < 0)
        out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        marks = np.append(at[::every], ends[-1])
        head = struct.pack("<4sIII", MAGIC, len(docs), len(ids), every)
        return b"".join((head, np.array([len(d) for d in docs], "<u4").tobytes(), np.diff(marks).astype("<u2").tobytes(), out.byteswap().tobytes()[: (int(ends[-1]) + 7) // 8]))

    def decode(self, block: bytes) -> list[np.ndarray]:
        """The documents of a block."""
        magic, docs, n, every = struct.unpack_from("<4sIII", block)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        at = 16
        sizes = np.frombuffer(block, "<u4", docs, at).astype(np.int64)
        parts = -(-n // every)
        steps = np.frombuffer(block, "<u2", parts, at + 4 * docs).astype(np.int64)
        raw = np.frombuffer(block + bytes(4), np.uint8, offset=at + 4 * docs + 2 * parts).astype(np.uint32)
        window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        bit = np.cumsum(steps) - steps
        out = np.empty((every, parts), np.uint32)
        drop, top = np.uint32(32 - self.limit), len(window) - 1
        for k in range(every):
            got = self.table[(window[np.minimum(bit >> 3, top)] << (bit & 7).astype(np.uint32)) >> drop]
            out[k] = got >> np.uint32(5)
            bit += got & np.uint32(31)
        ids = out.T.reshape(-1)[:n].astype("<u4")
        return np.split(ids, np.cumsum(sizes)[:-1])


def tokenize(df: DataFrame, tokenizer: str = TOKENIZER, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id and the ids of the whole text with the end id, packed little-endian (2 bytes each for up to 65,536 ids, else 4)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ChunkTokenizer.of(tokenizer)
        tok.remembered = remembered
        for batch in slices(batches):
            ids = tok.ids(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "ids"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids binary")


def id_counts(packed: DataFrame, dtype: np.dtype) -> np.ndarray:
    """How often each id occurs; the driver holds one number for each id of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in slices(batches, "ids"):
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype), minlength=len(total))
            got[: len(total)] += total
            total = got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    found = packed.select("ids").mapInArrow(work, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def write_ids(df: DataFrame, tokenizer: str = TOKENIZER, remembered: int = REMEMBERED) -> DataFrame:
    """The files: rows part, block, before (ids of the part that stand before it), n_ids, doc_ids, data; part -1 holds the code lengths."""
    spark = df.sparkSession
    dtype = np.dtype(ChunkTokenizer.of(tokenizer).dtype)
    packed = written(tokenize(df, tokenizer, remembered), "packed-ids")
    counts = id_counts(packed, dtype)
    lengths = code_lengths(counts)
    schema = "part int, block int, before long, n_ids long, doc_ids array<long>, data binary"
    table = lengths.tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(np.frombuffer(table, np.uint8)), TaskContext.get().partitionId()
        docs, names, held, before, block = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            cols = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before]), pa.array([held]), pa.array([names], pa.list_(pa.int64())), pa.array([code.encode(docs)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "block", "before", "n_ids", "doc_ids", "data"])

        for batch in slices(batches, "ids"):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(data, dtype)
                docs.append(ids)
                names.append(name)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield flush()
                    docs, names, before, held, block = [], [], before + held, 0, block + 1
        if docs:
            yield flush()

    # rows that share an id, or have none, stand in the order of a hash of their ids; a file holds about FILE_BYTES of packed ids
    size = int(counts.sum()) * dtype.itemsize
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    tie = F.xxhash64("ids")
    rows = packed.repartitionByRange(files, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    head = spark.createDataFrame([(-1, 0, 0, 0, [], bytearray(table))], schema)
    out = written(rows.mapInArrow(work, schema).unionByName(head), "ids", "uncompressed")
    forget(packed)
    return out


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    lengths = bytes(files.filter("part = -1").select("data").first()[0])
    # one number for each file
    sums = sorted((r.part, r.n) for r in files.filter("part >= 0").groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = {}, 0
    for part, n in sums:
        starts[part], total = total, total + n
    held = files.sparkSession.sparkContext.broadcast(starts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for part, before, names, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                docs = code.decode(data)
                sizes = np.array([len(d) for d in docs], np.int64)
                start = held.value[part] + before + np.cumsum(sizes) - sizes
                crc = [zlib.crc32(d.tobytes()) for d in docs]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = files.filter("part >= 0").select("part", "before", "doc_ids", "data")
    return blocks.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_ids(spark, sf_dir: str) -> DataFrame:
    """All documents encoded, written as Huffman blocks in ascending doc_id order, and read back."""
    return read_ids(write_ids(documents(spark, sf_dir)))
