"""Importance resampling towards a target distribution, with an integer word dictionary.

Texts are cut into blocks of bounded size. A block numbers its distinct words and keeps its documents as numbers; its distinct words, with
counts, are what is shuffled. Counts of all blocks give the dictionary: a row and an id for each distinct word. n-grams are tuples of ids.
Each distinct tuple is turned back into bytes and hashed once, into a bucket; counts are joined back to it, by bucket they give the
gains, and each block gets the bucket of each of its own tuples. A document's weight is the floored mean of its gains; with Gumbel noise
from its id it is the score, by which documents are drawn.

Blocks bound what is held in a task (``BLOCK`` bytes of texts; a longer text stands alone); a word has one row for each block at most, so
frequent words are no hot keys. The gains are ``BUCKETS`` numbers. Ranks are numbers within a range partition plus what comes before it.

Cases. Null and empty texts have no feature, weight 0, and keep a row. A null doc_id draws its noise as ``null`` and comes last in ties;
rows that repeat a doc_id are drawn for themselves, in a fixed order. An empty target gives gains of the corpus alone, an empty corpus no
rows. Ties go to the smaller doc_id. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageline.llm.common import _LOWER, PIECE_BYTES, PLAIN_GAPS, documents, forget, give_back, reading, written

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Words in a feature, at most.
SIZES = 1
#: Bytes of texts that share a block.
BLOCK = 16 << 20
ROW_BITS = 33

_ENCODED = "kind string, block long, target boolean, local int, word string, n long, doc_id long, nth int, n_words long, ids binary"


def block_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in turn, lower-cased (A-Z), and where each text's words begin (one more entry than texts)."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes, places, held, at = [], [], [], 0
    while at < len(raw):
        end = min(at + PIECE_BYTES, len(raw))
        while end < len(raw) and not PLAIN_GAPS[raw[end]]:
            ahead = np.flatnonzero(PLAIN_GAPS[raw[end : end + 4096]])
            end += int(ahead[0]) if len(ahead) else min(4096, len(raw) - end)
        piece = raw[at:end]
        gap = PLAIN_GAPS[piece]
        edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        starts = np.flatnonzero(edge == -1)
        sizes.append(np.flatnonzero(edge == 1) - starts)
        places.append(starts + at)
        held.append(_LOWER[piece[~gap]])
        at = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    ends = np.concatenate([[0], np.cumsum(join(sizes, np.int64))]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(join(held, np.uint8)))
    return words, np.searchsorted(join(places, np.int64), np.cumsum([0] + [len(t) + 1 for t in texts]))


def _packed(ids: np.ndarray, begin: np.ndarray) -> pa.Array:
    """An array of binaries: the numbers from each beginning to the next, four bytes each."""
    data = np.ascontiguousarray(ids, "<i4")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer((begin * 4).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _rows(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([(pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t)) if (x := columns.get(k)) is not None else pa.nulls(size, t) for k, t in zip(schema.names, schema.types, strict=True)], schema=schema)


def _encoder(block_bytes: int):
    schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("target", pa.bool_()), ("local", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()), ("nth", pa.int32()), ("n_words", pa.int64()), ("ids", pa.binary())])

    def close(block: int, target: bool, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        words, begin = block_words(texts)
        told = words.dictionary_encode()
        numbers = told.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(told.dictionary)
        counts = np.bincount(numbers, minlength=n)
        for at in range(0, n, 100_000):
            k = min(n - at, 100_000)
            yield _rows(schema, k, kind=["w"] * k, block=np.full(k, block), target=np.full(k, target), local=np.arange(at, at + k), word=told.dictionary.slice(at, k), n=counts[at : at + k])
        for at in range(0, len(texts), 2000):
            k = min(len(texts) - at, 2000)
            here = begin[at : at + k + 1]
            yield _rows(schema, k, kind=["d"] * k, block=np.full(k, block), target=np.full(k, target), doc_id=ids[at : at + k], nth=np.arange(at, at + k), n_words=np.diff(here), ids=_packed(numbers[here[0] : here[-1]], here - here[0]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 24, 0
        open_: dict[bool, tuple[list, list[bytes], int]] = {}
        for batch in batches:
            for doc_id, text, target in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = (text.as_buffer().to_pybytes() if text.is_valid else b"")
                ids, texts, size = open_.get(target, ([], [], 0))
                if texts and size + len(data) > block_bytes:
                    yield from close(base + made, target, ids, texts)
                    ids, texts, size, made = [], [], 0, made + 1
                ids.append(doc_id)
                texts.append(data)
                open_[target] = (ids, texts, size + len(data) + 1)
        for target, (ids, texts, _) in open_.items():
            yield from close(base + made, target, ids, texts)
            made += 1
        give_back()

    return encode


def encode(docs: DataFrame, target: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """Rows of kind w (block, local, word, n) and of kind d (block, nth, doc_id, n_words, ids: the local numbers of its words)."""
    text = F.coalesce("text", F.lit(""))
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.lit(False).alias("target")).unionByName(
        target.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.lit(True).alias("target"))
    )
    return written(both.mapInArrow(_encoder(block_bytes), _ENCODED), "importance-blocks", partition_by="kind")


def _tuples(sizes: int):
    """From the documents of a block and the ids of its words: its distinct tuples, and its documents as numbers of those."""

    def work(key, docs: pa.Table, words: pa.Table) -> pa.Table:
        block = key[0].as_py()
        ids = np.zeros(len(words), np.int64)
        ids[words["local"].to_numpy()] = words["id"].to_numpy()
        docs = docs.sort_by("nth")
        length = docs["n_words"].to_numpy()
        local = np.frombuffer(b"".join(docs["ids"].to_pylist()), "<i4")
        end = np.repeat(np.cumsum(length), length)
        owner = np.repeat(np.arange(len(length)), length)
        told, spots, owners = [], [], []
        for k in range(1, sizes + 1):
            at = np.flatnonzero(np.arange(len(local)) + k <= end)
            grams = np.full((len(at), sizes), -1, np.int64)
            for i in range(k):
                grams[:, i] = ids[local[at + i]]
            told.append(grams)
            spots.append(at)
            owners.append(owner[at])
        grams, owners = np.concatenate(told), np.concatenate(owners)
        distinct, number, counts = np.unique(grams, axis=0, return_inverse=True, return_counts=True)
        order = np.argsort(owners, kind="stable")
        number, held = number.reshape(-1)[order], np.bincount(owners, minlength=len(length))
        n, m = len(distinct), len(docs)
        size = (distinct >= 0).sum(axis=1)
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(distinct[distinct >= 0], pa.int64()))
        target = docs["target"][0].as_py()
        first = pa.table({"kind": ["f"] * n, "block": np.full(n, block), "target": np.full(n, target), "local": pa.array(np.arange(n), pa.int32()), "ids_of": flat, "n": pa.array(counts, pa.int64())})
        begin = np.concatenate([[0], np.cumsum(held)])
        second = pa.table({"kind": ["d"] * m, "block": np.full(m, block), "target": docs["target"], "doc_id": docs["doc_id"], "nth": docs["nth"], "n_words": docs["n_words"], "ids": _packed(number, begin)})
        both = pa.concat_tables([first, second], promote_options="default")
        return both.select(["kind", "block", "target", "local", "ids_of", "n", "doc_id", "nth", "n_words", "ids"])

    return work


def _weigher(gains: np.ndarray):
    def work(key, docs: pa.Table, features: pa.Table) -> pa.Table:
        own = np.zeros(len(features), np.int64)
        own[features["local"].to_numpy()] = gains[features["bucket"].to_numpy()]
        parts = docs["ids"].to_pylist()
        n = np.array([len(x) // 4 for x in parts], np.int64)
        total = np.concatenate([[0], np.cumsum(own[np.frombuffer(b"".join(parts), "<i4")])])
        end = np.cumsum(n)
        weight = (total[end] - total[end - n]) // np.maximum(n, 1)
        return pa.table({"block": docs["block"], "nth": docs["nth"], "doc_id": docs["doc_id"], "n_words": docs["n_words"], "n_features": n, "weight": weight})

    return work


def gains_of(found: list[tuple[int, int, int]], buckets: int) -> np.ndarray:
    """The gain of each bucket from (bucket, corpus count, target count)."""
    s, t = [0] * buckets, [0] * buckets
    for b, corpus, target in found:
        s[b], t[b] = corpus, target
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((y + 1.0) * (all_s + buckets) / ((x + 1.0) * (all_t + buckets)))) for x, y in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, sizes: int = SIZES, buckets: int = BUCKETS, block_bytes: int = BLOCK) -> DataFrame:
    """block, nth, doc_id, n_words, n_features, weight of each row of ``docs`` (doc_id, text); ``target`` has texts."""
    blocks = encode(docs, target, block_bytes)
    words = blocks.filter("kind = 'w'").select("block", "target", "local", "word", "n")
    counts = [F.sum(F.when(F.col("target") == side, F.col("n")).otherwise(0)).alias(name) for side, name in ((False, "n_docs"), (True, "n_target"))]
    dictionary = written(words.groupBy("word").agg(*counts).withColumn("id", F.monotonically_increasing_id()), "importance-words")
    encoded, scratch = blocks.filter("kind = 'd'").select("block", "target", "nth", "doc_id", "n_words", "ids"), [blocks, dictionary]
    bucket = F.pmod(F.crc32(F.col("bytes").cast("binary")), F.lit(buckets)).cast("int").alias("bucket")
    if sizes == 1:
        # a tuple of one id: its bytes are the word's
        hashed = dictionary.select("word", F.col("word").alias("bytes"), "n_docs", "n_target").select("word", bucket, "n_docs", "n_target")
        local = words.filter("not target").select("block", "local", "word").join(hashed.select("word", "bucket"), "word")
    else:
        known = words.join(dictionary.select("word", "id"), "word").select(F.col("block").alias("of"), "local", "id")
        kind = "kind string, block long, target boolean, local int, ids_of array<long>, n long, doc_id long, nth int, n_words long, ids binary"
        features = written(encoded.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_tuples(sizes), kind), "importance-tuples", partition_by="kind")
        sides = features.filter("kind = 'f'").select("block", "target", "local", "ids_of", "n")
        distinct = written(sides.groupBy("ids_of").agg(*counts).withColumn("tuple", F.monotonically_increasing_id()), "importance-distinct")
        spelled = distinct.select("tuple", F.posexplode("ids_of").alias("at", "id")).join(dictionary.select("id", "word"), "id")
        spelled = spelled.groupBy("tuple").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("bytes"))
        hashed = written(spelled.select("tuple", bucket).join(distinct, "tuple").select("ids_of", "bucket", "n_docs", "n_target"), "importance-hashed")
        local = sides.filter("not target").select("block", "local", "ids_of").join(hashed.select("ids_of", "bucket"), "ids_of")
        encoded = features.filter("kind = 'd'").select("block", "target", "nth", "doc_id", "n_words", "ids")
        scratch += [features, distinct, hashed]
    found = hashed.groupBy("bucket").agg(F.sum("n_docs").alias("s"), F.sum("n_target").alias("t")).collect()
    work = _weigher(gains_of([tuple(r) for r in found], buckets))
    weighed = encoded.filter("not target").groupBy("block").cogroup(local.select(F.col("block").alias("of"), "local", "bucket").groupBy("of")).applyInArrow(work, "block long, nth int, doc_id long, n_words long, n_features long, weight long")
    out = written(weighed, "importance-weights")
    forget(*scratch)
    return out


def numbered(df: DataFrame, *order) -> DataFrame:
    """The rows of ``df`` with nth (from 1) in the given order, whose last entries tell all rows apart: ranges are sorted apart, and what comes before each is added."""
    ids = F.monotonically_increasing_id().alias("_at")
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", ids), "numbered")
    part, at = F.shiftright("_at", ROW_BITS), F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    # a row for each range
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    out = dealt.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("nth_of_all", F.col("_before") + at + 1)
    return reading(out.drop("_part", "_at", "_before"), dealt)


def draw(weighed: DataFrame, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where undrawn) of each row."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = weighed.withColumn("score", F.col("weight") + noise)
    able = rows.filter(F.col("n_words") >= least_words)
    ranked = numbered(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("block"), F.asc("nth"))
    n = able.count() * percent // 100
    columns = ("doc_id", "n_features", "weight", "score")
    drawn = ranked.select(*columns, F.when(F.col("nth_of_all") <= n, F.col("nth_of_all")).alias("rank"))
    return drawn.unionByName(rows.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    """All documents weighed towards ``benchmark``."""
    docs = documents(spark, sf_dir)
    return draw(weigh(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL_BYTE = "('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT"
_SQL_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: {_SQL_BYTE})),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS ws FROM documents),
u AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
tu AS (SELECT w, count(*) AS n FROM (SELECT unnest({_SQL_WORDS}) AS w FROM benchmark) GROUP BY ALL),
b AS (SELECT w, {_SQL_CRC} % {BUCKETS} AS bucket FROM (SELECT w FROM u UNION SELECT w FROM tu)),
s AS (SELECT bucket, sum(n) AS n FROM u JOIN b USING (w) GROUP BY 1), t AS (SELECT bucket, sum(n) AS n FROM tu JOIN b USING (w) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
  / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT r, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM u JOIN b USING (w) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS nth, count(*) OVER () AS n FROM x WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= n * {PERCENT} // 100 THEN nth END AS rank FROM x LEFT JOIN o USING (r)"""
