"""A prefix trie of conversations by partition refinement.

All conversations begin in one class. Each round splits the active classes by the next turn; a class is named by the hash of its parent's
name and the turn (SHA-256), so members rename themselves and only counts by name are grouped. A class of one member retires: the rest of
its conversation is a unary chain, emitted at the end by one join. Rounds end with the deepest turn that two conversations share. Then
counts of children and leaves and saved tokens are folded back, level by level, from what each level's children sum up to.

Nothing is gathered: turns are numbered by ranges, so a conversation may hold any share of them; members, classes and levels are written
tables in the shared folder. The digest of the members that end in a node is fed in order from packed blocks of sorted ids, made range by
range: a node's blocks stream through one task, as the digest asks, however many they are.

Cases. Null role and text are empty. Rows without a conv_id belong to no conversation and are left out. Rows that share conv_id and turn are
ordered by role, then by the hash of role and text; equal rows are turns of their own. A conversation without turns, after rebuilding, ends
in the root. Negative ids round towards zero. An empty table has no node. Columns besides the four are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageline.llm.common import forget, reading, shared_dir, ship, written
from pageline.llm.importance import numbered

#: Conversations of one family of ids share the first turns of its first; how many, less than ``SHARED``.
FAMILY, SHARED = 5, 9
#: Characters of a packed block of ids.
BLOCK = 16 << 10
_NODE = "name binary, parent binary, conv_id long, n long, bytes long"
_MEMBER = "conv_id long, len long, name binary"
_FOLDED = "name binary, parent binary, n_children long, n_leaves long, saved long"
_ROOT = hashlib.sha256(b"root").digest()


def _key(role, text):
    """Tells turns apart: SHA-256 of the length of the role, the role and the text."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def turns_of(df: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), key and bytes of each turn of ``df`` (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = df.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), _key(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    # equal rows are told apart only so that they can be dealt to more than one task
    order = numbered(rows.withColumn("row", F.monotonically_increasing_id()), F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("key"), F.asc("row"))
    first = order.groupBy("conv_id").agg(F.min("nth_of_all").alias("first"))
    out = written(order.join(first, "conv_id").select("conv_id", (F.col("nth_of_all") - F.col("first")).alias("pos"), "key", "bytes"), "turns")
    forget(order)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first turns of its family in place of its own: conv_id and len; conv_id, len, depth (from 1), key and bytes of each turn."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = written(own.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED, "base": base}), "conversations")
    lens = own.select(F.col("conv_id").alias("base"), F.col("own").alias("in_base"))
    taken = F.least(F.col("h"), F.coalesce("in_base", F.lit(0)))
    convs = own.join(lens, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    convs = written(convs, "rebuilt-conversations")
    rest = turns.join(convs, "conv_id").filter("pos >= h").select("conv_id", "len", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "key", "bytes")
    first = turns.filter(F.col("pos") < SHARED).withColumnRenamed("conv_id", "base").join(convs, "base").filter("pos < taken").select("conv_id", "len", (F.col("pos") + 1).alias("depth"), "key", "bytes")
    # by depth, so that a round reads the row groups of its own depth
    out = rest.unionByName(first).repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id")
    out = written(out, "rebuilt-turns")
    forget(own)
    return convs.select("conv_id", "len"), reading(out, convs)


class _Levels:
    """Tables of one kind, a level each, in one folder."""

    def __init__(self, spark: SparkSession, what: str, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_dir(spark)}/trie-{what}-{uuid.uuid4().hex}"

    def put(self, depth: int, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.path}/depth={depth}")
        return self.level(depth)

    def level(self, depth: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/depth={depth}")

    def all(self) -> DataFrame:
        df = self.spark.read.schema(f"{self.schema}, depth long").parquet(self.path)
        df._written_to = self.path
        return df


def refine(convs: DataFrame, turns: DataFrame) -> tuple[_Levels, _Levels, int]:
    """Nodes and members of all classes that a round made, and the last depth."""
    spark = convs.sparkSession
    nodes, members = _Levels(spark, "nodes", _NODE), _Levels(spark, "members", _MEMBER)
    now = members.put(0, convs.select("conv_id", "len", F.lit(_ROOT).alias("name")))
    made = now.groupBy("name").agg(F.lit(None).cast("binary").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.lit(0).cast("long").alias("bytes"))
    made, depth = nodes.put(0, made), 0
    while not made.filter("n > 1").isEmpty():
        # what is alone in its class goes, by its own id: no class is a key here
        active = now.filter(F.col("len") > depth).join(made.filter("n = 1").select("conv_id"), "conv_id", "left_anti")
        step = turns.filter(F.col("depth") == depth + 1).select("conv_id", "key", "bytes")
        name = F.unhex(F.sha2(F.concat("name", "key"), 256))
        told = written(active.join(step, "conv_id").select("conv_id", "len", name.alias("name"), F.col("name").alias("parent"), "bytes"), "trie-step")
        now = members.put(depth + 1, told.select("conv_id", "len", "name"))
        made = nodes.put(depth + 1, told.groupBy("name").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("bytes").alias("bytes")))
        forget(told)
        depth += 1
    return nodes, members, depth


def fold(nodes: _Levels, last: int) -> _Levels:
    """What the children of each class sum up to, from the deepest level to the root, for classes of more than one member."""
    out, below = _Levels(nodes.spark, "folded", _FOLDED), None
    for depth in range(last, -1, -1):
        own = nodes.level(depth).filter("n > 1").select("name", "parent", ((F.col("n") - 1) * F.col("bytes")).alias("own"))
        if below is None:
            told = own.select("name", "parent", F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("own").alias("saved"))
        else:
            single = nodes.level(depth + 1).filter("n = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
            sums = below.select("parent", "n_leaves", "saved").unionByName(single).groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
            told = own.join(sums, "name", "left").select("name", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("own") + F.coalesce("saved", F.lit(0))).alias("saved"))
        below = out.put(depth, told)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, conv_id) as blocks: name, first id, ids joined by commas."""
    name, first, held, size = None, 0, [], 0
    done: list[tuple] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["name", "first", "ids"])

    for batch in batches:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (n != name or size > BLOCK):
                done.append((name, first, ",".join(held)))
                held, size = [], 0
            if not held:
                name, first = n, c
            held.append(str(c))
            size += len(held[-1]) + 1
        if len(done) >= 500:
            yield out()
            done = []
    if held:
        done.append((name, first, ",".join(held)))
    if done:
        yield out()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks as name and SHA-256 of all its blocks, joined by commas."""
    name, state, done = None, None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["name", "ends_sha256"])

    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n != name:
                if state is not None:
                    done.append((name, state.hexdigest()))
                name, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(done) >= 2000:
            yield out()
            done = []
    if state is not None:
        done.append((name, state.hexdigest()))
    if done:
        yield out()


def end_digests(ends: DataFrame) -> DataFrame:
    """name and ends_sha256 of ``ends`` (name, conv_id)."""
    order = ends.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    packed = order.mapInArrow(_pack, "name binary, first long, ids string")
    return packed.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_digest, "name binary, ends_sha256 string")


def trie(df: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node."""
    convs, turns = rebuilt(turns_of(df))
    nodes, members, last = refine(convs, turns)
    folded = fold(nodes, last).all()
    known = nodes.all()
    # a class may have any number of children: a join of two sorted sides, which Spark splits where it is skewed
    parents = known.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    split = known.filter("n > 1").join(parents, "parent", "left").join(folded.select("name", "n_children", "n_leaves", "saved"), "name")
    ends = members.all().filter(F.col("len") == F.col("depth"))
    split = split.join(end_digests(ends), "name", "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
    alone = written(known.filter("n = 1").join(parents, "parent", "left").select("conv_id", "depth", "parent_conv_id").join(convs, "conv_id"), "trie-alone")
    chain = alone.join(turns.select("conv_id", F.col("depth").alias("at")), "conv_id").filter("at > depth").select("conv_id", F.col("at").alias("depth"), F.col("conv_id").alias("parent_conv_id"), "len")
    chain = alone.select("conv_id", "depth", "parent_conv_id", "len").unionByName(chain)
    over = F.col("depth") == F.col("len")
    one = F.lit(1).cast("long")
    chain = chain.select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(over, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(over, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return reading(split.unionByName(chain), turns, *turns._reads, folded, known, members.all(), alone)


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    ship(spark)
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


_SQL_BYTE = "('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT"
_SQL_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: {_SQL_BYTE})),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
ORACLE = f"""WITH k AS (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
  octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, key, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) - 1 AS pos FROM k),
n AS (SELECT conv_id, count(*) AS own FROM o GROUP BY 1),
h AS (SELECT conv_id AS c, own, conv_id - conv_id % {FAMILY} AS base, {_SQL_CRC} % {SHARED} AS h FROM (SELECT *, conv_id::VARCHAR AS w FROM n)),
c AS (SELECT h.c, h.base, h.h, least(h.h, coalesce(b.own, 0)) AS taken, least(h.h, coalesce(b.own, 0)) + greatest(h.own - h.h, 0) AS len FROM h LEFT JOIN n AS b ON b.conv_id = h.base),
r AS (SELECT c, len, taken + pos - h + 1 AS depth, key, bytes FROM o JOIN c ON o.conv_id = c.c WHERE pos >= h
  UNION ALL SELECT c, len, pos + 1, key, bytes FROM o JOIN c ON o.conv_id = c.base WHERE pos < taken UNION ALL SELECT c, len, 0, '', 0 FROM c),
p AS (SELECT c, len, depth, bytes, sha256(string_agg(key, '') OVER (PARTITION BY c ORDER BY depth)) AS path FROM r),
g AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = depth), '') AS ends FROM p GROUP BY ALL),
l AS (SELECT g.*, q.path AS parent FROM g LEFT JOIN p AS q ON q.c = g.conv_id AND q.depth = g.depth - 1),
f AS (SELECT l.*, (SELECT count(*) FROM l AS x WHERE x.parent = l.path AND x.depth = l.depth + 1) AS n_children FROM l),
s AS (SELECT a.path, a.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved FROM f JOIN p AS a ON a.c = f.conv_id AND a.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s USING (path, depth) LEFT JOIN f AS u ON u.path = f.parent AND u.depth = f.depth - 1"""
