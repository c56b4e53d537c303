"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from pageline.llm import importance
from pageline.llm.queries import QUERIES
from tests.llm.test_licenses import plain_words
from tests.llm.test_operators import prose


def plain_features(text, sizes):
    words = plain_words(text)
    return [" ".join(words[i : i + k]) for k in range(1, sizes + 1) for i in range(len(words) - k + 1)]


def plain(ids, texts, target, sizes=1, buckets=importance.BUCKETS):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for t in texts for f in plain_features(t, sizes))
    t = Counter(bucket(f) for x in target for f in plain_features(x, sizes))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, text in zip(ids, texts, strict=True):
        features = plain_features(text, sizes)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(features), weight, score, None, len(plain_words(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * 10 // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.fixture
def texts(awkward):
    rng = random.Random(13)
    return [*awkward, "É a\x00B c-dK 1é2", *(prose(rng, rng.randint(1, 60)) for _ in range(150)), "Copies " * 25, "Copies " * 25]


@pytest.fixture
def target(spark):
    rng = random.Random(14)
    return [None, "", *(prose(rng, 30) + " goal" for _ in range(8))]


@pytest.mark.parametrize("block", (300, importance.BLOCK))
def test_weights_scores_and_ranks(spark, docs, texts, target, block, monkeypatch):
    monkeypatch.setattr(importance.weigh, "__defaults__", (*importance.weigh.__defaults__[:2], block))
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    ids = [None if i == 30 else i for i in range(len(texts))]
    got = found(QUERIES["op13_importance"](spark, docs(texts, ids=ids, benchmark=bench)))
    assert got == plain(ids, texts, target)
    assert sum(r[4] is not None for r in got) == 10


def test_longer_features_go_by_tuples_of_ids(spark, texts, target):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for sizes, buckets in ((2, 10_000), (3, 97)):
        got = found(importance.draw(importance.weigh(df, bench, sizes, buckets, 2000)))
        assert got == plain(range(len(texts)), texts, target, sizes, buckets)


def test_repeated_rows_and_ids_have_ranks_of_their_own(spark, docs, target):
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    texts = ["one two three four " * 6] * 200
    got = found(QUERIES["op13_importance"](spark, docs(texts, ids=[7] * 200, benchmark=bench)))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 21)) and len({r[:4] for r in got}) == 1 and len(got) == 200


def test_words_are_cut_and_numbered_in_pieces(monkeypatch):
    texts = [b"", b"A--b \xc3\x89a", b"xyz" * 50 + b" q", b"...", b"last"]
    want = [w.encode() for t in texts for w in plain_words(t.decode())]
    for size in (1, 3, 7, 1 << 19):
        monkeypatch.setattr(importance, "PIECE_BYTES", size)
        words, begin = importance.block_words(texts)
        assert [w.encode() for w in words.to_pylist()] == want and begin.tolist() == [0, 0, 3, 5, 5, 6]
    assert importance.block_words([b""])[1].tolist() == [0, 0]


def test_empty_tables_and_clashing_columns(spark, save):
    names = ("block", "nth", "kind", "target", "word", "local", "_at", "_part", "n_words", "score", "rank")
    df = spark.createDataFrame([(1, "goal " * 30, *"abcdefghijk")], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, "goal", "x")], "item_id long, text string, target string")
    assert found(QUERIES["op13_importance"](spark, save(documents=df, benchmark=bench))) == plain([1], ["goal " * 30], ["goal"])
    assert found(QUERIES["op13_importance"](spark, save(documents=df, benchmark=bench.filter("false")))) == plain([1], ["goal " * 30], [])
    assert QUERIES["op13_importance"](spark, save(documents=df.filter("false"), benchmark=bench)).count() == 0
