"""Cases that a run over the generated tables doesn't show: collisions by design, skewed ids, odd files, clashing columns."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageline.llm import common, decontaminate, jaccard, langid, media, mixing, pii, quality, sharding, tokens
from pageline.llm.queries import QUERIES
from tests.llm.test_operators import VOCABULARY, linked, prose, removed, rows, words


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


# hashes --------------------------------------------------------------------------------------------------------------


def test_words_that_fool_polynomial_hashes_are_told_apart():
    a, b = thue_morse(1 << 10), thue_morse(1 << 10, True)
    pairs = [(a, b), (a[:128], b[:128]), ("x" * 300, "x" * 301), ("x" * 8, "x" * 9), ("abcdefgh" * 2, "abcdefgh" * 3)]
    h = common.word_hashes([" ".join(p).encode() for p in pairs])[0]
    assert len(set(h.tolist())) == 10
    rng = random.Random(1)
    many = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(30_000)})
    assert len(set(common.word_hashes([" ".join(many).encode()])[0].tolist())) == len(many)


def test_words_of_any_length_hash_alike_wherever_they_stand():
    for n in (1, 7, 8, 9, 16, 17, 255, 256, 257, 1000):
        w = "q" * n
        h = common.word_hashes([f"{w} b  {w}".encode(), w.encode(), f"\n{w}\t".encode()])[0]
        assert h[0] == h[2] == h[3] == h[4]


def test_operators_tell_such_words_apart(spark, docs):
    a, b = thue_morse(1 << 10), thue_morse(1 << 10, True)
    rest = "one two three four five six seven eight nine ten eleven twelve"
    texts = [f"{a} {rest}", f"{b} {rest}", " ".join([a, *"pqrst"]), " ".join([b, *"uvwxy"])]
    bench = spark.createDataFrame([(1, f"{a} {a} {a}")], "item_id long, text string")
    path = docs([*texts, f"{b} {b} {b}"], benchmark=bench)
    got = rows(QUERIES["op2_substring_dedup"](spark, path), "doc_id")
    assert [r["n_removed"] for r in got] == [0] * 5
    assert [(r["n_shingles"], r["component_id"]) for r in rows(QUERIES["op9_jaccard_join"](spark, path), "doc_id")] == linked([*texts, f"{b} {b} {b}"])
    assert QUERIES["op1_decontaminate"](spark, path).count() == 0


# 1 -------------------------------------------------------------------------------------------------------------------


def plain_score(a, b):
    t, best = np.zeros((len(a) + 1, len(b) + 1)), 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i, j] = max(0, t[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -decontaminate.LOSS), t[i - 1, j] - decontaminate.LOSS, t[i, j - 1] - decontaminate.LOSS)
            best = max(best, t[i, j])
    return best


def test_decontamination_against_brute_force(spark, docs):
    """Every pair of document and item is aligned in a plain table."""
    rng = random.Random(21)
    items = [prose(rng, n) for n in (2, 3, 6, 9, 14, 25, 33)]
    texts = [None, "", prose(rng, 90)]
    for item in items * 5:
        w, much = item.split(), rng.choice((0.0, 0.1, 0.2, 0.3, 0.45))
        edited = [x for v in w for x in ([v] if rng.random() > much else rng.choice(([], [rng.choice(VOCABULARY)], [v, rng.choice(VOCABULARY)])))]
        texts.append(" ".join([prose(rng, rng.randint(0, 25)), *edited, prose(rng, rng.randint(0, 25))]))
    bench = spark.createDataFrame([*enumerate(items), (None, items[4]), (8, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in QUERIES["op1_decontaminate"](spark, docs(texts, benchmark=bench)).collect()}
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b = item.split(), (text or "").split()
            least = min(max(decontaminate.LEAST * len(a), min(len(a), decontaminate.LEAST_WORDS)), decontaminate.ENOUGH)
            s = plain_score(a, b)
            if len(a) >= decontaminate.FEWEST and s >= least - 1e-9:
                want.add((d, i, round(s / len(a), 6)))
    assert got == want and len(want) > 20


def test_items_without_a_number_are_left_out_and_ids_may_repeat(spark, docs):
    rng = random.Random(22)
    one, two = prose(rng, 20), prose(rng, 20)
    bench = spark.createDataFrame([("x1", one), (None, one), ("7", one), ("7", two), ("8", None), ("9", one)], "item_id string, text string")
    got = rows(QUERIES["op1_decontaminate"](spark, docs([one, two, f"{two} and {one}"], benchmark=bench)), "doc_id", "item_id")
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(0, 7), (0, 9), (1, 7), (2, 7), (2, 9)]


def test_long_passages_go_by_strips(monkeypatch):
    rng = random.Random(23)
    item = prose(rng, 30)
    text = " ".join([item.split()[k % 30] if k % 3 else rng.choice(VOCABULARY) for k in range(4000)]) + " " + item + " " + prose(rng, 500)
    seeds = decontaminate.Items([5], [item])
    whole = seeds.hits([text])
    monkeypatch.setattr(decontaminate, "STRIP", 64)
    longest = []
    real = decontaminate.align
    monkeypatch.setattr(decontaminate, "align", lambda items, texts: longest.append(max(map(len, texts))) or real(items, texts))
    assert [x[:2] for x in seeds.hits([text])[0]] == [x[:2] for x in whole[0]] == [(5, 1.0)]
    assert max(longest) <= 64 + int(seeds.span.max())


RECALL = {0.1: 0.99, 0.2: 0.95, 0.3: 0.9}


def test_recall_of_edited_copies_is_what_the_readme_says(spark):
    rng = random.Random(24)
    items = [prose(rng, rng.randint(25, 60)) for _ in range(40)]
    found = decontaminate.Items(list(range(len(items))), items)
    for much, least in RECALL.items():
        texts = []
        for item in items:
            edited = [x for v in item.split() for x in ([v] if rng.random() > much else rng.choice(([], ["changed"], [v, "more"])))]
            texts.append(" ".join([prose(rng, 30), *edited, prose(rng, 30)]))
        hits = found.hits(texts)
        assert sum(any(h[0] == i for h in x) for i, x in enumerate(hits)) >= least * len(items), much


# 3 -------------------------------------------------------------------------------------------------------------------


def plain_statistics(text):
    import re

    t = text or ""
    n, w, lines = len(t), words(t), t.split("\n")
    fields = re.split(r"[\x20\x09-\x0D]+", t)
    share = lambda ok: sum(map(ok, t)) / n if n else 0.0
    import unicodedata

    upper, number, letter = (lambda c: unicodedata.category(c) == "Lu"), (lambda c: unicodedata.category(c)[0] == "N"), (lambda c: unicodedata.category(c)[0] == "L")
    return {
        "log_chars": np.log1p(n), "word_length": n / len(w) if w else 0.0, "upper": share(upper), "digit": share(lambda c: c in "0123456789"),
        "symbol": share(lambda c: not (letter(c) or number(c) or c in " \t\n\x0b\f\r.,;:'-")), "unstopped": share(lambda c: c not in ".!?"),
        "gap": share(lambda c: c in " \t\n\x0b\f\r"), "words_distinct": len(set(fields)) / len(fields) if w else 0.0,
        "lines_distinct": len(set(lines)) / len(lines), "line_length": n / len(lines),
    }


def test_quality_against_brute_force(spark, docs, awkward):
    """Statistics, fit and score are done again without Spark."""
    rng = random.Random(25)
    texts = [prose(rng, rng.randint(5, 60)) + rng.choice((".", "\nEnd 12.", "!!")) for _ in range(150)]
    texts += [" ".join(w.upper() + "#" for w in prose(rng, rng.randint(5, 60)).split()) for _ in range(90)] + awkward
    labels = [(i, int(i < 150 or i % 9 == 0), 0) for i in range(240)] + [(3, 1, 0), (4, None, 0), (None, 1, 0), (9999, 0, 0)]
    d = docs(texts, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = rows(QUERIES["op3_quality_rules"](spark, d), "doc_id")
    learned = sorted((i, q) for i, q, _ in labels if q is not None and i is not None and i < len(texts) and zlib.crc32(str(i).encode()) % 3 != 1)
    stats = [plain_statistics(t) for t in texts]
    names = list(stats[0])
    x = np.array([[s[k] for k in names] for s in stats])
    model = quality.fit(x[[i for i, _ in learned]], np.array([float(q) for _, q in learned]), names)
    total = np.full(len(texts), model.intercept)
    for rule, weight in model.rules:
        total += weight * np.all([(x[:, names.index(n)] > c) == above for n, above, c in rule.tests], axis=0)
    assert [r["score"] for r in got] == pytest.approx(np.round(1 / (1 + np.exp(-total)), 6).tolist(), abs=2e-6)


def test_lasso_weights_are_optimal():
    rng = np.random.default_rng(26)
    x = rng.random((400, 4))
    y = (x[:, 0] + 0.3 * rng.standard_normal(400) > 0.5).astype(float)
    model = quality.fit(x, y, list("abcd"))
    z = np.stack([np.all([(x[:, "abcd".index(n)] > c) == above for n, above, c in rule.tests], axis=0) for rule, _ in model.rules], 1).astype(float)
    w = np.array([weight for _, weight in model.rules])
    scale = np.maximum(z.std(0), 0.05)
    p = 1 / (1 + np.exp(-(z @ w + model.intercept)))
    slope = ((z - z.mean(0)) / scale).T @ (p - y) / len(y)
    # at the optimum the loss falls along each used weight as fast as its penalty grows
    assert np.abs(slope + quality.LASSO * np.sign(w)).max() < 0.25 * quality.LASSO
    assert 0 < len(w) < 200 and ((p >= 0.5) == y).mean() > 0.8


# 4 -------------------------------------------------------------------------------------------------------------------


def test_added_spans_and_near_misses(spark, docs):
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'said token = "{token}" with', "version 1.22.333-beta of module_name_with_words-and-more", "see chapter-one-two-three-four-five and pages 12-14", "row 1234567890123456789012", "call (437) 555-0689 now", None]
    got = rows(QUERIES["op4_personal_data"](spark, docs(texts)), "doc_id")
    assert [r["n_secret"] for r in got] == [1, 0, 0, 0, 0, 0]
    assert [r["n_spans"] for r in got] == [1, 0, 0, 0, 1, 0] and [r["n_added"] for r in got] == [1, 0, 0, 0, 1, 0]


def test_all_planted_kinds_of_the_tables_are_found(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = df.select("doc_id", F.regexp_count("text", F.lit('token = "[0-9a-f]{40}"')).alias("n")).filter("n > 0").collect()
    got = {r.doc_id: r.n_secret for r in QUERIES["op4_personal_data"](spark, "/root/testdata/sf0.01").filter("n_secret > 0").collect()}
    assert len(planted) > 5 and all(got.get(r.doc_id, 0) >= r.n for r in planted)


def test_the_model_is_the_same_each_time(spark):
    a, b = pii.train(spark), pii.trained(spark)
    assert a.trees == b.trees and a.least == b.least and pii.trained(spark) is b


# 5 -------------------------------------------------------------------------------------------------------------------


def test_rows_that_share_an_id_have_one_order(spark, docs):
    rng = random.Random(27)
    texts = [prose(rng, rng.randint(0, 30)) for _ in range(120)]
    ids = [rng.choice((1, 2, None, 50 + k)) for k in range(120)]
    key = lambda df: sorted(map(str, df.collect()))
    d = docs(texts, ids=ids)
    one = key(QUERIES["op5_token_ids"](spark, d))
    df = spark.read.parquet(f"{d}/documents.parquet").repartition(7, "text")
    assert key(tokens.read_ids(tokens.write_ids(df))) == one


# 6 -------------------------------------------------------------------------------------------------------------------


def plain_profile(texts, top=langid.TOP):
    total = Counter()
    for t in texts:
        total.update(plain_grams(t))
    return [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], rank_key(x[0])))][:top]


def rank_key(gram):
    # as integers: shorter n-grams first, then by code point
    return (len(gram), gram)


def plain_grams(text):
    s, gap = " ", True
    for c in (text or "").lower():
        if c.isalpha():
            s, gap = s + c, False
        elif not gap:
            s, gap = s + " ", True
    s = s if s.endswith(" ") else s + " "
    if not s.strip():
        return Counter()
    out = Counter(c for c in s if c != " ")
    out.update(s[k : k + 2] for k in range(len(s) - 1))
    out.update(s[k : k + 3] for k in range(len(s) - 2))
    return out


def test_language_against_brute_force(spark, docs, awkward):
    """Profiles and distances are made again in plain Python."""
    rng = random.Random(28)
    of = {k: ["".join(rng.choice(k * 4 + "aeiou") for _ in range(rng.randint(2, 7))) for _ in range(40)] for k in ("xyz", "bcd", "ñçé")}
    texts, langs = [], []
    for _ in range(90):
        k = rng.choice(list(of))
        texts.append(" ".join(rng.choice(of[k]) + rng.choice(("", ",", " 12")) for _ in range(rng.randint(1, 40))))
        langs.append(k if rng.random() < 0.8 else None)
    texts, langs = texts + awkward, langs + [None] * len(awkward)
    got = rows(QUERIES["op6_language_id"](spark, docs(texts, langs)), "doc_id")
    profiles = {k: plain_profile([t for i, (t, x) in enumerate(zip(texts, langs, strict=True)) if x == k and zlib.crc32(str(i).encode()) % 4 != 2]) for k in of}
    for r, text in zip(got, texts, strict=True):
        own = plain_profile([text])
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        away = {k: sum(abs(p.index(g) - i) if g in p else langid.TOP for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(away), key=lambda k: away[k])
        assert (r["lang_pred"], r["score"]) == (best, round(1 - away[best] / (langid.TOP * len(own)), 6))


def test_rows_of_one_id_teach_the_language_they_name(spark, docs):
    texts = ["abab abab", "xyz xyz", "abab xyz"] * 3 + ["xyz xyz"]
    langs = ["aa", "bb", None] * 3 + [None]
    got = QUERIES["op6_language_id"](spark, docs(texts, langs, ids=[4] * 9 + [5])).collect()
    assert zlib.crc32(b"4") % 4 != 2
    assert {(r.lang_pred, r.score) for r in got if r.doc_id == 5} == {("bb", 1.0)}


# 7 -------------------------------------------------------------------------------------------------------------------


def test_sources_come_near_their_targets_with_their_long_texts(spark):
    got = QUERIES["op7_cube_mix"](spark, "/root/testdata/sf0.01").toPandas()
    for _, rows_ in got.groupby("source", dropna=False):
        target = rows_["target"].iloc[0]
        assert abs(rows_["taken"].sum() - target) <= 0.01 * target
    assert (got["taken"] <= 3 * got["size"]).all()


def test_mixing_of_rows_without_an_id(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 20)
    rng = random.Random(29)
    texts = [prose(rng, rng.randint(1, 30)) for _ in range(300)]
    d = docs(texts, sources=["a" if i < 200 else "b" for i in range(300)], ids=[None if i % 2 else 7 for i in range(300)])
    df = spark.read.parquet(f"{d}/documents.parquet").withColumns({"size": F.lit("x"), "_k": F.lit(1), "copies": F.lit(2), "row": F.lit("r"), "whole": F.lit(0)})
    out = mixing.mix(df)
    assert out.columns == df.columns
    total = sum(len(t.split()) for t in texts)
    assert abs(sum(len(r.text.split()) for r in out.collect()) - total) <= 30
    blocks = mixing.decide(df.drop("row")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 3 for r in blocks)


def test_targets_of_many_sources_agree_with_the_plain_rule(spark):
    rng = random.Random(30)
    found = [(f"s{k:03d}" if k else None, rng.choice((0, 3, 50, 1000)) * rng.randint(0, 9)) for k in range(120)]
    df = spark.createDataFrame([(s, n) for s, n in found], "source string, size long").repartition(5)
    got = {r.source: (r.nth, r.target) for r in mixing.source_plan(df).collect()}
    order = sorted(found, key=lambda x: (x[0] is None, x[0] or ""))
    want = mixing.targets([n for _, n in order], [mixing.WEIGHTS[k % 3] for k in range(120)])
    assert [got[s][0] for s, _ in order] == list(range(120))
    assert [got[s][1] for s, _ in order] == pytest.approx(want)


def test_landing_is_the_best_of_all_ways():
    rng = np.random.default_rng(31)
    size = rng.integers(5, 900, 12).astype(float)
    pi = np.round(rng.random(12))
    pi[:2] = (0.4, 0.7)
    out = mixing.land(pi, size)
    best = min(abs(sum(size[i] for i in range(12) if k >> i & 1) - (pi * size).sum()) for k in range(1 << 12))
    assert abs((out * size).sum() - (pi * size).sum()) == pytest.approx(best)


# 8 -------------------------------------------------------------------------------------------------------------------


def plain_dhash(raw):
    px = np.frombuffer(raw, np.uint8).reshape(-1, 64).astype(float)
    fine = np.repeat(np.repeat(px, 8, 0), 9, 1)  # each cell of the 8 x 9 grid is whole rows and columns of this
    small = np.round(fine.reshape(8, -1, 9, 64).mean(axis=(1, 3)), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def test_media_digests_against_brute_force(spark, docs, awkward):
    for r, t in zip(rows(QUERIES["op8_media_tiles"](spark, docs(awkward)), "doc_id"), awkward, strict=True):
        raw = (t or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        px = np.frombuffer(raw, np.uint8).reshape(-1, 64)
        stored = b"".join(npy(px[k : k + media.TILE_ROWS]) for k in range(0, len(px), media.TILE_ROWS))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), plain_dhash(raw))


def npy(a):
    head = b"{'descr': '|u1', 'fortran_order': False, 'shape': (%d, %d), }" % a.shape
    head += b" " * (-(len(head) + 11) % 64) + b"\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head + a.tobytes()


def test_odd_images(spark):
    images = {
        "above": b"P2\n2 1\n255\n300 1", "negative": b"P2\n1 1\n255\n-1", "zero": b"P5\n1 1\n0\n\x00", "wide": b"P5\n1 1\n70000\n\x00\x00", "raster": b"P5\n1 1\n9\n\x0a",
        "comment": b"P2\n2 1 # c\n255\n7 # eight\n9", "bits": b"P1\n3 1\n1 0 # x\n1", "words": b"P3\n1 1\n255\n1 x 2", "huge": b"P5\n99999999999 99999999999\n255\n", "none": b"",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in images.items()], "id string, image binary")
    got = {r.id: r for r in media.media_tiles(df).collect()}
    assert {k for k, r in got.items() if r.error is None} == {"comment", "bits"}
    assert media.from_tiles(bytes(got["comment"].tiles)).tolist() == [[7, 9]] and media.from_tiles(bytes(got["bits"].tiles)).tolist() == [[1, 0, 1]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]


def bmp(width, height, bits, raster, palette=b""):
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(palette) + len(raster), 0, 0, 54 + len(palette), 40, width, height, 1, bits, 0, len(raster), 0, 0, len(palette) // 4, 0) + palette + raster


def test_kinds_of_bmp():
    rgb = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    bgra = lambda y: b"".join(bytes(rgb[y, x, ::-1]) + b"\xff" for x in range(3))
    assert (media.decode(bmp(3, 2, 32, bgra(1) + bgra(0))) == rgb).all()
    assert (media.decode(bmp(3, -2, 32, bgra(0) + bgra(1))) == rgb).all()
    palette = b"".join(bytes([k, k + 1, k + 2, 0]) for k in range(4))
    got = media.decode(bmp(3, 2, 8, bytes([0, 1, 2, 0, 3, 3, 3, 0]), palette))
    assert got.tolist() == [[[5, 4, 3]] * 3, [[2, 1, 0], [3, 2, 1], [4, 3, 2]]]
    with pytest.raises(ValueError):
        media.decode(bmp(3, 2, 16, bytes(16)))


# 9 -------------------------------------------------------------------------------------------------------------------


def test_bound_on_candidates_never_drops_a_link(spark, docs):
    """Sets of frequent and rare shingles, of all overlaps near the threshold."""
    rng = random.Random(32)
    common_words = [f"c{k}" for k in range(60)]
    base = [[rng.choice(common_words) for _ in range(rng.randint(6, 40))] for _ in range(12)]
    texts = []
    for _ in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 2)] = [rng.choice((f"u{rng.randrange(5000)}", rng.choice(common_words)))] * rng.randint(0, 2)
        texts.append(" ".join(w))
    for small, standout in ((64, 8), (4, 0), (2, 0)):
        old = jaccard.STANDOUT, jaccard.BLOCK_DOCS
        jaccard.STANDOUT, jaccard.BLOCK_DOCS = standout, 8
        try:
            df = spark.read.parquet(f"{docs(texts)}/documents.parquet")
            got = rows(jaccard.link_documents(df, small=small), "doc_id")
        finally:
            jaccard.STANDOUT, jaccard.BLOCK_DOCS = old
        assert [(r["n_shingles"], r["component_id"]) for r in got] == linked(texts), (small, standout)


def test_only_texts_in_pairs_travel(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    ids = spark.range(0, 5000, 97).select(F.col("id").alias("doc_id"))
    sent = {r.doc_id for r in jaccard._packed_texts(df, ids).collect()}
    assert set(range(0, 5000, 97)) <= sent and len(sent) < 800


def test_members_of_large_groups_are_told_once_by_their_lead():
    """A document that shares many entries with its family was one row for each of them, and a join on entries met all of these again."""
    sets = [np.concatenate([np.arange(100, 140, dtype=np.uint64), np.arange(k * 1000 + 1000, k * 1000 + 1010, dtype=np.uint64)]) << np.uint64(40) for k in range(20)]
    blob = jaccard._six(np.concatenate(sets) >> np.uint64(16) & ~np.uint64(3))
    ids, n = np.arange(20, dtype="<i8"), np.full(20, 50, "<u4")
    data = struct.pack("<II", 20, 1000) + jaccard._bytes_apart(ids) + jaccard._bytes_apart(n) + jaccard._bytes_apart(n * 0) + jaccard._bytes_apart(n) + ids.astype("<u8").tobytes() + blob
    _, members = jaccard._groups([data], 75, 4)
    assert members.tolist() == [[0, k, 40] for k in range(20)]


def test_candidates_do_not_grow_with_shuffle_partitions(spark, docs, monkeypatch):
    """A pair was told in every part where it met, and there were as many parts as shuffle partitions; the lowest document of a large
    group and each other one were told as a pair and as members."""
    rng = random.Random(35)
    base = prose(rng, 60).split()
    texts = [" ".join([*base, f"u{k}"]) for k in range(200)]
    df = spark.read.parquet(f"{docs(texts)}/documents.parquet")
    real, made = jaccard._candidates, []
    monkeypatch.setattr(jaccard, "_candidates", lambda *a: made.append((found := real(*a)).groupBy("kind").count().collect()) or found)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 150):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert [(r["n_shingles"], r["component_id"]) for r in rows(jaccard.link_documents(df), "doc_id")] == linked(texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    few, many = ({r.kind: r["count"] for r in m} for m in made)
    assert few == many and not few.get(0)


def test_copies_are_no_part_of_the_index(spark, docs):
    """Of equal sets the first one is indexed; the result is what it was."""
    rng = random.Random(34)
    base = [prose(rng, 40) for _ in range(30)]
    texts = base * 20 + [b + " and more" for b in base]
    df = spark.read.parquet(f"{docs(texts)}/documents.parquet")
    narrow = jaccard._counted(df)[0]
    kinds = narrow.groupBy("digest", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    left = {r.doc_id for r in jaccard._first_of_equals(df, kinds).collect()}
    assert {r["first"] for r in kinds.collect()} <= left and len(left) < 100
    assert [(r["n_shingles"], r["component_id"]) for r in rows(jaccard.link_documents(df), "doc_id")] == linked(texts)


def test_large_components_meet_what_is_outside_and_not_themselves(spark, docs, monkeypatch):
    """A family of near copies: one large component, some documents of it that no link reaches. Counts the texts that travel."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 50)
    rng = random.Random(33)
    base = prose(rng, 60).split()
    near = [" ".join([*base, f"u{k}"]) for k in range(600)]
    far = [" ".join(w if rng.random() > 0.12 else f"v{k}.{i}" for i, w in enumerate(base)) for k in range(40)]
    sent = []
    real = jaccard._families
    monkeypatch.setattr(jaccard, "_families", lambda *a: sent.append(1) or real(*a))
    texts = near + far
    df = spark.read.parquet(f"{docs(texts)}/documents.parquet")
    got = rows(jaccard.link_documents(df, small=8), "doc_id")
    assert [(r["n_shingles"], r["component_id"]) for r in got] == linked(texts)


def test_rows_without_an_id_are_linked_with_nothing(spark, docs):
    text = "one two three four five six seven"
    got = QUERIES["op9_jaccard_join"](spark, docs([text, text, text, None], ids=[5, None, 6, None])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("5", 3, "5"), ("6", 3, "5"), ("None", 0, "None"), ("None", 3, "None")]


# 10 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("share", "whole"), [(0.3, True), (0.7, True), (1.5, False), (8.0, False)])
def test_only_groups_above_a_shard_are_dealt(spark, docs, share, whole):
    rng = random.Random(34)
    hot = "hot copy " * 30
    n = 100
    rest = [prose(rng, 40) for _ in range(2000)]
    # as many copies as fill so much of a shard
    total = sum(len(t) + 16 for t in rest)
    n = max(2, round(share / (sharding.SHARDS - share) * total / (len(hot) + 16)))
    for ids in (None, [None] * (2000 + n), [3] * (2000 + n)):
        texts = rest + [hot] * n
        got = QUERIES["op10_shards"](spark, docs(texts, ids=ids)).collect()
        crc = zlib.crc32(hot.encode())
        of = {r.shard for r in got if r.text_crc32 == crc}
        loads = Counter()
        for r in got:
            loads[r.shard] += r.size
        assert (len(of) == 1) == whole
        assert max(loads.values()) < 1.12 * sum(loads.values()) / sharding.SHARDS
        for k in loads:
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


# all -----------------------------------------------------------------------------------------------------------------

CLASHING = ("hits", "size", "row", "key", "item", "_key", "_k", "_nth", "_stats", "component_id", "n_shingles", "score", "lang_pred", "held_out", "nth", "draw", "copies", "place", "data", "part", "packed", "ids", "kind")


def test_extra_columns_with_any_name_do_no_harm(spark, docs, awkward, save):
    rng = random.Random(35)
    texts = awkward + [prose(rng, rng.randint(3, 40)) for _ in range(60)]
    item = texts[-1]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    talk = spark.createDataFrame([(k, 1, "user", "hello") for k in range(9)], "conv_id long, turn long, role string, text string")
    d = docs(texts, ["en"] * len(texts), benchmark=bench, labels=labels, conversations=talk)
    plain = {name: sorted(map(str, q(spark, d).collect())) for name, q in QUERIES.items()}
    df = spark.read.parquet(f"{d}/documents.parquet").withColumns({c: F.lit("clash") for c in CLASHING})
    df = spark.createDataFrame(df.collect(), df.schema)
    save(documents=df, benchmark=spark.createDataFrame([(1, item, "c", "c")], "item_id long, text string, hits string, row string"))
    for name, q in QUERIES.items():
        assert sorted(map(str, q(spark, d).collect())) == plain[name], name


def test_brute_force_helpers_agree_on_the_easy_case():
    assert removed(["a b"])[0][:2] == (2, 0)


# 2 -------------------------------------------------------------------------------------------------------------------


def test_rows_of_one_id_are_told_apart_by_more_than_a_few_bits(spark, docs):
    import xxhash

    rng = random.Random(21)
    passage = prose(rng, 40)
    long = prose(rng, 100) + " " + passage + " " + prose(rng, 90)
    low = xxhash.xxh3_64_intdigest(long.encode()) & 0xFFFF
    # a short row of the same id whose hash ends in the same 16 bits
    short = next(t for t in (f"{prose(rng, 14)} {k}" for k in range(2_000_000)) if xxhash.xxh3_64_intdigest(t.encode()) & 0xFFFF == low)
    texts, ids = [passage, short, long, short, prose(rng, 30) + " " + passage], [1, 5, 5, 5, 5]
    got = rows(QUERIES["op2_substring_dedup"](spark, docs(texts, ids=ids)), "doc_id", "n_words")
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == sorted([(1, 40, 0), (5, 15, 0), (5, 15, 0), (5, 230, 40), (5, 70, 40)])
