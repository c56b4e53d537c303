"""Each query against a brute-force version of its contract, on small tables with the awkward cases."""

import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from pageline.llm import common, decontaminate, jaccard, langid, media, mixing, pii, quality, sharding, substrings, tokens
from pageline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "in", "or", "ust")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def rows(df, *key):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple((r[k] is not None, r[k]) for k in key))


def words(text):
    return WORD.findall(text or "")


def test_word_hashes_follow_the_word_rule():
    texts = [b"a  b\tA", None, b"", b"y" * (common.PIECE_BYTES + 9000), "é\x1c É\x0bz".encode()]
    h, begin = common.word_hashes(texts)
    assert np.diff(begin).tolist() == [3, 0, 0, 1, 3]
    low, _ = common.word_hashes(texts, lower=True)
    assert low[0] == low[2] and h[0] != h[2]
    assert len(set(common.word_hashes([" ".join(VOCABULARY).encode()])[0].tolist())) == len(VOCABULARY)


# 1 -------------------------------------------------------------------------------------------------------------------


def test_decontamination_finds_copies_and_edits(spark, docs):
    rng = random.Random(1)
    items = [prose(rng, 30) for _ in range(6)] + [None, "", "too short"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    edited = items[1].split()
    for k in (4, 13, 22):
        edited[k] = "changed"
    del edited[8]
    noisy = " ".join(w.upper() + "!!" for w in items[2].split())
    texts = [prose(rng, 50) + ". " + items[0] + " " + prose(rng, 40), prose(rng, 20) + " " + " ".join(edited) + " end", noisy, prose(rng, 300), None, "", items[0]]
    got = rows(QUERIES["op1_decontaminate"](spark, docs(texts, benchmark=bench)), "doc_id", "item_id")
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(0, 0), (1, 1), (2, 2), (6, 0)]
    assert got[0]["score"] == 1.0 and (got[0]["start_word"], got[0]["end_word"]) == (50, 80)
    assert 0.6 < got[1]["score"] < 1.0


def test_decontamination_finds_copies_with_every_nth_word_changed(spark, docs):
    rng = random.Random(12)
    items = [prose(rng, 40) for _ in range(4)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def changed(item, n, into):
        return " ".join(into(w) if k % n == n - 1 else w for k, w in enumerate(item.split()))

    ways = [(n, into) for n in (3, 4, 5, 6) for into in (lambda w: "changed", lambda w: rng.choice(VOCABULARY))] + [(1, lambda w: f"{w} more")]
    texts = [items[0]] + [prose(rng, 60) + " " + changed(items[k % 4], n, into) + " " + prose(rng, 60) for k, (n, into) in enumerate(ways)] + [prose(rng, 400) for _ in range(10)]
    got = rows(QUERIES["op1_decontaminate"](spark, docs(texts, benchmark=bench)), "doc_id", "item_id")
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(0, 0)] + [(k + 1, k % 4) for k in range(len(ways))]


def test_decontamination_finds_passages_of_long_items(spark, docs):
    rng = random.Random(14)
    items = [prose(rng, 63), prose(rng, 300)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    parts = [items[0].split()[30:43], items[0].split()[:25], items[1].split()[100:219], items[1].split()[280:293], items[0].split()[30:39]]
    texts = [prose(rng, 70) + " " + " ".join(p) + " # " + prose(rng, 70) for p in parts]
    got = rows(QUERIES["op1_decontaminate"](spark, docs(texts, benchmark=bench)), "doc_id", "item_id")
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert all(r["score"] < 0.4 and r["start_word"] <= 70 and r["end_word"] >= 70 + len(p) for r, p in zip(got, parts, strict=False))


def test_decontamination_aligns_whatever_reaches_the_least_score(monkeypatch):
    rng = random.Random(13)
    items = [prose(rng, n) for n in (2, 3, 5, 9, 20, 33, 60)]
    texts = [prose(rng, 80)]
    for item in items * 12:
        w, much = item.split(), rng.choice((0.1, 0.2, 0.3, 0.4, 0.5))
        edited = [x for v in w for x in ([v] if rng.random() > much else rng.choice(([], [rng.choice(VOCABULARY)], [v, rng.choice(VOCABULARY)])))]
        texts.append(prose(rng, rng.randint(0, 50)) + " " + " ".join(edited) + " " + prose(rng, rng.randint(0, 50)))
    found = decontaminate.Items(list(range(len(items))), items)
    h, begin = decontaminate._words(texts)
    want = []
    for x, y in zip(begin[:-1], begin[1:], strict=True):
        score = [decontaminate.align([w], [h[x:y]])[0, 0] for w in found.words]
        want.append([(i, round(s / len(w), 6)) for i, (s, w) in enumerate(zip(score, found.words, strict=True)) if len(w) >= 3 and s >= found.score[i] - 1e-9])
    assert sum(map(len, want)) > 40
    k, _ = found.find(h, begin)
    seeds = found.without_common(np.bincount(k, minlength=len(found.known)))
    for held in (decontaminate.HELD, 50):
        monkeypatch.setattr(decontaminate, "HELD", held)
        assert [[x[:2] for x in hits] for hits in seeds.hits(texts)] == want


def test_alignment_matches_a_plain_table():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(2, 6, 12).astype(np.uint64), rng.integers(2, 6, 17).astype(np.uint64)
        t, best = np.zeros((13, 18)), 0.0
        for i in range(1, 13):
            for j in range(1, 18):
                t[i, j] = max(0, t[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -decontaminate.LOSS), t[i - 1, j] - decontaminate.LOSS, t[i, j - 1] - decontaminate.LOSS)
                best = max(best, t[i, j])
        assert decontaminate.align([a], [b])[0, 0] == pytest.approx(best)


# 2 -------------------------------------------------------------------------------------------------------------------


def removed(texts):
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = []
    for i, t in enumerate(texts):
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def test_substring_dedup(spark, docs, awkward):
    rng = random.Random(4)
    shared, base = prose(rng, 60), prose(rng, 200)
    texts = awkward + [base, prose(rng, 30) + " " + shared, shared + " " + prose(rng, 40), base + " more", prose(rng, 14), " ".join(base.split()[20:33]), " ".join(base.split()[20:32])]
    got = rows(QUERIES["op2_substring_dedup"](spark, docs(texts)), "doc_id")
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == removed(texts)


def test_prefixes_grow_until_groups_are_small(spark):
    texts = ["the " * 50 + prose(random.Random(k), 30) for k in range(20)]
    path, levels, *_ = substrings._windows([t.encode() for t in texts], 13)
    counts = [np.bincount(level, minlength=1 << bits) for level, (_, bits) in zip(levels, substrings.LEVELS, strict=True)]
    groups = substrings.Groups(counts, 40, 1)
    of = groups.of(path, levels)
    assert all(len(set(of[path == p])) == 1 for p in set(path.tolist())) and (of >= 0).all()
    assert len(set(of.tolist())) > 5


# 3 -------------------------------------------------------------------------------------------------------------------


def test_quality_rules(spark, docs, awkward):
    rng = random.Random(5)
    good = [prose(rng, rng.randint(20, 90)) + "." for _ in range(220)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, rng.randint(20, 90)).split()) for _ in range(80)]
    texts = good + bad + awkward
    labels = spark.createDataFrame([(i, int(i < 220), 0) for i in range(300)] + [(301, None, None)], "doc_id long, quality int, toxic int")
    got = rows(QUERIES["op3_quality_rules"](spark, docs(texts, labels=labels)), "doc_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["predicted"] == int(r["doc_id"] < 220) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got) and len(got) == len(texts)


def test_quality_without_labels_is_even():
    assert quality.fit(np.zeros((0, 2)), np.zeros(0), ["a", "b"]).intercept == 0.0


# 4 -------------------------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((d := int(c) * (1 + i % 2)) - (9 if d > 9 else 0) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_personal_data(spark, docs, awkward):
    rng, alphabet = random.Random(6), "a1@.+-( )%9é𝒳42 "
    texts = awkward + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["mail a@b.c%d@e.f 𝒳 4539 5787 6362 1486 and 10.0.0.256 1.2.3.4.5.6.7.8 +1 (437) 555-0689.", 'key token = "ffc3105535f423f352535e4ac53b5fefe076ac6d" x', "a" * 20_000 + " 12" * 3_000, "see  a@b.co "]
    got = rows(QUERIES["op4_personal_data"](spark, docs(texts)), "doc_id")
    for r, t in zip(got, texts, strict=True):
        want = base_spans(t)
        told = ",".join(f"{k}:{a}:{e}" for a, _, e, k in want)
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[3] == k for x in want) for k in BASE], t
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), t
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))
    secret = got[texts.index('key token = "ffc3105535f423f352535e4ac53b5fefe076ac6d" x')]
    assert secret["spans"] == "secret:13:53"


# 5 -------------------------------------------------------------------------------------------------------------------


def test_token_ids(spark, docs, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    texts = awkward + ["It's CAN'T É!! x², <|endoftext|> ok <|x", "İ> ﬀ|aé ͅ|"]
    got = rows(QUERIES["op5_token_ids"](spark, docs(texts)), "doc_id")
    start = 0
    for r, text in zip(got, texts, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_huffman_round_trip_and_limit():
    rng = np.random.default_rng(7)
    counts = np.array([2**min(k, 40) for k in range(60)] + [0, 5])
    lengths = tokens.code_lengths(counts)
    assert lengths.max() <= tokens.LIMIT and lengths[60] == 0 and sum(2.0 ** -float(n) for n in lengths if n) == pytest.approx(1)
    code = tokens.Code(lengths)
    block = [rng.integers(0, 60, n).astype(np.uint16) for n in (1, 500, 1, 64, 63, 3000)]
    assert [x.tolist() for x in code.decode(code.encode(block))] == [x.tolist() for x in block]
    one = tokens.Code(tokens.code_lengths(np.array([0, 9])))
    assert one.decode(one.encode([np.ones(70, np.uint16)]))[0].tolist() == [1] * 70


# 6 -------------------------------------------------------------------------------------------------------------------


def test_language_profiles(spark, docs, awkward):
    rng = random.Random(8)
    of = {"aa": ["thing", "there", "other", "with", "that"], "bb": ["ñandu", "ción", "llega", "queda", "osado"]}
    texts, langs = [], []
    for _ in range(120):
        lang = rng.choice(("aa", "bb"))
        texts.append(" ".join(rng.choice(of[lang]) for _ in range(30)))
        langs.append(lang)
    texts, langs = texts + awkward + ["123 !!"], langs + [None] * (len(awkward) + 1)
    got = rows(QUERIES["op6_language_id"](spark, docs(texts, langs)), "doc_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["lang_pred"] == lang for r, lang in zip(got[:120], langs, strict=False))
    assert [r["doc_id"] for r in got if r["lang_pred"] == "und"] == [120, 121, 122, 130]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_every_language_has_a_profile(spark, docs):
    code = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    texts = [" ".join([code(k * 37 % 17576)] * 5) for k in range(300) for _ in range(8)]
    langs = [f"l{k:03d}" for k in range(300) for _ in range(8)]
    got = rows(QUERIES["op6_language_id"](spark, docs(texts, langs)), "doc_id")
    taught = {lang for r, lang in zip(got, langs, strict=True) if not r["held_out"]}
    assert len(taught) > 290
    assert all(r["lang_pred"] == lang for r, lang in zip(got, langs, strict=True) if lang in taught)


def test_judgement_matches_plain_distances():
    rng = random.Random(15)
    texts = [prose(rng, 60) for _ in range(6)]
    ranks = {f"l{i}": langid.ranked(*langid.gram_counts(t)) for i, t in enumerate(texts)}
    profiles = langid.Profiles(ranks)
    for text in [prose(rng, n) for n in (1, 3, 30, 200)] + ["中文"]:
        own = langid.ranked(*langid.gram_counts(text)).tolist()
        away = [sum(abs(x.tolist().index(g) - i) if g in x else langid.TOP for i, g in enumerate(own)) for x in ranks.values()]
        best = away.index(min(away))
        assert profiles.judge(text) == (f"l{best}", round(1 - min(away) / (langid.TOP * len(own)), 6))


def test_ranks_and_distance_by_hand():
    grams, counts = langid.gram_counts("Ab1ab")
    assert sum(counts) == 4 + 6 + 5  # letters, pairs and triples over " ab ab "
    ranked = langid.ranked(grams, counts)
    assert counts[np.searchsorted(grams, ranked[0])] == counts.max()
    same = langid.Profiles({"x": ranked})
    assert same.judge("ab ab") == ("x", 1.0) and same.judge(None) == ("und", 0.0)


# 7 -------------------------------------------------------------------------------------------------------------------


def test_mix(spark, docs, awkward, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    rng = random.Random(9)
    # no single document outweighs its source here: none could then come near a target
    texts = [prose(rng, rng.randint(1, 30)) for _ in range(900)] + [t for t in awkward if len(t or "") < 1000]
    sources = [("b" if i < 500 else "a" if i < 700 else None if i < 720 else "c") for i in range(len(texts))]
    path = docs(texts, sources=sources)
    got = rows(QUERIES["op7_cube_mix"](spark, path), "doc_id")
    size = Counter()
    for t, s in zip(texts, sources, strict=True):
        size[s] += len(words(t))
    aim = dict(zip("abc", mixing.targets([size["a"], size["b"], size["c"], size[None]], [1, 2, 3, 1])[:3], strict=True))
    taken = Counter()
    for r, t, s in zip(got, texts, sources, strict=True):
        assert r["size"] == len(words(t)) and r["source_size"] == size[s] and r["taken"] <= 3 * r["size"]
        assert s is None or r["target"] == pytest.approx(aim[s])
        taken[s] += r["taken"]
    for s in "abc":
        assert abs(taken[s] - aim[s]) <= 40
    assert got == rows(QUERIES["op7_cube_mix"](spark, path), "doc_id")
    mixed = mixing.mix(spark.read.parquet(f"{path}/documents.parquet")).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {r["doc_id"]: r["copies"] for r in got if r["copies"]}


def test_targets_reshare_what_is_above():
    assert mixing.targets([10, 100, 1000], [1, 2, 3]) == pytest.approx([30, 300, 780])
    assert mixing.targets([0, 5], [1, 2]) == [0, 5]


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 50, 200).astype(float)
    pi = np.full(200, 0.37)
    out = mixing.flight(pi, size, rng)
    assert out.sum() == pytest.approx(pi.sum()) and (out * size).sum() == pytest.approx((pi * size).sum())
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2


# 8 -------------------------------------------------------------------------------------------------------------------


def test_media(spark, docs, awkward):
    got = rows(QUERIES["op8_media_tiles"](spark, docs(awkward)), "doc_id")
    for r, t in zip(got, awkward, strict=True):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > len(payload) and len(r["feature"]) == 16
    assert got[6]["media_sha256"] == got[7]["media_sha256"]


def test_decoders_and_resize():
    px = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode_pgm(px)) == px).all()
    assert (media.decode(b"P2 # c\n4 3\n255\n" + b" ".join(b"%d" % v for v in px.ravel())) == px).all()
    assert media.decode(b"P1\n3 1\n101").tolist() == [[1, 0, 1]] and media.decode(b"P4\n3 1\n\xa0").tolist() == [[1, 0, 1]]
    rgb = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    assert (media.decode(b"P6\n3 2\n255\n" + rgb.tobytes()) == rgb).all()
    line = b"".join(bytes(rgb[y, x, ::-1]) for y in (1,) for x in range(3)) + bytes(3) + b"".join(bytes(rgb[0, x, ::-1]) for x in range(3)) + bytes(3)
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(line), 0, 0, 54, 40, 3, 2, 1, 24, 0, len(line), 0, 0, 0, 0) + line
    assert (media.decode(bmp) == rgb).all()
    assert (media.from_tiles(media.to_tiles(np.zeros((3000, 2), np.uint8))).shape) == (3000, 2)
    assert (np.load(io.BytesIO(media.to_tiles(px))) == px).all()
    big = np.random.default_rng(0).integers(0, 255, (2600, 36)).astype(np.uint8)
    plain = big.reshape(8, 325, 9, 4).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(big, 8, 9), plain)
    assert np.allclose(media.area_resize(px, 1, 1), px.mean())


def test_media_tells_bad_images(spark):
    df = spark.createDataFrame([(1, bytearray(b"P5\n9 9\n255\nshort")), (2, None), (3, bytearray(media.encode_pgm(np.ones((2, 2), np.uint8))))], "id long, image binary")
    got = rows(media.media_tiles(df), "id")
    assert [r["error"] is None for r in got] == [False, False, True] and got[2]["height"] == 2


# 9 -------------------------------------------------------------------------------------------------------------------


def linked(texts):
    sets = []
    for t in texts:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("small", [64, 3])
def test_jaccard_join(spark, docs, awkward, small, monkeypatch):
    monkeypatch.setattr(jaccard.link_documents, "__defaults__", (jaccard.LEAST, small))
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 16)
    monkeypatch.setattr(jaccard, "STANDOUT", 2)
    rng = random.Random(10)
    texts = list(awkward) + ["ONE", "Two words", "two WORDS"]
    for _ in range(4):
        base = prose(rng, rng.randint(8, 80)).split()
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            texts.append(" ".join(copy))
    shared = prose(rng, 30)
    texts += [prose(rng, rng.randint(1, 20)) + " " + shared for _ in range(40)] + [prose(rng, 60) for _ in range(20)]
    got = rows(QUERIES["op9_jaccard_join"](spark, docs(texts)), "doc_id")
    assert [(r["n_shingles"], r["component_id"]) for r in got] == linked(texts)


# 10 ------------------------------------------------------------------------------------------------------------------


def test_shards(spark, docs, awkward):
    rng = random.Random(11)
    texts = awkward + [prose(rng, rng.randint(1, 60)) for _ in range(1500)] + ["hot copy " * 20] * 500
    got = rows(QUERIES["op10_shards"](spark, docs(texts)), "doc_id")
    loads, slots, where = Counter(), {}, {}
    for r, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(t or "", set()).add(r["shard"])
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(loads.values()) / 40
    assert max(v for k, v in loads.items()) < 1.15 * mean or max(len(t or "") for t in texts) > mean
    assert all(len(s) == 1 for t, s in where.items() if t != "hot copy " * 20)


def test_packing_is_even():
    loads = np.random.default_rng(3).random((800, 3))
    loads /= loads.sum(0)
    of = sharding.pack(loads, 40)
    assert np.stack([np.bincount(of, loads[:, k], 40) for k in range(3)]).max() < 1.05 / 40


# all -----------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, docs, save):
    path = docs([])
    save(benchmark=spark.createDataFrame([], "item_id long, text string"), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    for name, query in QUERIES.items():
        assert query(spark, path).count() == 0, name


def test_model_of_personal_data_is_calibrated(spark):
    model = pii.train(spark)
    assert np.isfinite(model.least["secret"]) and len(model.trees) == pii.TREES
