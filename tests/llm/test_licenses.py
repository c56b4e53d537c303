"""License scans against a brute-force version of the contract and of the votes."""

import random
import re

import pytest

from pageline.llm import licenses
from pageline.llm.queries import QUERIES
from tests.llm.test_operators import prose, rows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORDS.findall((text or "").translate(UPPER))


def base(words):
    return [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]


def method(words):
    """label and score of each verified span, from all pairs of places."""
    found = []
    for text, label in licenses.TEMPLATES:
        t, by = text.split(), {}
        for i in range(len(words) - licenses.K + 1):
            for j in range(len(t) - licenses.K + 1):
                if words[i : i + licenses.K] == t[j : j + licenses.K]:
                    by.setdefault(i - j, []).append((i, j))
        for d, votes in by.items():
            near = {e: v for e, v in by.items() if abs(e - d) <= licenses.BAND}
            if min(near, key=lambda e: (-len(near[e]), e)) != d:
                continue
            places = [i for v in near.values() for i, _ in v]
            covered = len({j + k for v in near.values() for _, j in v for k in range(licenses.K)})
            if covered >= licenses.LEAST * len(t) and covered >= licenses.LEAST * (max(places) + licenses.K - min(places)):
                found.append((label, covered / len(t)))
    return found


def expected(text):
    words = plain_words(text)
    own, more = base(words), method(words)
    at = [i for i, _ in own]
    labels = {x for _, x in own}
    return {
        "n_words": len(words), "n_base": len(own), "first_word": min(at, default=None), "last_word": max(at, default=None),
        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {x for x, _ in more})),
        "score": max([0.0, *(s for _, s in more), *(1.0 for _ in own)]), "n_spans": len(own) + len(more),
    }


def edited(rng, text):
    out = []
    for w in text.split():
        way = rng.random()
        out += [] if way < 0.05 else [w, "really"] if way < 0.1 else ["other"] if way < 0.13 else [w]
    return " ".join(out)


@pytest.fixture
def texts(awkward):
    rng = random.Random(11)
    out = [*awkward, "CC BY", "cc-by cc  by/CC.BY", "by cc", "(All Rights\nReserved.) all rights", "GENERAL public\tlicense general public", "cc by cc by cc by"]
    out += ["all riğhts reserved", "aK cc by İn cc by", "é cc by é", "\x00cc\x1fby", "cc by" + " x" * 40_000 + " cc by", "licensed under the apache " * 400]
    for text, _ in licenses.TEMPLATES:
        out += [prose(rng, 30) + " " + text.upper() + ". " + prose(rng, 20), prose(rng, 5) + " " + edited(rng, text) + " " + prose(rng, 5), edited(rng, text) + " " + edited(rng, text), " ".join(text.split()[: len(text.split()) // 2])]
    return out


def test_licenses_against_brute_force(spark, docs, texts):
    ids = [i % 60 if i % 7 else None for i in range(len(texts))]
    got = QUERIES["op11_licenses"](spark, docs(texts, ids=ids)).collect()
    want = sorted(((i, *expected(t).values()) for i, t in zip(ids, texts, strict=True)), key=repr)
    assert sorted(((r.doc_id, *(r[k] for k in expected(""))) for r in got), key=repr) == want


def test_planted_notices_are_labelled_and_unlike_ones_are_not(spark, docs):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "Released under the BSD License.", "licensed under the terms", "This work is licensed"]
    got = rows(QUERIES["op11_licenses"](spark, docs([f"words before. {x} words behind" for x in lines])), "doc_id")
    assert [r["labels"] for r in got] == ["mit", "cc-by,cc-by-nc", "apache", "", "", ""]


def test_spans_have_places_and_phrases_of_any_length(spark):
    df = spark.createDataFrame([(1, "a b c d e f one two three four five"), (2, "one two x three four five")], "doc_id long, text string")
    known = licenses.templates((("one two three four five", "long"),), (("b c d e", "short"),))
    got = rows(licenses.license_spans(df, known).drop("row"), "doc_id", "start_word")
    assert [(r["doc_id"], r["label"], r["start_word"], r["end_word"]) for r in got if r["label"]] == [(1, "short", 1, 5), (1, "long", 6, 11)]
    with pytest.raises(ValueError):
        licenses.templates((("one", "x"),), ())


def test_one_exchange_and_no_python(spark, docs):
    plan = QUERIES["op11_licenses"](spark, docs(["cc by"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_clashing_columns(spark, save):
    names = ("row", "pos", "w", "template", "label", "base", "diagonal", "n_words", "t0")
    df = spark.createDataFrame([(1, "cc by", *"abcdefghi")], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert [(r.doc_id, r.base_labels) for r in QUERIES["op11_licenses"](spark, save(documents=df)).collect()] == [(1, "cc-by")]
    assert QUERIES["op11_licenses"](spark, save(documents=df.filter("false"))).count() == 0
