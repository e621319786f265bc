"""Phrases against plain counting, with ranges cut anywhere and words of any kind."""

import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pricemill.llm import collocations


def plain(rows, least, covered=80, scale=2_000_000):
    """{(lang, phrase): (a, l, r, n, score)} by dictionaries."""
    counts, totals = Counter(), Counter()
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                counts.update((lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    frequent = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    found = {}
    for (lang, words), a in frequent.items():
        inside = any(
            other == lang and len(longer) > len(words) and 100 * f >= covered * a
            and any(longer[i:i + len(words)] == words for i in range(len(longer)))
            for (other, longer), f in frequent.items()
        )
        if inside:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((int(Fraction(scale * a, left + right)), k, left, right))
        score, _, left, right = min(cuts)
        found[lang, " ".join(words)] = (a, left, right, totals[lang], score)
    return found


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "b", "A\x01b", "a\x00", "é", "zz", "\x1c", "b-c", "d" * 300]
    rows = []
    for _ in range(n):
        parts = rng.choices(words, weights=[9, 7, 2, 2, 3, 3, 1, 2, 1], k=rng.randint(0, 40))
        text = "".join(p + rng.choice([" ", "  ", "\t", " ", ", ", ".\n", "\r"]) for p in parts)
        rows.append((rng.choice(["x", "x", "x", None, "a\x00b"]), text))
    return rows + [("x", None), (None, ""), ("x", " \t")] + rows[:20]


@pytest.fixture
def framed(spark):
    def make(rows):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")

    return make


@pytest.mark.parametrize("least", [1, 4, 12])
def test_against_counting(framed, least):
    rows = texts(least)
    frame = framed(rows).withColumn("key", F.lit("clash")).withColumn("part", F.lit(1)).repartition(5)
    got = {
        (r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"])
        for r in collocations.candidates(frame, least=least).collect()
    }
    assert got == plain(rows, least)


def test_one_hot_word_over_many_ranges(spark, framed, monkeypatch):
    """Ranges are cut inside the phrases of one word; first words are copied, runs added up."""
    monkeypatch.setattr(collocations, "_WORDS_AT_ONCE", 500)
    monkeypatch.setattr(collocations, "shuffle_partitions", lambda spark: 23)
    rng = random.Random(3)
    rows = [("x", " ".join(f"hot w{rng.randint(0, 9)}" for _ in range(30))) for _ in range(80)]
    got = {
        (r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"])
        for r in collocations.candidates(framed(rows), least=3).collect()
    }
    assert got == plain(rows, 3) and got


def test_rank_ties_and_limit(framed):
    rows = [("x", "b c. a d. e f")] * 5 + [("y", "b c")] * 5
    found = collocations.collocations(framed(rows), largest=2, least=5).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"]) for r in found) == [
        ("x", 1, "a d"), ("x", 2, "b c"), ("y", 1, "b c")
    ]


def test_products_beyond_64_bits(spark):
    big = 1 << 45
    streams = spark.createDataFrame(
        [("x\0a\0b", big, 4 * big, 0, big + 3, None, None, big + 4, None, None)],
        "key string, f long, n long, extension long, l_1 long, l_2 long, l_3 long, r_1 long,"
        " r_2 long, r_3 long",
    )
    row = collocations.scored(streams).first()
    assert row["score"] == 2_000_000 * big // (2 * big + 7)


def test_empty(nasty, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    found = {r["phrase"]: r["a"] for r in collocations.collocations(nasty).collect()}
    assert found["word word word word"] == 49_997 and "word word" not in found


def test_long_text_is_whole(framed):
    rows = [("x", "left right " * 200_000)]
    got = {r["phrase"]: r["a"] for r in collocations.candidates(framed(rows)).collect()}
    assert got["left right left right"] == 199_999


def test_keys_round_trip():
    for word in ("\0", "\1", "\1\2", "\0\1", "a\1\0b", "plain"):
        assert collocations.unescaped(collocations.escaped(word)) == word
    words = sorted(["".join(w) for w in itertools.product("\0\1\2a", repeat=3)])
    assert sorted(words, key=collocations.escaped) == words
