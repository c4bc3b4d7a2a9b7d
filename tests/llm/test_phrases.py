"""Phrases against the same rules in SQL, and against a plain count."""

import random
from collections import Counter

import duckdb
import pytest

from tesserae.llm import phrases


def rows(count, docs):
    """Prose of few words with planted phrases, nulls, odd separators, repeated words and repeated rows."""
    draw, vocabulary = random.Random(3), ["a", "B", "é", "dd", "e5", "F", "g", "hh"]
    out = [(None, "a b c. " * 40), ("en", None), ("en", ""), ("und", "A B,c\x0bd\x0ce\r\nf\tg  h\x1ci " * 40), ("en", "the " * 500), ("fr", "x y x y x y x y;" * 30), ("fr", "x  y " * 31)]
    for i in range(docs):
        text = " ".join(draw.choices(vocabulary, [1 / (k + 1) for k in range(8)])[0] + draw.choice(["", "", "", ".", " \t", "\n"]) for _ in range(count))
        out.append((["en", "fr", None][i % 3], text + (" New York City hall" if i % 2 else " new york city.")))
    return out + out[-20:]


def sql(spark, df):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    return Counter(con.sql(phrases.SQL).project("lang, rank, phrase, a, l, r, n, score").fetchall())


@pytest.mark.parametrize("at_once", [1 << 21, 500])
def test_rules(spark, monkeypatch, at_once):
    """Nearly all words are dealt out at this size; in small blocks too."""
    monkeypatch.setattr(phrases, "AT_ONCE", at_once)
    df = spark.createDataFrame(rows(60, 240), "lang string, text string").repartition(5)
    out = Counter(map(tuple, phrases.collocations(df).collect()))
    assert len(out) > 60 and out == sql(spark, df)


def test_cases(spark, docs):
    assert Counter(map(tuple, phrases.collocations(docs).collect())) == sql(spark, docs.select("lang", "text"))


def test_every_frequent_phrase_is_counted(spark):
    """Against a plain count of all phrases, by words; overlaps included."""
    data = [(lang or "und", text or "") for lang, text in rows(60, 90)]
    plain = Counter()
    for lang, text in data:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for c in ".,;:!?\x0a\x0b\x0c\x0d":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = piece.replace("\t", " ").split(" ")
            w = [x for x in w if x]
            plain.update((lang, *w[i : i + m]) for m in (2, 3, 4) for i in range(len(w) - m + 1))
    vocabulary, grams = phrases.frequent(spark.createDataFrame(data, "lang string, text string").repartition(3))
    name = {r["id"]: r["word"] for r in vocabulary.where("word IS NOT NULL").collect()}
    found = {(r["lang"], *[name[r[w]] for w in ("w1", "w2", "w3", "w4") if r[w]]): r["n"] for r in grams.collect()}
    assert found == {k: n for k, n in plain.items() if n >= 30}


def test_hashes_that_meet_are_told_apart(spark, monkeypatch):
    """Fragments and n-grams of one hash are still compared by their words."""
    monkeypatch.setattr(phrases, "_key", lambda columns: columns[0] % 3)
    import numpy as np

    a, b = np.array([5, 8, 5, 8, 5], np.uint64), np.array([1, 1, 2, 1, 1], np.uint64)
    columns, n = phrases._merged([a, b], np.array([1, 10, 100, 1000, 10000]))
    assert sorted(zip(*(c.tolist() for c in columns), n.tolist(), strict=True)) == [(5, 1, 10001), (5, 2, 100), (8, 1, 1010)]
