"""Passages found in texts' bytes against Python's own search."""

import random

import pyarrow as pa
import pytest

from tesserae.operators import passages
from tesserae.plans import citation as pc


def made(seed):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice("ab é中😀\n") for _ in range(n))
    texts = [text(draw.choice([0, 3, 20, 400])) for _ in range(60)] + ["", "What is it? What is that?", "aaaaaaaaaaaaaaaaaaaaaa"]
    asked = [t[a : a + n] for t in texts if len(t) > 15 for a, n in [(draw.randrange(len(t) - 8), draw.choice([4, 9, 17, 300]))]]
    asked += ["What is it?", "What is that?", "What is what?", "a" * 9, "a" * 16, "a" * 23, texts[3] + "x" * 8]
    return texts, [a for a in asked if len(a.encode()) >= passages.WORD]


@pytest.mark.parametrize("piece", [16, 64, 1 << 20])
def test_held_as_python_says(monkeypatch, piece):
    """Passages at ends, across pieces, with one beginning, that overlap themselves or would run on into the next text."""
    monkeypatch.setattr(passages, "PIECE", piece)
    for seed in range(6):
        texts, asked = made(seed)
        column = pa.array(["cut off", *texts, None])[1:]
        text, passage = passages.Passages(pa.array(asked)).within(column)
        assert sorted(zip(text.tolist(), passage.tolist(), strict=True)) == [(i, j) for i, t in enumerate(texts) for j, a in enumerate(asked) if a in t]


def test_one_pass_over_the_texts(spark, tmp_path):
    """Small tables of passages need no join of words: texts are read once for long and once for short passages; nulls and repeated rows are as in SQL."""
    texts = spark.createDataFrame([(1, "one two three four five six seven"), (1, "another text"), (2, None), (None, "one two three four five six seven"), (3, "six"), (4, "")], "document_id long, text string")
    asked = spark.createDataFrame([(10, "two three four five six seven"), (11, "six"), (12, None), (13, ""), (14, "another text"), (14, "two three four five six seven")], "query_id long, query string")
    for name, table in (("texts", texts), ("asked", asked)):
        table.write.parquet(str(tmp_path / name))
    texts, asked = (spark.read.parquet(str(tmp_path / name)) for name in ("texts", "asked"))
    found = pc.holding(texts, asked)
    t, a = ([tuple(r) for r in d.collect()] for d in (texts, asked))
    assert {tuple(r) for r in found.collect()} == {(q, d) for q, p in a for d, x in t if p is not None and x is not None and p in x}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "xxhash64" not in plan
    assert pc.holding(texts, asked.where("query_id = 12")).count() == 0 == pc.holding(texts.limit(0), asked).count()
