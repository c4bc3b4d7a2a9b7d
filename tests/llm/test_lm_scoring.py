"""LM scoring: counts and base scores against a plain version, the model as a distribution and on held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import lm_scoring as lm
from tesserae.llm.queries import QUERIES


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        folded = folded.replace(c, " ")
    return [w for w in folded.split(" ") if w] + [None]


def plain(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens) and base score of each row."""
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, text in rows if not out_of(i) for w in words(text))
    n, v = sum(counts.values()), len(counts)
    found = []
    for i, text in rows:
        w = words(text)
        found.append(((i, out_of(i), len(w), sum(x in counts for x in w), n), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return found


def agree(df, rows):
    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score) for r in df.collect() if r.doc_id is not None)
    want = sorted(x for x in plain(rows) if x[0][0] is not None)
    assert [k for k, _ in mine] == [k for k, _ in want]
    assert np.allclose([b for _, b in mine], [b for _, b in want], rtol=1e-9)


@pytest.mark.parametrize("known", [lm.KNOWN, 50, 0])
def test_counts_and_base(spark, docs, cases, monkeypatch, known):
    """Words beyond the broadcast ones meet their counts in the join; also when all of them do."""
    monkeypatch.setattr(lm, "KNOWN", known)
    agree(lm.score(docs), [r[:2] for r in cases])


def test_counts_and_base_sample(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    agree(QUERIES["op13_lm_scoring"](spark, sf_dir), rows)


def fitted(texts):
    """A model of some texts, without Spark's part."""
    column = pa.array(texts)
    ids, _ = lm.tokens(column)
    found, n = np.unique(ids, return_counts=True)
    order = np.argsort(-n, kind="stable")
    known, head = lm.Known.of(found[order], n[order]), n[order][: lm.HEAD]
    totals = lm.Totals(len(ids), len(found), len(ids) - int(head.sum()), len(found) - len(head))
    model, squares = lm.Model.start(head, totals.rest_n + totals.rest_v + 1), [np.full(lm.ROWS, lm.START, np.float32) for _ in range(2)]
    shared = type("Shared", (), {"value": (known, model, squares)})
    sent = [r for b in lm._train(shared)(iter([pa.RecordBatch.from_arrays([column], names=["text"])])) for r in b.to_pylist()]
    return known, lm._mixed(model, squares, sent)[0], totals, order


def test_chances_sum_to_one():
    """Over every first word and the rest, after any history."""
    texts = [" ".join(f"w{(i * k) % 37}" for i in range(60)) for k in range(1, 40)]
    known, model, _, _ = fitted(texts)
    ids, offs = lm.tokens(pa.array(texts[:3]))
    history = lm.Histories(ids, offs)
    p, total = lm.chances(model.class_rows, history.of_class(0, len(ids)), model.class_bias)
    classes = p / total[:, None]
    assert np.allclose(classes.sum(1), 1, atol=1e-5)
    whole = classes[:, lm.REST].astype(float)
    assert not classes[:, 2 : lm.REST].any()  # 38 words are in two classes
    for c in range(2):
        at = np.arange(len(ids))
        q, s = lm.chances(model.word_rows, history.of_word(at, np.full(len(ids), c)), model.word_bias[np.full(len(ids), c)])
        whole += classes[:, c] * (q / s[:, None]).sum(1)
    assert np.allclose(whole, 1, atol=1e-4)


def test_learns_a_rule():
    """Every word settles the next: the model comes near certainty, counts alone can't."""
    texts = [" ".join(f"w{(i * 7 + k) % 50}" for i in range(400)) for k in range(60)]
    known, model, totals, _ = fitted(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([False]), pa.array([" ".join(f"w{(i * 7 + 3) % 50}" for i in range(300))])], names=["doc_id", "held_out", "text"])
    out = next(iter(lm._scores(type("Shared", (), {"value": (known, model, totals)}))(iter([batch])))).to_pylist()[0]
    assert out["log_p"] / out["n_tokens"] > -0.3 and (out["counted"] - out["n_tokens"] * math.log10(totals.n + totals.v + 1)) / out["n_tokens"] < -1.5


def test_better_than_counts_on_held_out(spark):
    rows = lm.query(spark, "/root/testdata/sf0.01").where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.1


def test_mixing_is_a_weighted_mean():
    start = lm.Model.start(np.array([5, 3]), 2.0)
    squares = [np.zeros(lm.ROWS, np.float32) for _ in range(2)]

    def sent(met, value):
        one, weights = np.zeros(lm.BLOCK_ROWS), np.zeros((lm.BLOCK_ROWS, lm.WIDE))
        one[3], weights[3] = 1, value
        return lm._block(0, lm.BLOCK_ROWS, met * one, one, weights)

    both = [r for b in lm._averaged(iter([sent(1, 2.0), sent(3, 6.0)])) for r in b.to_pylist()]
    model, squares = lm._mixed(start, squares, both)
    assert np.allclose(model.class_rows[lm.BLOCK_ROWS + 3], 5.0) and not model.class_rows[lm.BLOCK_ROWS + 4].any() and squares[0][lm.BLOCK_ROWS + 3] == 2
