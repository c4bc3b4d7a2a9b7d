"""Quality rules: robust multivariate outliers by minimum covariance determinant per language and source.

Four statistics of each text that passes the base rules are transformed into a vector; location and scatter
of these vectors are estimated for every (lang, source), every lang and the whole corpus by concentration
steps: distances under the current estimate, the closest ``ALPHA`` of the documents, their moments, anew.
A step is one pass with partial aggregation: distances are put into ``BINS`` bins of fixed edges (64 a doubling of
1 + squared distance), moments are summed by bin, and each group's bins (a bounded number) give its closest part. So a
group of any size costs a task no more than its bins.

There are three starts: the median and MAD of every coordinate, the moments of all documents, and the moments of those
that no coordinate puts further than ``NEAR`` MADs from its median. Each takes ``FIRST`` steps; the one with the least determinant
goes on until no group's determinant falls by more than ``SETTLED`` of itself, or ``STEPS`` steps are done. ``FLOOR`` is
added to the scatter's diagonal, as most texts have no symbol and no repetition at all and a plain determinant would be 0.

A group of ``LEAST`` documents on stands on its own; a smaller one of n is drawn towards its language's estimate, by
1 - n / LEAST of the way in location and scatter, and a small language towards the corpus, so that no group changes its
judge at a size. Where the corpus itself has fewer than LEAST, the base rules decide alone.

Defined cases: null text counts as empty (and fails); null lang or source counts as ''; rows that repeat an id or have
none are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm._shared import staged
from tesserae.llm._text import Words, mix, pieces

P = 4
ALPHA, FIRST, STEPS, SETTLED, NEAR, BINS = 0.75, 2, 12, 1e-3, 2.5, 1024
#: Documents from which on an estimate stands on its own: five for each coordinate.
LEAST = 5 * P
#: Files that estimates are written as: one row a group is little, and a small table is broadcast instead of dealing all documents by group.
FILES = 8
#: Least standard deviation of each coordinate: log of the mean word length; roots of the rates of symbols, repeated lines, repeated words.
FLOOR = (0.08, 0.08, 0.16, 0.16)
#: A clean document's chance to lie beyond the cut, were the vectors normal.
TAIL = 1e-5

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in STATS])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _chi2_tail(x: float, p: int) -> float:
    """P(chi-square with an even number p of degrees > x)."""
    return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(p // 2))


def _chi2_point(tail: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_tail(mid, p) > tail else (lo, mid)
    return hi


#: Makes the scatter of the closest ALPHA consistent for normal vectors.
CONSISTENCY = ALPHA / (1 - _chi2_tail(_chi2_point(1 - ALPHA, P), P + 2))
CUT = _chi2_point(TAIL, P)


def _sum_by(doc: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(doc, values, n).astype(np.int64)


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts in STATS of each text."""
    w = Words(column)
    n, doc = w.n_docs, w.doc_of()
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points before each byte
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
    lines, again = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = w.data.tobytes()
    for d in range(n):
        own = [x for x in raw[w.offs[d] : w.offs[d + 1]].split(b"\n") if x and not x.isspace()]
        lines[d], again[d] = len(own), len(own) - len(set(own))
    covered = np.zeros(len(w.starts), bool)
    key, first, of = w.windows(3)
    if len(key):
        key = mix(key ^ mix(of.astype(np.uint64) + np.uint64(1)))
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = first[times[where] > 1]
        for k in range(3):
            covered[twice + k] = True
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": _sum_by(doc, points[w.ends] - points[w.starts], n),
        "n_symbols": symbols[w.offs[1:]] - symbols[w.offs[:-1]],
        "n_lines": lines,
        "n_dup_lines": again,
        "n_repeat_words": _sum_by(doc, covered, n),
    }


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "__stats") -> DataFrame:
    """All columns of docs and a struct of STATS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            found = statistics(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays([pa.array(found[k]) for k in STATS], list(STATS))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, _TYPE)]))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def vector(stats: Column) -> list[Column]:
    """The transformed statistics; null without words."""
    n = F.nullif(stats["n_words"], F.lit(0)).cast("double")
    return [F.log(stats["word_chars"] / n), F.sqrt(stats["n_symbols"] / n), F.sqrt(stats["n_dup_lines"] / F.nullif(stats["n_lines"], F.lit(0))), F.sqrt(stats["n_repeat_words"] / n)]


def _distance(x: list[Column], fit: Column) -> Column:
    """Squared Mahalanobis distance; the matrix is stored by its upper triangle, off-diagonal entries doubled."""
    d = [v - fit["mean"][i] for i, v in enumerate(x)]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        out = out + fit["inverse"][k] * d[i] * d[j]
    return F.greatest(out, F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.least(F.floor(F.log2(1 + d2) * 64), F.lit(BINS - 1)).cast("int")


#: Fixed edges of the bins of each coordinate, for medians.
_LOW, _WIDTH = -1.0, 8.0 / BINS
_FIT = "lang string, source string, level int, start int, n long, mean array<double>, scatter array<double>, inverse array<double>, logdet double"
_GROUP = ["level", "lang", "source"]
_EACH = [*_GROUP, "start"]


def _said(values) -> list[float]:
    return [float(f"{x:.9e}") for x in values]


def _params(key, n: int, mean: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    """A fit as a row; scatter is given without the floor."""
    full = scatter + np.diag(np.square(FLOOR))
    inverse = np.linalg.inv(full)
    return pd.DataFrame({
        "lang": [key[1]], "source": [key[2]], "level": [key[0]], "start": [key[3]], "n": [n], "mean": [_said(mean)], "scatter": [_said([scatter[i, j] for i, j in _PAIRS])],
        "inverse": [_said([inverse[i, j] * (1 if i == j else 2) for i, j in _PAIRS])], "logdet": [float(np.linalg.slogdet(full)[1])],
    })


def _full(packed) -> np.ndarray:
    out = np.zeros((P, P))
    for k, (i, j) in enumerate(_PAIRS):
        out[i, j] = out[j, i] = packed[k]
    return out


def _weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)])


def _start(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    mean, spread = np.zeros(P), np.zeros(P)
    for i in range(P):
        own = rows[rows["at"] == i]
        middle, counts = _LOW + (own["bin"].to_numpy() + 0.5) * _WIDTH, own["n"].to_numpy()
        mean[i] = _weighted_median(middle, counts)
        spread[i] = 1.4826 * _weighted_median(np.abs(middle - mean[i]), counts)
    return _params((*key, 0), int(rows.loc[rows["at"] == 0, "n"].sum()), mean, np.diag(spread**2))


def _moments(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = rows["n"].sum()
    mean = np.array([rows[f"s{i}"].sum() / n for i in range(P)])
    scatter = np.zeros((P, P))
    for i, j in _PAIRS:
        scatter[i, j] = scatter[j, i] = rows[f"s{i}_{j}"].sum() / n - mean[i] * mean[j]
    return mean, scatter


def _begin(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    """Moments of all documents (start 1) and of the near ones (start 2), or of all where none is near."""
    total, near = int(rows["n"].sum()), rows[rows["near"]]
    return pd.concat([_params((*key, 1), total, *_moments(rows)), _params((*key, 2), total, *_moments(near if len(near) else rows))])


def _step(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("bin")
    total = int(rows["n"].sum())
    last = int(np.searchsorted(np.cumsum(rows["n"].to_numpy()), math.ceil(ALPHA * total)))
    mean, scatter = _moments(rows.iloc[: last + 1])
    return _params(key, total, mean, scatter * CONSISTENCY)


def drawn(mean: np.ndarray, scatter: np.ndarray, n: int, above: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray] | None:
    """A group's location and scatter, drawn towards those of the level above if it is small."""
    if n >= LEAST:
        return mean, scatter
    if above is None:
        return None
    own = n / LEAST
    return own * mean + (1 - own) * above[0], own * scatter + (1 - own) * above[1]


def _towards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fits drawn towards the estimate that comes with them (above_mean, above_scatter); those of the corpus have none."""
    for rows in batches:
        out = []
        for _, r in rows.iterrows():
            above = None if r["above_mean"] is None else (np.array(r["above_mean"]), _full(r["above_scatter"]))
            found = drawn(np.array(r["mean"]), _full(r["scatter"]), int(r["n"]), above)
            if found is not None:
                out.append(_params((r["level"], r["lang"], r["source"], r["start"]), int(r["n"]), *found))
        if out:
            yield pd.concat(out)


def fit(rows: DataFrame) -> DataFrame:
    """Estimates by (level, lang, source): 2 for a source of a language, 1 for a language; none where the corpus is too small.

    rows: lang, source, x0 .. x3 of the documents that pass the base rules.
    """
    none = F.lit("")
    levels = F.array(F.struct(F.lit(0).alias("level"), none.alias("lang"), none.alias("source")), F.struct(F.lit(1).alias("level"), F.col("lang"), none.alias("source")), F.struct(F.lit(2).alias("level"), F.col("lang"), F.col("source")))
    x = [F.col(f"x{i}") for i in range(P)]
    each = rows.select(F.explode(levels).alias("g"), *x).select("g.*", *x)
    cells = [F.struct(F.lit(i).alias("at"), F.greatest(F.lit(0), F.least(F.floor((v - _LOW) / _WIDTH), F.lit(BINS - 1))).cast("int").alias("bin")) for i, v in enumerate(x)]
    counts = each.select(*_GROUP, F.explode(F.array(*cells)).alias("c")).groupBy(*_GROUP, "c.at", "c.bin").agg(F.count("*").alias("n"))
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in _PAIRS]
    fits = F.struct("mean", "inverse").alias("fit")

    def step(now: DataFrame) -> DataFrame:
        placed = each.join(now.select(*_EACH, fits), _GROUP).withColumn("bin", _bin(_distance(x, F.col("fit"))))
        return staged(placed.groupBy(*_EACH, "bin").agg(F.count("*").alias("n"), *sums).groupBy(*_EACH).applyInPandas(_step, _FIT).repartition(FILES), "mcd")

    robust = staged(counts.groupBy(*_GROUP).applyInPandas(_start, _FIT).repartition(FILES), "mcd")
    near = F.lit(True)
    for i, v in enumerate(x):
        k = _PAIRS.index((i, i))
        near = near & (F.abs(v - F.col("fit.mean")[i]) <= NEAR * F.sqrt(F.col("fit.scatter")[k] + F.lit(FLOOR[i] ** 2)))
    judged = each.join(robust.select(*_GROUP, F.struct("mean", "scatter").alias("fit")), _GROUP).withColumn("near", near)
    begun = judged.groupBy(*_GROUP, "near").agg(F.count("*").alias("n"), *sums).groupBy(*_GROUP).applyInPandas(_begin, _FIT)
    now = staged(robust.unionByName(begun).repartition(FILES), "mcd")
    for _ in range(FIRST):
        now = step(now)
    now = staged(now.groupBy(*_GROUP).agg(F.min_by(F.struct(*now.columns), F.struct("logdet", "start")).alias("r")).select("r.*").repartition(FILES), "mcd")
    for _ in range(STEPS - FIRST):
        after = step(now)
        fall = now.select(*_GROUP, F.col("logdet").alias("before")).join(after, _GROUP).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        now = after
        if fall is None or fall <= SETTLED:
            break
    # From the corpus down: each level is drawn towards the one above it.
    corpus = now.where("level = 0").withColumns({"above_mean": F.lit(None).cast("array<double>"), "above_scatter": F.lit(None).cast("array<double>")}).mapInPandas(_towards, _FIT).first()
    if corpus is None:
        return now.limit(0)
    over = {"above_mean": F.lit(list(corpus["mean"])), "above_scatter": F.lit(list(corpus["scatter"]))}
    languages = staged(now.where("level = 1").withColumns(over).mapInPandas(_towards, _FIT), "languages")
    above = languages.select("lang", F.col("mean").alias("above_mean"), F.col("scatter").alias("above_scatter"))
    return staged(languages.unionByName(now.where("level = 2").join(above, "lang").mapInPandas(_towards, _FIT)).repartition(FILES), "estimates")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", out: str = "__quality") -> DataFrame:
    """All columns of docs and a struct: STATS, base_failed, distance (squared; null without an estimate), kept."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(F.col(text_col).cast("string").alias("text"), blank(lang_col).alias("lang"), blank(source_col).alias("source"))
    measured = with_statistics(own).where(~base_failed(F.col("__stats")))
    rows = staged(measured.select("lang", "source", *[v.alias(f"x{i}") for i, v in enumerate(vector(F.col("__stats")))]), "statistics")
    fits = fit(rows)
    out_rows = with_statistics(docs, text_col).withColumns({"__lang": blank(lang_col), "__source": blank(source_col)})
    for level, keys in ((2, ["lang", "source"]), (1, ["lang"])):
        own_fit = fits.where(F.col("level") == level).select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct("mean", "inverse").alias(f"__fit{level}"))
        out_rows = out_rows.join(own_fit, [f"__{k}" for k in keys], "left")
    stats = F.col("__stats")
    distance = _distance(vector(stats), F.coalesce(F.col("__fit2"), F.col("__fit1")))
    failed = base_failed(stats)
    return out_rows.select(*docs.columns, F.struct(*[stats[k].alias(k) for k in STATS], failed.alias("base_failed"), distance.alias("distance"), (~failed & F.coalesce(distance <= CUT, F.lit(True))).alias("kept")).alias(out))


def keep(docs: DataFrame, **columns: str) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge(docs, **columns).where("__quality.kept").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: doc_id, the five counts, base_failed, kept of all documents."""
    q = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return q.select("doc_id", *[f"__quality.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")])
