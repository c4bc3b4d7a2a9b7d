"""Substring dedup: Rabin-Karp hashes of every k-word window, counted in Spark.

A word is removed if a window that covers it also starts in a document with a smaller id.
Plan, so that no more than the shared windows are shuffled:

1. Copies of one text repeat all of it: only the copy with the smallest id takes part below, the others
   are marked whole.
2. Equal windows hold the same smallest hash of their ``ANCHOR``-word grams. These anchors, about one in
   twenty words, are counted over all documents; a window whose anchor lies in one text only can't repeat.
3. The windows of shared anchors are hashed and counted: smallest id by (window hash, half of the anchor
   hash), 96 bits. Windows with a smaller id than their own go back to their document, where they are
   merged into maximal intervals.

Defined cases: a null text counts as empty; a row with a null id neither loses words nor makes others lose
any; rows that repeat an id are judged each by its own text, and don't remove each other's words; texts with
fewer than k words lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm._shared import staged, texts
from tesserae.llm._text import Words, cuts, flat, lists, pieces, signed, sliding_min

#: Words of an anchor: long enough to be rare in prose, short enough that few grams are anchors.
ANCHOR = 12
_TAG = (1 << 31) - 1


def _anchors(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every k-word window: its anchor, its first word, its document."""
    gram, first, doc = w.windows(min(ANCHOR, k))
    span = k - min(ANCHOR, k) + 1
    least = sliding_min(gram, span)
    ok = doc[: len(least)] == doc[span - 1 :] if len(least) else np.empty(0, bool)
    return least[ok], first[: len(least)][ok], doc[: len(least)][ok]


def _anchor_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = Words(batch.column("text"))
            least, _, doc = _anchors(w, k)
            if not len(least):
                continue
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            text_hash = batch.column("text_hash").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(signed(least[new])), pa.array(text_hash[doc[new]])], names=["anchor", "text_hash"])

    return run


def _window_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = Words(batch.column("text"))
            full, start, doc = w.windows(k)
            least, _, _ = _anchors(w, k)
            shared, found = batch.column("anchors"), []
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for d in range(batch.num_rows):
                a, b = cut[d], cut[d + 1]
                found.append(a + np.flatnonzero(np.isin(least[a:b], shared[d].values.to_numpy().view(np.uint64))))
            at = flat(found, np.int64)
            tag = (batch.column("text_hash").to_numpy() & _TAG) << 32
            place = tag[doc[at]] | (start[at] - w.first[doc[at]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(full[at])), pa.array((least[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(batch.column("doc_id").to_numpy()[doc[at]]), pa.array(place)],
                names=["window", "half", "doc_id", "place"],
            )

    return run


def merge_intervals(starts: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of words that windows of k words from these starts cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    gap = np.flatnonzero(np.diff(starts) > k)
    return list(zip(starts[np.r_[0, gap + 1]].tolist(), (starts[np.r_[gap, len(starts) - 1]] + k).tolist(), strict=True))


_TYPE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.LongType()))])


def _removed(k: int, names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            n_words, kept, ends, sizes = [], [], [], []
            whole, places = batch.column("__whole").to_pylist(), batch.column("__places")
            tags = batch.column("__hash").to_numpy() & _TAG
            for d, text in enumerate(batch.column(text_col).to_pylist()):
                words = (text or "").encode().split()
                spans: list[tuple[int, int]] = []
                if whole[d] and len(words) >= k:
                    spans = [(0, len(words))]
                elif places[d].is_valid:
                    at = places[d].values.to_numpy()
                    spans = merge_intervals(at[(at >> 32) == tags[d]] & ((1 << 32) - 1), k)
                left, at = [], 0
                for a, b in spans:
                    left += words[at:a]
                    at = b
                n_words.append(len(words))
                kept.append(b" ".join(left + words[at:]).decode())
                ends += [x for s in spans for x in s]
                sizes.append(2 * len(spans))
            found = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(kept, pa.string()), lists(np.array(ends, np.int64), cuts(np.array(sizes, np.int64)))], ["n_words", "kept_text", "removed"])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], found], names=[*names, "__dedup"])

    return run


def _apart(rows: DataFrame, aggregate: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with an aggregate by the same keys, which may be hot.

    A further key, made of the first, has the aggregate dealt out anew for the join: both of its sides are then plain
    exchanges, whose large partitions Spark can split.
    """
    more = F.shiftright(keys[0], 48)
    return rows.withColumn("__key", more).join(aggregate.withColumn("__key", more), [*keys, "__key"]).drop("__key")


def repeated_windows(docs: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that repeats something: doc_id, text_hash, whole (a copy of an earlier text), places."""
    rows = texts(docs.where(F.col(id_col).isNotNull()), id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    ids = rows.select("doc_id", "text_hash", F.xxhash64(F.lit(1), "text").alias("other_hash"), F.length("text").alias("n_chars"))
    same = ["text_hash", "other_hash", "n_chars"]
    first = ids.groupBy(*same).agg(F.min("doc_id").alias("first_id"))
    copies = _apart(ids, first, same).where("doc_id > first_id").select("doc_id", "text_hash", F.lit(True).alias("whole"), F.lit(None).cast("array<long>").alias("places"))

    anchors = rows.select("text", "text_hash").mapInArrow(_anchor_rows(k), "anchor long, text_hash long")
    shared = anchors.groupBy("anchor").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a < b").select("anchor")
    by_text = _apart(anchors, shared, ["anchor"]).groupBy("text_hash").agg(F.collect_set("anchor").alias("anchors"))
    wanted = first.groupBy("text_hash").agg(F.min("first_id").alias("doc_id")).join(by_text, "text_hash")
    found = staged(rows.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text", "text_hash", "anchors").mapInArrow(_window_rows(k), "window long, half int, doc_id long, place long"), "windows")
    least = found.groupBy("window", "half").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("window", "half", "least")
    later = _apart(found, least, ["window", "half"]).where("doc_id > least").groupBy("doc_id", (F.col("place").bitwiseAND(F.lit(_TAG << 32))).alias("tag")).agg(F.collect_list("place").alias("places"))
    # A tag and an id lead back to one text; collect_list holds at most the windows of one document.
    owners = ids.select("doc_id", "text_hash", F.shiftleft(F.col("text_hash").bitwiseAND(F.lit(_TAG)), 32).alias("tag")).distinct()
    places = later.join(owners, ["doc_id", "tag"]).select("doc_id", "text_hash", F.lit(False).alias("whole"), "places")
    return copies.unionByName(places).groupBy("doc_id", "text_hash").agg(F.max("whole").alias("whole"), F.flatten(F.collect_list("places")).alias("places"))


def remove_repeated(docs: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and a struct __dedup: n_words, kept_text (kept words joined by a space), removed (flat list of interval ends, in words)."""
    marks = repeated_windows(docs, k, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("whole").alias("__whole"), F.col("places").alias("__places"))
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__hash": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    marked = keyed.join(marks, ["__id", "__hash"], "left").select(*docs.columns, "__hash", "__whole", "__places")
    return marked.mapInArrow(_removed(k, docs.columns, text_col), T.StructType([*docs.schema.fields, T.StructField("__dedup", _TYPE)]))


def strip(docs: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the kept words as the text of those that lose any."""
    found = remove_repeated(docs, k, id_col, text_col)
    text = F.when(F.size("__dedup.removed") > 0, F.col("__dedup.kept_text")).otherwise(F.col(text_col))
    return found.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op10: doc_id, n_words, n_removed, kept_sha256 of all documents."""
    out = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.aggregate("__dedup.removed", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda z, x: F.struct((z["n"] + x * z["s"]).alias("n"), (-z["s"]).alias("s")), lambda z: z["n"])
    return out.select("doc_id", "__dedup.n_words", gone.alias("n_removed"), F.sha2(F.encode("__dedup.kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM w)),
least AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
flags AS (SELECT doc_id, s FROM windows JOIN least USING (k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s FROM w),
marked AS (SELECT words.doc_id, word, words.s, coalesce(max(flags.s IS NOT NULL) OVER (PARTITION BY words.doc_id ORDER BY words.s ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM words LEFT JOIN flags USING (doc_id, s)),
found AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY s) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN found USING (doc_id)
"""
