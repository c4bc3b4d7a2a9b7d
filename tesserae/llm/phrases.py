"""Phrase collocation mining by pivot partitioning, after MG-FSM (Miliaraki et al., 2013).

1. Words are counted by language; those found fewer than ``least`` times stand in no frequent phrase.
2. The frequent words' counts go into a table of 2**20 buckets, broadcast at a fixed 8 MB. A word's weight is its bucket's
   sum: what reads 0 is surely rare, and weights order words from rare to common.
3. The pivot of an n-gram is its rarest word by weight, the leftmost one of several. For every word that has a neighbour in
   its piece which isn't rarer, the text around it is rewritten to the fragment of up to three words on either side that
   are no rarer: on the left only more common ones, so each occurrence of an n-gram lies in one fragment, its pivot's.
   A task counts equal fragments before it sends them, packed, to the group of their pivot. A pivot with more than its
   share of all words is dealt to several groups by its fragments.
4. Each group enumerates the windows of its fragments that hold the pivot, and counts them. Where a pivot is in one group,
   counts are final and n-grams below ``least`` end there; the few pivots that are dealt out are summed once more.
5. Parts of a candidate are frequent themselves, so scores and the rule on longer phrases are joins of that table.

Words are told apart by 64-bit hashes of language and word; two frequent words with one hash are noticed and the hash is
taken anew. n-grams and fragments are compared by all their words, not by a hash.

Defined cases: a null text counts as empty, a null language as ``und``; null ids and repeated rows count as texts of
their own; a very long text is worked on in one piece. Empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm._shared import staged
from tesserae.llm._text import Words, buffers, cuts, mix, pieces, signed

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE, COVER = 2_000_000, 80
#: Buckets of the weights (longs, so 8 MB), words of a group, words worked on before a task sends or counts (some 150 bytes each).
BUCKETS, GROUP_WORDS, AT_ONCE = 1 << 20, 1 << 20, 1 << 19
_SHIFT = np.uint64(44)
_REACH = LONGEST - 1
_IDS = [f"w{k + 1}" for k in range(LONGEST)]

# Bytes that end a piece become line feeds, which Words takes for space; the rest of its spaces are blank and tab.
_ENDS = np.arange(256, dtype=np.uint8)
_ENDS[[ord(c) for c in ".,;:!?\x0b\x0c\x0d"]] = 10


def _cut(batch: pa.RecordBatch, seed: int, langs: dict[str, int]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their ids, the number of each one's language in ``langs``, which grows, and whether the next one follows in the same piece."""
    data, offs = buffers(batch.column("text"))
    data = _ENDS[data]
    w = Words(pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs), pa.py_buffer(data)), fold=True)
    named = batch.column("lang").dictionary_encode()
    names = named.dictionary.to_pylist()
    index = named.indices.to_numpy()[w.doc_of()]
    hashes = np.array([_lang_hash(x, seed) for x in names], np.uint64)[index]
    lang = np.array([langs.setdefault(x, len(langs)) for x in names], np.int64)[index]
    ids = mix(w.hashes ^ hashes)
    ids[ids == 0] = 1
    n = len(ids)
    follows = np.zeros(n, bool)
    if n > 1:
        ends = np.concatenate([[0], np.cumsum(w.data == 10)])
        follows[:-1] = ends[w.starts[1:]] == ends[w.ends[:-1]]
        last = w.first[1:-1] - 1  # a document's last word is followed by none
        follows[last[last >= 0]] = False
    return w, ids, lang, follows


def _lang_hash(lang: str, seed: int) -> int:
    x = np.array([seed], np.uint64)
    for byte in lang.encode():
        x = mix(x * np.uint64(257) + np.uint64(byte + 1))
    return int(x[0])


def _word_rows(seed: int):
    """(lang, word, id, n) of the words of some texts, and (lang, null, null, n) of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        size, langs = 0, {}
        for batch in pieces(batches):
            w, ids, lang, _ = _cut(batch, seed, langs)
            if not len(ids):
                continue
            found, first, n = np.unique(ids, return_index=True, return_counts=True)
            held.append((found, n, lang[first], _strings(w, first)))
            size += len(found)
            if size > AT_ONCE:
                yield _counted(held, langs)
                held, size = [], 0
        if held:
            yield _counted(held, langs)

    return run


def _strings(w: Words, at: np.ndarray) -> pa.Array:
    """The words at these places."""
    size = w.ends[at] - w.starts[at]
    offs = cuts(size)
    byte = np.arange(offs[-1]) + np.repeat(w.starts[at] - offs[:-1], size)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offs), pa.py_buffer(w.data[byte]))


def _counted(held: list, langs: dict[str, int]) -> pa.RecordBatch:
    ids, n, lang = (np.concatenate([x[k] for x in held]) for k in range(3))
    words = pa.concat_arrays([x[3] for x in held])
    found, first, index = np.unique(ids, return_index=True, return_inverse=True)
    sums = np.bincount(index, n, len(found)).astype(np.int64)
    whole = np.bincount(lang, n, len(langs)).astype(np.int64)
    names, blank = pa.array(list(langs), pa.string()), pa.nulls(len(langs), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([names.take(pa.array(lang[first])), names]), pa.concat_arrays([words.take(pa.array(first)).cast(pa.string()), blank]), pa.concat_arrays([pa.array(signed(found)), pa.nulls(len(langs), pa.int64())]), pa.array(np.concatenate([sums, whole]))],
        names=["lang", "word", "id", "n"],
    )


def _around(ids: np.ndarray, weight: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each word's fragment reaches to the left and to the right."""
    n = len(ids)
    left, right = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    on = weight > 0
    go_left, go_right = on.copy(), on.copy()
    for k in range(1, _REACH + 1):
        if n <= k:
            break
        go_left[:k] = False
        go_left[k:] &= follows[: n - k] & (weight[: n - k] > weight[k:])
        go_right[n - k :] = False
        go_right[: n - k] &= follows[k - 1 : n - 1] & (weight[k:] >= weight[: n - k])
        left += go_left
        right += go_right
    return left, right


def _same(columns: list[np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups equal rows: an order that puts them together, and where each run of equal rows begins in it.

    Rows are sorted by a hash; should two different ones share it, by all their columns.
    """
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    differ = np.zeros(max(len(key) - 1, 0), bool)
    for c in columns:
        differ |= c[order[1:]] != c[order[:-1]]
    if (differ & ~fresh[1:]).any():
        order = np.lexsort(columns)
        fresh[1:] = False
        for c in columns:
            fresh[1:] |= c[order[1:]] != c[order[:-1]]
    return order, np.flatnonzero(fresh)


def _key(columns: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c)
    return key


def _sent(ids: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, lang: np.ndarray, names: list[str], share: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Fragments of these words, counted and packed: a row for each group, language and whether its pivots are dealt out."""
    at = np.flatnonzero(left | right)
    if not len(at):
        return
    l, r, steps = left[at], right[at], np.arange(-_REACH, _REACH + 1)
    inside = (steps >= -l.astype(np.int64)[:, None]) & (steps <= r.astype(np.int64)[:, None])
    shown = np.where(inside, ids[np.clip(at[:, None] + steps, 0, len(ids) - 1)], np.uint64(0))
    columns = [np.ascontiguousarray(shown[:, k]) for k in range(len(steps))]
    key = _key(columns)
    order, begins = _same(columns, key)
    one = order[begins]
    n = np.diff(np.append(begins, len(order)))
    shown, inside, l, r, key, lang = shown[one], inside[one], l[one], r[one], key[one], lang[at[one]]
    pivot = shown[:, _REACH]
    parts = 1 + table[(pivot >> _SHIFT).astype(np.int64)] // share
    group = (mix(pivot + key % parts.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    unit = (group * len(names) + lang) * 2 + (parts > 1)
    order = np.lexsort((pivot, unit))
    unit, shown, inside, shape, n = unit[order], shown[order], inside[order], (l * 4 + r)[order], n[order]
    starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    stops = np.append(starts[1:], len(unit))
    rows = {"grp": [], "lang": [], "dealt": [], "shapes": [], "counts": [], "ids": []}
    for a, b in zip(starts, stops, strict=True):
        u = int(unit[a])
        for k, v in zip(rows, (u // 2 // len(names), names[u // 2 % len(names)], bool(u % 2), shape[a:b].astype(np.uint8).tobytes(), n[a:b].astype(np.uint32).tobytes(), shown[a:b][inside[a:b]].tobytes()), strict=True):
            rows[k].append(v)
    yield pa.RecordBatch.from_arrays([pa.array(rows["grp"], pa.int64()), pa.array(rows["lang"], pa.string()), pa.array(rows["dealt"], pa.bool_()), *[pa.array(rows[k], pa.binary()) for k in ("shapes", "counts", "ids")]], names=list(rows))


def _fragments(shared, seed: int, share: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.int64)
        held: list[tuple] = []
        size, langs = 0, {}
        for batch in pieces(batches):
            _, ids, lang, follows = _cut(batch, seed, langs)
            held.append((ids, *_around(ids, table[(ids >> _SHIFT).astype(np.int64)], follows), lang))
            size += len(ids)
            if size > AT_ONCE:
                ids, left, right, lang = (np.concatenate(x) for x in zip(*held, strict=True))
                yield from _sent(ids, table, left, right, lang, list(langs), share, groups)
                held, size = [], 0
        if held:
            ids, left, right, lang = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from _sent(ids, table, left, right, lang, list(langs), share, groups)

    return run


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words by place (0: none), reach to the left and right, count of each fragment."""
    shape, n = np.frombuffer(row["shapes"], np.uint8), np.frombuffer(row["counts"], np.uint32)
    l, r, steps = (shape // 4).astype(np.int64), (shape % 4).astype(np.int64), np.arange(-_REACH, _REACH + 1)
    inside = (steps >= -l[:, None]) & (steps <= r[:, None])
    shown = np.zeros(inside.shape, np.uint64)
    shown[inside] = np.frombuffer(row["ids"], np.uint64)
    return shown, l, r, n


def _grams(shown: np.ndarray, l: np.ndarray, r: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """All windows of 2 to 4 words that hold the pivot: their words by place (0: none) and counts."""
    words: list[list[np.ndarray]] = [[] for _ in range(LONGEST)]
    counts = []
    for a in range(_REACH + 1):
        for size in range(max(2, a + 1), LONGEST + 1):
            b = size - 1 - a
            rows = np.flatnonzero((l >= a) & (r >= b))
            for k in range(LONGEST):
                words[k].append(shown[rows, _REACH - a + k] if k < size else np.zeros(len(rows), np.uint64))
            counts.append(n[rows])
    return [np.concatenate(x) for x in words], np.concatenate(counts).astype(np.int64)


def _merged(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    if not len(n):
        return columns, n
    order, begins = _same(columns, _key(columns))
    one = order[begins]
    return [c[one] for c in columns], np.add.reduceat(n[order], begins)


def _mined(least: int):
    """Counts the n-grams of each group; rows come sorted by group, so one group is in memory."""

    def out(lang: str, dealt: bool, held: list) -> Iterator[pa.RecordBatch]:
        columns, n = _merged([np.concatenate([x[0][k] for x in held]) for k in range(LONGEST)], np.concatenate([x[1] for x in held]))
        if not dealt:
            some = n >= least
            columns, n = [c[some] for c in columns], n[some]
        if len(n):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *[pa.array(signed(c)) for c in columns], pa.array(n)], names=["lang", *_IDS, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, most = None, [], 0, 2 * AT_ONCE
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                now = (row["grp"], row["lang"], row["dealt"])
                if now != at:
                    if held:
                        yield from out(at[1], at[2], held)
                    at, held, size, most = now, [], 0, 2 * AT_ONCE
                held.append(_merged(*_grams(*_unpacked(row))))
                size += len(held[-1][1])
                if size > most:  # when as much has come as the last merge left, so that merging stays in proportion
                    held = [_merged([np.concatenate([x[0][k] for x in held]) for k in range(LONGEST)], np.concatenate([x[1] for x in held]))]
                    size = len(held[0][1])
                    most = max(2 * AT_ONCE, 2 * size)
        if held:
            yield from out(at[1], at[2], held)

    return run


def words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, id, n: every word's count, and with word and id null that of all words of a language."""
    return docs.mapInArrow(_word_rows(seed), "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Two tables: words (lang, word, id, n) with each language's total as a null word; and all phrases of 2 to 4 words with at least ``least`` occurrences (lang, w1 to w4, n)."""
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for seed in range(1, 9):
        vocabulary = staged(words(read, seed).where((F.col("n") >= least) | F.col("word").isNull()), "words")
        if vocabulary.where("word IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("frequent words share hashes under every seed")
    total = vocabulary.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    buckets = vocabulary.where("word IS NOT NULL").groupBy(F.shiftrightunsigned("id", int(_SHIFT)).cast("int").alias("b")).agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(BUCKETS, np.int64)
    table[buckets["b"].to_numpy(np.int64)] = buckets["n"].to_numpy(np.int64)
    groups = max(64, total // GROUP_WORDS)
    share = max(1, total // (2 * groups))
    sent = read.mapInArrow(_fragments(spark.sparkContext.broadcast(table.tobytes()), seed, share, groups), "grp long, lang string, dealt boolean, shapes binary, counts binary, ids binary")
    mined = sent.repartition("grp").sortWithinPartitions("grp", "lang", "dealt").mapInArrow(_mined(least), f"lang string, {', '.join(f'{w} long' for w in _IDS)}, n long")
    return vocabulary, staged(mined.groupBy("lang", *_IDS).agg(F.sum("n").alias("n")).where(F.col("n") >= least), "grams")


def _part(a: int, b: int) -> Column:
    """Words a + 1 to b of a phrase, as the four ids of a phrase of their own."""
    return F.struct(*[(F.col(_IDS[a + k]) if a + k < b else F.lit(0).cast("long")).alias(w) for k, w in enumerate(_IDS)])


def _whole(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of every language."""
    vocabulary, grams = frequent(docs, least, text_col, lang_col)
    known = vocabulary.where("word IS NOT NULL")
    size = F.when(F.col("w3") == 0, 2).when(F.col("w4") == 0, 3).otherwise(4)
    grams = grams.withColumn("size", size)
    parts = staged(grams.where("size < 4").select(*_IDS, "n").unionByName(known.select(F.col("id").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in _IDS[1:]], "n")), "parts")

    def halves(m: int) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), _part(0, k).alias("one"), _part(k, m).alias("two")) for k in range(1, m)])

    def inner(m: int) -> Column:
        return F.array(*[_part(a, a + s) for s in range(2, m) for a in range(m - s + 1)])

    def by_size(f, sizes: tuple[int, ...]) -> Column:
        out = F.when(F.col("size") == sizes[0], f(sizes[0]))
        for m in sizes[1:]:
            out = out.when(F.col("size") == m, f(m))
        return out

    cut = grams.select("lang", *_IDS, F.col("n").alias("a"), F.explode(by_size(halves, (2, 3, 4))).alias("cut")).select("lang", *_IDS, "a", "cut.k", F.col("cut.one").alias("one"), F.col("cut.two").alias("two"))
    for side, name in (("one", "l"), ("two", "r")):
        of = parts.select(*[F.col(w).alias(f"p{w}") for w in _IDS], F.col("n").alias(name))
        cut = cut.join(of, [F.col(f"{side}.{w}") == F.col(f"p{w}") for w in _IDS]).drop(*[f"p{w}" for w in _IDS], side)
    # Decimals: products may pass a long.
    score = F.expr(f"(cast({SCALE} AS decimal(7,0)) * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    lowest = cut.withColumn("score", score).groupBy("lang", *_IDS, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    longer = grams.where("size > 2").select("n", F.explode(by_size(inner, (3, 4))).alias("in")).groupBy(*[F.col(f"in.{w}").alias(w) for w in _IDS]).agg(F.max("n").alias("longer"))
    kept = lowest.join(longer, _IDS, "left").where(F.col("longer").isNull() | (_whole("longer") * 100 < _whole("a") * COVER))
    kept = kept.select("lang", *_IDS, "a", "low.l", "low.r", "low.score")
    # All that tie with the last of the first by numbers; words are fetched for these alone.
    ahead = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = staged(kept.withColumn("rank", F.rank().over(ahead)).where(F.col("rank") <= top), "first")
    for k, w in enumerate(_IDS):
        first = first.join(known.select(F.col("id").alias(w), F.col("word").alias(f"word{k}")), w, "left")
    named = first.select("lang", F.concat_ws(" ", *[f"word{k}" for k in range(LONGEST)]).alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = vocabulary.where("word IS NULL").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: each language's first 2,000 phrases."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = r"""
WITH p AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS piece FROM p)),
grams AS (
  SELECT lang, m, list_aggregate(w[s : s + m - 1], 'string_agg', ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM q, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)
),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(len(w)) AS n FROM q GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) AS c
  JOIN f AS l ON l.lang = c.lang AND l.phrase = list_aggregate(c.w[1 : k], 'string_agg', ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = list_aggregate(c.w[k + 1 :], 'string_agg', ' ')
),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, list_aggregate(w[s : s + j - 1], 'string_agg', ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, j, unnest(range(1, m - j + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS j FROM c)) GROUP BY ALL
),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
