"""N-gram Jaccard join: all links between documents whose shingle sets overlap enough, as components.

A set holds the distinct 5-word shingles of a text (A-Z lower-cased); two sets link when
100 * intersection >= PERCENT * union. The join is exact; it skips by set relations:

* Equal sets are one class: a set's identity is a 64-bit hash of its members and size.
* Tokens have one order for all documents: those in crowded buckets of a fixed-size count sketch of the
  whole corpus come last. Only a set's first tokens are indexed (a prefix filter), with their positions and
  LEAST extra ones, so that linked sets share at least ``least_shared`` tokens there.
* An index list is ordered by size, then position, and cut into blocks where the step to the next entry is too wide
  for a link in size or in position: sets of different blocks never meet. In a block of up to SHORT sets a pair is
  counted if position and size still allow a link, and compared if counted often enough.
* In a longer block all sets are first compared with one of them, the lead. Sets that link to it are together
  and aren't compared with each other. Jaccard distance is a metric, so sets whose distances to the lead lie two
  bands of LINK apart can't link: what is left to compare are sets of one band, or of neighbouring bands, that
  aren't known to be together yet. They meet in groups of bounded size.
* There a set's overlaps with all others are derived from those of the most similar set that has been worked on:
  only the index lists of the tokens in which the two differ are read. A set all of whose possible partners are
  together with it already is passed over. Only a spanning forest of the links leaves a group.

Defined cases: an empty or null text has an empty set, links with nothing, and is its own component; a text
with fewer than 5 words has its whole sequence as one shingle; a null id takes no part and has no component;
rows that repeat an id take part each, under that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import few_files, staged, texts
from tesserae.llm._text import Words, cuts, flat, mix, pieces, signed, windows
from tesserae.llm.components import components

K, PERCENT = 5, 80
#: One more indexed token for so many members.
EXTRA = 16
SKETCH_BITS = 18
#: Blocks of an index list with more sets than this are worked on by groups, not by pairs.
SHORT = 8
#: Largest Jaccard distance of linked sets; the bands of distances to a lead are as wide.
LINK = 1 - PERCENT / 100
#: Classes that a task remembers as indexed, so as not to index them again.
SEEN = 200_000
SALTS = 64
#: A block of a group holds about so many sets and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 18


def needed(a, b):
    """Least intersection of two linked sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def least_shared(n):
    """Indexed tokens that a set of n shares with any set that it links to, at least."""
    return 1 + n // EXTRA


def indexed(n):
    """Tokens of a set of n in the index."""
    return np.minimum(n, n - -(-PERCENT * n // 100) + least_shared(n))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order of hash, and their n + 1 offsets."""
    w = Words(column, fold=True)
    h, _, doc = w.windows(K)
    short = np.flatnonzero((w.counts > 0) & (w.counts < K))
    if len(short):
        whole = np.array([windows(w.hashes[w.first[d] : w.first[d + 1]], int(w.counts[d]))[0] ^ np.uint64(w.counts[d]) for d in short], np.uint64)
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(w.n_docs + 1))


def identities(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h))])
    return mix((total[cut[1:]] - total[cut[:-1]]) ^ mix(np.diff(cut).astype(np.uint64)))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        h, cut = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(cut)), pa.array(signed(identities(h, cut)))], names=["doc_id", "text_hash", "n", "set_id"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in pieces(batches):
        h, _ = shingle_sets(batch.column("text"))
        counts += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
    at = np.flatnonzero(counts)
    for i in range(0, len(at), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)].astype(np.int32)), pa.array(counts[at[i : i + (1 << 16)]])], names=["bucket", "n"])


def crowded(rows: DataFrame) -> np.ndarray:
    """For each bucket of the sketch, log2 of its count over the mean: 0 for ordinary ones. Of fixed size."""
    sketch = staged(few_files(rows.select("text").mapInArrow(_buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")), 1 << SKETCH_BITS), "sketch")
    mean = (sketch.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_BITS)
    level = np.zeros(1 << SKETCH_BITS, np.uint8)
    for bucket, n in sketch.where(F.col("n") > 2 * mean + 16).collect():  # at most 2**SKETCH_BITS rows
        level[bucket] = min(63, 1 + int(np.log2(n / (mean + 8))))
    return level


def _postings(level: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            h, cut = shingle_sets(batch.column("text"))
            ids, n = identities(h, cut), np.diff(cut)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], doc))
            h, at = h[order], np.arange(len(h)) - cut[doc]
            fresh = np.zeros(len(n), bool)
            for d, x in enumerate(ids.tolist()):  # indexed twice at worst, which the lists take as once
                if x not in seen:
                    seen.add(x)
                    fresh[d] = True
            if len(seen) > SEEN:
                seen.clear()
            ok = (at < indexed(n)[doc]) & fresh[doc]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[ok])), pa.array((n[doc[ok]] << 32) | at[ok]), pa.array(signed(ids[doc[ok]]))], names=["token", "place", "set_id"])

    return run


def possible(size_a: np.ndarray, at_a: np.ndarray, size_b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Whether sets that share a token at these positions of the common order may link."""
    most = np.minimum(at_a, at_b) + np.minimum(size_a - at_a, size_b - at_b)
    return most >= needed(size_a, size_b)


def blocks_of(token: np.ndarray, place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the postings and starts of the blocks of their lists; postings are in order of (token, place, ids).

    No link crosses from a block to another. A list is cut where the size grows by more than 100 / PERCENT; each of
    these runs is ordered by position and cut where that grows by more than 1 - PERCENT / 100 of its largest size,
    as sets of sizes a <= b that share a token at positions p and q have a union of at least b + |p - q| - (b - a).
    """
    size = place >> 32
    run = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (size[1:] * PERCENT > 100 * size[:-1])])
    of = np.repeat(np.arange(len(run)), np.diff(np.r_[run, len(token)]))
    largest = np.maximum.reduceat(size, run)[of]
    at = place & 0xFFFFFFFF
    order = np.lexsort((ids, at, of))
    at, of = at[order], of[order]
    start = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (100 * (at[1:] - at[:-1]) > (100 - PERCENT) * largest[1:])])
    return order, start


def _pairs_and_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings in order of (token, place, set_id): pairs of short blocks, members of long ones.

    a, b, least > 0: a pair that shares a token, and how many it needs; least = 0: set b is in the group of set a.
    """

    def done(token, place, ids):
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])  # a set has one place in a list
        token, place, ids = token[new], place[new], ids[new]
        order, start = blocks_of(token, place, ids)
        place, ids = place[order], ids[order]
        length = np.diff(np.r_[start, len(token)])
        a, b, least = [], [], []
        for k in range(2, SHORT + 1):
            own = start[length == k]
            for i in range(k - 1):
                for j in range(i + 1, k):
                    x, y = own + i, own + j
                    nx, ny = place[x] >> 32, place[y] >> 32
                    ok = possible(nx, place[x] & 0xFFFFFFFF, ny, place[y] & 0xFFFFFFFF)
                    p, q = ids[x[ok]], ids[y[ok]]
                    a.append(np.minimum(p, q))
                    b.append(np.maximum(p, q))
                    least.append(least_shared(np.minimum(nx, ny))[ok])
        for s, n in zip(start[length > SHORT].tolist(), length[length > SHORT].tolist(), strict=True):
            own = ids[s : s + n]
            a.append(np.full(n, own.min()))
            b.append(own)
            least.append(np.zeros(n, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(flat(x, np.int64)) for x in (a, b, least)], names=["a", "b", "least"])

    held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
    leader = None  # (token, set) of a list so long that it is passed on in parts
    for batch in batches:
        rows = [np.concatenate([x, batch.column(n).to_numpy()]) for x, n in zip(held, ("token", "place", "set_id"), strict=True)]
        if leader is not None:
            same = int(np.searchsorted(rows[0], leader[0], "right"))
            if same:
                ids = np.unique(rows[2][:same])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), leader[1])), pa.array(ids), pa.array(np.zeros(len(ids), np.int64))], names=["a", "b", "least"])
            rows = [x[same:] for x in rows]
            if not len(rows[0]):
                held = rows
                continue
            leader = None
        cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        if len(rows[0]) - cut > 50_000 and len(np.unique(rows[2][cut:])) > SHORT:
            if cut:
                yield done(*[x[:cut] for x in rows])
            ids = np.unique(rows[2][cut:])
            leader = (rows[0][-1], ids[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), leader[1])), pa.array(ids), pa.array(np.zeros(len(ids), np.int64))], names=["a", "b", "least"])
            held = [x[:0] for x in rows]
        else:
            if cut:
                yield done(*[x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
    if len(held[0]):
        yield done(*held)


def _sets_of(texts_: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members and offsets of the sets with these ids, and the rows that have them, one for each id.

    Another text under the same document id has another identity; repeated rows count once.
    """
    values, cut = shingle_sets(texts_)
    own = np.flatnonzero(signed(identities(values, cut)) == ids)
    own = own[np.unique(ids[own], return_index=True)[1]]
    return flat([values[cut[x] : cut[x + 1]] for x in own], np.uint64), cuts(np.diff(cut)[own]), own


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares a lead with its members: the band of each one's distance (0: linked). Of pairs only links are given."""
    for batch in batches:
        lead, member, band, long = [], [], [], []
        leads, column = batch.column("lead").to_numpy(), batch.column("sets")
        for k in range(batch.num_rows):
            rows = column[k].values
            ids = rows.field("member").to_numpy()
            values, cut, own = _sets_of(rows.field("text"), ids)
            ids, wide, n = ids[own], rows.field("long").to_numpy(zero_copy_only=False)[own], np.diff(cut)
            at = np.flatnonzero(ids == leads[k])
            if len(at) != 1 or len(ids) < 2:
                continue
            first = values[cut[at[0]] : cut[at[0] + 1]]
            place = np.minimum(np.searchsorted(first, values), len(first) - 1)
            both = np.add.reduceat((first[place] == values).astype(np.int64), cut[:-1])
            link = both >= needed(n, len(first))
            step = np.where(link, 0, np.maximum(1, np.floor((1 - both / (n + len(first) - both)) / LINK - 1e-9).astype(np.int64)))
            ok = (link | wide) & (ids != leads[k])
            lead.append(np.full(int(ok.sum()), leads[k]))
            member.append(ids[ok])
            band.append(step[ok])
            long.append(wide[ok])
        yield pa.RecordBatch.from_arrays([pa.array(flat(x, np.int64)) for x in (lead, member, band)] + [pa.array(flat(long, bool))], names=["lead", "member", "band", "long"])


def linked_parts(values: np.ndarray, cut: np.ndarray, known: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Component of each set among the links of these sets, and how many index entries were read for it.

    values: the sets' distinct members; known: components that are known; side: where given, only sets of different
    sides are compared. A component is named by the least of its first sets' known names (or indexes).
    """
    m, n = len(cut) - 1, np.diff(cut)
    owner = np.repeat(np.arange(m), n)
    _, where, times = np.unique(values, return_inverse=True, return_counts=True)
    at = cuts(times)
    lists = owner[np.argsort(where, kind="stable")]  # index lists, one after another
    part = np.arange(m) if known is None else known.copy()
    size_ok = 100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :])
    open_ = np.ones((m, m), bool) if side is None else side[:, None] != side[None, :]
    open_ &= size_ok
    np.fill_diagonal(open_, False)
    answers, computed = np.zeros((m, m), np.int32), np.zeros(m, bool)
    read = 0

    def entries(tokens: np.ndarray) -> np.ndarray:
        count = times[tokens]
        total = int(count.sum())
        return lists[np.repeat(at[tokens], count) + np.arange(total) - np.repeat(np.cumsum(count) - count, count)]

    for s in range(m):
        left = open_[s] & (part != part[s]) & ~computed
        if computed.any() and left.any():  # distances to the sets worked on rule out more
            far = 1 - answers[computed] / (n[computed][:, None] + n[None, :] - answers[computed])
            left &= (np.abs(far - far[:, s : s + 1]) <= LINK + 1e-9).all(0)
        if not left.any():
            continue
        own = where[cut[s] : cut[s + 1]]
        row, best = None, -1
        if computed.any():
            gap = np.where(computed, n + n[s] - 2 * answers[:, s], np.iinfo(np.int64).max)
            best = int(gap.argmin())
            if gap[best] < n[s]:
                other = where[cut[best] : cut[best + 1]]
                more, less = entries(np.setdiff1d(own, other, assume_unique=True)), entries(np.setdiff1d(other, own, assume_unique=True))
                read += len(more) + len(less)
                row = answers[best] + np.bincount(more, minlength=m) - np.bincount(less, minlength=m)
        if row is None:
            all_ = entries(own)
            read += len(all_)
            row = np.bincount(all_, minlength=m)
        answers[s], computed[s] = row, True
        near = np.flatnonzero(left & (row >= needed(n[s], n)))
        if len(near):
            together = np.unique(np.r_[part[near], part[s]])
            part[np.isin(part, together)] = together[0]
    return part, read


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the known components of the sets of a group."""
    for batch in batches:
        a, b = [], []
        column = batch.column("sets")
        for k in range(batch.num_rows):
            rows = column[k].values
            values, cut, own = _sets_of(rows.field("text"), rows.field("member").to_numpy())
            if len(own) < 2:
                continue
            root, side = rows.field("root").to_numpy()[own], rows.field("side").to_numpy()[own]
            part, _ = linked_parts(values, cut, root, side if (side >= 0).all() else None)
            ok = part != root
            a.append(root[ok])
            b.append(part[ok])
        yield pa.RecordBatch.from_arrays([pa.array(flat(a, np.int64)), pa.array(flat(b, np.int64))], names=["a", "b"])


def _blocks(sized: DataFrame, *keys: str) -> DataFrame:
    """Blocks of bounded size that the members of each key are cut into. sized: keys, n."""
    return sized.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("sets"))


def _hashed(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("member"), blocks).cast("int")


def _salted(rows: DataFrame) -> DataFrame:
    """A lead's members are dealt to SALTS tasks, as one lead may have most of all."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int"))


def _merged(table: DataFrame) -> DataFrame:
    """A table that grows with the corpus, as a side of a join: it is never broadcast.

    The planner would go by the size of its files; ids that repeat or lie close take several times as much in the driver.
    """
    return table.hint("merge")


def _by_lead(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined with the row of their lead in a table.

    The table is repeated only for salts that the lead's rows have, and merged: the planner takes a repeated table for as
    small as it was before.
    """
    salted = _salted(rows)
    places = salted.select("lead", "salt").distinct().join(_merged(table), "lead")
    return salted.join(_merged(places), ["lead", "salt"]).drop("salt")


def groups(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """lead, member, long, n, doc_id: the sets to be compared with each lead (itself included); long: and with each other."""
    level = crowded(rows)
    postings = rows.select("text").mapInArrow(_postings(level), "token long, place long, set_id long").repartition("token").sortWithinPartitions("token", "place", "set_id")
    found = staged(postings.mapInArrow(_pairs_and_groups, "a long, b long, least long").groupBy("a", "b", "least").agg(F.count("*").alias("n")), "candidates")
    pairs = found.where("least > 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    # A set shares with another at most its tokens in long blocks and those it shares in short ones; without enough of them it leaves the groups.
    long = found.where("least = 0").select(F.col("a").alias("lead"), F.col("b").alias("member"), "n")
    short = pairs.select(F.explode(F.array("a", "b")).alias("member"), "n").groupBy("member").agg(F.max("n").alias("short"))
    most = long.groupBy("member").agg(F.sum("n").alias("long")).join(_merged(short), "member", "left").select("member", (F.col("long") + F.coalesce("short", F.lit(0))).alias("most"))
    smallest = F.ceil(F.col("n") * PERCENT / 100)
    ample = most.join(_merged(classes.select(F.col("set_id").alias("member"), "n")), "member").where(F.col("most") >= 1 + F.floor(smallest / EXTRA)).select("member")
    # The lead's own row comes with its list; a lead that isn't ample itself is still compared with.
    kept = long.select("lead", "member").join(_merged(ample), "member").select("lead", "member", F.lit(True).alias("long"))
    leads = kept.select("lead").distinct().select("lead", F.col("lead").alias("member"), F.lit(True).alias("long"))
    close = pairs.where("n >= least").select(F.col("a").alias("lead"), F.explode(F.array("a", "b")).alias("member"), F.lit(False).alias("long"))
    every = kept.unionByName(leads).unionByName(close).groupBy("lead", "member").agg(F.max("long").alias("long"))
    return staged(every.join(_merged(classes.select(F.col("set_id").alias("member"), "n", F.col("first_id").alias("doc_id"))), "member"), "groups")


def stars(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """lead, member, band, long of the members of each lead; of pairs only the linked ones (band 0)."""
    sizes = staged(few_files(_blocks(grouped, "lead").where("sets > 1"), grouped.count()), "blocks")
    placed = _by_lead(grouped, sizes).withColumn("block", F.explode(F.when(F.col("member") == F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_hashed(F.col("blocks"))))))
    blocks = rows.join(_merged(placed.select("lead", "block", "member", "long", "doc_id")), "doc_id").groupBy("lead", "block").agg(F.collect_list(F.struct("member", "long", "text")).alias("sets")).where(F.size("sets") > 1)
    return staged(blocks.select("lead", "sets").mapInArrow(_stars, "lead long, member long, band long, long boolean"), "stars")


def rest(rows: DataFrame, grouped: DataFrame, starred: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Links (a, b: roots) that the leads don't show. None: none can be left."""
    open_ = starred.where("long").select("lead", "member", "band")
    open_ = open_.unionByName(open_.select("lead").distinct().select("lead", F.col("lead").alias("member"), F.lit(0).cast("long").alias("band")))
    open_ = open_.join(_merged(roots.select(F.col("a").alias("member"), "root")), "member", "left").withColumn("root", F.coalesce("root", "member"))
    some = open_.groupBy("lead").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("band").alias("top")).where("top > 0 and x != y").select("lead")
    open_ = staged(_by_lead(open_, some).join(_merged(grouped.select("lead", "member", "n", "doc_id")), ["lead", "member"]), "open")
    if not open_.limit(1).count():
        return None
    sizes = _blocks(open_, "lead", "band").groupBy("lead").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    each = _by_lead(open_, sizes).withColumn("own", _hashed(F.element_at("blocks", F.col("band"))))
    near = []
    for step in (-1, 0, 1):
        low = F.least(F.col("band"), F.col("band") + step)
        count = F.element_at("blocks", F.col("band") + step)
        others = F.when((low < 0) | F.lit(step == 0) & (F.col("band") == 0) | count.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), count - 1))
        own, other = F.col("own"), F.col("x")
        i, j = {-1: (other, own), 0: (F.least(own, other), F.greatest(own, other)), 1: (own, other)}[step]
        side = {-1: F.lit(1), 0: F.when(own == other, -1).otherwise(F.when(own < other, 0).otherwise(1)), 1: F.lit(0)}[step]
        key = F.struct(low.alias("low"), F.greatest(F.col("band"), F.col("band") + step).alias("high"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
        near.append(each.select("lead", "member", "root", "doc_id", "own", "band", F.explode(others).alias("x")).select("lead", "member", "root", "doc_id", key.alias("key")))
    placed = near[0].unionByName(near[1]).unionByName(near[2]).select("lead", "key.low", "key.high", "key.i", "key.j", "key.side", "member", "root", "doc_id")
    met = rows.join(_merged(placed), "doc_id").groupBy("lead", "low", "high", "i", "j").agg(F.collect_list(F.struct("member", "root", "side", "text")).alias("sets")).where(F.size("sets") > 1)
    return met.select("sets").mapInArrow(_group_links, "a long, b long")


def roots_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """a, root: the component of each set that links to another but of its root. rows: doc_id, text; classes: set_id, n, first_id."""
    grouped = groups(rows, classes)
    starred = stars(rows, grouped)
    first = components(starred.where("band = 0").select(F.col("lead").alias("a"), F.col("member").alias("b")))
    left = rest(rows, grouped, starred, first)
    if left is None:
        return first
    second = components(left).select(F.col("a").alias("x"), F.col("root").alias("y"))
    moved = first.join(_merged(second), F.col("root") == F.col("x"), "left").select("a", F.coalesce("y", "root").alias("root"))
    alone = second.select(F.col("x").alias("a"), F.col("y").alias("root"))
    return moved.unionByName(alone.join(_merged(first.select("a")), "a", "left_anti"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_hash (xxhash64), n_shingles, set_id (equal sets share it), class_id (linked sets share it), component_id."""
    rows = texts(docs, id_col, text_col)
    members = staged(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_members, "doc_id long, text_hash long, n long, set_id long"), "members")
    rows, most = rows.where("doc_id is not null"), members.count()
    classes = staged(few_files(members.where("doc_id is not null and n > 0").groupBy("set_id").agg(F.max("n").alias("n"), F.min("doc_id").alias("first_id")), most), "classes")
    roots = roots_of(rows, classes).withColumnRenamed("a", "set_id")
    rooted = classes.join(_merged(roots), "set_id", "left").select("set_id", "first_id", F.coalesce("root", "set_id").alias("class_id"))
    least = staged(few_files(rooted.groupBy("class_id").agg(F.min("first_id").alias("component_id")), most), "least")
    named = staged(few_files(rooted.join(_merged(least), "class_id").select("set_id", "class_id", "component_id"), most), "named")
    full = F.col("n") > 0
    return members.join(_merged(named), "set_id", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "set_id", F.when(full, F.col("class_id")).alias("class_id"), F.when(F.col("doc_id").isNull(), F.lit(None)).when(full, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents whose component has one with a smaller id; of rows that repeat an id in a component, one stays.

    Rows without an id stay.
    """
    every = staged(join(docs, id_col, text_col).where("doc_id is not null"), "judged")
    most = every.count()
    found = every.where("n_shingles > 0")
    first = found.where("doc_id = component_id").groupBy("class_id").agg(F.min("text_hash").alias("text_hash"))
    second = found.where("doc_id = component_id").join(_merged(first.withColumnRenamed("text_hash", "kept_hash")), "class_id").where("text_hash != kept_hash")
    key = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")]
    gone = staged(few_files(found.where("doc_id != component_id").select(*key).unionByName(second.select(*key)).distinct(), most), "gone")
    again = staged(few_files(every.groupBy(*key).count().where("count > 1").select("__id", "__hash"), most), "again")
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__hash": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    # Texts are shuffled for deduplication only where a row is repeated.
    named = keyed.where("__id is not null").join(_merged(gone), ["__id", "__hash"], "left_anti")
    once = named.join(_merged(again), ["__id", "__hash"], "left_anti")
    repeated = named.join(_merged(again), ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
    return once.unionByName(repeated).unionByName(keyed.where("__id is null")).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: doc_id, n_shingles, component_id of all documents."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, md5_number_lower(array_to_string(w[s : s + {K - 1}], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {K - 2}, least(len(w), 1) + 1))) AS s FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.x = b.x AND a.doc_id != b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= {PERCENT} * (p.n + q.n - shared)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least_one AS (SELECT a AS doc_id, min(b) AS least FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least_one.least, doc_id)) AS component_id FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_one USING (doc_id)
"""
