"""Sharding: vector bin packing of groups of equal texts by bytes, tokens and rows.

The law that holds is ``bytes``: shard sizes are near equal; tokens and rows are balanced along with them. What is packed
are groups of equal texts: each group of more than a ``SINGLE``-th of a shard in any measure is an item of its own, the
long tail of smaller ones goes by hash into ``BUCKETS`` items, so that the number of items is bounded; a group of more than
``WHOLE`` of a shard is cut into items of about a ``PART``-th of one each, by rows, as it can't stay together in equal
shards; every other group stays together. Items go, by decreasing size, to the shard where the dot product of their
sizes with the residual capacities is highest. Then items move, or change places, between the worst shard and others as
long as the weighted squares of all three measures' deviations become less.

Slots are counted by item, so no task ranks a whole shard.

Defined cases: a null text has no bytes, is an equal text to the empty one and has CRC 0; rows that repeat an id or
have none are placed each, and may be parted like any others where their text is a group too large for a shard; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm._shared import staged, texts

SHARDS, EXTRA_BYTES = 40, 16
BUCKETS, SINGLE, WHOLE, PART, MOVES = 8192, 128, 0.9, 16, 2000
MEASURES = ("bytes", "tokens", "rows")
#: What a measure's squared deviation counts for: bytes are the law.
WEIGHTS = np.array([25.0, 1.0, 1.0])
#: Pairs of items that a change of places is looked for among.
SWAPS = 40_000


def assign(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; items: one row of MEASURES each."""
    total = items.sum(0)
    capacity = np.maximum(total / shards, 1)
    demand = items / capacity
    residual = np.ones((shards, len(MEASURES)))
    shard = np.zeros(len(items), np.int64)
    for k in np.lexsort((np.arange(len(items)), -demand.max(1))):
        fits = (residual >= demand[k]).all(1)
        worth = residual @ demand[k]
        s = int(np.argmax(np.where(fits, worth, worth - 1e6)))
        shard[k] = s
        residual[s] -= demand[k]
    return _evened(demand, shard, shards)


def _gain(off_s: np.ndarray, off_t: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """By how much the weighted squares of two shards' deviations fall if a net demand moves from s to t."""
    return (WEIGHTS * (off_s**2 + off_t**2 - (off_s - moved) ** 2 - (off_t + moved) ** 2)).sum(-1)


def _evened(demand: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    load = np.zeros((shards, len(MEASURES)))
    np.add.at(load, shard, demand)
    off = load - 1  # deviations, in shards
    none = np.zeros((1, len(MEASURES)))
    for _ in range(MOVES):
        done = True
        for s in np.argsort(-(WEIGHTS * off**2).sum(1)).tolist():
            mine = np.flatnonzero(shard == s)
            best = (1e-12, 0, -1, -1)
            for t in np.argsort((WEIGHTS * off * off[s]).sum(1))[:6].tolist():  # those that deviate the other way
                if t == s:
                    continue
                theirs = np.flatnonzero(shard == t)
                out, back = np.concatenate([none, demand[mine]]), np.concatenate([none, demand[theirs]])
                if len(out) * len(back) <= SWAPS:
                    gain = _gain(off[s], off[t], out[:, None] - back[None])
                    i, j = divmod(int(gain.argmax()), len(back))
                else:  # items are many, so single moves are fine enough
                    gain = np.concatenate([_gain(off[s], off[t], out), _gain(off[s], off[t], -back)])
                    k = int(gain.argmax())
                    i, j = (k, 0) if k < len(out) else (0, k - len(out))
                if gain.max() > best[0]:
                    best = (float(gain.max()), t, int(mine[i - 1]) if i else -1, int(theirs[j - 1]) if j else -1)
            _, t, x, y = best
            if x >= 0 or y >= 0:
                for k, here, there in ((x, s, t), (y, t, s)):
                    if k >= 0:
                        shard[k] = there
                        off[here] -= demand[k]
                        off[there] += demand[k]
                done = False
                break
        if done:
            break
    return shard


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, n_tokens (words), text_crc32, shard, slot."""
    spark = docs.sparkSession
    raw = F.encode("text", "UTF-8")
    rows = texts(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("group"), (F.octet_length("text") + EXTRA_BYTES).cast("long").alias("size"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"), F.crc32(raw).alias("text_crc32")
    )
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    share = F.greatest(*[F.col(m) / max(total[m] or 0, 1) * shards for m in MEASURES])
    # Of groups that hold more than a SINGLE-th of a shard there are at most 3 * SINGLE * shards.
    heavy = rows.groupBy("group").agg(*sums).where(share > 1 / SINGLE).select("group", F.when(share > WHOLE, F.ceil(share * PART)).otherwise(1).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int")
    placed = rows.join(F.broadcast(heavy), "group", "left").withColumn("part", F.coalesce(part, F.lit(-1)))
    placed = placed.withColumn("item", F.when(F.col("parts").isNull(), F.pmod("group", F.lit(BUCKETS))).otherwise(F.col("group"))).drop("parts")
    found = placed.groupBy("item", "part").agg(*sums).orderBy("item", "part").collect()  # bounded by BUCKETS, SINGLE, PART and shards
    where = assign(np.array([[r[m] for m in MEASURES] for r in found], float).reshape(-1, len(MEASURES)), shards)
    base, table = [0] * shards, []
    for r, s in zip(found, where.tolist(), strict=True):
        table.append((r["item"], r["part"], s, base[s]))
        base[s] += r["rows"]
    table = spark.createDataFrame(table, "item long, part int, shard int, base long")
    # Rows of an item are numbered within the task that has read them, from where the tasks before end: no task holds an item.
    placed = placed.withColumn("task", F.shiftright("row", 33))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("item", "part").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("item", "part", "task").agg(F.count("*").alias("n")).select("item", "part", "task", ahead.alias("start"))
    own = F.row_number().over(Window.partitionBy("item", "part", "task").orderBy("row")) - 1
    numbered = placed.withColumn("own", own).join(starts, ["item", "part", "task"]).join(F.broadcast(table), ["item", "part"])
    return numbered.select("doc_id", "size", "n_tokens", "text_crc32", "shard", (F.col("base") + F.col("start") + F.col("own")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents, in 40 shards."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
