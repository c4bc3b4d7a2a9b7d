"""Tables that change by small batches: a log in hash buckets, of which only those that have changed are merged.

A row is a write of (document_id, item) at seq, which doesn't fall from batch to batch; ``deleted`` makes it a tombstone, one without an
item for all items of the document. The view is the last write of each key after its last tombstone. All tables of a document are bucketed by its id alike, so a cascade
touches the same few buckets of each. Merged buckets keep no tombstones, as what comes later has a later seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.sources import snapshots

BUCKETS = 64
KEYS = ["bucket"]


def bucket(of: str = "document_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(buckets)).cast("int")


def appended(rows: DataFrame, root: str, buckets: int = BUCKETS) -> snapshots.Snapshot:
    """Adds a batch (document_id, item, seq, deleted, ...) to the log: one more run of the buckets that it has rows for."""
    return snapshots.publish(rows.withColumn("bucket", bucket(buckets=buckets)), root, KEYS, replace=False)


def view(log: DataFrame) -> DataFrame:
    """Last write of each (document_id, item) after the document's and the item's last tombstone; without seq's ties: of equal seq a tombstone wins."""
    item = Window.partitionBy("document_id", "item").orderBy(F.desc("seq"), F.desc("deleted"))
    document = Window.partitionBy("document_id")
    # Both windows share the shuffle by document: item's rows lie within it.
    rows = log.withColumn("__gone", F.max(F.when(F.col("deleted") & F.col("item").isNull(), F.col("seq"))).over(document)).withColumn("__nth", F.row_number().over(item))
    kept = rows.where((F.col("__nth") == 1) & ~F.col("deleted") & (F.col("__gone").isNull() | (F.col("seq") > F.col("__gone"))))
    return kept.drop("__gone", "__nth")


def current(spark: SparkSession, root: str, of: snapshots.Snapshot | None = None) -> DataFrame:
    """The view over all buckets, merged or not."""
    return view(snapshots.read(spark, root, of=of)).drop("bucket")


def compacted(spark: SparkSession, root: str) -> list[str]:
    """Merges the buckets that have more than one run: their parts. Other buckets are neither listed nor read.

    A bucket whose rows are all gone leaves the table. Readers of the snapshot before keep theirs.
    """
    base = snapshots.snapshot(spark, root)
    changed = sorted(p for p, runs in base.parts.items() if len(runs) > 1)
    if not changed:
        return []
    merged = view(snapshots.read(spark, root, parts=changed, of=base))
    run, parts = snapshots.write_run(merged, root, KEYS)
    kept = {p: runs for p, runs in base.parts.items() if p not in changed}
    snapshots.commit(spark, root, base, KEYS, base.schema, kept | {p: [run] for p in parts})
    return changed


def cascaded(gone: DataFrame, seq: int, roots: list[str], buckets: int = BUCKETS) -> None:
    """Tombstones for documents (document_id) in every table: each table's own columns stay null.

    The documents are staged once by the caller if they are dear to compute; each table gets one small run.
    """
    spark, of = gone.sparkSession, gone.select("document_id").distinct()
    for root in roots:
        schema = snapshots.snapshot(spark, root).schema
        filled = {"document_id": F.col("document_id"), "seq": F.lit(seq).cast("long"), "deleted": F.lit(True)}
        appended(of.select(*[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema if f.name != "bucket"]), root, buckets)
