"""Registry, access scopes, relationships, versions, readiness: latest-wins views over appended rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Permissions of each role.
ROLE_PERMISSIONS = {
    "VIEWER": ("READ",),
    "CONTRIBUTOR": ("READ", "UPLOAD", "UPDATE"),
    "MANAGER": ("READ", "UPLOAD", "UPDATE", "DELETE", "SHARE", "MANAGE"),
    "OWNER": ("READ", "UPLOAD", "UPDATE", "DELETE", "SHARE", "MANAGE"),
}


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key; order: columns, newest last."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__newest", newest).where("__newest = 1").drop("__newest")


def upsert(log: DataFrame, keys: list[str], at: str, created: str = "created_at") -> DataFrame:
    """Last write of each key, with the time of its first."""
    first = F.min(at).over(Window.partitionBy(*keys))
    return latest(log.withColumn(created, first), keys, at)


def filtered(documents: DataFrame, **conditions) -> DataFrame:
    """Rows that meet every condition that isn't None; a list means any of its values."""
    for name, value in conditions.items():
        if value is not None:
            documents = documents.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return documents


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows in order (which ends with a unique column), with the total and whether more follow."""
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset(offset).limit(limit)
    # total is one row.
    return cut.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def after(rows: DataFrame, order: list[tuple[str, bool]], last: dict, limit: int) -> DataFrame:
    """The page behind a row by its key: the next ``limit`` rows in order, none of those before being read in order again.

    order: (column, ascending), ending with a unique one; last: the values of the last row of the page before, {} for the first page.
    The bound on the first column reaches the scan; each task keeps ``limit`` rows. Nulls come first where ascending and last where not, as
    Spark orders them.
    """
    if last:
        keep = F.lit(False)
        for i, (name, up) in enumerate(order):
            here, value = F.col(name), last[name]
            if value is None:
                beyond = here.isNotNull() if up else F.lit(False)
            else:
                beyond = here > F.lit(value) if up else here.isNull() | (here < F.lit(value))
            tied = F.lit(True)
            for other, _ in order[:i]:
                tied = tied & F.col(other).eqNullSafe(F.lit(last[other]))
            keep = keep | (tied & beyond)
        name, up = order[0]
        bound = F.lit(True) if last[name] is None else F.col(name) >= F.lit(last[name]) if up else F.col(name).isNull() | (F.col(name) <= F.lit(last[name]))
        rows = rows.where(bound & keep)
    return rows.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order]).limit(limit)


def write_pages(rows: DataFrame, order: list[Column], path: str, ranges: int) -> None:
    """Writes rows in folders by ranges of their order, and how many each range has; order ends with a unique column."""
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    dealt.write.partitionBy("__range").parquet(f"{path}/rows")
    spark = rows.sparkSession
    spark.read.parquet(f"{path}/rows").groupBy("__range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/ranges")


def read_page(spark: SparkSession, path: str, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of what write_pages has written, with total and has_more: reads the ranges alone that the page lies in.

    The list of ranges (a row for each) is read by the driver; the rest is one scan of some folders and a sort of their rows.
    """
    counts = sorted((r["__range"], r["n"]) for r in spark.read.parquet(f"{path}/ranges").collect())
    total, start, skipped, wanted = sum(n for _, n in counts), 0, 0, []
    for k, n in counts:
        if start < offset + limit and start + n > offset:
            wanted.append(k)
        elif start + n <= offset:
            skipped += n
        start += n
    folders = [f"{path}/rows/__range={k}" for k in wanted or [k for k, _ in counts[:1]]]
    rows = (spark.read.option("basePath", f"{path}/rows").parquet(*folders) if folders else spark.read.parquet(f"{path}/rows")).drop("__range")
    if not wanted:
        rows = rows.limit(0)
    cut = rows.orderBy(*order).offset(offset - skipped if wanted else 0).limit(limit)
    return cut.withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(total > offset + limit)})


def first_options(rows: DataFrame, of: str, option: str, locale: str, limit: int) -> DataFrame:
    """of, option, rank: the first distinct options of each owner in the order of a locale; ties by code points.

    The rank's limit is applied in each task before the shuffle, so a hot owner's options don't meet in one.
    """
    distinct = rows.select(of, option).where(F.col(option).isNotNull()).distinct()
    order = Window.partitionBy(of).orderBy(F.collate(F.col(option), locale), F.col(option))
    return distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def role_permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in ROLE_PERMISSIONS.items() for p in ps], "role string, permission string")


def authorised_vaults(vaults: DataFrame, members: DataFrame, permission: str = "READ") -> DataFrame:
    """user_id, vault_id: active vaults that a user owns, or is a member of with a role that grants the permission."""
    spark = vaults.sparkSession
    active = vaults.where("status = 'ACTIVE'")
    grants = role_permissions(spark).where(F.col("permission") == permission).select("role")
    joined = members.join(F.broadcast(grants), "role", "left_semi").join(active.select("vault_id"), "vault_id", "left_semi").select("user_id", "vault_id")
    return active.select(F.col("owner").alias("user_id"), "vault_id").unionByName(joined).distinct()


def scope_status(requests: DataFrame, scopes: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds status to requests (request_id, user_id, vault_id or null, document_id or null)."""
    mine = scopes.withColumn("allowed", F.lit(True))
    docs = documents.select("document_id", F.col("vault_id").alias("document_vault"))
    rows = requests.join(docs, "document_id", "left").join(mine, ["user_id", "vault_id"], "left")
    rows = rows.join(mine.select("user_id", F.col("vault_id").alias("document_vault"), F.col("allowed").alias("document_allowed")), ["user_id", "document_vault"], "left")
    status = (
        F.when(F.col("vault_id").isNotNull() & F.col("allowed").isNull(), "VAULT_FORBIDDEN")
        .when(F.col("document_id").isNotNull() & F.col("document_vault").isNull(), "DOCUMENT_NOT_FOUND")
        .when(F.col("document_id").isNotNull() & F.col("document_allowed").isNull(), "DOCUMENT_FORBIDDEN")
        .when(F.col("document_id").isNotNull() & F.col("vault_id").isNotNull() & (F.col("document_vault") != F.col("vault_id")), "SCOPE_CONFLICT")
        .otherwise("OK")
    )
    return rows.select("request_id", "user_id", "vault_id", "document_id", status.alias("status"))


def relationships(edges: DataFrame) -> DataFrame:
    """document_id, other_id, kind: edges from either end, each once."""
    out = edges.select(F.col("source_id").alias("document_id"), F.col("target_id").alias("other_id"), "kind")
    back = edges.select(F.col("target_id").alias("document_id"), F.col("source_id").alias("other_id"), "kind")
    return out.unionByName(back).distinct()


def checksum_duplicates(files: DataFrame, content: str = "content") -> DataFrame:
    """checksum, n, first_id of contents that occur more than once."""
    out = files.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("checksum")).agg(F.count("*").alias("n"), F.min("document_id").alias("first_id"))
    return out.where("n > 1")


def supersede(versions: DataFrame) -> DataFrame:
    """Adds status: the highest version of a document is ACTIVE, the others SUPERSEDED; and the next number."""
    doc = Window.partitionBy("document_id")
    top = F.max("version_number").over(doc)
    return versions.withColumns({"status": F.when(F.col("version_number") == top, "ACTIVE").otherwise("SUPERSEDED"), "next_number": top + 1})


def merge_metadata(documents: DataFrame, patches: DataFrame) -> DataFrame:
    """documents (document_id, metadata map) with the patches' entries over theirs, later patches (by at) winning."""
    entries = patches.select("document_id", "at", F.explode("metadata").alias("key", "value"))
    last = latest(entries, ["document_id", "key"], "at").groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("patch"))
    kept = F.map_filter("metadata", lambda k, _: ~F.map_contains_key(F.coalesce("patch", F.create_map().cast("map<string,string>")), k))
    return documents.join(last, "document_id", "left").select("document_id", F.map_concat(kept, F.coalesce("patch", F.create_map().cast("map<string,string>"))).alias("metadata"))


def ready_problems(documents: DataFrame, sources: DataFrame, trees: DataFrame, chunks: DataFrame, embeddings: DataFrame, entries: DataFrame) -> DataFrame:
    """Problems that keep a document from being ready. Sides are counted by document before they are joined.

    sources, trees, chunks, embeddings, entries: document_id; embeddings also dimension.
    """
    count = lambda df, name: df.groupBy("document_id").agg(F.count("*").alias(name))
    dims = embeddings.groupBy("document_id").agg(F.count("*").alias("n_embeddings"), F.count_distinct("dimension").alias("n_dimensions"))
    rows = reduce(lambda a, b: a.join(b, "document_id", "left"), [count(sources, "n_sources"), count(trees, "n_trees"), count(chunks, "n_chunks"), dims, count(entries, "n_entries")], documents.select("document_id"))
    rows = rows.na.fill(0)
    problem = lambda test, name: F.when(test, F.lit(name))
    found = F.array(
        problem(F.col("n_sources") == 0, "no source"), problem(F.col("n_trees") == 0, "no tree"), problem(F.col("n_chunks") == 0, "no chunks"),
        problem(F.col("n_embeddings") != F.col("n_chunks"), "embeddings differ from chunks"), problem(F.col("n_entries") != F.col("n_embeddings"), "index differs from embeddings"), problem(F.col("n_dimensions") > 1, "mixed dimensions"),
    )
    return rows.withColumn("problems", F.array_compact(found)).select("document_id", "n_chunks", "n_embeddings", "n_entries", F.array_join("problems", "; ").alias("problems"), (F.size("problems") == 0).alias("ready"))


def index_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ACTIVE").alias("active"), F.count_distinct("model").alias("models"), F.count_distinct("dimension").alias("dimensions"))


def outdated(embeddings: DataFrame, model: str, version: str) -> DataFrame:
    return embeddings.where((F.col("status") == "ACTIVE") & ((F.col("model") != model) | (F.col("model_version") != version)))


def without(entries: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Index rows but for those of the given entries or documents."""
    return entries.join(gone.select(key).distinct(), key, "left_anti")
