"""Who may register what, and where it goes: registration with its edges, vaults' documents as an edge table, error categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of edges that a registration may carry, by the column that lists their targets.
EDGES = {"supersedes": "SUPERSEDES", "amends": "AMENDS", "references": "REFERENCES"}

#: Status of a response by the category of its error; any other is 500.
CATEGORY_STATUS = {
    "validation": 400, "authentication": 401, "authorization": 403, "not_found": 404, "conflict": 409, "rate_limited": 429, "internal": 500, "dependency": 502, "timeout": 504,
}


def category_status(category: Column | str) -> Column:
    """The status of an error category; 200 where there is none."""
    c = F.col(category) if isinstance(category, str) else category
    out = F.when(c.isNull(), F.lit(200))
    for name, status in CATEGORY_STATUS.items():
        out = out.when(c == name, F.lit(status))
    return out.otherwise(F.lit(500))


def judged(requests: DataFrame, vaults: DataFrame, uploaders: DataFrame) -> DataFrame:
    """Adds error (null: accepted) to requests (user_id, vault_id, ...): the vault has to exist, then the user to be allowed to upload to it.

    vaults: vault_id; uploaders: user_id, vault_id of those that may upload (registry.authorised_vaults).
    """
    known = vaults.select("vault_id").distinct().withColumn("__known", F.lit(True))
    allowed = uploaders.select("user_id", "vault_id").distinct().withColumn("__allowed", F.lit(True))
    rows = requests.join(known, "vault_id", "left").join(allowed, ["user_id", "vault_id"], "left")
    error = F.when(F.col("__known").isNull(), "vault does not exist").when(F.col("__allowed").isNull(), "not authorized to create documents in the vault")
    return rows.withColumn("error", error).select(*requests.columns, "error")


def registered(accepted: DataFrame) -> DataFrame:
    """Documents of accepted requests (document_id, title, vault_id, checksum): active, as first version, waiting to be processed.

    n_same: how many registrations before or beside it have its content; that is told, not refused.
    """
    same = F.when(F.col("checksum").isNotNull(), F.count("*").over(Window.partitionBy("checksum")) - 1).otherwise(0)
    return accepted.select("document_id", "title", "vault_id", "checksum", F.lit("ACTIVE").alias("status"), F.lit("UPLOADED").alias("state"), F.lit(1).alias("version_number"), same.cast("long").alias("n_same"))


def registration_edges(accepted: DataFrame) -> DataFrame:
    """source_id, target_id, kind of the edges that accepted requests name, each once; kinds are separate edges."""
    parts = [accepted.select(F.col("document_id").alias("source_id"), F.explode(column).alias("target_id"), F.lit(kind).alias("kind")) for column, kind in EDGES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("target_id IS NOT NULL").distinct()


def vault_edges(events: DataFrame, vaults: DataFrame) -> DataFrame:
    """vault_id, document_id, assigned_seq: the documents of each vault after all events (seq, vault_id, document_id, action).

    ASSIGN of what is assigned already changes nothing, so the first one since the last UNASSIGN counts; an event of a vault that
    doesn't exist is an error and changes nothing. A document may be in several vaults. One shuffle by edge.
    """
    edge = Window.partitionBy("vault_id", "document_id")
    known = events.join(vaults.select("vault_id").distinct(), "vault_id", "left_semi")
    taken = known.withColumn("__gone", F.max(F.when(F.col("action") == "UNASSIGN", F.col("seq"))).over(edge))
    held = taken.where((F.col("action") == "ASSIGN") & (F.col("__gone").isNull() | (F.col("seq") > F.col("__gone"))))
    return held.groupBy("vault_id", "document_id").agg(F.min("seq").alias("assigned_seq"))


def vault_counts(edges: DataFrame, vaults: DataFrame) -> DataFrame:
    """Every vault with how many documents it has, 0 for none."""
    n = edges.groupBy("vault_id").agg(F.count("*").alias("document_count"))
    return vaults.select("vault_id").distinct().join(n, "vault_id", "left").na.fill(0, ["document_count"])
