"""Administrative folds and compositions: vaults, sources, searches by strategy, prompts, validation, reprocessing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import citation, retrieval
from tesserae.operators.registry import latest

STRATEGIES = ("KEYWORD", "SEMANTIC", "HYBRID")
#: Stages in order, with the table that each builds.
STAGES = (("ocr", "lines"), ("parse", "nodes"), ("embed", "embeddings"), ("index", "entries"))
SOURCE_BYTES = 25 << 20


def search(strategy: str, semantic: DataFrame, keyword: DataFrame, k: int = 10, with_ratio: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The first k of a ranked list, or of both fused; rows: query_id, entry_id, score, rank."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "HYBRID":
        return retrieval.fuse(semantic, keyword, with_ratio, k)
    return (semantic if strategy == "SEMANTIC" else keyword).where(F.col("rank") <= k).select("query_id", "entry_id", "score", "rank")


def evidence_prompt(evidence: DataFrame) -> DataFrame:
    """One prompt for each query: source, title, place and content of its evidence, parted by rules. evidence: query_id, rank, document_id, title, label, text.

    Without a title the document's id stands for it, without a label the source's number.
    """
    rank = F.col("rank").cast("string")
    title = F.coalesce("title", F.concat(F.lit("Document "), F.col("document_id").cast("string")))
    label = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("Source "), rank))
    part = F.concat(F.lit("[Nguồn "), rank, F.lit("]\nTài liệu: "), title, F.lit("\nVị trí: "), label, F.lit("\nNội dung:\n"), F.coalesce("text", F.lit("")))
    rows = evidence.select("query_id", "rank", part.alias("part")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("parts"))
    return rows.select("query_id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n---\n\n").alias("prompt"))


def validated(answers: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """Adds n_unsupported, status and limitation to answers (answer_id, status): a success with unsupported claims is partial."""
    open_claims = citation.unsupported(claims, links).groupBy("answer_id").agg(F.count("*").alias("n_unsupported"))
    rows = answers.join(open_claims, "answer_id", "left").withColumn("n_unsupported", F.coalesce("n_unsupported", F.lit(0)))
    status = F.when((F.col("status") == "SUCCESS") & (F.col("n_unsupported") > 0), "PARTIAL").otherwise(F.col("status"))
    limit = F.when(F.col("n_unsupported") > 0, F.concat(F.col("n_unsupported").cast("string"), F.lit(" claim(s) could not be supported by evidence.")))
    return rows.withColumns({"status": status, "limitation": limit})


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text_col: str = "text", out: str = "vector", batch: int = 64) -> DataFrame:
    """Adds vectors by a model that maps texts to vectors of one length, in batches; a null or empty text has none."""

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            found = pd.Series([None] * len(texts), dtype=object)
            known = [i for i, t in enumerate(texts) if t]
            for at in range(0, len(known), batch):
                part = known[at : at + batch]
                vectors = model([texts.iloc[i] for i in part])
                if len(vectors) != len(part) or len({len(v) for v in vectors}) > 1:
                    raise ValueError("the model must give one vector of one length for each text")
                for i, v in zip(part, vectors, strict=True):
                    found.iloc[i] = v
            yield found

    return rows.withColumn(out, run(F.col(text_col)))


def descendants(sized: DataFrame) -> DataFrame:
    """document_id, ord, descendant: all nodes below each, in preorder. sized: as chunking.subtree_sizes gives them."""
    return sized.where("last > ord").select("document_id", "ord", F.explode(F.sequence(F.col("ord") + 1, F.col("last"))).alias("descendant"))


def source_view(lines: DataFrame, contents: DataFrame) -> DataFrame:
    """Of each page its text, and the file as base64 (one line) if it isn't larger than SOURCE_BYTES. contents: document_id, content."""
    own = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    pages = lines.groupBy("document_id", "page_number").agg(F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("text"))
    files = contents.select("document_id", F.when(F.octet_length("content") <= SOURCE_BYTES, F.translate(F.base64("content"), "\r\n", "")).alias("content_base64"))
    return pages.join(files, "document_id", "left")


def decoded_upload(payloads: DataFrame, data: str = "data") -> DataFrame:
    """Adds content: base64 payloads, with or without a data-URL head."""
    return payloads.withColumn("content", F.unbase64(F.regexp_replace(data, r"^data:[^,]*,", "")))


def vault_states(events: DataFrame) -> DataFrame:
    """Last status and fields of each vault from its events (vault_id, seq, action, name); a repeated archive or restore is an error."""
    order = Window.partitionBy("vault_id").orderBy("seq")
    status = F.when(F.col("action") == "ARCHIVE", "ARCHIVED").when(F.col("action").isin("CREATE", "RESTORE"), "ACTIVE")
    rows = events.withColumn("status", F.last(status, True).over(order)).withColumn("before", F.lag("status").over(order))
    error = F.col("action").isin("ARCHIVE", "RESTORE") & F.col("before").eqNullSafe(F.col("status"))
    rows = rows.withColumns({"name": F.last("name", True).over(order), "n_errors": F.sum(error.cast("int")).over(order)})
    return latest(rows, ["vault_id"], "seq").select("vault_id", "status", "name", "n_errors")


def member_roles(events: DataFrame) -> DataFrame:
    """vault_id, user_id, role of who is a member after all events (vault_id, user_id, seq, action, role)."""
    return latest(events, ["vault_id", "user_id"], "seq").where("action != 'REMOVE'").select("vault_id", "user_id", "role")


def with_tag(rows: DataFrame, tag: str, tags: str = "tags") -> DataFrame:
    return rows.where(F.array_contains(tags, tag))


def member_of(vaults: DataFrame, user: str) -> DataFrame:
    """Vaults (owner, members map) that a user owns or is a member of, by whole ids."""
    return vaults.where((F.col("owner") == user) | F.map_contains_key("members", user))


def job_list(jobs: DataFrame, documents: DataFrame, states: DataFrame) -> DataFrame:
    """Jobs of known documents with a processing state."""
    return jobs.join(documents.select("document_id", "title"), "document_id").join(states.select("document_id", "state"), "document_id")


def upload_status(documents: DataFrame, states: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every document with its state and its last job's status, null where there is none."""
    last = jobs.groupBy("document_id").agg(F.max_by("last_status", F.struct("created_at", "job_id")).alias("last_status"))
    return documents.select("document_id").join(states.select("document_id", "state"), "document_id", "left").join(last, "document_id", "left")


def reprocessed(stage: str) -> list[str]:
    """Tables that are built anew when a stage is repeated: its own and those after it."""
    names = [s for s, _ in STAGES]
    return [t for _, t in STAGES[names.index(stage) :]]


def reprocess(stage: str, tables: dict[str, DataFrame], builders: dict[str, Callable[[DataFrame], DataFrame]], of: DataFrame) -> dict[str, DataFrame]:
    """The tables after a stage is repeated for some documents (document_id): their rows from that stage on are built anew.

    tables also has "files", which the first stage reads; builders map the rows of the table before to those of a table.
    """
    order = ["files", *[t for _, t in STAGES]]
    out, of = dict(tables), of.select("document_id").distinct()
    todo = reprocessed(stage)
    source = tables[order[order.index(todo[0]) - 1]].join(of, "document_id", "left_semi")
    for name in todo:
        source = builders[name](source)
        out[name] = tables[name].join(of, "document_id", "left_anti").unionByName(source)
    return out


#: Fixed answer where there is nothing to answer from.
NO_EVIDENCE = "Không tìm thấy thông tin phù hợp trong phạm vi tài liệu được chọn."


def generated(queries: DataFrame, prompts: DataFrame, fallback: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """query_id, content, status: a model's answer to each prompt; NO_EVIDENCE without a prompt, or where the model says so.

    Where the model fails or none is given, the template answer (fallback: query_id, content) stands in.
    """

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(prompt):
            try:
                return model(prompt) if prompt else None
            except Exception:  # a failing provider leaves the template answer
                return None

        for batch in series:
            yield batch.map(one)

    rows = queries.select("query_id").join(prompts.select("query_id", "prompt"), "query_id", "left").join(fallback.select("query_id", F.col("content").alias("template")), "query_id", "left")
    said = F.lit(None).cast("string") if model is None else run(F.col("prompt"))
    rows = rows.withColumn("said", said).withColumn("none", F.col("prompt").isNull() | F.coalesce(tx.reports_no_evidence(F.col("said")), F.lit(False)))
    content = F.when(F.col("none"), F.lit(NO_EVIDENCE)).otherwise(F.coalesce("said", "template"))
    return rows.select("query_id", content.alias("content"), F.when(F.col("none"), "NO_EVIDENCE").otherwise("SUCCESS").alias("status"))


def member_errors(events: DataFrame, vaults: DataFrame) -> DataFrame:
    """Member events (vault_id, user_id, seq, action, role) that are refused, with error; vaults: vault_id, owner.

    An owner can't be removed or changed; who is a member can't be added again; who isn't can't be removed or changed.
    """
    order = Window.partitionBy("vault_id", "user_id").orderBy("seq")
    rows = events.withColumn("before", F.lag("action").over(order)).join(vaults.select("vault_id", "owner"), "vault_id", "left")
    inside = F.coalesce(F.col("before") != "REMOVE", F.lit(False))
    owner = F.coalesce(F.col("user_id") == F.col("owner"), F.lit(False))
    error = (
        F.when(F.col("owner").isNull(), "unknown_vault")
        .when(owner & (F.col("action") != "ADD"), "owner_protected")
        .when((F.col("action") == "ADD") & (inside | owner), "already_member")
        .when((F.col("action") != "ADD") & ~inside, "not_a_member")
    )
    return rows.withColumn("error", error).where("error is not null").select("vault_id", "user_id", "seq", "action", "error")


def marked_stale(embeddings: DataFrame, stale: Column) -> DataFrame:
    return embeddings.withColumn("status", F.when(stale & (F.col("status") == "ACTIVE"), "STALE").otherwise(F.col("status")))


def with_document_status(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Index rows with their document's present status; rows of documents that are gone go too."""
    return entries.drop("document_status").join(documents.select("document_id", F.col("status").alias("document_status")), "document_id")


def flags_ready(plans: DataFrame, flags: list[str], needed: int | None = None) -> DataFrame:
    """Adds ready: all flags hold, or at least the needed number."""
    count = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags), F.lit(0))
    return plans.withColumn("ready", count >= (len(flags) if needed is None else needed))


def highlighted(text: Column | str, terms: list[str]) -> Column:
    """Text with the terms marked, case aside."""
    escaped = "|".join("\\Q" + t + "\\E" for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(tx.col(text), f"(?iu)({escaped})", "<mark>$1</mark>")


def acknowledged(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Adds acknowledged to alerts (alert_id)."""
    return alerts.join(acks.select("alert_id").distinct().withColumn("ack", F.lit(True)), "alert_id", "left").withColumn("acknowledged", F.coalesce("ack", F.lit(False))).drop("ack")
