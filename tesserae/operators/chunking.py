"""Structure-aware chunks: subtree sizes by prefix sums, the cut, the split of oversized leaves, the merge of small chunks."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import token_estimate
from tesserae.operators.structure import of_ancestor

#: Chunk types of node types; structural chunks don't start a merge.
CHUNK_TYPES = {"DOCUMENT": "COMPOSITE", "CHAPTER": "CHAPTER", "SECTION": "SECTION", "ARTICLE": "ARTICLE", "CLAUSE": "CLAUSE", "POINT": "POINT", "PREAMBLE": "PARAGRAPH", "PARAGRAPH": "PARAGRAPH", "APPENDIX": "APPENDIX", "TABLE": "COMPOSITE", "FIGURE": "COMPOSITE", "UNKNOWN": "PARAGRAPH"}
STRUCTURAL = ("ARTICLE", "CLAUSE", "POINT", "CHAPTER", "SECTION", "APPENDIX")


@dataclass(frozen=True)
class Chunking:
    most: int = 1024
    merge_below: int = 100


def with_root(nodes: DataFrame, title: str = "Document") -> DataFrame:
    """Nodes and, of each document, its root (ord 0)."""
    root = nodes.groupBy("document_id").agg(F.lit(0).alias("ord"), F.lit("DOCUMENT").alias("type"), F.lit(title).alias("title"), F.lit("").alias("text"), F.lit(-1).alias("parent"), F.lit(0).alias("depth"), F.lit("1").alias("path"), F.lit("").alias("reference"))
    return nodes.select(*root.columns).unionByName(root)


def own_text(title: str = "title", text: str = "text") -> Column:
    """A node's own lines: its title and, if another, its text."""
    t, x = F.col(title), F.col(text)
    return F.concat_ws("\n", F.when(t != "", t), F.when((x != "") & (~x.eqNullSafe(t)), x))


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """Adds last (ord of the subtree's end), n_chars and tokens of the subtree's text.

    Nodes are in preorder, so a subtree is the run up to the next node that isn't deeper; its length is a difference
    of running sums of own lengths and line counts.
    """
    doc = Window.partitionBy("document_id").orderBy("ord")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    own = own_text()
    rows = nodes.withColumns({"own": own, "filled": (own != "").cast("long")})
    rows = rows.withColumns({"chars": F.sum(F.length("own")).over(upto), "parts": F.sum("filled").over(upto)})
    # Depth is at most three: the next node of each smaller or equal depth, with the sums before it, by one window each.
    after = doc.rowsBetween(1, Window.unboundedFollowing)
    here = F.struct((F.col("ord") - 1).alias("last"), (F.col("chars") - F.length("own")).alias("chars"), (F.col("parts") - F.col("filled")).alias("parts"))
    end = F.last(F.struct(F.col("ord").alias("last"), "chars", "parts")).over(doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = F.lit(None)
    for d in range(4):
        following = F.when(F.col("depth") == d, F.first(F.when(F.col("depth") <= d, here), True).over(after)).otherwise(following)
    rows = rows.withColumn("to", F.coalesce(following, end))
    n_parts = F.col("to.parts") - F.col("parts") + F.col("filled")
    n_chars = F.col("to.chars") - F.col("chars") + F.length("own") + F.greatest(n_parts - 1, F.lit(0))
    sized = rows.withColumns({"n_chars": n_chars.cast("long"), "last": F.col("to.last")})
    tokens = F.when(F.col("n_chars") == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4))).cast("long")
    return sized.select(*nodes.columns, "own", "last", "n_chars", tokens.alias("tokens"))


def marked(sized: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Adds chosen and oversized: chunks are made of the nodes that fit while their parent doesn't, and of leaves that don't fit."""
    fits = F.col("tokens") <= config.most
    parent_fits = F.coalesce(of_ancestor(fits), F.lit(False))
    return sized.withColumns({"chosen": ~parent_fits & (fits | (F.col("last") == F.col("ord"))), "oversized": ~fits})


def cut(sized: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    return marked(sized, config).where("chosen").drop("chosen")


def cut_texts(sized: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """The chosen nodes with the text of their subtrees; a line belongs to at most one, the last that starts before it."""
    doc = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    head = [c for c in sized.columns if c not in ("document_id", "text", "own")]
    rows = marked(sized, config).withColumn("head", F.last(F.when(F.col("chosen"), F.struct(*head, "oversized")), True).over(doc)).where("head is not null and ord <= head.last")
    lines = F.array_sort(F.collect_list(F.when(F.col("own") != "", F.struct("ord", "own"))))
    text = F.array_join(F.transform(lines, lambda x: x["own"]), "\n")
    out = rows.groupBy("document_id", F.col("head.ord").alias("at")).agg(F.any_value("head").alias("head"), text.alias("text"))
    return out.select("document_id", "head.*", "text")


#: Boundaries in order of preference.
BOUNDARIES = ("\n\n", "\n", ". ", "; ", ", ", " ")
_PLACES = tuple((re.compile(f"(?={re.escape(b)})"), len(b), len(b.rstrip())) for b in BOUNDARIES)
_SOLID = re.compile(r"\S")


def part_spans(text: str, most_chars: int) -> Iterator[tuple[int, int]]:
    """Start and end of each part of a text: at most most_chars, cut at a boundary that starts in the part's second half.

    Places of all boundaries are listed once, by class; a cut is the last place of the first class that has one in reach,
    found by bisection, or else where the reach ends. White space around parts is left out.
    """
    places = [(array("q", (m.start() for m in pattern.finditer(text))), width, kept) for pattern, width, kept in _PLACES]
    stop = len(text.rstrip())
    found = _SOLID.search(text)
    while found:
        start = found.start()
        end = stop
        if stop - start > most_chars:
            reach = ((listed[k], kept) for listed, width, kept in places if (k := bisect_right(listed, start + most_chars - width) - 1) >= 0 and listed[k] >= start + most_chars // 2)
            at, kept = next(reach, (start + most_chars, 0))
            end = at + kept if at + kept > start else start + most_chars
        yield start, start + len(text[start:end].rstrip())
        found = _SOLID.search(text, end)


def split_text(text: str | None, most_chars: int) -> list[str]:
    return [text[a:b] for a, b in part_spans(text, most_chars)] if text else []


def split_oversized(df: DataFrame, text_col: str = "text", config: Chunking = Chunking()) -> DataFrame:
    """One row per part, with part (from 0): the cut is greedy, so it is the one step that needs Python, in Arrow batches."""
    most = max(1, config.most * 4)

    @F.pandas_udf("array<string>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: split_text(t, most))

    small = F.length(text_col) <= most
    found = F.when(small, F.array(F.col(text_col))).otherwise(parts(F.when(~small, F.col(text_col))))
    return df.select(*[c for c in df.columns if c != text_col], F.posexplode(found).alias("part", text_col))


def merge_small(chunks: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Adjacent chunks of one parent merged in pairs: a small one that isn't structural takes in the next.

    chunks: document_id, ord, chunk_type, tokens, path, text, reference. A left-to-right pass takes every second chance
    of a run of chances, so the parity of the place in its run decides.
    """
    doc = Window.partitionBy("document_id").orderBy("ord")
    prefix = F.regexp_replace("path", r"\.?[^.]*$", "")
    rows = chunks.withColumn("prefix", prefix)
    able = ~F.col("chunk_type").isin(*STRUCTURAL) & (F.col("tokens") < config.merge_below) & (F.lead("prefix").over(doc) == F.col("prefix")) & (F.col("tokens") + F.lead("tokens").over(doc) <= config.most)
    rows = rows.withColumns({"able": F.coalesce(able, F.lit(False)), "n": F.row_number().over(doc)})
    stop = F.max(F.when(~F.col("able"), F.col("n"))).over(doc.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("takes", F.col("able") & ((F.col("n") - F.coalesce(stop, F.lit(0)) - 1) % 2 == 0))
    taken = F.coalesce(F.lag("takes").over(doc), F.lit(False))
    after = {c: F.lead(c).over(doc) for c in ("tokens", "text", "reference", "ord")}
    rows = rows.withColumns({"taken": taken, **{f"next_{c}": v for c, v in after.items()}}).where("not taken")
    pick = lambda merged, own: F.when(F.col("takes"), merged).otherwise(own)
    refs = lambda *names: F.filter(F.array(*names), lambda r: F.coalesce(r, F.lit("")) != "")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.select(
        "document_id", "ord", pick(F.lit("COMPOSITE"), F.col("chunk_type")).alias("chunk_type"), pick(F.col("tokens") + F.col("next_tokens"), F.col("tokens")).alias("tokens"), "path",
        pick(F.concat_ws("\n", filled("text"), filled("next_text")), F.col("text")).alias("text"), pick(refs("reference", "next_reference"), refs("reference")).alias("references"), pick(F.array("ord", "next_ord"), F.array("ord")).alias("node_ords"),
    )


def chunk_type_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CHUNK_TYPES.items() for x in kv]), kind)


def chunks(nodes: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Nodes to chunks: cut, split, merged. nodes: as structure.references gives them."""
    sized = subtree_sizes(with_root(nodes))
    chosen = cut_texts(sized, config).withColumn("chunk_type", chunk_type_of(F.col("type")))
    parts = split_oversized(chosen, "text", config).withColumn("tokens", F.when(F.col("oversized"), token_estimate("text")).otherwise(F.col("tokens")))
    order = Window.partitionBy("document_id").orderBy("ord", "part")
    placed = parts.withColumn("place", F.row_number().over(order)).drop("ord").withColumnRenamed("place", "ord")
    return merge_small(placed.select("document_id", "ord", "chunk_type", "tokens", "path", "text", "reference"), config)
