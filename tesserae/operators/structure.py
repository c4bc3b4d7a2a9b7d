"""Document structure: lines, headings, sections, hierarchy, references, paths, statistics, violations.

The hierarchy is made by windows alone. Headings of type PREAMBLE, CHAPTER, ARTICLE and APPENDIX ("units") hang on
the root and open a group; the rest of a group finds its parent from what came before it in the group. A node is at
most three levels below the root, so walks to the root are bounded joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import col, strip

#: Heading patterns in order of test, with the label of their titles. Java folds Đ only with (?iu).
POINT_LETTERS = "a-zđáàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵ"
HEADINGS = (
    ("CHAPTER", r"(?iu)^Chương\s+([IVXLCDM\d]+)[\.\s:]*(.*)", "Chương"),
    ("SECTION", r"(?iu)^Mục\s+([IVXLCDM\d]+)[\.\s:]*(.*)", "Mục"),
    ("ARTICLE", r"(?iu)^Điều\s+(\d+)[\.\s:]*(.*)", "Điều"),
    ("APPENDIX", r"(?iu)^Phụ\s*lục\s+([IVXLCDM\dA-Z]+)[\.\s:]*(.*)", "Phụ lục"),
    ("CLAUSE", r"^(\d+)[\.\)]\s+(.*)", "Khoản"),
    ("POINT", rf"(?iu)^([{POINT_LETTERS}]+)[\.\)]\s+(.*)", "Điểm"),
)
LABELS = {"CHAPTER": "Chương", "SECTION": "Mục", "ARTICLE": "Điều", "CLAUSE": "Khoản", "POINT": "Điểm", "APPENDIX": "Phụ lục", "PREAMBLE": "Khoản"}
UNITS = ("PREAMBLE", "CHAPTER", "ARTICLE", "APPENDIX")
NUMBER_FIRST = r"^([\dIVXLCDM]+|[a-zđ])\s*[\.\)\s]"
NUMBER_NAMED = r"(?iu)^(?:Điều|Chương|Mục|Khoản|Điểm|Article|Chapter|Section|Clause|Point)\s+([\dIVXLCDM]+|[a-z])"


def lines(docs: DataFrame, page_lines: int = 20) -> DataFrame:
    """document_id, page_number, line_no (from 1, blanks counted), text (stripped): the lines that aren't blank."""
    out = docs.select("document_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "raw"))
    return out.select("document_id", (F.floor(F.col("at") / page_lines) + 1).cast("int").alias("page_number"), (F.col("at") + 1).cast("int").alias("line_no"), strip("raw").alias("text")).where("text != ''")


def classify(rows: DataFrame) -> DataFrame:
    """Adds type (null for plain text), number, title, body to lines; clauses and points lose their marker."""
    text = F.col("text")
    kind = number = title = body = None
    for name, pattern, label in HEADINGS:
        hit, n, rest = text.rlike(pattern), F.regexp_extract(text, pattern, 1), strip(F.regexp_extract(text, pattern, 2))
        own_title = F.concat(F.lit(label + " "), n)
        inline = name in ("CLAUSE", "POINT")
        full = own_title if inline else F.when(rest == "", own_title).otherwise(rest)
        values = (F.lit(name), n, full, rest if inline else text)
        kind, number, title, body = (F.when(hit, v) if c is None else c.when(hit, v) for c, v in zip((kind, number, title, body), values, strict=True))
    return rows.withColumns({"type": kind, "number": number, "title": title, "body": body})


def sections(classified: DataFrame) -> DataFrame:
    """document_id, ord, type, number, title, text, page_start, page_end, line_start, line_end: headings with their following text, and preambles.

    Plain text before the first article gathers until a chapter, article or appendix (or the end) turns it into a
    preamble, which stands right before that heading; later plain text belongs to the heading before it. A heading
    starts and ends on its own line; a preamble ends on the page of the heading that ends it, on the line before it.
    """
    doc = Window.partitionBy("document_id").orderBy("line_no")
    before, after = doc.rowsBetween(Window.unboundedPreceding, -1), doc.rowsBetween(1, Window.unboundedFollowing)
    flush = F.when(F.col("type").isin("CHAPTER", "ARTICLE", "APPENDIX"), F.struct("line_no", "page_number"))
    whole = doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = classified.withColumns(
        {
            "seen_article": F.coalesce(F.max(F.col("type").eqNullSafe(F.lit("ARTICLE"))).over(before), F.lit(False)),
            "last_heading": F.last(F.when(F.col("type").isNotNull(), F.col("line_no")), ignorenulls=True).over(before),
            "ended_by": F.min(flush).over(after),
            "end": F.last(F.struct("line_no", "page_number")).over(whole),
        }
    )
    plain = F.col("type").isNull()
    lead = plain & ~F.col("seen_article")
    at = F.when(lead, F.coalesce("ended_by.line_no", F.lit(2**31 - 1))).when(plain, F.col("last_heading")).otherwise(F.col("line_no"))
    # A preamble sorts right before the heading that ends it.
    placed = marked.withColumns({"at": at, "part": F.when(lead, F.lit(0)).otherwise(F.lit(1)), "line": F.coalesce("body", "text")})
    placed = placed.withColumns({"page_end": F.when(lead, F.coalesce("ended_by.page_number", "end.page_number")), "line_end": F.when(lead, F.coalesce(F.col("ended_by.line_no") - 1, "end.line_no"))})
    own = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    found = placed.groupBy("document_id", "at", "part").agg(
        F.max("type").alias("type"), F.max("number").alias("number"), F.max("title").alias("title"), F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("text"), F.min("page_number").alias("page_start"), F.min("line_no").alias("line_start"), F.max("page_end").alias("page_end"), F.max("line_end").alias("line_end")
    )
    order = Window.partitionBy("document_id").orderBy("at", "part")
    return found.select(
        "document_id", F.row_number().over(order).cast("long").alias("ord"), F.coalesce("type", F.lit("PREAMBLE")).alias("type"), "number", F.coalesce("title", F.lit("Preamble")).alias("title"), strip("text").alias("text"), "page_start", F.coalesce("page_end", "page_start").alias("page_end"), "line_start", F.coalesce("line_end", "line_start").alias("line_end")
    )


def hierarchy(found: DataFrame) -> DataFrame:
    """Adds parent (ord; 0 is the root), depth (root: 0), sibling (from 0) to sections."""
    doc = Window.partitionBy("document_id").orderBy("ord")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    unit = F.col("type").isin(*UNITS)
    rows = found.withColumns({"grp": F.sum(unit.cast("int")).over(upto), "u_type": F.last(F.when(unit, F.col("type")), True).over(upto), "u_ord": F.last(F.when(unit, F.col("ord")), True).over(upto)})
    grp = Window.partitionBy("document_id", "grp").orderBy("ord")
    earlier = grp.rowsBetween(Window.unboundedPreceding, -1)
    inner = F.col("type").isin("CLAUSE", "POINT")
    rows = rows.withColumns(
        {
            "inner_before": F.coalesce(F.max(inner).over(earlier), F.lit(False)),
            "section_before": F.coalesce(F.max(F.col("type") == "SECTION").over(earlier), F.lit(False)),
            "first_inner": F.first(F.when(inner, F.col("type")), True).over(grp.rowsBetween(Window.unboundedPreceding, 0)),
            "n_sections": F.sum((F.col("type") == "SECTION").cast("int")).over(grp.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    run = Window.partitionBy("document_id", "grp", "n_sections").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    on_unit = (
        F.when(F.col("type") == "SECTION", (F.col("u_type") == "CHAPTER") & ~F.col("inner_before"))
        .when(F.col("type") == "CLAUSE", (F.col("u_type") == "ARTICLE") & ~F.col("section_before") & (F.col("first_inner") == "CLAUSE"))
        .otherwise(F.lit(False))
    )
    rows = rows.withColumn("on_unit", F.coalesce(on_unit, F.lit(False)))
    level = F.when(F.col("on_unit"), F.lit(2)).otherwise(F.lit(1))
    rows = rows.withColumn("above", F.last(F.when(F.col("type") == "CLAUSE", F.struct("ord", level.alias("depth"))), True).over(run))
    point = F.col("type") == "POINT"
    parent = F.when(F.col("on_unit"), F.col("u_ord")).when(point, F.coalesce(F.col("above.ord"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    depth = F.when(point, F.coalesce(F.col("above.depth"), F.lit(0)) + 1).otherwise(level)
    rows = rows.select(*found.columns, parent.alias("parent"), depth.alias("depth"))
    sibling = F.row_number().over(Window.partitionBy("document_id", "parent").orderBy("ord")) - 1
    return rows.select(*found.columns, "parent", sibling.alias("sibling"), "depth")


def of_ancestor(value: Column, up: int = 1, deepest: int = 3) -> Column:
    """A value of the ancestor so many levels up, as a window over nodes in preorder: the last node before that is so much less deep.

    Null where there is no such ancestor below the root's own row.
    """
    before = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    out = F.lit(None)
    for d in range(deepest + 1 - up):
        out = F.when(F.col("depth") == d + up, F.last(F.when(F.col("depth") == d, value), True).over(before)).otherwise(out)
    return out


def number_of(title: Column | str, text: Column | str) -> Column:
    """The number or letter that a title, else a text, starts with or names first."""
    tries = [F.nullif(F.regexp_extract(F.coalesce(col(f), F.lit("")), p, 1), F.lit("")) for f in (title, text) for p in (NUMBER_FIRST, NUMBER_NAMED)]
    return F.coalesce(*tries)


def label_of(kind: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), col(kind))


def references(nodes: DataFrame) -> DataFrame:
    """Adds reference (from the root: labels with numbers) and path (numbers, else places; the root gives 1) to nodes.

    Nodes may bring number_of their title and text as own_number: who doesn't ask for texts then sorts none.
    """
    n = F.col("own_number") if "own_number" in nodes.columns else number_of("title", "text")
    own = nodes.withColumn("own_reference", F.concat_ws(" ", label_of("type"), n)).withColumn("own_step", F.coalesce(n, (F.col("sibling") + 1).cast("string")))
    upper = {f"{c}{up}": of_ancestor(F.col(f"own_{name}"), up) for up in (1, 2) for c, name in (("r", "reference"), ("s", "step"))}
    walked = own.withColumns(upper)
    return walked.select(*nodes.columns, F.concat_ws(" ", "r2", "r1", "own_reference").alias("reference"), F.concat_ws(".", F.lit("1"), "s2", "s1", "own_step").alias("path"), F.when(label_of("type").isNull(), F.coalesce("title", F.lit(""))).otherwise(F.col("own_reference")).alias("short_reference"))


def statistics(nodes: DataFrame) -> DataFrame:
    """Of each tree: nodes (with the root), depth, articles, clauses, appendices, last page."""
    count = lambda t: F.count_if(F.col("type") == t).alias(f"n_{t.lower()}")
    return nodes.groupBy("document_id").agg((F.count("*") + 1).alias("n_nodes"), F.max("depth").alias("max_depth"), count("ARTICLE"), count("CLAUSE"), count("APPENDIX"), F.greatest(F.lit(1), F.max("page_end")).alias("last_page"))


def violations(nodes: DataFrame) -> DataFrame:
    """document_id, ord, problem, severity. nodes: document_id, ord, parent, sibling, reference, path, and optionally children (ords).

    Ord 0 is the root that every tree has; a row with a null or negative parent is a root beside it, unless it is ord 0
    itself. All but orphans and children are told by windows over one pass of the nodes.
    """
    doc = lambda *keys: Window.partitionBy("document_id", *keys).orderBy("ord")
    copy = {c: F.row_number().over(doc(c)) for c in ("reference", "path")}
    rows = nodes.withColumns({"n_reference": copy["reference"], "n_path": copy["path"], "n_id": F.row_number().over(doc("ord")), "previous": F.lag("sibling").over(doc("parent"))})
    told = lambda test, problem, severity: F.when(test, F.struct(F.lit(problem).alias("problem"), F.lit(severity).alias("severity")))
    found = F.array_compact(
        F.array(
            told(F.col("parent") >= F.col("ord"), "cycle", "error"),
            told((F.coalesce("parent", F.lit(-1)) < 0) & (F.col("ord") != 0), "second_root", "error"),
            told(F.col("n_id") == 2, "duplicate_id", "error"),
            told((F.col("n_reference") > 1) & (F.col("reference") != ""), "duplicate_reference", "warning"),
            told((F.col("n_path") > 1) & (F.col("path") != ""), "duplicate_path", "warning"),
            told(F.col("previous") >= F.col("sibling"), "order", "warning"),
        )
    )
    known = nodes.select("document_id", F.col("ord").alias("parent"))
    orphans = nodes.where("parent > 0").join(known, ["document_id", "parent"], "left_anti").select("document_id", "ord", F.lit("orphan").alias("problem"), F.lit("error").alias("severity"))
    out = rows.select("document_id", "ord", F.explode(found).alias("p")).select("document_id", "ord", "p.*").unionByName(orphans)
    if "children" not in nodes.columns:
        return out
    listed = nodes.select("document_id", "ord", F.explode("children").alias("child"))
    kept = listed.join(nodes.select("document_id", F.col("ord").alias("child"), F.col("parent").alias("its_parent"), F.lit(True).alias("known")), ["document_id", "child"], "left")
    problem = F.when(F.col("known").isNull(), "missing_child").when(~F.col("its_parent").eqNullSafe(F.col("ord")), "child_of_another")
    return out.unionByName(kept.select("document_id", "ord", problem.alias("problem"), F.lit("error").alias("severity")).where("problem is not null"))


def node_by_path(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path") == path)
