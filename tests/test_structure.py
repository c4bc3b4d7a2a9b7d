"""Structure and chunks: a traced document, and greedy passes against plain loops."""

import random

from pyspark.sql import functions as F

from tesserae.operators import chunking, structure

LINES = [
    "Căn cứ Luật A;", "Theo đề nghị của B;", "Chương I", "QUY ĐỊNH CHUNG", "Điều 1. Phạm vi", "Nội dung một.", "Điều 2. Đối tượng", "1. Tổ chức;", "2. Cá nhân.",
    "Chương II", "QUY ĐỊNH CỤ THỂ", "Điều 3. Nguyên tắc", "a) Một;", "b) Hai;", "c) Ba.", "Phụ lục I", "DANH MỤC",
]


def tree(spark, lines=LINES):
    docs = spark.createDataFrame([(1, "\n".join(lines))], "document_id long, text string")
    return structure.references(structure.hierarchy(structure.sections(structure.classify(structure.lines(docs)))))


def test_traced_document(spark):
    rows = [r.asDict() for r in tree(spark).orderBy("ord").collect()]
    assert [r["type"] for r in rows] == ["PREAMBLE", "CHAPTER", "PREAMBLE", "ARTICLE", "ARTICLE", "CLAUSE", "CLAUSE", "CHAPTER", "ARTICLE", "POINT", "POINT", "POINT", "APPENDIX"]
    assert [r["parent"] for r in rows] == [0, 0, 0, 0, 0, 5, 5, 0, 0, 0, 0, 0, 0]
    by = {r["ord"]: r for r in rows}
    assert (by[4]["reference"], by[7]["reference"], by[10]["reference"], by[1]["reference"], by[2]["reference"], by[13]["reference"]) == ("Điều 1", "Điều 2 Khoản 2", "Điểm a", "Khoản", "Chương I", "Phụ lục")
    assert (by[1]["path"], by[3]["path"], by[7]["path"], by[8]["path"], by[10]["path"]) == ("1.1", "1.3", "1.2.2", "1.II", "1.a")
    assert by[1]["text"] == "Căn cứ Luật A;\nTheo đề nghị của B;" and by[4]["text"].endswith("Nội dung một.") and by[6]["text"] == "Tổ chức;"


def test_statistics_and_violations(spark):
    nodes = tree(spark).cache()
    s = structure.statistics(nodes).first()
    assert (s.n_nodes, s.max_depth, s.n_article, s.n_clause, s.n_appendix) == (14, 2, 3, 2, 1)
    found = {(r.ord, r.problem) for r in structure.violations(nodes).collect()}
    assert (4, "duplicate_path") in found and (9, "duplicate_path") in found and not any(p in ("orphan", "cycle") for _, p in found)


def test_hierarchy_against_a_stack(spark):
    """Random heading sequences against the rules stated as a loop."""
    draw = random.Random(5)
    heads = {"CHAPTER": "Chương I", "SECTION": "Mục 1", "ARTICLE": "Điều 1.", "APPENDIX": "Phụ lục I", "CLAUSE": "1. x", "POINT": "a) x"}
    docs, want = [], {}
    for d in range(150):
        kinds = [draw.choice(list(heads)) for _ in range(draw.randint(1, 14))]
        docs.append((d, "\n".join(heads[k] for k in kinds)))
        unit, clause, inner, section, parents = None, None, [], False, []
        for i, k in enumerate(kinds, 1):
            parent = 0
            if k in ("CHAPTER", "ARTICLE", "APPENDIX"):
                unit, clause, inner, section = (k, i), None, [], False
            elif k == "SECTION":
                parent = unit[1] if unit and unit[0] == "CHAPTER" and not inner else 0
                section, clause = True, None
            elif k == "CLAUSE":
                inner.append(k)
                parent = unit[1] if unit and unit[0] == "ARTICLE" and not section and inner[0] == "CLAUSE" else 0
                clause = i
            else:
                inner.append(k)
                parent = clause or 0
            parents.append(parent)
        want[d] = parents
    df = spark.createDataFrame(docs, "document_id long, text string")
    got = {}
    for r in structure.hierarchy(structure.sections(structure.classify(structure.lines(df)))).orderBy("document_id", "ord").collect():
        got.setdefault(r.document_id, []).append(r.parent)
    assert got == want


def test_split(spark):
    text = "a" * 30 + ". " + "b" * 30 + "\n\n" + "c" * 90 + " " + "d" * 10
    parts = chunking.split_text(text, 64)
    assert parts == ["a" * 30 + ". " + "b" * 30, "c" * 64, "c" * 26 + " " + "d" * 10]
    df = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None)], "id int, text string")
    rows = [(r.id, r.part, r.text) for r in chunking.split_oversized(df, "text", chunking.Chunking(most=16)).collect()]
    assert sorted(x for x in rows if x[0] == 1) == [(1, i, p) for i, p in enumerate(parts)] and (2, 0, "short") in rows
    assert all(len(p) <= 64 for p in parts)


def test_merge_takes_pairs(spark):
    rows = [(1, i, "PARAGRAPH", 10, f"1.{i}", f"t{i}", "") for i in range(1, 6)] + [(1, 6, "ARTICLE", 10, "1.6", "t6", "Điều 6")]
    df = spark.createDataFrame(rows, "document_id long, ord long, chunk_type string, tokens long, path string, text string, reference string")
    out = chunking.merge_small(df, chunking.Chunking(most=100, merge_below=20)).orderBy("ord").collect()
    assert [(r.ord, r.text, r.chunk_type) for r in out] == [(1, "t1\nt2", "COMPOSITE"), (3, "t3\nt4", "COMPOSITE"), (5, "t5\nt6", "COMPOSITE")]
    assert out[2].references == ["Điều 6"]


def test_chunks_hold_every_fitting_line(spark):
    out = chunking.chunks(tree(spark)).orderBy("ord").collect()
    assert len(out) == 1 and out[0].text.startswith("Document\nPreamble\nCăn cứ") and out[0].chunk_type == "COMPOSITE"
    small = chunking.chunks(tree(spark), chunking.Chunking(most=8, merge_below=0))
    assert small.agg(F.max("tokens")).first()[0] <= 8 and small.count() > 5
