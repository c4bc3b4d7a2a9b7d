"""Text expressions: tokens, query terms, document codes, sentences, claims. All built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query does without, and words that claim matching ignores.
QUERY_STOPWORDS = (
    "ai", "bằng", "các", "cách", "cho", "chứng", "có", "của",
    "định", "được", "gì", "hiểu", "không", "kho", "là", "một",
    "mẫu", "nào", "năm", "ngày", "này", "quy", "số", "theo",
    "thế", "tài", "liệu", "trong", "từ", "và", "về",
    "what", "when", "where", "which", "who", "the", "is", "are",
)
CLAIM_STOPWORDS = (
    "và", "của", "các", "có", "được", "cho", "trong", "với",
    "một", "những", "đến", "từ", "theo", "tại", "về", "hoặc",
    "không", "này", "đó", "là", "đã", "sẽ", "đang", "bị",
)

#: Patterns of legal references and dates, and keywords of claim types in order of test.
REFERENCE_TEST = r"Điều\s+\d+|Khoản\s+\d+|Điểm\s+[a-zđ]|Chương\s+\d+|Mục\s+\d+|Phụ\s+lục\s+\d+"
REFERENCES = (
    r"Điều\s+\d+(?:\s+Khoản\s+\d+(?:\s+Điểm\s+[a-zđ])?)?",
    r"Khoản\s+\d+(?:\s+Điểm\s+[a-zđ])?",
    r"Điểm\s+[a-zđ]",
    r"Chương\s+\d+",
    r"Mục\s+\d+",
    r"Phụ\s+lục\s+\d+",
)
DATE_TEST = r"\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}|ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}|tháng\s+\d{1,2}\s+năm\s+\d{4}|năm\s+\d{4}"
DATES = (r"\d{1,2}/\d{1,2}/\d{4}", r"ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}")
KEYWORDS = (
    ("DEFINITION", ("là", "được hiểu là", "được định nghĩa là", "nghĩa là", "được gọi là")),
    ("EXCEPTION", ("trừ", "ngoại lệ", "không áp dụng", "trừ trường hợp", "trừ khi")),
    ("THRESHOLD", ("từ", "đến", "trên", "dưới", "tối thiểu", "tối đa", "không quá", "không dưới", "vượt quá")),
    ("LEGAL_REQUIREMENT", ("phải", "cần", "bắt buộc", "yêu cầu", "có nghĩa vụ", "có trách nhiệm", "không được", "cấm")),
)
SENTENCE_START = "A-ZĐÁẢÃẠÀẦẨẪẬẤẮẰẲẴẶÉẺẼẸÈỀỂỄỆẾỒỔỖỘỐỜỞỠỢỚÚỦŨỤÙỪỬỮỰỨỊ"
INSUFFICIENT = (
    r"không (?:có|tìm thấy) (?:bất kỳ )?(?:thông tin|bằng chứng)(?: nào)? (?:về|đề cập|quy định|trong|từ)",
    r"không thể (?:xác định|xác minh|trả lời).{0,100}(?:bằng chứng|tài liệu)",
    r"(?:evidence|documents?).{0,80}(?:insufficient|do not contain)",
)
TOKEN = r"[\p{L}\p{N}_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space around: trim() alone keeps tabs and line ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Single spaces, none around."""
    return F.regexp_replace(strip(c), r"\s+", " ")


def tokens(c: Column | str) -> Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN), F.lit(0)))


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def query_terms(c: Column | str) -> Column:
    """Terms that a query is matched by, with two time paraphrases resolved."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    own = F.array_except(F.filter(tokens(c), lambda t: F.length(t) > 1), strings(QUERY_STOPWORDS))
    zone = F.when(text.contains("múi giờ"), F.array_union(F.array_except(own, strings(["múi", "giờ"])), strings(["gmt"]))).otherwise(own)
    return F.when(text.contains("ngày theo lịch"), F.array_union(zone, strings(["dương", "nghỉ", "lễ", "tết"]))).otherwise(zone)


def document_codes(c: Column | str) -> Column:
    """Tokens that look like document codes: digits with letters, or three digits and more."""
    return F.filter(tokens(c), lambda t: t.rlike(r"\p{N}") & (t.rlike(r"\p{L}") | t.rlike(r"^\p{N}{3,}$")))


def share(part: Column, whole: Column) -> Column:
    """|part of whole| / |whole|, 0 for an empty whole."""
    return F.when(F.size(whole) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.nullif(F.size(whole), F.lit(0)))


def token_estimate(c: Column | str) -> Column:
    """0 for an empty text, else a token per four characters, at least 1."""
    n = F.length(col(c))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def sentences(c: Column | str) -> Column:
    """Sentences: cut after . ! ? before a capital; where that cuts nothing, after any . ! ?"""
    text = F.coalesce(col(c), F.lit(""))
    first = F.split(text, rf"(?<=[.!?])\s+(?=[{SENTENCE_START}])")
    found = F.when(F.size(first) <= 1, F.split(text, r"(?<=[.!?])\s+")).otherwise(first)
    return F.filter(F.transform(found, strip), lambda s: s != "")


def claim_type(c: Column | str) -> Column:
    text, low = col(c), F.lower(col(c))
    out = F.when(text.rlike(REFERENCE_TEST), F.lit("LEGAL_REFERENCE"))
    for name, words in KEYWORDS:
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        out = out.when(test, F.lit(name))
    return out.when(text.rlike(DATE_TEST), F.lit("DATE")).otherwise(F.lit("STATEMENT_OF_FACT"))


def legal_references(c: Column | str) -> Column:
    """All references, pattern by pattern: a reference that two patterns match is there twice."""
    return F.concat(*[F.regexp_extract_all(col(c), F.lit(p), F.lit(0)) for p in REFERENCES])


def date_mentions(c: Column | str) -> Column:
    return F.concat(*[F.regexp_extract_all(col(c), F.lit(p), F.lit(0)) for p in DATES])


def mention_starts(c: Column | str, patterns: tuple[str, ...]) -> Column:
    """Where each of the patterns' matches starts (from 0), in the order of regexp_extract_all pattern by pattern.

    What lies between the matches and the matches themselves alternate, so their lengths add up to the places.
    """

    def starts(pattern: str) -> Column:
        between, found = F.split(col(c), pattern, -1), F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(steps, zero, lambda s, x: F.struct((s["at"] + x["b"] + x["m"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["b"])).alias("out")))["out"]

    return F.concat(*[starts(p) for p in patterns])


def match_score(claim: Column | str, evidence: Column | str) -> Column:
    """1 for equal texts, .9 and .8 for one in the other, else the share of the claim's words in the evidence."""
    a, b = F.lower(F.coalesce(col(claim), F.lit(""))), F.lower(F.coalesce(col(evidence), F.lit("")))
    words = lambda x: F.array_except(F.filter(F.array_distinct(F.split(collapse(x), " ")), lambda w: w != ""), strings(CLAIM_STOPWORDS))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when(F.contains(b, a), F.lit(0.9)).when(F.contains(a, b), F.lit(0.8)).otherwise(share(words(b), words(a)))


def usage(score: Column | str) -> Column:
    return F.when(col(score) >= 0.8, "DIRECT").when(col(score) >= 0.5, "SUPPORTING").otherwise("CONTEXT")


def reports_no_evidence(c: Column | str) -> Column:
    """Whether an answer's opening says that there is no evidence."""
    opening = F.substring(collapse(F.lower(col(c))), 1, 700)
    out = F.lit(False)
    for p in INSUFFICIENT:
        out = out | opening.rlike(p)
    return out


def normalised_tags(c: Column | str) -> Column:
    """Tags of a JSON array of strings or a comma- or line-separated list: single spaces, first spelling of each, at most 64 characters and 20 tags."""
    text = F.coalesce(col(c), F.lit(""))
    listed = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))
    parts = F.coalesce(F.filter(listed, lambda t: t.isNotNull()), F.split(F.regexp_replace(text, r"\n", ","), ","))
    raw = F.filter(F.transform(parts, collapse), lambda t: (t != "") & (F.length(t) <= 64))
    low = F.transform(raw, F.lower)
    kept = F.filter(F.transform(raw, lambda t, i: F.struct(t.alias("tag"), (F.array_position(low, F.lower(t)) == i + 1).alias("first"))), lambda x: x["first"])
    return F.slice(F.transform(kept, lambda x: x["tag"]), 1, 20)


def sanitised_filename(c: Column | str) -> Column:
    """A file name without unsafe characters; runs of dots, blanks and underscores become one underscore."""
    safe = F.regexp_replace(col(c), r'[/\\:*?"<>|\x00\x1f-]', "_")
    short = F.regexp_replace(F.regexp_replace(safe, r"[._\s]+", "_"), r"^[._\- ]+|[._\- ]+$", "")
    return F.when(short == "", F.lit("uploaded_file")).otherwise(short)
