"""Secret scans: rules, and character Markov models of random strings and ordinary identifiers.

Everything runs as built-in column functions. The rules give the base spans. Beside them, every run of at least
``LEAST`` characters of ``ALPHABET`` with a digit and a letter, outside the base spans, is scored: the sum over
its character pairs of log P(pair | random) - log P(pair | identifier), in thousandths. Runs from ``MARGIN`` on
are reported as kind ``random``.

Both models are trained here, from labelled samples: strings drawn evenly from the alphabets of keys, and
identifiers put together from words of programs in the usual styles.

Defined cases: a null text counts as empty and gives no span; a text of any length is worked on whole, in
linear time but for the spans found, whose offsets are summed in parts of ``PART``;
each row is worked on by itself, so repeated rows give equal rows and a null id stays null.
"""

from __future__ import annotations

import math
import random
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rules: kind, pattern, group whose length counts, least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (("assign", ASSIGN, 1, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24))
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST, MARGIN, PART = 20, 12_000, 256
_RUN = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"

_WORDS = (
    "get set make read write open close load save find sort list map index count size name value key item node user group file path line text word token page block table row column field type class "
    "object model view data info state status error message request response client server session config option param result query filter order start stop begin end next prev last first total "
    "number string buffer stream input output source target parent child default custom public private static const async update delete create insert select remove append merge split join parse "
    "format render handle process execute test check valid event listener service manager factory builder helper util common core base main local global temp cache memory thread task job worker "
    "image video audio width height color style font content header footer title description address email phone date time year month day hour minute second version release build debug trace level "
    "the and that with from this have will your which their about other there after should information document international management development language"
).split()


def identifiers(n: int = 6000, seed: int = 1) -> list[str]:
    """Labelled sample of ordinary identifiers."""
    draw, out = random.Random(seed), []
    for _ in range(n):
        words = [draw.choice(_WORDS) for _ in range(draw.randint(2, 5))]
        style = draw.randrange(6)
        text = [
            "_".join(words), "-".join(words), "".join(w.title() for w in words), words[0] + "".join(w.title() for w in words[1:]), "_".join(words).upper(), "/".join(words),
        ][style]
        tail = draw.choice(["", "", "", "1", "2", "01", "64", "2024", "v2", "_1", "-2023-10-05", "=true"])
        out.append(text + tail)
    return out


def random_strings(n: int = 6000, seed: int = 2) -> list[str]:
    """Labelled sample of random strings."""
    draw = random.Random(seed)
    kinds = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-")
    return ["".join(draw.choice(kinds[i % len(kinds)]) for _ in range(draw.randint(20, 44))) for i in range(n)]


def train(sample: list[str], smooth: float = 0.5) -> dict[tuple[str, str], float]:
    """Log probabilities of the next character."""
    counts = {(a, b): smooth for a in ALPHABET for b in ALPHABET}
    for text in sample:
        for pair in zip(text, text[1:], strict=False):
            counts[pair] += 1
    total = {a: sum(counts[a, b] for b in ALPHABET) for a in ALPHABET}
    return {(a, b): math.log(n / total[a]) for (a, b), n in counts.items()}


@cache
def ratios() -> tuple[int, ...]:
    """Log-likelihood ratio of each pair of characters of ALPHABET, in thousandths, row by row."""
    chance, plain = train(random_strings()), train(identifiers())
    return tuple(round(1000 * (chance[a, b] - plain[a, b])) for a in ALPHABET for b in ALPHABET)


def score(run: Column) -> Column:
    """Sum of the ratios of a run's character pairs."""
    table = F.split(F.lit(",".join(map(str, ratios()))), ",").cast("array<long>")
    n = len(ALPHABET)
    at = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    first = F.slice(at, F.lit(1), F.length(run) - 1)
    rest = F.slice(at, F.lit(2), F.length(run) - 1)
    return F.aggregate(F.zip_with(first, rest, lambda a, b: F.element_at(table, (a - 1) * n + b)), F.lit(0).cast("long"), lambda z, x: z + x)


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda z, x: z + x)


def _running(lengths: Column) -> Column:
    """Sums of all lengths before each, in parts, so that the work grows little faster than the matches."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PART).cast("int")), lambda k: F.slice(lengths, k * PART + 1, F.lit(PART)))
    empty = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("before"))
    grow = lambda z, x: F.struct((z["sum"] + x).alias("sum"), F.concat(z["before"], F.array(z["sum"])).alias("before"))
    bases = F.aggregate(F.transform(parts, _sum), empty, grow, lambda z: z["before"])
    inner = F.transform(parts, lambda p: F.aggregate(p, empty, grow, lambda z: z["before"]))
    return F.flatten(F.zip_with(bases, inner, lambda b, own: F.transform(own, lambda x: x + b)))


def matches(text: Column, pattern: str) -> Column:
    """All matches, leftmost first, without overlap: array of (start, end, whole), in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    lengths = F.transform(F.arrays_zip(between.alias("gap"), whole.alias("own")), lambda m: (F.length(m["gap"]) + F.length(m["own"])).cast("long"))
    ends = F.zip_with(_running(lengths), lengths, lambda b, x: b + x)
    return F.zip_with(ends, whole, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("whole")))


_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(kind: int, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the rules, by start, then kind."""
    out = []
    for k, (_, pattern, group, least) in enumerate(RULES):
        found = matches(text, pattern)
        if group:
            values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
            found = F.transform(F.filter(F.arrays_zip(found.alias("m"), values.alias("v")), lambda x: F.length(x["v"]) >= least), lambda x: x["m"])  # noqa: B023
        out.append(F.when(text.rlike(pattern), _spans(k, found)).otherwise(F.array().cast(_SPAN)))
    return F.array_sort(F.concat(*out))


def random_spans(text: Column, base: Column) -> Column:
    """Runs outside the base spans that are likelier random than identifiers."""
    looks = lambda m: m["whole"].rlike("[0-9]") & m["whole"].rlike("[A-Za-z]")
    free = lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    found = F.filter(matches(text, _RUN), lambda m: looks(m) & free(m))
    found = F.filter(found, lambda m: score(m["whole"]) >= MARGIN)
    return F.when(text.rlike(_RUN), _spans(len(RULES), found)).otherwise(F.array().cast(_SPAN))


def described(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", out: str = "__secrets") -> DataFrame:
    """All columns of docs and a struct: base, all (arrays of start, kind, end; kind by its place in KINDS)."""
    text, names = F.coalesce(F.col(text_col).cast("string"), F.lit("")), docs.columns
    step = docs.withColumn("__base", base_spans(text)).withColumn("__random", random_spans(text, F.col("__base")))
    return step.select(*names, F.struct(F.col("__base").alias("base"), F.array_sort(F.concat("__base", "__random")).alias("all")).alias(out))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs with every span, merged where they overlap, replaced by a mark."""
    text, names = F.coalesce(F.col(text_col).cast("string"), F.lit("")), docs.columns
    found = scan(docs, text_col)
    spans = F.col("__secrets.all")
    # Text between the spans; a span that starts before the last one's end gives nothing before it.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda z, s: F.struct(
        F.greatest(z["at"], s["end"]).alias("at"),
        F.when((s["start"] < z["at"]), z["parts"]).otherwise(F.concat(z["parts"], F.array(F.substring(text, (z["at"] + 1).cast("int"), (s["start"] - z["at"]).cast("int")), F.lit(mark)))).alias("parts"),
    )
    clean = F.aggregate(spans, start, step, lambda z: F.concat(F.array_join(z["parts"], ""), F.substring(text, (z["at"] + 1).cast("int"), F.length(text))))
    return found.select(*[F.when(F.size(spans) > 0, clean).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    """op7: doc_id, n_assign, n_access, n_hex, base_sha256, spans of all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.col("__secrets.base")
    n = [F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(len(RULES))]  # noqa: B023
    return found.select("doc_id", *n, F.sha2(described(base), 256).alias("base_sha256"), described(F.col("__secrets.all")).alias("spans"))


def _sql() -> str:
    n = len(ALPHABET)
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"

    def places(name: str, pattern: str) -> str:
        """Matches as rows: doc_id, i, whole, start, stop."""
        quoted = pattern.replace("'", "''")
        return f"""{name}_cut AS (SELECT doc_id, t, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS p FROM texts WHERE regexp_matches(t, '{quoted}')),
{name}_rows AS (SELECT doc_id, t, unnest(m) AS whole, unnest(p[1 : len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM {name}_cut),
{name} AS (SELECT doc_id, i, whole, (sum(len(gap) + len(whole)) OVER (PARTITION BY doc_id ORDER BY i) - len(whole))::BIGINT AS start, (sum(len(gap) + len(whole)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS stop FROM {name}_rows)"""

    assign = ASSIGN.replace("'", "''")
    joined = lambda rows: f"coalesce(string_agg(({kinds})[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind){rows}, '')"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{places("assign", ASSIGN)}, {places("access", RULES[1][1])}, {places("hexes", RULES[2][1])}, {places("runs", _RUN)},
base AS (SELECT doc_id, start, 0 AS kind, stop FROM assign WHERE len(regexp_extract(whole, '{assign}', 1)) >= {RULES[0][3]} UNION ALL SELECT doc_id, start, 1, stop FROM access UNION ALL SELECT doc_id, start, 2, stop FROM hexes),
weights AS (SELECT [{", ".join(map(str, ratios()))}] AS r),
free AS (SELECT * FROM runs WHERE regexp_matches(whole, '[0-9]') AND regexp_matches(whole, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = runs.doc_id AND b.start < runs.stop AND runs.start < b.stop)),
steps AS (SELECT doc_id, start, stop, whole, unnest(range(1, len(whole))) AS j FROM free),
scored AS (SELECT doc_id, start, stop, sum(r[(instr('{ALPHABET}', whole[j]) - 1) * {n} + instr('{ALPHABET}', whole[j + 1])]) AS score FROM steps, weights GROUP BY ALL),
every AS (SELECT * FROM base UNION ALL SELECT doc_id, start, {len(RULES)}, stop FROM scored WHERE score >= {MARGIN}),
told AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {joined(f" FILTER (kind < {len(RULES)})")} AS base, {joined("")} AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN told USING (doc_id)
"""


SQL = _sql()
