"""Personal data: rules, and a skip-chain conditional random field that makes labels consistent in a document.

The rules give the base spans of four kinds. The field adds spans: its nodes are the tokens of a text that hold a
digit or ``@``, and those that equal the local part of an address found there; its labels are the kinds and none.

* Unary potentials: log-linear in features of the token's shape and of the word before it.
* Chain potentials between neighbouring nodes that only white space parts.
* Skip potentials between tokens of one key, however far apart: the digits of a number (its last ``TAIL``), or the
  lower-case local part of an address. Where a key has observed occurrences, every other one is tied to those next to it on
  either side, and so has their evidence at first hand; else to the one before it. The graph stays linear in the text.

Tokens of base spans are observed. Loopy message passing (sum-product, parallel, damped, ``ROUNDS`` rounds over
arrays) gives marginals; a token whose kind has at least ``SURE`` probability and which meets no base span is
reported with that kind. A token without digits, ``@`` or such a key has no feature for any kind and stays none: its
potentials are constant, so leaving it out changes no marginal. Only tokens that share a key with an observed one
are reported: the field carries evidence along, shape alone never suffices.

Weights are trained here by gradient ascent on the pseudo-likelihood of ``SAMPLE`` generated documents whose tokens
are labelled; the bound is the sample's size, as no row of a table is read for it.

Defined cases: a null text counts as empty; texts of any length are worked on whole, in time linear in the text;
each row is worked on by itself, so repeated rows give equal rows and a null id stays null.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm._text import pieces

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LABELS = NONE + 1
ROUNDS, DAMP, SURE, TAIL, SAMPLE = 12, 0.3, 0.5, 8, 400

#: Fixed patterns of the rules. A match of an address is found from its @, so that long runs without one cost nothing.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free = 0  # where the last match ended
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        found = _HOST.match(text, at + 1) if start < at else None
        if found:
            yield 0, start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the rules: leftmost, not overlapping within a kind; matches that fail a kind's test are dropped."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: A token without the punctuation around it, but with a plus sign before a number.
_CORE = re.compile(r"^[^\w+]*(.*?)[^\w]*$", re.S)
_SHAPES = (
    ("email", re.compile(r"\S+@\S+")),
    ("dotted", re.compile(r"\d{1,3}(\.\d{1,3}){3}")),
    ("plus", re.compile(r"\+\d[\d().-]*")),
    ("digits13", re.compile(r"\d{13,19}")),
    ("digits9", re.compile(r"\d{9,12}")),
    ("digits5", re.compile(r"\d{5,8}")),
    ("digits1", re.compile(r"\d{1,4}")),
    ("grouped9", re.compile(r"(?=(?:\D*\d){9,19}\D*\Z)\(?\d[\d().-]*\d\)?")),
    ("grouped", re.compile(r"\(?\d[\d().-]*\d\)?")),
    ("decimal", re.compile(r"\d+[.,:/]\d+")),
    ("word", re.compile(r"[^\W\d_]+([._-]?[^\W_]+)*")),
)
_CUES = {"mail": "cue_email", "email": "cue_email", "e-mail": "cue_email", "ip": "cue_ip", "host": "cue_ip", "server": "cue_ip", "card": "cue_card", "visa": "cue_card", "credit": "cue_card", "phone": "cue_phone", "tel": "cue_phone", "call": "cue_phone", "mobile": "cue_phone", "fax": "cue_phone"}
FEATURES = ("bias", *(s for s, _ in _SHAPES), "other", "cue_email", "cue_ip", "cue_card", "cue_phone")
_FEATURE = {f: i for i, f in enumerate(FEATURES)}


class Node:
    """A token: its span without outer punctuation, features, keys, and the label that a base span gives it (or -1)."""

    __slots__ = ("end", "features", "keys", "label", "start", "token_end", "token_start")

    def __init__(self, start: int, end: int, core: str, before: str, token: tuple[int, int]):
        self.start, self.end, self.label = start, end, -1
        self.token_start, self.token_end = token
        shape = next((s for s, p in _SHAPES if p.fullmatch(core)), "other")
        self.features = [0, _FEATURE[shape]]
        cue = _CUES.get(before)
        if cue:
            self.features.append(_FEATURE[cue])
        self.keys = keys(core)


def keys(core: str) -> list[str]:
    digits = "".join(c for c in core if c in "0123456789")
    out = []
    if len(digits) >= TAIL and len(digits) * 2 > len(core):
        out.append(digits[-TAIL:])
    if "@" in core:
        out.append(core.partition("@")[0].lower())
    elif "." in core or any(c.isdigit() for c in core):
        out.append(core.lower())
    return [k for k in out if len(k) > 3]


def nodes(text: str, base: list[Span]) -> list[Node]:
    locals_ = {text[a:e].partition("@")[0].lower() for k, a, e in base if k == 0}
    out: list[Node] = []
    before = ""
    spans = sorted((a, e, k) for k, a, e in base)
    at = 0
    for m in _TOKEN.finditer(text):
        token = m[0]
        if "@" in token or any(c in token for c in "0123456789") or (locals_ and token.lower().strip(".,;:!?()\"'") in locals_):
            core = _CORE.match(token)
            a, e = (m.start() + core.start(1), m.start() + core.end(1)) if core and core[1] else m.span()
            node = Node(a, e, text[a:e], before, m.span())
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            j = at
            while j < len(spans) and spans[j][0] < m.end() and spans[j][1] <= m.start():
                j += 1
            if j < len(spans) and spans[j][0] < m.end():
                x, y, node.label = spans[j]
                if y >= node.end and x <= node.start and node.label != 0:
                    own = {k for k in node.keys if len(k) == TAIL and k.isdecimal()}  # a span may run on into a number beside it
                    node.keys = sorted(own | set(keys(text[x:y])))
            out.append(node)
        before = token.lower().strip(".,;:!?()\"'")
    return out


def edges(found: list[Node], text: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes: neighbours, and each occurrence of a key with the observed ones next to it on either side, or with the last one where none is."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if not text[found[i].token_end : found[i + 1].token_start].strip()]
    skip, last, observed = set(), {}, {}
    sure = {k for node in found if node.label >= 0 for k in node.keys}
    for i, node in enumerate(found):
        known = sure.intersection(node.keys)
        skip |= {(j, i) for j in ((observed if known else last).get(k, i) for k in known or node.keys) if j != i}
        for k in node.keys:
            last[k] = i
            if node.label >= 0:
                observed[k] = i
    following = {}
    for i in reversed(range(len(found))):
        skip |= {(i, following[k]) for k in found[i].keys if k in following}
        if found[i].label >= 0:
            following |= dict.fromkeys(found[i].keys, i)
    return np.array(chain, np.int64).reshape(-1, 2), np.array(sorted(skip), np.int64).reshape(-1, 2)


def _unary(found: list[Node], weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(found), LABELS))
    for i, node in enumerate(found):
        out[i] = weights[node.features].sum(0)
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, chain_weight: np.ndarray, skip_weight: np.ndarray) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product."""
    edge = np.concatenate([chain, skip])
    potential = np.concatenate([np.repeat(chain_weight[None], len(chain), 0), np.repeat(skip_weight[None], len(skip), 0)])
    source, target = np.r_[edge[:, 0], edge[:, 1]], np.r_[edge[:, 1], edge[:, 0]]
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.r_[np.arange(len(edge), 2 * len(edge)), np.arange(len(edge))]
    message = np.zeros((len(source), LABELS))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = _logsum((belief[source] - message[back])[:, :, None] + potential, 1)
        out -= out.max(1, keepdims=True)
        message = DAMP * message + (1 - DAMP) * out
    belief = unary.copy()
    np.add.at(belief, target, message)
    belief -= belief.max(1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(1, keepdims=True)


# --- training -------------------------------------------------------------------------------------------------


def _digits(draw: random.Random, n: int) -> str:
    return "".join(draw.choice("0123456789") for _ in range(n))


def _card(draw: random.Random) -> str:
    head = "4" + _digits(draw, 14)
    return next(head + c for c in "0123456789" if luhn(head + c))


def samples(n: int = SAMPLE, seed: int = 7) -> list[list[tuple[str, int]]]:
    """Labelled documents: lists of (token, label). Facts recur in other forms; numbers that are none of them don't."""
    draw, out = random.Random(seed), []
    names = ["anna", "jonas", "li.wei", "maria", "omar", "petra", "sam", "yuki", "k.ito", "ines"]
    words = "the of and to with call mail card phone server at room page order on for figure total year version chapter".split()
    for _ in range(n):
        local = f"{draw.choice(names)}.{draw.randrange(10, 99)}"
        phone, card = "1" + _digits(draw, 10), _card(draw)
        ip = ".".join(str(draw.randrange(1, 255)) for _ in range(4))
        facts = [
            [(f"{local}@mail{draw.randrange(9)}.example.com", 0), (local, 0), (local.upper(), 0)],
            [(f"+{phone}", 3), (phone, 3), (f"{phone[:1]}-{phone[1:4]}-{phone[4:7]}-{phone[7:]}", 3)],
            [(card, 2), ("-".join(card[i : i + 4] for i in range(0, 16, 4)), 2)],
            [(ip, 1)],
        ]
        doc: list[tuple[str, int]] = []
        for fact in draw.sample(facts, draw.randrange(0, 4)):
            doc += [fact[0], *[draw.choice(fact) for _ in range(draw.randrange(0, 3))]]
        for _ in range(draw.randrange(4, 14)):
            other = [str(draw.randrange(2000)), _digits(draw, draw.randrange(5, 13)), f"{draw.randrange(99)}.{draw.randrange(99)}", f"v{draw.randrange(9)}.{draw.randrange(20)}", f"2.{draw.randrange(9)}.{draw.randrange(30)}", f"{_digits(draw, 4)}-{_digits(draw, 2)}-{_digits(draw, 2)}", f"{_digits(draw, 1)}-{_digits(draw, 2)}-{_digits(draw, 6)}-{_digits(draw, 1)}", f"a{draw.randrange(999)}"]
            number = draw.choice(other)
            doc += [(number, NONE)] * draw.choice([1, 1, 1, 2])
        draw.shuffle(doc)
        filled: list[tuple[str, int]] = []
        for token in doc:
            filled += [(draw.choice(words), NONE) for _ in range(draw.randrange(0, 3))] + [token]
        out.append(filled)
    return out


@cache
def weights() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary, chain and skip weights, by gradient ascent on the pseudo-likelihood of the labelled sample."""
    rows, label, chain, skip, size = [], [], [], [], 0
    for doc in samples():
        text = " ".join(t for t, _ in doc)
        kind_at, place = {}, 0
        for token, kind in doc:
            kind_at[place] = kind
            place += len(token) + 1
        found = nodes(text, base_spans(text))
        c, s = edges(found, text)
        chain.append(c + size)
        skip.append(s + size)
        for node in found:
            x = np.zeros(len(FEATURES))
            x[node.features] = 1
            rows.append(x)
            label.append(kind_at[node.token_start])
        size += len(found)
    x, y = np.array(rows), np.array(label)
    one = np.eye(LABELS)[y]
    pairs = [np.concatenate([e, e[:, ::-1]]) for e in (np.concatenate(chain), np.concatenate(skip))]
    around = []
    for e in pairs:
        a = np.zeros((len(y), LABELS))
        np.add.at(a, e[:, 1], one[e[:, 0]])
        around.append(a)
    unary, chained, skipped = np.zeros((len(FEATURES), LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    rate, decay = 4.0, 1e-3
    for _ in range(800):
        score = x @ unary + around[0] @ chained + around[1] @ skipped
        p = np.exp(score - _logsum(score, 1)[:, None])
        gap = (one - p) / len(y)
        unary += rate * (x.T @ gap - decay * unary)
        for w, a in ((chained, around[0]), (skipped, around[1])):
            g = a.T @ gap
            w += rate * ((g + g.T) / 2 - decay * w)
    return unary, chained, skipped


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that the field adds to the base spans of a text."""
    found = nodes(text, base)
    if not found:
        return []
    unary, chained, skipped = weights()
    chain, skip = edges(found, text)
    known = {k for n in found if n.label >= 0 for k in n.keys}
    tied = np.array([not known.isdisjoint(n.keys) for n in found])
    if not (tied & np.array([n.label < 0 for n in found])).any():  # shape alone never suffices
        return []
    score = _unary(found, unary)
    seen = np.array([n.label for n in found])
    score[seen >= 0] = -1e6  # firm, however many occurrences are tied to it
    score[np.flatnonzero(seen >= 0), seen[seen >= 0]] = 0.0
    p = marginals(score, chain, skip, chained, skipped)
    best = p[:, :NONE].argmax(1)
    out = []
    for i in np.flatnonzero((seen < 0) & tied & (p[np.arange(len(found)), best] >= SURE)):  # a token without a label meets no base span
        out.append((int(best[i]), found[i].start, found[i].end))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs and a struct __pii: base, all (arrays of kind, start, end in code points, by kind, then start)."""
    names = docs.columns

    def packed(spans: list[list[Span]]) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": e} for k, a, e in sorted(own)] for own in spans], pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            base, every = [], []
            for text in batch.column(text_col).to_pylist():
                own = base_spans(text or "")
                base.append(own)
                every.append(own + added_spans(text, own) if own else own)
            both = pa.StructArray.from_arrays([packed(base), packed(every)], ["base", "all"])
            yield pa.RecordBatch.from_arrays([*batch.columns, both], names=[*names, "__pii"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__pii", T.StructType([T.StructField("base", _SPANS), T.StructField("all", _SPANS)]))]))


def _described(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of all documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = [F.size(F.filter("__pii.base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(len(KINDS))]  # noqa: B023
    return found.select("doc_id", *n, F.sha2(_described(F.col("__pii.base")), 256).alias("base_sha256"), _described(F.col("__pii.all")).alias("spans"))
