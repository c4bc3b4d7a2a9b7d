"""Plain versions of the operators."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def jaccard(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    fold = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, text in rows:
        w = words((text or "").translate(fold))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return Counter((doc, len(sets[i]), None if doc is None else least[root(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def dedup(rows, k=50):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - k + 1):
            if doc is not None:
                key = " ".join(w[i : i + k])
                first[key] = min(doc, first.get(key, doc))
    out = Counter()
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if doc is not None and first[" ".join(w[i : i + k])] < doc:
                gone[i : i + k] = [True] * k
        out[doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())] += 1
    return out


def quality(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(three), set()
    for i, x in enumerate(three):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text):
    text, out = text or "", []
    tests = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) < 256 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    for kind, (pattern, good) in zip(("email", "ip", "card", "phone"), tests, strict=True):
        out.append([f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if good(m[0])])
    return out


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def mcd(groups, q):
    """Location and scatter of each group by the same starts and steps, over plain arrays; q: the module with its parameters."""
    import math

    import numpy as np

    ridge, fits = np.diag(np.square(q.FLOOR)), {}

    def median(v):
        return np.sort(v)[math.ceil(len(v) / 2) - 1]

    def moments(x):
        return x.mean(0), np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1])

    def step(x, mean, scatter):
        inverse = np.linalg.inv(scatter + ridge)
        d2 = np.maximum(np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean), 0)
        place = np.minimum(np.floor(np.log2(1 + d2) * 64), q.BINS - 1)
        mean, scatter = moments(x[place <= np.sort(place)[math.ceil(q.ALPHA * len(x)) - 1]])
        return mean, scatter * q.CONSISTENCY

    def size(fit):
        return np.linalg.slogdet(fit[1] + ridge)[1]

    for key, x in groups.items():
        cell = q._LOW + (np.clip(np.floor((x - q._LOW) / q._WIDTH), 0, q.BINS - 1) + 0.5) * q._WIDTH
        mean = np.array([median(c) for c in cell.T])
        robust = mean, np.diag(np.square([1.4826 * median(np.abs(c - m)) for c, m in zip(cell.T, mean, strict=True)]))
        near = (np.abs(x - mean) <= q.NEAR * np.sqrt(np.diag(robust[1] + ridge))).all(1)
        starts = [robust, moments(x), moments(x[near] if near.any() else x)]
        for _ in range(q.FIRST):
            starts = [step(x, *s) for s in starts]
        fits[key] = starts[int(np.argmin([round(size(s), 7) for s in starts]))]
    for _ in range(q.STEPS - q.FIRST):
        after = {k: step(groups[k], *f) for k, f in fits.items()}
        fall = max(size(fits[k]) - size(after[k]) for k in fits)
        fits = after
        if fall <= q.SETTLED:
            break
    return fits


def grouped(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
