"""Small tables and plain-Python versions of the operators."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n)]


def documents(seed=3, n=60):
    """Texts with exact and near copies, nulls, empty and blank texts and repeated rows."""
    rng, texts = random.Random(seed), []
    for _ in range(n):
        texts.append(" ".join(words(rng, rng.randint(3, 120))))
    base = words(rng, 150)
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
        texts.append(" ".join(w))
    texts += [texts[0]] * 7 + [texts[1].upper(), None, "", " \n\t", "one two", "one two", "one"]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, "no id here", "en", None, None), rows[5]]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(rows, percent=85):
    """doc_id -> smallest doc_id reachable, by all pairs."""
    rows = [(d, shingles(t)) for d, t, *_ in rows if d is not None]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d in parent}


def repeated_words(w, width=8):
    seen = Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    marked = set()
    for i in range(len(w) - width + 1):
        if seen[tuple(w[i : i + width])] > 1:
            marked.update(range(i, i + width))
    return len(marked)


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def template(text):
    """(words without case and punctuation, template words) of a text."""
    raw = [w for w in WORD.findall(re.sub(r"[\x01-\x08\x0E-\x1F]", "", text or "")) if any(c.isalnum() for c in w)]
    names = re.compile(r"[A-Z][\w'’-]*")
    canon = []
    for i, w in enumerate(raw):
        if i and (raw[i - 1][-1].isalnum() or raw[i - 1][-1] in ",;") and (m := names.match(w)):
            w = "\x02" + w[m.end() :]
        w = re.sub(r"(?<![^\W_])[0-9]+(?:[.,:/-][0-9]+)*", "\x01", w)
        if i and canon[i - 1].endswith("\x01") or "\x01" in w:
            w = re.sub(r"^(\x01?)(km|m|s|l|h|g)(?![^\W_])", "\\1\x03", w, flags=re.I)
        canon.append(w)
    strip = lambda w, keep: "".join(c for c in w.lower() if c.isalnum() or c in keep)
    return [strip(w, "") for w in raw], [strip(w, "\x01\x02\x03") for w in canon]


def leak(text, item, window=8, literal=4, min_words=12, shortest=3):
    """(first word, words) of the best passage of an item in a text, by every shift."""
    (dw, dc), (iw, ic) = template(text), template(item)
    if len(iw) < shortest:
        return None
    n, slot = min(window, len(iw)), lambda c: any(x in c for x in "\x01\x02\x03")
    best = None
    for shift in range(-len(iw), len(dw)):
        hits = []
        for i in range(len(iw) - n + 1):
            if i + shift < 0 or i + shift + n > len(dw):
                continue
            plain = sum(not slot(c) for c in ic[i : i + n])
            a, b = slice(i, i + n), slice(i + shift, i + shift + n)
            if iw[a] == dw[b] or (ic[a] == dc[b] and plain >= min(literal, -(-n // 2))):
                hits.append(i)
        if not hits:
            continue
        span = [k for k in range(hits[0], hits[-1] + n) if iw[k] == dw[k + shift] or ic[k] == dc[k + shift]]
        slots = [(iw[k], dw[k + shift]) for k in span if slot(ic[k])]
        votes = Counter(slots)
        top = {a: max((votes[a, b], a == b, b) for x, b in votes if x == a)[2] for a, _ in votes}
        total = sum(not slot(ic[k]) for k in span) + sum(top[a] == b for a, b in slots)
        if total >= min(min_words, max(min(window, len(iw)), -(-len(iw) // 2))):
            best = max(best or (0,), (total, -shift, hits[0]))
    return best and (best[2] - best[1], best[0])


def one_process(x, y, folds, features, ridge=1e-3, bins=2048, seed=11):
    """Scores of the quality classifier, fitted on one matrix."""
    rng, folds, d = np.random.default_rng(seed), np.array(folds), x.shape[1]
    directions, phases = rng.normal(size=(d, features)) / np.sqrt(d / 2), rng.uniform(0, 2 * np.pi, features)
    z = np.sqrt(2 / features) * np.cos(np.clip((x - x.mean(0)) / x.std(0), -6, 6) @ directions + phases)
    z = np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def solve(rows):
        a = z[rows].T @ z[rows]
        return np.linalg.solve(a + ridge * max(a[-1, -1], 1) * np.eye(features + 1) / features, z[rows].T @ y[rows])

    unseen = np.zeros(len(x))
    for f in range(1, 5):
        unseen[folds == f] = z[folds == f] @ solve((folds != f) & (folds != 0))
    points = sorted(Counter(np.clip(((unseen[folds != 0] + 0.5) / 2 * bins).astype(int), 0, bins - 1).tolist()).items())
    blocks = [[((b + 0.5) / bins * 2 - 0.5) * n, n, y[(folds != 0) & (np.clip(((unseen + 0.5) / 2 * bins).astype(int), 0, bins - 1) == b)].sum()] for b, n in points]
    at = 0
    while at + 1 < len(blocks):  # merges the first falling pair and starts over
        if blocks[at][2] / blocks[at][1] >= blocks[at + 1][2] / blocks[at + 1][1]:
            blocks[at : at + 2] = [[p + q for p, q in zip(blocks[at], blocks[at + 1], strict=True)]]
            at = -1
        at += 1
    b = np.array(blocks, float)
    return np.clip(np.interp(z @ solve(folds != 0), b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]), 0, 1)


def groups(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
