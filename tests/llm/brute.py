"""Slow, plain versions of the operators, and small tables with hard cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import regex
from pyspark.sql import types as T

from chronopix.llm import decontaminate

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("shard", T.StringType()), T.StructField("sig", T.StringType()), T.StructField("_h", T.StringType())])
BASE = "the quick brown fox jumps over the lazy dog while nine small cats watch from a warm red roof and then go home again very slowly"


def documents(spark, rows):
    """rows of (doc_id, text[, lang, source]); extra columns clash with names that operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", None, "x", "y", None) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def hard_documents(spark):
    near = BASE.replace("lazy", "sleepy")
    rows = [(0, BASE), (1, BASE.upper()), (2, near + " and more words follow here to differ"), (3, ""), (4, None), (5, "  \n\t "), (6, "two words"), (7, "two  WORDS"), (8, LONG), (9, LONG + " tail"), (9, LONG + " tail"), (None, BASE), (10, "éàü ñ"), (11, BASE + " ok")]
    return documents(spark, rows + [(100 + i, "a hot text that many rows repeat word for word in full") for i in range(40)])


def empty_documents(spark):
    return documents(spark, [(0, "x")]).limit(0)


def shingles(text, n=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def jaccard_components(rows):
    """{row number: (n, component)} by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min([x for x in v if x is not None], default=None) for k, v in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def posteriors(rows):
    """({row or its id: {language: posterior}}, [kept]) by counting everything anew without the document itself.

    rows: (id, text, declared, host).
    """
    low = lambda t: [32 if b in (9, 10, 11, 12, 13) else 48 if 48 <= b < 58 else b + 32 if 65 <= b < 91 else b for b in (t or "").encode()]
    slot = lambda a, b, c: (((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 16
    grams = [[slot(*x[i : i + 3]) for i in range(len(x) - 2)] for x in (low(r[1]) for r in rows)]
    letters = [sum(65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in (r[1] or "").encode()) for r in rows]
    names = sorted({r[2] for r in rows if r[2]})
    counts = {k: Counter() for k in names}
    for r, g in zip(rows, grams, strict=True):
        if r[2]:
            counts[r[2]].update(g)
    size = {k: sum(c.values()) for k, c in counts.items()}

    def likelihood(i, k):
        g, own = Counter(grams[i]), rows[i][2] == k and size[k] > len(grams[i])
        total = size[k] - (len(grams[i]) if own else 0)
        ll = sum(n * math.log((counts[k][x] - (n if own else 0) + 0.5) / (total + 32768)) for x, n in g.items())
        return ll * min(200, len(grams[i])) / max(1, len(grams[i]))

    ll = [{k: likelihood(i, k) for k in names} for i in range(len(rows))]
    best = [max(names, key=lambda k: x[k]) if n and len(set(x.values())) > 1 else None for x, n in zip(ll, letters, strict=True)]
    suffix = lambda h: h.rpartition(".")[2] if h and "." in h else ""
    out, kept = {}, []
    table = np.array([[(counts[k][x] + 0.5) / (size[k] + 32768) for x in range(1 << 16)] for k in names])
    log = np.log(table)
    cross = table @ log.T
    means = {k: sorted(round(20 * ll[i][k] / min(200, len(grams[i]))) / 20 for i in range(len(rows)) if best[i] == k and len(grams[i]) >= 50) for k in names}
    for i, (doc_id, _, declared, host) in enumerate(rows):
        others = [(rows[j], best[j]) for j in range(len(rows)) if j != i]
        joint = {}
        for k in names:
            mine = sum(b == k for _, b in others)
            prior = (mine + 1) / (sum(b is not None for _, b in others) + len(names))
            if host:
                same = [b for r, b in others if r[3] and suffix(r[3]) == suffix(host)]
                prior = (sum(b == k for b in same) + 20 * prior) / (sum(b is not None for b in same) + 20)
                same = [b for r, b in others if r[3] == host]
                prior = (sum(b == k for b in same) + 20 * prior) / (sum(b is not None for b in same) + 20)
            claim = 1.0
            if declared:
                spoken = [r[2] for r, b in others if b == k and r[2]]
                claim = (sum(x == declared for x in spoken) + 1) / (len(spoken) + len(names))
            joint[k] = ll[i][k] + math.log(claim) + math.log(prior)
        top = max(joint.values())
        mass = sum(math.exp(x - top) for x in joint.values())
        out[doc_id] = {k: math.exp(x - top) / mass for k, x in joint.items()}
        at = max(names, key=lambda k: joint[k])
        a = names.index(at)
        median, high = np.percentile(means[at], [50, 84]) if means[at] else (cross[a, a], cross[a, a])
        uniform = -16 * math.log(2)
        nearest = max([uniform] + [cross[b, a] for b in range(len(names)) if b != a])
        limit = max(uniform, median - max(3 * (high - median), (median - nearest) / 2))
        spread = math.sqrt((table[a] * log[a] ** 2).sum() - cross[a, a] ** 2)
        n = len(grams[i])
        known = n == 0 or ll[i][at] / min(200, n) >= limit - 3 * spread * math.sqrt(3 / n)
        kept.append(letters[i] > 0 and 1 / mass >= 0.5 and known)
    return out, kept


def statistics(text):
    """The quality statistics of a text, one by one."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 13
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw.lower()) if w]
    count = lambda test: sum(map(test, raw))
    n, w = len(raw), max(1, len(words))
    lines = raw.count(b"\n")
    punct = count(lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,'-")
    share = lambda x: math.log(x + 0.002)
    many = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else len(words)
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p((n - count(lambda b: b in b" \t\n\v\f\r")) / w), share(count(lambda b: 65 <= b < 91) / n), share(count(lambda b: 48 <= b < 58) / n), share(punct / n), share(punct / w),
        math.log1p(lines) - math.log1p(len(words)), len(many) / w, pairs / w, share(max(many.values(), default=0) / w), math.log1p(n / max(1, lines + 1)), share(count(lambda b: chr(b) in ".!?") / w),
    ]


def quality_scores(rows, labels):
    """Scores by class densities with inverse covariances, from labelled rows that are not held out."""
    x = np.array([statistics(r[1]) for r in rows])
    train = {k: x[[i for i, r in enumerate(rows) if labels.get(r[0]) == k and zlib.crc32(str(r[0]).encode()) % 3 != 1]] for k in (0, 1)}
    cov = {k: np.cov(v.T, bias=True) for k, v in train.items()}
    size = {k: len(v) for k, v in train.items()}
    pooled = sum(size[k] * cov[k] for k in (0, 1)) / sum(size.values())
    log = {}
    for k in (0, 1):
        c = 0.9 * cov[k] + 0.1 * np.diag(np.maximum(np.diag(pooled), 1e-4)) + 1e-4 * np.eye(13)
        z = x - train[k].mean(0)
        log[k] = math.log(size[k] / sum(size.values())) - 0.5 * (np.linalg.slogdet(c)[1] + (z @ np.linalg.inv(c) * z).sum(1))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


UNITS = "|".join(sorted(decontaminate.UNITS.split(), key=len, reverse=True))
NUMBER, UNIT, NAME, POINT = "\x02", "\x03", "\x04", "\x05"


def tokens(text):
    """(kind or None, word or value) of each token."""
    t = regex.sub(r"(?<=\d)[.,:](?=\d)", POINT, text or "")
    t = regex.sub(rf"(\d[\d{POINT}]*) ?((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", lambda m: f" {NUMBER}{m[1]} {UNIT}{m[2]} ", t)
    t = regex.sub(rf"(?<![\d{NUMBER}{POINT}])(\d[\d{POINT}]*)", lambda m: f" {NUMBER}{m[1]} ", t)
    t = regex.sub(r"(?<=[\p{Ll},;] )(\p{Lu}\p{L}*)", lambda m: NAME + m[1], t)
    words = [w for w in regex.split(rf"[^\p{{L}}\p{{N}}{NUMBER}-{POINT}]+", t.lower()) if w]
    return [(w[0], w[1:]) if w[0] < POINT else (None, w) for w in words]


def valued(part):
    return tuple((None if k == NAME else k, v) for k, v in part)


def leaks(docs, items, cover=0.8, run=13):
    """{(document, smallest item of the template): (kind, matched)}"""
    templates = {}
    for item_id, text in items:
        if item := tokens(text):
            literal = len(item) < 3 or all(k for k, _ in item)
            shape = valued(item) if literal else tuple((k, item.index((k, v))) if k else (None, v) for k, v in item)
            templates.setdefault((literal, shape), []).append((item_id, item))
    out = {}
    for row, text in enumerate(docs):
        doc = tokens(text)
        for (literal, shape), members in templates.items():
            n, best = len(shape), None
            same = {valued(item) for _, item in members}
            names = [{item[j][1] for _, item in members} for j in range(n)]
            for first in range(-n + 1, len(doc)):
                part = [doc[first + j] if 0 <= first + j < len(doc) else (None, "") for j in range(n)]
                exact = valued(part) in same
                for by_word in (False, True):
                    agree = []
                    for j, ((k, v), (ik, iv)) in enumerate(zip(part, shape, strict=True)):
                        if ik == NAME and by_word:
                            agree.append(v in names[j] and k in (None, NAME))
                        elif ik:
                            agree.append(k == ik)
                        else:
                            agree.append((k is None or (k == NAME and (by_word or j == 0))) and v == iv)
                    longest = max(map(len, "".join(".x"[a] for a in agree).split(".")))
                    slots = {(s[1], d) for s, d, a in zip(shape, part, agree, strict=True) if a and s[0]}
                    slots = {(s, v if k is None else k + v) for s, (k, v) in slots}
                    enough = sum(agree) >= -(-4 * n // 5) or longest >= run
                    worded = any(a and not s[0] for s, a in zip(shape, agree, strict=True))
                    if exact or (not literal and enough and worded and len({s for s, _ in slots}) == len(slots)):
                        changed = sum(not a and not (j == 0 and part[0][0] == NAME) for j, a in enumerate(agree))
                        found = (exact, n if exact else sum(agree), n if exact else longest, -first, -changed)
                        best = max(best or found, found)
            if best:
                out[row, min(i for i, _ in members)] = ("exact" if best[0] else "reparameterised" if not best[4] else "altered", best[1])
    return out


def keep_language(rows):
    return [r for r, k in zip(rows, posteriors(rows)[1], strict=True) if k]


def keep_quality(rows, labels):
    return [r for r, s in zip(rows, quality_scores(rows, labels), strict=True) if s >= 0.5]


def keep_first(rows):
    """The first row of each group of near copies, by id, null last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    sets = [shingles(r[1]) for r in rows]
    near = lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    seen, out = set(), []
    for i in order:
        if i in seen:
            continue
        out.append(rows[i])
        queue = [i]
        while queue:
            a = queue.pop()
            if a not in seen:
                seen.add(a)
                queue += [b for b in order if b not in seen and near(a, b)]
    return out


def keep_clean(rows, items):
    found = {d for (d, _), (_, n) in leaks([r[1] for r in rows], items).items() if n >= 3}
    return [r for i, r in enumerate(rows) if i not in found]
