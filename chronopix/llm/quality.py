"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass reads every whole text and writes FEATURES numbers per document. Class means and covariances come from sums over
all labelled training rows (grouped aggregation; two rows reach the driver). Covariances are shrunk towards the diagonal
of the pooled one and then inverted through their Cholesky factors, which are computed once and shipped with the task. The
score is the logistic of the difference of the two log-densities, with the classes' shares as prior.

Labels decide nothing but the training rows: those whose crc32(doc_id as text) mod 3 is not 1. Labels, lang, source and
doc_id are no inputs of a score.

Defined cases: null and empty texts have all-zero statistics and get a score as others do; several labels of one doc_id
count as 1 if their mean is at least 0.5; null labels and null doc_ids are not trained on, and a null doc_id is not held
out; without training rows of both classes every score is 0.5; rows that repeat a doc_id are scored one by one; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, save, utf8, without
from .shingles import binary_column, slices, word_hashes

FEATURES = ("length", "words", "word_length", "upper", "digit", "punctuation", "marks", "lines", "distinct", "distinct_pairs", "top_word", "short", "stops")
SHRINKAGE, FLOOR = 0.1, 1e-4


def _classes() -> np.ndarray:
    """Byte classes: upper, digit, punctuation other than .,'-, sentence stops, line feed, space."""
    out = np.zeros((256, 6), dtype=np.int64)
    out[65:91, 0] = 1
    out[48:58, 1] = 1
    for b in range(33, 127):
        if not chr(b).isalnum() and chr(b) not in ".,'-":
            out[b, 2] = 1
    out[[ord(c) for c in ".!?"], 3] = 1
    out[10, 4] = 1
    out[[32, 9, 10, 11, 12, 13], 5] = 1
    return out


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The transformed statistics of texts data[bounds[i]:bounds[i+1]], a row each."""
    classes = _classes()
    rows = len(bounds) - 1
    base = int(bounds[0])
    buf, at = data[base : int(bounds[-1])], bounds - base
    size = np.diff(at).astype(np.float64)
    counts = np.zeros((rows, classes.shape[1]))
    full = np.flatnonzero(size)
    if len(full):
        for k in range(classes.shape[1]):
            counts[full, k] = np.add.reduceat(classes[:, k].astype(np.int32)[buf], at[:-1][full])
    hashes, word_at = word_hashes(data, bounds)
    words = np.diff(word_at).astype(np.float64)
    distinct, pairs, top = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    mixed = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] if len(hashes) > 1 else hashes[:0]
    for r in range(rows):
        a, b = int(word_at[r]), int(word_at[r + 1])
        if b > a:
            _, many = np.unique(hashes[a:b], return_counts=True)
            distinct[r], top[r] = len(many), many.max()
            pairs[r] = len(np.unique(mixed[a : b - 1])) if b - a > 1 else 1
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    upper, digit, punct, stops, lines, space = counts.T
    share = lambda x: np.log(x + 0.002)
    letters = size - space
    out = np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(letters / w), share(upper / n), share(digit / n), share(punct / n), share(punct / w), np.log1p(lines) - np.log1p(words),
        distinct / w, pairs / w, share(top / w), np.log1p(size / np.maximum(lines + 1, 1)), share(stops / w),
    ])
    out[size == 0] = 0
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, x0, x1, ...) for every row."""
    import pyarrow as pa

    names = [f"x{i}" for i in range(len(FEATURES))]

    def run(batches) -> Iterator:
        schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.string())] + [(n, pa.float64()) for n in names])
        for batch in batches:
            data, bounds = binary_column(batch.column(2))
            for i, j in slices(bounds):
                x = statistics(data, bounds[i : j + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(x[:, k]) for k in range(x.shape[1]))], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), utf8(F.col(text_col).cast("string")).alias("body"))
    return source.mapInArrow(run, "doc_id long, row_key string, " + ", ".join(f"{n} double" for n in names))


class Discriminant:
    """Two normal densities with shrunk covariances, held as means, Cholesky factors and log-determinants."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        total = sum(m[0] for m in moments.values())
        self.parts = {}
        covariances = {k: s2 / n - np.outer(s1 / n, s1 / n) for k, (n, s1, s2) in moments.items()}
        pooled = sum(moments[k][0] * c for k, c in covariances.items()) / total
        target = np.diag(np.maximum(np.diag(pooled), FLOOR))
        for k, (n, s1, _) in moments.items():
            factor = np.linalg.cholesky((1 - shrinkage) * covariances[k] + shrinkage * target + FLOOR * np.eye(len(s1)))
            self.parts[k] = (s1 / n, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of class 1 in the two densities."""
        log = {}
        for k, (mean, inverse, determinant, prior) in self.parts.items():
            z = (x - mean) @ inverse.T
            log[k] = prior - 0.5 * (determinant + (z * z).sum(1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant | None:
    """From all labelled rows of stats that are not held out; None if a class has too few rows."""
    d = len(FEATURES)
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    rows = stats.filter(~held_out("doc_id")).join(marks, "doc_id")
    first = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]
    second = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    moments = {}
    for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *first, *second).collect():
        s2 = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                s2[i, j] = s2[j, i] = r[f"p{i}_{j}"]
        moments[r.y] = (float(r.n), np.array([r[f"s{i}"] for i in range(d)]), s2)
    return Discriminant(moments) if len(moments) == 2 and min(m[0] for m in moments.values()) > 1 else None


def held_out(column: str):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted, row_key of every row of docs."""
    stats = save(document_statistics(docs, id_col, text_col), "quality-stats")
    model = fit(stats, labels, label)
    names = [f"x{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[names].to_numpy(dtype=np.float64)
            s = model.score(x) if model else np.full(len(b), 0.5)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "row_key": b["row_key"], "score": s})

    scored = stats.mapInPandas(run, "doc_id long, row_key string, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "row_key")


def keep_good(docs: DataFrame, scored: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs with a predicted quality of 1, with all their columns; rows without an id are told apart by their row keys."""
    return without(docs, scored.filter("predicted = 0"), row_key(id_col, text_col))
