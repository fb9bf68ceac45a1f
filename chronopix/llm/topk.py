"""Exact top-k inner-product search with a metric tree (M-tree) and best-first search.

Vectors become integers, floor(scale * x). Pivots, a bounded sample (PIVOTS vectors at most), are the routing objects of
the root; each vector goes to its nearest pivot, and each pivot's vectors are dealt to pages of about PAGE / 2 vectors, so
a pivot that attracts a third of all rows gives many pages, not one large task. A page is stored with its two-level metric
tree, whose nodes have a centre, a covering radius, the distance to the parent's centre, the largest norm and the smallest
id below. A query's bound on a node is (|q|^2 + maxnorm^2 - max(0, d(q, centre) - radius)^2) / 2; before d(q, centre) is
computed, |d(q, parent) - d(parent, centre)| bounds it from below (triangle inequality). Nodes are visited by descending
bound and the search ends when the best bound left can't beat the k-th score. Ties go to the smaller id: a node whose bound
equals the k-th score is left out only if its smallest id is larger than the k-th id.

Two rounds: first every query searches the page family of its nearest pivot, which gives a k-th score; then it visits
those pivots only whose bound reaches that score. A page travels once for LANE blocks of queries, and its tree is read there.

Distances and bounds are floats with room for rounding; they only leave out what can't win. Scores are exact for all finite
components: float products while no partial sum can pass 2**53, else products of Python integers for the candidates that
floats can't rule out. Where squares would pass the range of floats, bounds are computed on vectors divided by 2**shift.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors are compared with
vectors of equal length only; rows that repeat an id are candidates each by itself, and a query is never matched with
rows of its own id; an id asked for by several rows is answered once per row; fewer than k candidates give all; null ids
take no part; an empty table gives an empty result; other columns are not read. Ranks follow the exact scores; `score` is
the nearest 64-bit integer where the exact one, which `exact` has as text, is beyond 64 bits.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, save, small

PIVOTS, PAGE, LEAF, QUERIES, LANE = 64, 8192, 64, 512, 64

#: Room for the rounding of distances, relative to the squared norms.
SLACK = 1e-7


def taking_part(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, vec) of the rows whose components are all there and finite."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite).select("id", F.size("vec").alias("dim"), "vec")


def matrix(vectors, dim: int) -> np.ndarray:
    return np.array(list(vectors), dtype=np.float64).reshape(-1, dim) if dim else np.zeros((len(vectors), 0))


def integers(row: np.ndarray, scale: float) -> list[int]:
    """floor(scale * x) of every component, exact also where the product passes the range of floats."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * row)
    return [int(v) if math.isfinite(v) else math.floor(Fraction(scale) * Fraction(float(x))) for v, x in zip(y.tolist(), row.tolist(), strict=True)]


def floats(raw: np.ndarray, scale: float, shift: int) -> np.ndarray:
    """floor(scale * x) / 2**shift as floats: exact without a shift, else within their rounding."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * raw)
    return y if not shift else np.where(np.isfinite(y), np.ldexp(y, -shift), np.ldexp(raw, -shift) * scale)


def shift_of(largest: float | None, scale: float) -> int:
    """By how many bits vectors must shrink for their squares to be floats."""
    return max(0, math.frexp(largest or 0.0)[1] + math.frexp(scale)[1] - 400)


def order_key(score: int) -> str:
    """A text whose order is that of integers of any size."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}" + "".join(chr(105 - ord(d)) for d in digits)


def from_key(key: str) -> int:
    return int(key[6:]) if key[0] == "1" else -int("".join(chr(105 - ord(d)) for d in key[6:]))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)))


class MTree:
    """A page: leaves of at most LEAF vectors under inner nodes, under the page's root.

    Rows stand in the order of leaves. Node tables have a row per node: first row below, its end, radius, distance to the
    parent, largest norm^2, smallest id; inner nodes also first leaf and end.
    """

    ARRAYS = ("ids", "raw", "centre", "inner", "inner_centres", "inner_ids", "leaf", "leaf_centres", "leaf_ids")

    def __init__(self, ids: np.ndarray, raw: np.ndarray, scale: float = 1.0, shift: int = 0):
        vecs = floats(raw, scale, shift)
        norm2 = (vecs * vecs).sum(1)
        self.centre = vecs.mean(0)
        fan = max(1, int(np.sqrt(max(1, -(-len(ids) // LEAF)))))
        order, inner, leaf = [], [], []
        at = 0

        def node(rows: np.ndarray, parent: np.ndarray) -> tuple:
            c = vecs[rows].mean(0)
            radius = float(np.sqrt(((vecs[rows] - c) ** 2).sum(1).max()))
            return c, int(ids[rows].min()), [at, at + len(rows), radius, float(np.sqrt(((c - parent) ** 2).sum())), float(norm2[rows].max())]

        for group in _split(vecs, np.arange(len(ids)), fan):
            c, least, row = node(group, self.centre)
            first = len(leaf)
            for part in _split(vecs, group, max(1, -(-len(group) // LEAF))):
                part = part[np.argsort(ids[part], kind="stable")]
                leaf.append(node(part, c))
                order.append(part)
                at += len(part)
            inner.append((c, least, row + [first, len(leaf)]))
        order = np.concatenate(order)
        self.ids, self.raw = ids[order], raw[order]
        for name, nodes in (("inner", inner), ("leaf", leaf)):
            setattr(self, name, np.array([x[2] for x in nodes], dtype=np.float64))
            setattr(self, f"{name}_centres", np.array([x[0] for x in nodes]).reshape(len(nodes), -1))
            setattr(self, f"{name}_ids", np.array([x[1] for x in nodes], dtype=np.int64))
        self._ready(scale, shift)

    def _ready(self, scale: float, shift: int) -> None:
        self.scale, self.shift = scale, shift
        self.vecs = floats(self.raw, scale, shift)
        self.largest = float(np.abs(self.vecs).max(initial=0.0))
        self.inner_rows, self.leaf_rows = self.inner.tolist(), self.leaf.tolist()

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.ARRAYS}, numbers=np.array([self.scale, self.shift]))
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> MTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(blob)) as arrays:
            for k in cls.ARRAYS:
                setattr(tree, k, arrays[k])
            scale, shift = arrays["numbers"]
        tree._ready(float(scale), int(shift))
        return tree

    def search(self, q_id: int, raw: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The page's k best (score, id) for a query that reach the score `floor`."""
        q = floats(raw, self.scale, self.shift)
        q2 = float(q @ q)
        exact = not self.shift and len(q) * self.largest * float(np.abs(q).max(initial=0.0)) <= 2.0**53
        whole: list[int] = []
        float_of = lambda s: float(s >> (2 * self.shift))
        least = -math.inf if floor is None else float_of(floor)
        best: list[tuple[int, int]] = []  # heap of (score, -id)

        def bound(low: float, node: list[float]) -> float:
            gap = max(0.0, low - node[2])
            return (q2 + node[4] - gap * gap) / 2 + SLACK * (q2 + node[4] + 1)

        def useless(b: float, least_id: int) -> bool:
            if b < least:
                return True
            if len(best) < k:
                return False
            kth = float_of(best[0][0])
            return b < kth or (exact and math.floor(b) == best[0][0] and -least_id < best[0][1])

        to_root = float(np.sqrt(((q - self.centre) ** 2).sum()))
        heap: list = []
        count = 0
        for i, node in enumerate(self.inner_rows):
            b = bound(abs(to_root - node[3]), node)
            if not useless(b, int(self.inner_ids[i])):
                heapq.heappush(heap, (-b, count := count + 1, 0, i, 0.0))
        while heap:
            b, _, level, i, parent = heapq.heappop(heap)
            node, least_id, centre = (self.inner_rows[i], int(self.inner_ids[i]), self.inner_centres[i]) if level < 2 else (self.leaf_rows[i], int(self.leaf_ids[i]), self.leaf_centres[i])
            if useless(-b, least_id):
                continue
            if level in (0, 2):  # the cheap bound let it pass: now compute its distance
                d = float(np.sqrt(((q - centre) ** 2).sum()))
                b = bound(d, node)
                if not useless(b, least_id):
                    heapq.heappush(heap, (-b, count := count + 1, level + 1, i, d))
            elif level == 1:
                for j in range(int(node[5]), int(node[6])):
                    b = bound(abs(parent - self.leaf_rows[j][3]), self.leaf_rows[j])
                    if not useless(b, int(self.leaf_ids[j])):
                        heapq.heappush(heap, (-b, count := count + 1, 2, j, 0.0))
            else:
                first, end = int(node[0]), int(node[1])
                scores = self.vecs[first:end] @ q
                reach = float_of(best[0][0]) if len(best) == k else least
                for r in np.flatnonzero(scores >= reach if exact else scores + SLACK * (q2 + node[4] + 1) >= reach):
                    r_id = int(self.ids[first + r])
                    if r_id == q_id:
                        continue
                    if exact:
                        score = int(scores[r])
                    else:
                        whole = whole or integers(raw, self.scale)
                        score = sum(x * y for x, y in zip(integers(self.raw[first + r], self.scale), whole, strict=True))
                    if floor is not None and score < floor:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -r_id))
                    elif (score, -r_id) > best[0]:
                        heapq.heapreplace(best, (score, -r_id))
        return [(s, -i) for s, i in best]


def _split(vecs: np.ndarray, rows: np.ndarray, parts: int) -> list[np.ndarray]:
    """Cuts rows along the direction of largest spread, again and again, into about `parts` parts of near-equal size."""
    if parts <= 1 or len(rows) <= 1:
        return [rows]
    x = vecs[rows]
    far = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    other = x[((x - far) ** 2).sum(1).argmax()]
    order = rows[np.argsort(x @ (other - far), kind="stable")]
    left = parts // 2
    cut = len(rows) * left // parts
    return _split(vecs, order[:cut], left) + _split(vecs, order[cut:], parts - left)


def stored_pages(assigned: DataFrame, sizes: DataFrame, scale: float, shift: int) -> DataFrame:
    """(dim, pivot, page, tree): the vectors of a pivot, dealt by row to its pages, each written with its tree."""
    dealt = assigned.join(small(sizes.select("dim", "pivot", "pages")), ["dim", "pivot"]).withColumn("page", F.pmod(F.xxhash64("uid"), F.col("pages")).cast("int"))
    rows = dealt.groupBy("dim", "pivot", "page").agg(F.collect_list(F.struct("id", "vec")).alias("rows"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            trees = [MTree(np.array([r["id"] for r in rows], dtype=np.int64), matrix([r["vec"] for r in rows], dim), scale, shift).dump() for dim, rows in zip(b["dim"], b["rows"], strict=True)]
            yield b[["dim", "pivot", "page"]].assign(tree=trees)

    return save(rows.mapInPandas(build, "dim int, pivot int, page int, tree binary"), "topk-pages", rows=4)


def _search(routed: DataFrame, paged: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(asker, query_id, vec_id, key) of routed queries (asker, id, dim, vec, pivot, floor) in all pages of their pivot.

    Queries travel in blocks of about QUERIES to every page of the pivot, and a page once for LANE blocks.
    """
    spark = routed.sparkSession
    many = routed.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("chunks"))
    chunks = save(many.join(small(sizes.select("dim", "pivot", "pages")), ["dim", "pivot"]), "topk-chunks")
    blocks = routed.join(small(chunks), ["dim", "pivot"]).withColumn("chunk", F.pmod(F.xxhash64("asker"), F.col("chunks")).cast("int"))
    blocks = blocks.groupBy("dim", "pivot", "pages", "chunk").agg(F.collect_list(F.struct("asker", "id", "vec", "floor")).alias("queries"))
    lane = F.floor(F.col("chunk") / F.lit(LANE)).cast("int")
    key = ["dim", "pivot", "page", "lane"]
    asked = blocks.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).select("dim", "pivot", "page", lane.alias("lane"), F.lit(None).cast("binary").alias("tree"), "chunk", "queries")
    lanes = chunks.select("dim", "pivot", F.explode(F.sequence(F.lit(0), F.floor((F.col("chunks") - 1) / F.lit(LANE)).cast("int"))).alias("lane"))
    trees = paged.join(small(lanes), ["dim", "pivot"]).select(*key, "tree", F.lit(-1).alias("chunk"), F.lit(None).cast(blocks.schema["queries"].dataType).alias("queries"))
    work = trees.unionByName(asked).repartition(max(6, partitions(spark)), *key).sortWithinPartitions(*key, "chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = None
        for b in batches:
            for blob, queries, dim in zip(b["tree"], b["queries"], b["dim"], strict=True):
                if blob is not None:  # a page, before its queries
                    tree = MTree.load(bytes(blob))
                    continue
                out = []
                for q, x in zip(queries, matrix([q["vec"] for q in queries], dim), strict=True):
                    floor = None if q["floor"] is None else from_key(q["floor"])
                    out += [(q["asker"], q["id"], i, order_key(s)) for s, i in tree.search(q["id"], x, k, floor)]
                yield pd.DataFrame(out, columns=["asker", "query_id", "vec_id", "key"])

    return work.mapInPandas(run, "asker long, query_id long, vec_id long, key string")


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_every: int = 50, k: int = 5, scale: float = 256.0,
          pivots: int = PIVOTS, page: int = PAGE) -> DataFrame:
    """query_id, rank, vec_id, score, exact: each query's k best rows by integer inner product; queries are rows whose id
    is divisible by query_every."""
    vectors = taking_part(df, id_col, vec_col)
    # at most `pivots` routing objects per length, from a hash order; lengths are few, and beyond 64 share no pivots but one
    w = Window.partitionBy("dim").orderBy(F.xxhash64("vec"), "vec")
    chosen = vectors.select("dim", "vec").groupBy("dim", F.pmod(F.xxhash64("vec"), F.lit(pivots)).alias("slot")).agg(F.min("vec").alias("vec"))
    shift = shift_of(vectors.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))).first()[0], scale)
    roots: dict[int, list] = {}
    for row in chosen.withColumn("rank", F.row_number().over(w)).orderBy("dim", "rank").limit(pivots * 64).collect():
        roots.setdefault(row.dim, []).append(row.vec)
    roots = {d: floats(matrix(v, d), scale, shift) for d, v in roots.items()}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby("dim"):
                c = roots.get(dim)
                x = floats(matrix(g["vec"], dim), scale, shift)
                near, d = np.zeros(len(g), dtype=np.int32), np.sqrt((x * x).sum(1))
                if c is not None:
                    all_d = _distances(x, c)
                    near = all_d.argmin(1).astype(np.int32)
                    d = all_d[np.arange(len(g)), near]
                yield g[["uid", "id", "dim", "vec"]].assign(pivot=near, far=d, norm2=(x * x).sum(1))

    numbered = vectors.withColumn("uid", F.monotonically_increasing_id())
    assigned = save(numbered.mapInPandas(assign, "uid long, id long, dim int, vec array<double>, pivot int, far double, norm2 double"), "topk-assigned", rows=5000)
    sizes = save(
        assigned.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, page // 2))).cast("int").alias("pages"), F.max("far").alias("radius"), F.max("norm2").alias("norm2")),
        "topk-sizes",
    )
    paged = stored_pages(assigned, sizes, scale, shift)
    asking = assigned.filter(F.col("id") % query_every == 0).select(F.col("uid").alias("asker"), "id", "dim", "vec", "pivot")
    order = Window.partitionBy("asker").orderBy(F.desc("key"), "vec_id")
    first = _search(asking.withColumn("floor", F.lit(None).cast("string")), paged, sizes, k)
    first = save(first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "topk-first", rows=4)
    kth = first.groupBy("asker").agg(F.min("key").alias("kth"), F.count(F.lit(1)).alias("found"))
    kth = kth.select("asker", F.when(F.col("found") >= k, F.col("kth")).alias("floor"))
    balls = {(r.dim, r.pivot): (r.radius, r.norm2) for r in sizes.filter(F.col("dim").isin([int(d) for d in roots])).collect()}  # at most pivots * 64

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby("dim"):
                c = roots.get(dim)
                if c is None:  # a length without pivots has one family
                    continue
                q = floats(matrix(g["vec"], dim), scale, shift)
                q2 = (q * q).sum(1)
                d = _distances(q, c)
                least = np.array([-np.inf if f is None else float(from_key(f) >> (2 * shift)) for f in g["floor"]])
                for p in range(d.shape[1]):
                    if (dim, p) not in balls:
                        continue
                    radius, norm2 = balls[dim, p]
                    room = SLACK * (q2 + norm2 + 1)
                    gap = np.maximum(0, d[:, p] - radius - np.sqrt(room))
                    go = ((q2 + norm2 - gap * gap) / 2 + room >= least) & (g["pivot"].to_numpy() != p)
                    if go.any():
                        yield g.loc[go, ["asker", "id", "dim", "vec"]].assign(pivot=np.int32(p), floor=g["floor"][go])

    routed = asking.join(kth, "asker", "left").mapInPandas(route, "asker long, id long, dim int, vec array<double>, pivot int, floor string")
    routed = save(routed, "topk-routed", rows=5000)
    found = first.drop("rank").unionByName(save(_search(routed, paged, sizes, k), "topk-second", rows=4))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole = [from_key(x) for x in b["key"]]
            yield b[["query_id", "rank", "vec_id"]].assign(score=np.array([min(2**63 - 1, max(-(2**63), s)) for s in whole], dtype=np.int64), exact=[str(s) for s in whole])

    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "key").mapInPandas(scores, "query_id long, rank int, vec_id long, score long, exact string")
