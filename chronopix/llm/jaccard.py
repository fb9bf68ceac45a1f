"""Exact n-gram Jaccard join with signature trees.

Documents whose sets of 5-word shingles have a Jaccard similarity of 80/100 or more are linked; the result names each
document's component. The steps:

1. `sets` reads every text: sorted shingle hashes, a signature of the set, a token bitmap, and a count sketch of all
   shingles (2**SKETCH counters whatever the input's size). Documents of equal sets form a class; a class goes on as one.
   Sets are eight times as large as texts compress to, so they are never stored; steps 2 and 4 make them anew from texts.
2. `runs`: a class is sent under the shingles of its prefix. Two sets linked share one of the first
   n - ceil(0.8 n) + 1 shingles of any fixed order; the order puts shingles of larger sketch counts later, so a passage
   that many documents share brings only those together which consist of little else. Of a run, classes
   stay that have a partner there whose size and position allow a link. Runs of more than BIG classes become candidates as a star.
   Unlike sets that are linked have four shingles or more in common, so prefixes are COMMON - 1 longer and linked sets share
   COMMON shingles of them. `shared_runs` keeps equal runs once and counts their shingles; of runs with fewer than COMMON, only
   pairs go on that have so many in all. The pairs that meet by chance grow with the square of the input, and end here, as keys.
3. `tree_edges`: within a run a signature tree is traversed against itself. Its nodes hold OR-combined bitmaps, the range
   of set sizes, and the largest excess of a set over its bits; a node pair is left out when its largest possible overlap,
   common bits + the smaller excess, is below the least overlap that sets of such sizes need. Pairs of leaves that are left
   are candidates; of these a spanning forest goes on, and its components (clusters) are a superset of the result's.
4. `verified`: the sets of a cluster meet in one task, or, in clusters of over CLUSTER classes, in blocks: each block with
   itself and with block 0. The tree proposes pairs not connected yet, and the sets decide exactly. What is then outside the
   cluster's largest component is checked by pairs (`linked_pairs`): those that share a run, and in runs of over BIG also a
   second prefix shingle, as far as the trees leave them, so unlike classes that have one shingle in common cost no pairs.
   Where over BIG classes share both, blocks of those outside meet blocks of all (`dense_blocks`).
5. Components of the verified links, as min-label stars in joins; each document gets its component's smallest doc_id.

Defined cases: null and empty texts and texts without words have no shingles, no links and themselves as component;
rows that repeat a doc_id are taken one by one; null doc_ids count for links but are never the smallest unless alone; an
empty table gives an empty result; other columns are not read. Sets are told apart by 128 bits; shingles have 64-bit hashes,
so two shingles of two documents are taken as equal with a probability of 2^-64 a pair.

similar_pairs() gives all links between classes and link_counts() their numbers, with the same steps.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lookup, marked, release, row_key, save, small, spread_lookup, utf8, without
from .shingles import WORDS, binary_column, mix, shingle_sets, slices, word_hashes

SKETCH, CHUNKS = 22, 64
BIG, CLUSTER, BLOCK = 1024, 512, 256
BUCKET = 300_000
COMMON, FEW = 3, 24
HOT = 1 << 20
ENTRY = np.dtype([("key", "<u8"), ("sig", "V16"), ("n", "<u4"), ("pos", "<u4")])
HALVES = np.dtype([("key", "<u8"), ("high", "<u8"), ("low", "<u8"), ("n", "<u4"), ("pos", "<u4")])
SET_SCHEMA = "doc_id long, row_key string, sig binary, n long, bits binary, chunk int"


def least_overlap(a, b):
    """Smallest overlap with 100 * overlap >= 80 * union for sets of sizes a and b: ceil(4 (a + b) / 9)."""
    return -(-4 * (a + b) // 9)


def bitmap(tokens: np.ndarray) -> bytes:
    """Bits of the tokens' leading digits; about four bits a token, 64 to 65536, so that halves of a bitmap fold."""
    width = min(16, max(6, int(4 * len(tokens) - 1).bit_length()))
    on = np.zeros(1 << width, dtype=np.uint8)
    on[(tokens >> np.uint64(64 - width)).astype(np.int64)] = 1
    return np.packbits(on).tobytes()


def signature(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


class Seen:
    """Signatures met in a task; beyond the limit repeated sets only travel more than once."""

    def __init__(self, limit: int = 500_000):
        self.met: set[bytes] = set()
        self.limit = limit

    def new(self, k: bytes) -> bool:
        if k in self.met:
            return False
        if len(self.met) < self.limit:
            self.met.add(k)
        return True


def batch_sets(column, words: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, last row, sets) over slices of an Arrow column of texts."""
    data, bounds = binary_column(column)
    for i, j in slices(bounds):
        hashes, at = word_hashes(data, bounds[i : j + 1])
        yield i, j, list(shingle_sets(hashes, at, words))


def sets(source: DataFrame, words: int = WORDS) -> DataFrame:
    """A row per document of source (doc_id, row_key, body), with bits only where the set is new to the task, and sketch rows
    (chunk not null, counters in bits)."""
    import pyarrow as pa

    def run(batches) -> Iterator:
        schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.string()), ("sig", pa.binary()), ("n", pa.int64()), ("bits", pa.binary()), ("chunk", pa.int32())])
        seen = Seen()
        counts = np.zeros(1 << SKETCH, dtype=np.uint32)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for i, j, found in batch_sets(batch.column(2), words):
                sig, bits = [], []
                for s in found:
                    k = signature(s.tobytes()) if len(s) else None
                    sig.append(k)
                    bits.append(bitmap(s) if k is not None and seen.new(k) else None)
                    held.append((s & np.uint64((1 << SKETCH) - 1)).astype(np.uint32))
                    size += len(s)
                if size > 1_000_000:
                    np.add.at(counts, np.concatenate(held), np.uint32(1))
                    held.clear()
                    size = 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(sig, pa.binary()), pa.array([len(s) for s in found], pa.int64()), pa.array(bits, pa.binary()), pa.nulls(j - i, pa.int32())], schema=schema
                )
        if size:
            np.add.at(counts, np.concatenate(held), np.uint32(1))
        if counts.any():
            parts = [zlib.compress(c.tobytes(), 1) for c in np.split(counts, CHUNKS)]
            none = pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(CHUNKS, pa.string()), pa.nulls(CHUNKS, pa.binary()), none, pa.array(parts, pa.binary()), pa.array(range(CHUNKS), pa.int32())], schema=schema)

    return source.mapInArrow(run, SET_SCHEMA)


def sketch_classes(table: DataFrame) -> tuple[np.ndarray, int]:
    """(classes, usual): log2 of each counter of the summed sketch, less `usual`, which is that of usual counters.

    2**SKETCH bytes come to the driver, whatever the input's size.
    """

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH) // CHUNKS, dtype=np.uint64)
        for blob in frame["bits"]:
            total += np.frombuffer(zlib.decompress(bytes(blob)), dtype=np.uint32)
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "total": [int(total.sum())], "logs": [np.log2(np.maximum(total, 1)).astype(np.uint8).tobytes()]})

    rows = table.filter("chunk IS NOT NULL").select("chunk", "bits").groupBy("chunk").applyInPandas(add, "chunk int, total long, logs binary").collect()
    if not rows:
        return np.zeros(1 << SKETCH, dtype=np.uint8), 0
    logs = np.concatenate([np.frombuffer(bytes(r.logs), dtype=np.uint8) for r in sorted(rows, key=lambda r: r.chunk)])
    usual = int(np.log2(max(1, sum(r.total for r in rows) >> SKETCH)))
    return np.maximum(logs, usual) - np.uint8(usual), usual


def prefix_length(n: int) -> int:
    """How many of a set's first shingles must hold one of those that it shares with any set linked to it."""
    return n + (-8 * n // 10) + 1


def ordered_keys(t: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The shingles of a set as keys whose order puts those of larger sketch counts later."""
    return (logs[(t & np.uint64((1 << SKETCH) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (t >> np.uint64(6))


def _prefix_entries(source: DataFrame, order, buckets: int, words: int) -> DataFrame:
    """(bucket, entries): blobs of ENTRY, the prefix shingles of each set."""
    import pyarrow as pa

    spread = np.uint64(0x9E3779B97F4A7C15)

    def run(batches) -> Iterator:
        logs, usual = order.value
        seen = Seen()
        held: list[np.ndarray] = []
        size = 0

        def flush():
            e = np.concatenate(held)
            held.clear()
            # a shingle that may stand in over HOT classes is dealt over several buckets by class
            salts = np.maximum(1, (np.uint64(1) << np.minimum((e["key"] >> np.uint64(58)) + np.uint64(usual), np.uint64(60))) // np.uint64(HOT))
            h = (e["key"] * spread) ^ ((e.view(HALVES)["low"] >> np.uint64(20)) % salts) * spread
            bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            e, bucket = e[by], bucket[by]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            blobs = [x.tobytes() for x in np.split(e, cuts)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate(([0], cuts))], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for _, _, found in batch_sets(batch.column(0), words):
                for t in found:
                    n = len(t)
                    if not n or not seen.new(sig := signature(t.tobytes())):
                        continue
                    keys = ordered_keys(t, logs)
                    p = min(n, prefix_length(n) + COMMON - 1)
                    e = np.empty(p, dtype=ENTRY)
                    e["key"] = np.sort(np.partition(keys, p - 1)[:p]) if p < n else np.sort(keys)
                    e["sig"], e["n"], e["pos"] = np.void(sig), n, np.arange(p)
                    held.append(e)
                    size += p
                if size > 300_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return source.select("body").mapInArrow(run, "bucket int, entries binary")


def _runs(entries: DataFrame, buckets: int, usual: int) -> DataFrame:
    """(run, key, x, sigs, many): classes that share a prefix shingle x, or `many` of them; key only where others of the shingle are in
    other buckets, x only there and in runs of more than BIG. Of a run in which few pairs may be linked, each is a run of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blobs: dict[int, list[bytes]] = {}
        for b in batches:
            for k, e in zip(b["bucket"], b["entries"], strict=True):
                blobs.setdefault(k, []).append(e)
        for k in list(blobs):
            e = np.frombuffer(b"".join(blobs.pop(k)), dtype=HALVES)
            e = e[np.lexsort((e["low"], e["high"], e["key"]))]
            fresh = np.ones(len(e), dtype=bool)
            fresh[1:] = (e["key"][1:] != e["key"][:-1]) | (e["high"][1:] != e["high"][:-1]) | (e["low"][1:] != e["low"][:-1])
            e = e[fresh]
            starts = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1])))
            ends = np.append(starts[1:], len(e))
            hot = (e["key"][starts] >> np.uint64(58)) + np.uint64(usual) >= np.uint64(HOT.bit_length())
            # COMMON - 1 shared shingles at most come before one that counts
            rest, n = e["n"].astype(np.int64) - e["pos"] + (COMMON - 1), e["n"].astype(np.int64)
            many = ends - starts
            two = np.flatnonzero((many == 2) & ~hot)
            i = starts[two]
            apart = np.minimum(rest[i], rest[i + 1]) < least_overlap(n[i], n[i + 1])
            take = (many > 1) | hot
            take[two[apart]] = False
            out: dict[bytes, list] = {}

            def add(m, key, x):
                raw = m.view(ENTRY)["sig"].tobytes()
                name = hashlib.blake2b(raw if x is None else raw + m["key"][0].tobytes(), digest_size=16).digest()
                if name in out:
                    out[name][4] += 1
                else:
                    out[name] = [name, key, x, [raw[q : q + 16] for q in range(0, len(raw), 16)], 1]

            for s, t, h in zip(starts[take], ends[take], hot[take], strict=True):
                m = e[s:t]
                if not h and 2 < len(m) <= BIG:
                    # of two sets, the shared shingle and what comes after it in either must reach the least overlap
                    fits = np.minimum(rest[s:t, None], rest[None, s:t]) >= least_overlap(n[s:t, None], n[None, s:t])
                    np.fill_diagonal(fits, False)
                    left, right = np.nonzero(np.triu(fits))
                    if len(left) <= len(m):
                        for pair in zip(left, right, strict=True):
                            add(m[list(pair)], None, None)
                    else:
                        add(m[fits.any(1)], None, None)
                else:
                    add(m, int(e["key"][s] >> np.uint64(1)) if h else None, int(e["key"][s].astype(np.int64)) if h or len(m) > BIG else None)
                if len(out) >= 2000:
                    yield _run_frame(out)
                    out.clear()
            if out:
                yield _run_frame(out)

    return entries.repartition(buckets, "bucket").mapInPandas(run, "run binary, key long, x long, sigs array<binary>, many int")


def _run_frame(out: dict[bytes, list]) -> pd.DataFrame:
    return pd.DataFrame(list(out.values()), columns=["run", "key", "x", "sigs", "many"]).astype({"key": "Int64", "x": "Int64"})


def shared_runs(runs: DataFrame) -> DataFrame:
    """(run, key, x, sigs): runs of which a linked pair is in at least one, equal ones once.

    A linked pair shares COMMON shingles. It is in a run that has so many, or of over FEW classes; or all its runs have fewer,
    and then their numbers add up to COMMON: of those, pairs are counted and stay as runs of two.
    """
    equal = save(runs.filter("x IS NULL").groupBy("run").agg(F.first("sigs").alias("sigs"), F.sum("many").alias("many")), "jaccard-equal")
    weak = (F.col("many") < COMMON) & (F.size("sigs") <= FEW)
    later = lambda a, i: F.transform(F.slice("sigs", i + 2, F.size("sigs")), lambda b: F.concat(a, b))
    pairs = equal.filter(weak).select(F.explode(F.flatten(F.transform("sigs", later))).alias("run"), "many")
    pairs = pairs.groupBy("run").agg(F.sum("many").alias("many")).filter(F.col("many") >= COMMON)
    pairs = pairs.select("run", F.array(F.substring("run", 1, 16), F.substring("run", 17, 16)).alias("sigs"))
    few = equal.filter(~weak).select("run", "sigs").unionByName(pairs)
    none = F.lit(None).cast("long")
    out = save(few.select("run", none.alias("key"), none.alias("x"), "sigs").unionByName(runs.filter("x IS NOT NULL").drop("many")), "jaccard-shared")
    release(equal)
    release(runs)
    return out


class SignatureTree:
    """Levels of nodes over sets ordered by size: OR of bitmaps, least and largest size, largest excess over the bits."""

    FAN = 8

    def __init__(self, rows: np.ndarray, n: np.ndarray, bits: np.ndarray):
        by = np.argsort(n[rows], kind="stable")
        self.rows = rows[by]
        own = n[self.rows]
        excess = own - np.bitwise_count(bits[by]).sum(1, dtype=np.int64)
        self.levels = [(bits[by], own, own, excess)]
        while len(self.levels[-1][1]) > self.FAN:
            b, low, high, ex = self.levels[-1]
            at = np.arange(0, len(low), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(ex, at)))

    def _children(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node, its children a level below, and which node each child belongs to."""
        below = len(self.levels[level - 1][1])
        first = i * self.FAN
        many = np.minimum(first + self.FAN, below) - first
        of = np.repeat(np.arange(len(i)), many)
        return np.repeat(first, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many), of


def _possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Whether nodes i of level a and j of level b may hold a linked pair."""
    low_a, low_b, high_a, high_b = a[1][i], b[1][j], a[2][i], b[2][j]
    ok = (10 * high_a >= 8 * low_b) & (10 * high_b >= 8 * low_a)
    at = np.flatnonzero(ok)
    for s in range(0, len(at), 20_000):
        k = at[s : s + 20_000]
        common = np.bitwise_count(a[0][i[k]] & b[0][j[k]]).sum(1, dtype=np.int64)
        most = np.minimum(common + np.minimum(a[3][i[k]], b[3][j[k]]), np.minimum(high_a[k], high_b[k]))
        ok[k] = most >= least_overlap(low_a[k], low_b[k])
    return ok


def dual_traversal(a: SignatureTree, b: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of a, of b) of the leaf pairs that may be linked; of a tree with itself each pair once."""
    same = a is b
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[la][1])), np.arange(len(b.levels[lb][1])), indexing="ij"))
    while True:
        if same:
            keep = i <= j if la else i < j
            i, j = i[keep], j[keep]
        ok = _possible(a.levels[la], i, b.levels[lb], j)
        i, j = i[ok], j[ok]
        if not la and not lb:
            return a.rows[i], b.rows[j]
        if la and (la >= lb or same):
            i, of = a._children(la, i)
            j = j[of]
            la -= 1
            if same:
                j, of = b._children(lb, j)
                i = i[of]
                lb -= 1
        else:
            j, of = b._children(lb, j)
            i = i[of]
            lb -= 1


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def candidate_pairs(n: np.ndarray, maps: list[bytes], left: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that the trees leave; with `left`, only pairs with a row of it. A tree for each bitmap width, and
    against the trees of the next width, whose bitmaps are folded by OR-ing neighbouring bits."""
    by_width: dict[int, list[int]] = {}
    for r, m in enumerate(maps):
        by_width.setdefault(len(m), []).append(r)
    for width, rows in sorted(by_width.items()):
        own = np.array(rows)
        tree = SignatureTree(own, n, np.frombuffer(b"".join(maps[r] for r in rows), dtype=np.uint8).reshape(len(rows), width).view(_word(width)))
        pairs = [dual_traversal(tree, tree)]
        if wide := by_width.get(2 * width):
            on = np.unpackbits(np.frombuffer(b"".join(maps[r] for r in wide), dtype=np.uint8).reshape(len(wide), 2 * width), axis=1)
            folded = np.packbits(on[:, ::2] | on[:, 1::2], axis=1)
            pairs.append(dual_traversal(tree, SignatureTree(np.array(wide), n, folded.view(_word(width)))))
        for i, j in pairs:
            if left is not None:
                keep = left[i] | left[j]
                i, j = i[keep], j[keep]
            yield i, j


def _word(width: int) -> np.dtype:
    return np.dtype(np.uint64 if width % 8 == 0 else np.uint8)


def _forest_edges(sigs: list[bytes], n: np.ndarray, maps: list[bytes]) -> list[tuple[bytes, bytes]]:
    forest, out = Forest(len(sigs)), []
    for i, j in candidate_pairs(n, maps):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if forest.join(a, b):
                out.append((sigs[a], sigs[b]))
    return out


def tree_edges(grouped: DataFrame) -> DataFrame:
    """A spanning forest of the pairs that the signature trees of runs leave: (a, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple[bytes, bytes]] = []
            for members in b["members"]:
                unique = {bytes(m["sig"]): m for m in members}
                if len(unique) > 1:
                    rows = list(unique.values())
                    out += _forest_edges(list(unique), np.array([m["n"] for m in rows], dtype=np.int64), [bytes(m["bits"]) for m in rows])
            yield pd.DataFrame(list(dict.fromkeys(out)), columns=["a", "b"])

    return grouped.select("members").mapInPandas(run, "a binary, b binary")


def tree_pairs(grouped: DataFrame) -> DataFrame:
    """All pairs that the signature trees of runs leave: (a, b), a < b. members: sig, n, bits, label, outside; of two with a label, equal
    labels are connected already, and one must be outside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for members in b["members"]:
                unique = {bytes(m["sig"]): m for m in members}
                sigs, rows = list(unique), list(unique.values())
                if len(rows) < 2:
                    continue
                names: dict = {}
                label = np.array([names.setdefault(bytes(m["label"]) if m["label"] is not None else sig, i) for i, (sig, m) in enumerate(unique.items())])
                outside = np.array([bool(m["outside"]) for m in rows])
                for i, j in candidate_pairs(np.array([m["n"] for m in rows], dtype=np.int64), [bytes(m["bits"]) for m in rows], outside):
                    take = label[i] != label[j]
                    out = [(min(sigs[a], sigs[c]), max(sigs[a], sigs[c])) for a, c in zip(i[take].tolist(), j[take].tolist(), strict=True)]
                    if out:
                        yield pd.DataFrame(out, columns=["a", "b"])

    return grouped.select("members").mapInPandas(run, "a binary, b binary")


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return 100 * common >= 80 * (len(a) + len(b) - common)


def exact_pairs(pairs: DataFrame, sets_: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of classes whose sets (sig, tokens) are linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [_linked(np.frombuffer(bytes(x), dtype=np.uint64), np.frombuffer(bytes(y), dtype=np.uint64)) for x, y in zip(b["left"], b["right"], strict=True)]
            yield b.loc[np.array(ok, dtype=bool), ["a", "b"]]

    salt = F.xxhash64("a", "b")
    both = spread_lookup(pairs, sets_.select(F.col("sig").alias("a"), F.col("tokens").alias("left")), "a", salt)
    both = spread_lookup(both, sets_.select(F.col("sig").alias("b"), F.col("tokens").alias("right")), "b", salt)
    return both.select("a", "b", "left", "right").mapInPandas(run, "a binary, b binary")


def second_keys(sets_: DataFrame, order) -> DataFrame:
    """(run, sig, outside) of sets (sig, tokens, xs, outside): of two linked sets, where one of the first COMMON common shingles is one of xs, the
    next is in the first n - ceil(0.8 n) + COMMON + 1 of each; a run is named by the two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs, _ = order.value
        for b in batches:
            for sig, tokens, xs, outside in zip(b["sig"], b["tokens"], b["xs"], b["outside"], strict=True):
                keys = np.sort(ordered_keys(np.frombuffer(bytes(tokens), dtype=np.uint64), logs))[: prefix_length(len(tokens) // 8) + COMMON]
                out = [np.empty(0, dtype=np.uint64)]
                for x in np.array(xs, dtype=np.int64).view(np.uint64):
                    out.append(mix(keys[np.searchsorted(keys, x) + 1 :] ^ mix(x[None])))
                runs = np.concatenate(out).view(np.int64)
                yield pd.DataFrame({"run": runs, "sig": [bytes(sig)] * len(runs), "outside": outside})

    return sets_.mapInPandas(run, "run long, sig binary, outside boolean")


def dense_blocks(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, sig, outside, i, j, left, right) of members (run, sig, outside), classes of runs in which outside ones meet all: blocks that send
    few copies of a set. A class is in block i of `left` blocks of outside classes, and in block j of `right` blocks of all.

    Only outside classes go to every block of all, and all only to the blocks of outside ones. Runs of a cluster (roots: sig, root)
    that have most classes in common are taken together if that sends fewer copies than run by run; no pair of a run is lost.
    """

    def sizes(rows: DataFrame, by: str) -> DataFrame:
        counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("outside").cast("int")).alias("o"))
        return counts.withColumn("right", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("left", F.ceil(F.col("o") / BLOCK).cast("int"))

    sent = F.sum(F.col("o") * F.col("right") + F.col("c") * F.col("left")).alias("sent")
    of_run = save(members.groupBy("run").agg(F.min("sig").alias("sig")).join(roots.select("sig", F.hex("root").alias("cluster")), "sig").select("run", "cluster"), "jaccard-run-clusters")
    rows = members.join(small(of_run), "run")
    apart = sizes(members, "run").join(of_run, "run").groupBy("cluster").agg(sent)
    whole = rows.groupBy("cluster", "sig").agg(F.max("outside").alias("outside"))
    both = apart.join(sizes(whole, "cluster").groupBy("cluster").agg(sent.alias("together")), "cluster")
    together = save(both.select("cluster", (F.col("together") < F.col("sent")).alias("whole")), "jaccard-run-choice")
    rows = rows.join(small(together), "cluster").withColumn("root", F.when(F.col("whole"), F.col("cluster")).otherwise(F.hex("run")))
    rows = save(rows.groupBy("root", "sig").agg(F.max("outside").alias("outside")), "jaccard-dense-members")
    block = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
    return rows.join(small(sizes(rows, "root").drop("c", "o")), "root").withColumn("i", block("left")).withColumn("j", block("right"))


def dense_tasks(rows: DataFrame) -> DataFrame:
    """Rows of dense_blocks() with tokens and label as rows of tasks: each block of outside classes with each block of all."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.filter("outside").withColumn("j", numbers("right")).withColumn("part", F.lit(1))
    right = rows.withColumn("i", numbers("left")).withColumn("part", F.lit(0))
    keep = ["root", "i", "j", "sig", "tokens", "part", "label"]
    return left.select(*keep).unionByName(right.select(*keep))


def linked_pairs(known: DataFrame, bits: DataFrame, found: DataFrame, order, roots: DataFrame) -> DataFrame:
    """All links (a, b) between classes of known (sig, tokens, label, outside), but those within a label and those with no outside class.

    Candidates are the pairs that share a run of BIG classes at most, and in larger ones those that share a second prefix shingle
    too, as far as the trees leave them. Where still more than BIG classes share both shingles, they are compared in blocks. roots (sig, root)
    names the classes' clusters.
    """
    spark = known.sparkSession
    marks = save(known.select("sig", "label", "outside").join(bits, "sig"), "jaccard-marks")
    group = lambda rows: rows.groupBy("run").agg(F.collect_list(F.struct("sig", "n", "bits", "label", "outside")).alias("members"), F.max("outside").alias("some")).filter("some")
    small_runs = found.filter("x IS NULL").dropDuplicates(["run"]).select("run", F.explode("sigs").alias("sig")).join(marks, "sig")
    pairs = tree_pairs(group(small_runs))
    large = found.filter("x IS NOT NULL").select("x", F.explode("sigs").alias("sig")).groupBy("sig").agg(F.collect_set("x").alias("xs"))
    seconds = save(second_keys(known.select("sig", "tokens", "outside").join(large, "sig"), order), "jaccard-seconds", rows=20)
    counts = seconds.groupBy("run").agg(F.count(F.lit(1)).alias("c"), F.max("outside").alias("some")).filter("c > 1 AND some")
    counts = save(counts, "jaccard-counts")
    few = seconds.drop("outside").join(counts.filter(F.col("c") <= BIG).select("run"), "run").join(marks, "sig")
    pairs = save(pairs.unionByName(tree_pairs(group(few))).distinct(), "jaccard-pairs", rows=20)
    links = exact_pairs(pairs, known.select("sig", "tokens"))
    dense = counts.filter(F.col("c") > BIG)
    if not dense.limit(1).count():
        return links
    rows = dense_blocks(seconds.join(small(dense.select("run")), "run"), roots)
    rows = spread_lookup(rows, known.select("sig", "tokens", "label"), "sig", F.xxhash64("root"))
    return links.unionByName(verified(_gather(dense_tasks(save(rows, "jaccard-dense", "lz4"))), every=True)).distinct()


def verified(tasks: DataFrame, every: bool = False) -> DataFrame:
    """tasks (members of sig, tokens, part, label): a spanning forest of the exact links, or all with every, as (a, b).

    part 0 marks rows whose pairs among themselves are not asked for; equal labels are connected already.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for members in batch["members"]:
                unique: dict[bytes, object] = {}
                for m in members:
                    if m["part"] != 0 or bytes(m["sig"]) not in unique:
                        unique[bytes(m["sig"])] = m
                sigs, rows = list(unique), list(unique.values())
                arrays = [np.frombuffer(bytes(m["tokens"]), dtype=np.uint64) for m in rows]
                n = np.array([len(x) for x in arrays], dtype=np.int64)
                forest, labels, out = Forest(len(rows)), {}, []
                for r, m in enumerate(rows):
                    if m["label"] is not None:
                        forest.join(r, labels.setdefault(bytes(m["label"]), r))
                left = np.array([m["part"] != 0 for m in rows])
                for i, j in candidate_pairs(n, [bitmap(x) for x in arrays], None if left.all() else left):
                    for a, b in zip(i.tolist(), j.tolist(), strict=True):
                        if forest.find(a) != forest.find(b) and _linked(arrays[a], arrays[b]):
                            if not every:
                                forest.join(a, b)
                            out.append((min(sigs[a], sigs[b]), max(sigs[a], sigs[b])))
                yield pd.DataFrame(out, columns=["a", "b"])

    return tasks.select("members").mapInPandas(run, "a binary, b binary")


def _gather(rows: DataFrame) -> DataFrame:
    return rows.groupBy("root", "i", "j").agg(F.collect_list(F.struct("sig", "tokens", "part", "label")).alias("members"))


def _member_sets(source: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sig, tokens) of wanted classes, once each, made anew from the texts.

    A bitmap over the wanted signatures, 2**27 bits at most, goes to the tasks and keeps other sets from being sent.
    """
    import pyarrow as pa

    spark = source.sparkSession
    width = min(27, max(16, (16 * wanted.count()).bit_length()))
    place = F.conv(F.hex(F.substring("sig", 1, 4)), 16, 10).cast("long").bitwiseAND((1 << width) - 1)
    marks = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask"))
    on = np.zeros(1 << (width - 6), dtype=np.int64)
    for r in marks.collect():  # 2**21 words at most
        on[r.word] = r.mask
    table = spark.sparkContext.broadcast(on)

    def run(batches) -> Iterator:
        masks, seen = table.value, Seen()
        for batch in batches:
            for _, _, found in batch_sets(batch.column(0), words):
                sigs, blobs = [], []
                for t in found:
                    if not len(t):
                        continue
                    raw = t.tobytes()
                    k = signature(raw)
                    at = int.from_bytes(k[:4], "big") & ((1 << width) - 1)
                    if int(masks[at >> 6]) >> (at & 63) & 1 and seen.new(k):
                        sigs.append(k), blobs.append(raw)
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(blobs, pa.binary())], names=["sig", "tokens"])

    own = source.select("body").mapInArrow(run, "sig binary, tokens binary")
    return own.join(wanted.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.first("tokens").alias("tokens"))


@dataclass
class Candidates:
    """What the first three steps leave: rows of documents (doc_id, row_key, sig, n), classes' sizes and bitmaps, runs, the order of
    shingles, and clusters of classes (sig, root, m)."""

    source: DataFrame
    rows: DataFrame
    total: int
    bits: DataFrame
    found: DataFrame
    order: object
    clusters: DataFrame


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> Candidates:
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), utf8(F.col(text_col).cast("string")).alias("body"))
    table = save(sets(source, words), "jaccard-sets")
    rows = table.filter("chunk IS NULL").select("doc_id", "row_key", "sig", "n")
    total, shingles = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    classes = sketch_classes(table)
    order = spark.sparkContext.broadcast(classes)
    buckets = max(12, -(-(shingles or 0) // 5 // BUCKET))
    found = shared_runs(save(_runs(_prefix_entries(source, order, buckets, words), buckets, classes[1]), "jaccard-runs"))

    def star(x: DataFrame) -> DataFrame:
        return x.select(F.array_min("sigs").alias("a"), F.explode("sigs").alias("b")).filter("a <> b")

    few, big = found.filter("x IS NULL"), found.filter("x IS NOT NULL")
    hubs = big.filter("key IS NOT NULL").select("key", F.array_min("sigs").alias("a"))
    hub_edges = hubs.join(hubs.groupBy("key").agg(F.min("a").alias("b")), "key").select("a", "b").filter("a <> b")
    bits = table.filter("bits IS NOT NULL AND chunk IS NULL").groupBy("sig").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    members = few.dropDuplicates(["run"]).select("run", F.explode("sigs").alias("sig")).join(bits, "sig")
    grouped = members.groupBy("run").agg(F.collect_list(F.struct("sig", "n", "bits")).alias("members"))
    edges = save(tree_edges(grouped).unionByName(star(big)).unionByName(hub_edges).distinct(), "jaccard-candidates")
    clusters = components(edges).select(F.col("node").alias("sig"), "root")
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    return Candidates(source, rows, total, bits, found, order, save(clusters.join(sizes, "root"), "jaccard-clusters"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, row_key, keep_key of every row of docs; keep_key is the row key of the component's row
    with the smallest doc_id."""
    c = candidates(docs, id_col, text_col, words)
    blocks = F.when(F.col("m") <= CLUSTER, F.lit(1)).otherwise(F.ceil(F.col("m") / BLOCK)).cast("int")
    held = save(
        c.clusters.withColumn("nb", blocks).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("nb")).cast("int")).join(_member_sets(c.source, c.clusters, words), "sig"),
        "jaccard-held", "lz4",
    )
    partner = F.when(F.col("nb") == 1, F.array(F.lit(0))).when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.lit(1), F.greatest(F.col("nb") - 1, F.lit(1))))
    plain = held.withColumn("part", F.lit(1)).withColumn("label", F.lit(None).cast("binary"))
    links = save(verified(_gather(plain.withColumn("i", F.lit(0)).withColumn("j", F.explode(partner)))), "jaccard-links", rows=20)
    if c.clusters.filter(F.col("m") > CLUSTER).limit(1).count():
        links = save(links.unionByName(_rest(held, links, c)), "jaccard-links", rows=20)
    linked = components(links)
    first = c.rows.filter("sig IS NOT NULL").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"), F.count(F.lit(1)).alias("copies"))
    rooted = first.join(linked.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    names = rooted.groupBy("root").agg(F.min("first").alias("least"), F.sum("copies").alias("held"))
    by_class = lookup(rooted, names, ["root"], "held", c.total).select("sig", F.col("least.doc_id").alias("component_id"), F.col("least.row_key").alias("keep_key"), "copies")
    named = lookup(c.rows.filter("sig IS NOT NULL"), by_class, ["sig"], "copies", c.total)
    out = named.unionByName(c.rows.filter("sig IS NULL").withColumn("component_id", F.col("doc_id")).withColumn("keep_key", F.col("row_key")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "row_key", "keep_key")


def _rest(held: DataFrame, links: DataFrame, c: Candidates) -> DataFrame:
    """Links of large clusters that the first round may have missed: of classes outside a cluster's largest component, with each other
    and with all others."""
    own = held.filter(F.col("m") > CLUSTER)
    label = components(links).withColumnRenamed("node", "sig").withColumnRenamed("root", "label")
    known = own.join(label, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    counts = known.groupBy("root", "label").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("root").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all")).filter(F.col("all") > F.col("top.c"))
    known = known.join(small(top.select("root", F.col("top.label").alias("largest"))), "root").select("sig", "tokens", "label", (F.col("label") != F.col("largest")).alias("outside"))
    known = save(known, "jaccard-known", "lz4")
    return linked_pairs(known, c.bits, c.found, c.order, c.clusters)


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(links, members): all pairs (a, b) of classes that are linked, and (doc_id, row_key, sig, n_shingles) of every row of docs.

    Documents of one class have equal sets and are linked too. In a group of m unlike near copies there are up to m^2 / 2 links.
    """
    c = candidates(docs, id_col, text_col, words)
    known = save(_member_sets(c.source, c.clusters, words).select("sig", "tokens", F.lit(None).cast("binary").alias("label"), F.lit(True).alias("outside")), "jaccard-known", "lz4")
    links = save(linked_pairs(known, c.bits, c.found, c.order, c.clusters), "jaccard-all-links", rows=20)
    return links, c.rows.select("doc_id", "row_key", "sig", F.col("n").alias("n_shingles"))


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_shingles, n_links) of every row: how many other rows it is linked with, copies included."""
    total = members.count()
    copies = members.filter("sig IS NOT NULL").groupBy("sig").agg(F.count(F.lit(1)).alias("copies"))
    both = links.select(F.col("a").alias("sig"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("sig"), F.col("a").alias("other")))
    others = both.join(copies.select(F.col("sig").alias("other"), "copies"), "other").groupBy("sig").agg(F.sum("copies").alias("others"))
    by_class = copies.join(others, "sig", "left").select("sig", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    named = lookup(members, by_class, ["sig"], "copies", total)
    return named.select("doc_id", "row_key", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, named: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with all its columns: that with the smallest doc_id, null last.

    Of rows that repeat such a doc_id and its text one stays. Rows without words are in no component and stay.
    """
    key = row_key(id_col, text_col)
    rest = without(docs, named.filter("n_shingles > 0 AND keep_key <> row_key"), key)
    repeated = named.filter("n_shingles > 0 AND keep_key = row_key").groupBy("row_key").count().filter("count > 1").select("row_key")
    if not repeated.limit(1).count():
        return rest
    name = f"_key_{uuid.uuid4().hex}"
    again = marked(rest.withColumn(name, key), repeated.select(F.col("row_key").alias(name)), F.col(name))
    again = again.join(repeated.select(F.col("row_key").alias(name)), name, "left_semi").dropDuplicates([name])
    return without(rest, repeated, key).unionByName(again.select(*docs.columns))


# In SQL: exact sets (64-bit hashes of shingles), links by counting common shingles, components by transitive closure.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [hash(array_to_string(ws, ' '))]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i:i + 4], ' '))) END) AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * c >= 80 * (len(x.sh) + len(y.sh) - c)),
l AS MATERIALIZED (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id
"""
