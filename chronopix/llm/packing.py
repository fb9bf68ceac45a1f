"""Packing documents into sequences: shortest-pack-first over the length histogram.

A document's ids are cut into full sequences and one rest. The histogram of the rests' lengths (`limit` entries at most)
comes to the driver, which places lengths longest first, each into the emptiest packs that still have room, and counts how
often each packing pattern is used. Patterns then go back to the pieces by rank within their length: each pattern owns an
interval of ranks of each of its lengths. Ranks come from counts of (length, part) and from positions inside a part, so no
length is ever gathered in one task.

Defined cases: null and empty texts are documents of just the end id; rows that repeat a doc_id are documents each by
itself; a null doc_id stays null; an empty table gives no pieces; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .tokens import map_documents, vocabulary

LIMIT = 1024

Pattern = tuple[int, ...]


def shortest_pack_first(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[Pattern, int]]:
    """Packing patterns and how often each is used; their lengths cover the histogram exactly.

    Lengths go longest first. The packs with the most room come first; packs of one pattern are handled as a count, so the
    work depends on the number of lengths and not on the number of pieces.
    """
    packs: dict[int, list[tuple[Pattern, int]]] = {}  # by room left
    rooms: list[int] = []  # sorted rooms that have packs

    def put(room: int, pattern: Pattern, count: int) -> None:
        if room not in packs:
            packs[room] = []
            insort(rooms, room)
        packs[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        made: list[tuple[int, Pattern, int]] = []
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            pattern, count = packs[room].pop()
            if not packs[room]:
                del packs[room]
                rooms.pop()
            used = min(left, count)
            left -= used
            # a pack may take the same length again at once
            fits = min(room // length, 1 + left // max(1, used)) if used == count else 1
            left -= used * (fits - 1)
            made.append((room - fits * length, pattern + (length,) * fits, used))
            if count > used:
                put(room, pattern, count - used)
        if left:
            each = limit // length
            if left // each:
                made.append((limit - each * length, (length,) * each, left // each))
            if left % each:
                made.append((limit - (left % each) * length, (length,) * (left % each), 1))
        for room, pattern, count in made:
            put(room, pattern, count)
    return sorted(((p, c) for group in packs.values() for p, c in group), key=lambda x: (sum(x[0]), x[0]), reverse=True)


def token_pieces(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, engine: str = "tiktoken", with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A document's pieces: doc_id, start, length, doc_tokens, ids_crc32, part, seen (earlier pieces of this length in the
    part) and, if asked for, ids as little-endian unsigned 32-bit integers. A part is a range of pieces of one task."""
    path = path or vocabulary()
    seen: dict[int, int] = {}
    part = [None]

    def cut(doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        from pyspark import TaskContext

        context = TaskContext.get()
        now = (context.taskAttemptId() if context else 0, context.partitionId() if context else 0)
        if part[0] != now:
            part[0] = now
            seen.clear()
        for start in range(0, len(ids), limit):
            piece = ids[start : start + limit]
            n = len(piece)
            at = seen.get(n, 0)
            seen[n] = at + 1
            yield (doc_id, start, n, len(ids), zlib.crc32(piece.tobytes()), now[1], at, piece.tobytes() if with_ids else None)

    pieces = map_documents(docs, cut, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, part long, seen long, ids binary", path, engine, id_col, text_col, 512)
    return pieces if with_ids else pieces.drop("ids")


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to a written table of token_pieces(). Full pieces are sequences of their own."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("c").alias("n")).collect()}  # `limit` rows at most
    rows, sequence, taken = [], 0, dict.fromkeys(histogram, 0)
    for pattern, count in shortest_pack_first(histogram, limit):
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], taken[length] + count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    if taken != histogram:
        raise AssertionError("the patterns do not cover the histogram")
    # intervals: as many as patterns have places, which the number of lengths bounds, not the number of pieces
    table: dict[int, np.ndarray] = {n: np.array(sorted(x[1:] for x in rows if x[0] == n), dtype=np.int64).T for n in histogram}
    slots = spark.sparkContext.broadcast(table)
    placed = pieces.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("seen"))

    columns = [c for c in pieces.columns if c not in ("part", "seen")]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence_id, offset = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for length, g in b.groupby("length"):
                low, _, first, offsets = slots.value[length]
                rank = g["rank"].to_numpy()
                at = np.searchsorted(low, rank, side="right") - 1
                where = b.index.get_indexer(g.index)
                sequence_id[where] = first[at] + rank - low[at]
                offset[where] = offsets[at]
            out = b[columns].copy()
            out["sequence_id"], out["offset"] = sequence_id, offset
            yield out

    kinds = ", ".join(f"{c} {t}" for c, t in pieces.dtypes if c in columns)
    return placed.select(*columns, "rank").mapInPandas(find, f"{kinds}, sequence_id long, offset long".replace("bigint", "long"))


def pack_documents(docs: DataFrame, path: str | None = None, limit: int = LIMIT, engine: str = "tiktoken", with_ids: bool = True) -> DataFrame:
    """Documents to packed pieces: doc_id, start, length, doc_tokens, ids_crc32, (ids), sequence_id, offset."""
    return pack(save(token_pieces(docs, path, limit, engine, with_ids), "pack-pieces"), limit)


def sequences(packed: DataFrame, limit: int = LIMIT, pad: int = 0) -> DataFrame:
    """(sequence_id, ids array, doc_ids, lengths): packed pieces with ids, put together. Sequences are padded to `limit`,
    except where their length is a power of two."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("p"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, p in zip(b["sequence_id"], b["p"], strict=True):
                ids = np.frombuffer(b"".join(bytes(x["ids"]) for x in p), dtype="<u4")
                n = len(ids) if len(ids) & (len(ids) - 1) == 0 else limit
                full = np.full(n, pad, dtype=np.int64)
                full[: len(ids)] = ids
                out.append((s, full.tolist(), [x["doc_id"] for x in p], [x["length"] for x in p]))
            yield pd.DataFrame(out, columns=["sequence_id", "ids", "doc_ids", "lengths"])

    return rows.mapInPandas(join, "sequence_id long, ids array<long>, doc_ids array<long>, lengths array<long>")
