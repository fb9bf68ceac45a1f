"""Token ids in bit planes: blocks of ids are transposed to byte planes, and each plane is compressed with zstandard.

A store has two tables in a folder that all executors share:

* files (bucket, seq, n_ids, n_docs, content): each content is a file of the format below. Documents stand in ascending
  doc_id order over (bucket, seq) and inside a file; a document lies in one file.
* index (bucket, seq, first_id, n_ids, n_docs): the ids of all files before each file.

Format of a file (little-endian): magic `BPS1`; u32 block size, number of blocks, number of documents; u64 number of ids;
for each block: u32 ids in it, u32 crc32 of its ids, then for each of its four planes u32 bytes (0: all bytes of the plane
are zero); then the chunk index, u64 offset of each block's first plane; then the document directory, zstandard of
i64 doc_ids and u32 lengths, after its u32 size; then the planes. In a block, plane j holds byte j of each id. With
bits=True each byte plane is further transposed to eight bit planes, which stand one after the other in it.

Defined cases: a null text is a document of just the end id; rows that repeat a doc_id follow each other, equal texts
together; null doc_ids come first and come back as null; a text of any length is read whole; an empty table gives a store without documents; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small
from .tokens import document_ids, encoder, vocabulary

MAGIC = b"BPS1"
BLOCK, FILE_IDS, STRETCH = 65536, 1 << 20, 4096
NULL_ID = -(2**63)


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The four byte planes of unsigned 32-bit ids; with bits, each as eight bit planes."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [p.tobytes() for p in planes]
    return [np.packbits(np.unpackbits(p[:, None], axis=1, bitorder="little").T, axis=1, bitorder="little").tobytes() for p in planes]


def from_planes(planes: list[bytes | None], n: int, bits: bool = False) -> np.ndarray:
    out = np.zeros((n, 4), dtype=np.uint8)
    for j, p in enumerate(planes):
        if p is None:
            continue
        x = np.frombuffer(p, dtype=np.uint8)
        if bits:
            rows = np.unpackbits(x.reshape(8, -1), axis=1, bitorder="little")[:, :n]
            x = np.packbits(rows.T, axis=1, bitorder="little")[:, 0]
        out[:, j] = x
    return out.reshape(-1).view("<u4")


def encode_file(doc_ids: list[int], lengths: list[int], ids: np.ndarray, block: int = BLOCK, bits: bool = False, level: int = 3) -> bytes:
    import zstandard

    z = zstandard.ZstdCompressor(level=level)
    heads, bodies, offsets, at = [], [], [], 0
    for start in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[start : start + block], dtype="<u4")
        packed = [z.compress(p) if any(p) else b"" for p in to_planes(part, bits)]
        heads.append(struct.pack("<6I", len(part), zlib.crc32(part.tobytes()), *map(len, packed)))
        offsets.append(at)
        at += sum(map(len, packed))
        bodies += packed
    directory = z.compress(np.array(doc_ids, dtype="<i8").tobytes() + np.array(lengths, dtype="<u4").tobytes())
    head = MAGIC + struct.pack("<IIIQ", block | (int(bits) << 31), len(heads), len(doc_ids), len(ids))
    return b"".join([head, *heads, struct.pack(f"<{len(offsets)}Q", *offsets), struct.pack("<I", len(directory)), directory, *bodies])


class PlaneFile:
    """Reads a file of the format: its directory, single blocks, or all ids. Raises ValueError on damage."""

    def __init__(self, content: bytes):
        import zstandard

        if content[:4] != MAGIC:
            raise ValueError("not a plane file")
        self.content, self.z = content, zstandard.ZstdDecompressor()
        block, self.blocks, docs, self.n_ids = struct.unpack_from("<IIIQ", content, 4)
        self.block, self.bits = block & 0x7FFFFFFF, bool(block >> 31)
        at = 24
        self.heads = [struct.unpack_from("<6I", content, at + 24 * i) for i in range(self.blocks)]
        at += 24 * self.blocks
        self.offsets = struct.unpack_from(f"<{self.blocks}Q", content, at)
        at += 8 * self.blocks
        (size,) = struct.unpack_from("<I", content, at)
        raw = self.z.decompress(content[at + 4 : at + 4 + size])
        self.doc_ids = np.frombuffer(raw[: 8 * docs], dtype="<i8")
        self.lengths = np.frombuffer(raw[8 * docs :], dtype="<u4").astype(np.int64)
        self.start = at + 4 + size

    def block_ids(self, i: int) -> np.ndarray:
        n, crc, *sizes = self.heads[i]
        at, planes = self.start + self.offsets[i], []
        for s in sizes:
            planes.append(self.z.decompress(self.content[at : at + s]) if s else None)
            at += s
        ids = from_planes(planes, n, self.bits)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block_ids(i) for i in range(self.blocks)]) if self.blocks else np.empty(0, dtype="<u4")

    def range(self, first: int, count: int) -> np.ndarray:
        """`count` ids from position `first` of this file on, from the blocks that hold them only."""
        if not count:
            return np.empty(0, dtype="<u4")
        a, b = first // self.block, (first + count - 1) // self.block
        return np.concatenate([self.block_ids(i) for i in range(a, b + 1)])[first - a * self.block :][:count]


@dataclass
class PlaneStore:
    files: DataFrame
    index: DataFrame


def write_store(
    docs: DataFrame, path: str | None = None, engine: str = "tiktoken", id_col: str = "doc_id", text_col: str = "text", bytes_per_bucket: int = 24 << 20,
    file_ids: int = FILE_IDS, block: int = BLOCK, bits: bool = False,
) -> PlaneStore:
    """Tokenizes documents and writes them in ascending doc_id order.

    Buckets are ranges of (doc_id, text hash, row), as many as the texts have bytes_per_bucket, so a doc_id that many rows
    repeat spans buckets; texts are shuffled once. A task sorts its bucket (Spark spills) and holds the ids of one file at a time.
    """
    vocab = path or vocabulary()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    total = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    order = [F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("uid")]
    keyed = source.withColumn("hash", F.xxhash64("body")).withColumn("uid", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(max(6, -(-total // bytes_per_bucket)), *order).sortWithinPartitions(*order)
    dealt = dealt.select("doc_id", "body", F.spark_partition_id().alias("bucket"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocab, engine)
        now, seq = None, 0
        doc_ids: list[int] = []
        parts: list[np.ndarray] = []

        def close() -> pd.DataFrame:
            lengths = [len(p) for p in parts]
            content = encode_file(doc_ids, lengths, np.concatenate(parts), block, bits)
            return pd.DataFrame({"bucket": [now], "seq": [seq], "n_ids": [sum(lengths)], "n_docs": [len(doc_ids)], "content": [content]})

        size = 0
        for b in batches:
            for doc_id, text, k in zip(b["doc_id"], b["body"], b["bucket"], strict=True):
                if parts and (k != now or size >= file_ids):
                    yield close()
                    seq = seq + 1 if k == now else 0
                    doc_ids.clear(), parts.clear()
                    size = 0
                now = k
                ids = document_ids(text, encode)
                doc_ids.append(NULL_ID if doc_id is None or doc_id != doc_id else int(doc_id))
                parts.append(ids)
                size += len(ids)
        if parts:
            yield close()

    files = save(dealt.mapInPandas(write, "bucket int, seq int, n_ids long, n_docs int, content binary"), "planes", "uncompressed")
    sizes = files.select("bucket", "seq", "n_ids", "n_docs")
    # files of a bucket, buckets of a stretch, stretches: no window sees more rows than one of these has
    def running(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    sizes = sizes.withColumn("stretch", F.floor(F.col("bucket") / F.lit(STRETCH)))
    buckets = sizes.groupBy("stretch", "bucket").agg(F.sum("n_ids").alias("n_ids"))
    stretches = running(buckets.groupBy("stretch").agg(F.sum("n_ids").alias("n_ids")), [], "stretch", "far").drop("n_ids")
    bases = running(buckets, ["stretch"], "bucket", "near").drop("n_ids").join(small(stretches), "stretch").drop("stretch")
    local = running(sizes, ["bucket"], "seq", "inside").join(bases, "bucket")
    index = local.select("bucket", "seq", (F.col("far") + F.col("near") + F.col("inside")).alias("first_id"), "n_ids", "n_docs")
    return PlaneStore(files, save(index, "planes-index"))


def read_store(store: PlaneStore, with_ids: bool = True) -> DataFrame:
    """A row per document: doc_id, start, n_tokens, ids_crc32, (ids as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bucket, seq, content in zip(b["bucket"], b["seq"], b["content"], strict=True):
                f = PlaneFile(bytes(content))
                ids = f.ids()
                ends = np.cumsum(f.lengths)
                starts = ends - f.lengths
                pieces = [ids[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
                out = pd.DataFrame({"bucket": bucket, "seq": seq, "doc_id": f.doc_ids, "local": starts, "n_tokens": f.lengths, "ids_crc32": [zlib.crc32(p) for p in pieces]})
                out["doc_id"] = out["doc_id"].astype("Int64").mask(out["doc_id"] == NULL_ID)
                if with_ids:
                    out["ids"] = pieces
                yield out

    schema = "bucket int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = store.files.select("bucket", "seq", "content").mapInPandas(read, schema)
    joined = rows.join(store.index.select("bucket", "seq", "first_id"), ["bucket", "seq"])
    return joined.select("doc_id", (F.col("first_id") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
