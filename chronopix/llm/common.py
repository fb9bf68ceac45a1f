"""Shared storage, skew-safe joins, ranks and components for the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: A key is heavy when it holds at least this share of all rows, so there are at most 1 / HEAVY_SHARE such keys.
HEAVY_SHARE = 0.001

#: Edges that one task joins in a forest: some 50 MB.
SMALL_EDGES = 300_000

#: Rows of an Arrow batch: whole texts are long, and batches are held in the JVM and in Python at once.
ROWS = 500

#: Narrow tables of so many rows at most are broadcast: some 10 MB.
BROADCAST_ROWS = 100_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a session that runs in one process gets a temporary one, and any other raises: a folder of the driver's
    own machine is no use to executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='chronopix-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has ended: nothing can be deleted through it
            return


@contextmanager
def batch_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Meanwhile, Arrow batches hold so many rows at most: Python workers then hold little at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def save(df: DataFrame, name: str, compression: str = "zstd", rows: int | None = ROWS) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and lost executors lose nothing.

    rows bounds the Arrow batches of Python stages in df.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/chronopix-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    with batch_rows(spark, rows):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chronopix_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table that save() wrote and that nothing will read again."""
    path = getattr(df, "_chronopix_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join to at most one row of right per key; right.count says how many rows of left have the key.

    Keys with a HEAVY_SHARE of all rows (1 / HEAVY_SHARE keys at most) are broadcast, so that no task gets all rows of such
    a key; the others go through a shuffle join. Rows of left with a null key match nothing and aren't shuffled.
    """
    whole = left
    null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    left = whole.filter(~null)
    least = max(1000, int(total * HEAVY_SHARE))
    heavy = right.filter(F.col(count) >= least).drop(count)
    light = right.filter(F.col(count) < least).drop(count)
    near = left.join(F.broadcast(heavy), keys, "inner")
    far = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, "left")
    none = whole.filter(null).select(*whole.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in (*keys, count)])
    return near.unionByName(far).unionByName(none)


def spread_lookup(left: DataFrame, right: DataFrame, key: str, salt: Column, each: int = 10_000) -> DataFrame:
    """Left join to at most one row of right per key, whose rows may be large: a row of right is sent once for `each` rows of left
    that have its key, so that no task gets all rows of a hot key. salt tells rows of left apart, alike in every attempt of a task."""
    counts = save(left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "spread")
    counts = counts.withColumn("_parts", F.ceil(F.col("_n") / F.lit(each)).cast("int"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    dealt = lookup(left, counts, [key], "_n", total).withColumn("_part", F.pmod(salt, F.col("_parts")).cast("int"))
    copies = right.join(counts.select(key, "_parts"), key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.drop("_parts").join(copies.hint("merge"), [key, "_part"], "left").drop("_part")


def ranked(df: DataFrame, by: list[str], order: list[Column], rank: str, salts: int, salt: Column) -> DataFrame:
    """Adds a rank, gapless from 0 within each value of `by`, without ever having all rows of one value in one task.

    Rows get a salt; the counts of (by, salt) give each salted part its first rank, and parts are ranked by themselves.
    """
    parts = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    counts = parts.groupBy(*by, "_salt").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_first", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy(*by, "_salt").orderBy(*order)
    own = parts.withColumn("_own", F.row_number().over(inside) - 1)
    keys = [*by, "_salt"]
    return (
        own.join(firsts, keys, "left")
        .withColumn(rank, (F.col("_first") + F.col("_own")).cast("long"))
        .drop("_salt", "_own", "_first")
    )


def components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """Connected components of edges (a, b), numbers or binaries: (node, root), root the smallest node; nodes without edges are absent.

    Alternates the large-star and small-star steps until the edges form stars; every round is written to the shared folder,
    and only its number of edges and a checksum come to the driver. Once there are `small` edges or fewer, one task joins
    them in a forest instead.
    """
    now = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = _mark(now)
    while True:
        if mark[0] <= small:
            return save(_in_one_task(now), "roots")
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        after = save(large.join(down, "a").select(pairs.alias("e")).select("e.*").filter("a <> b").distinct(), "edges")
        before, mark = mark, _mark(after)
        release(now)
        now = after
        if mark == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a checksum that does not depend on their order."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 33))).first())


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = [b[["a", "b"]].to_numpy() for b in batches]
        nodes, at = np.unique(np.concatenate(ends).ravel() if ends else np.empty(0, dtype=object), return_inverse=True)
        up = list(range(len(nodes)))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in at.reshape(-1, 2).tolist():
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        yield pd.DataFrame({"node": nodes, "root": nodes[np.array([find(i) for i in range(len(nodes))], dtype=np.int64)]})

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInPandas(run, f"node {kind}, root {kind}")


def marked(df: DataFrame, wanted: DataFrame, key: Column, bits: int = 22, others: bool = False) -> DataFrame:
    """Rows of df whose key may be in wanted, a filter that lets some others through too; or, with others, the other rows.

    A bitmap of 2**bits bits over the wanted keys' hashes, 2**(bits - 6) rows whatever their number, is broadcast.
    wanted has the key as its only column, or names it as df does.
    """
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    h, word, mask = (f"_{x}_{uuid.uuid4().hex}" for x in ("hash", "word", "mask"))  # no column of df has such a name
    marks = wanted.select(hashed.alias(h)).groupBy(F.shiftright(h, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({h} & 63 as int))")).alias(mask))
    own = df.withColumn(h, hashed).withColumn(word, F.shiftright(h, 6)).join(F.broadcast(marks), word, "left")
    on = F.coalesce(F.expr(f"shiftright({mask}, cast({h} & 63 as int)) & 1"), F.lit(0)) == 1
    return own.filter(~on if others else on).drop(h, word, mask)


def row_key(*columns: str | Column) -> Column:
    """128 bits that stand for a row's values, nulls included: rows without an id, or that repeat one, can be told apart."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [x for c in parts for x in (c.isNull(), c)]
    return F.concat(F.hex(F.xxhash64(*parts)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), *parts)))


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """Rows of docs, with all columns, whose row key is not among the row_key of gone.

    A bitmap over the keys (2**27 bits at most) clears nearly all rows that stay. Of what it marks, only keys are shuffled, to find
    those that it marks by chance; rows with such a key stay too.
    """
    name = f"_key_{uuid.uuid4().hex}"  # no column of docs has such a name
    wanted = save(gone.select(F.col("row_key").alias(name)).filter(F.col(name).isNotNull()).distinct(), "gone")
    width = lambda n: min(27, max(16, (64 * n).bit_length()))
    bits = width(wanted.count())
    own = docs.withColumn(name, key)
    near = marked(own, wanted, F.col(name), bits, others=True).select(*docs.columns)
    spared = save(marked(own.select(name), wanted, F.col(name), bits).join(wanted, name, "left_anti").distinct(), "spared")
    many = spared.count()
    if not many:
        return near
    far = marked(own, spared, F.col(name), width(many)).join(small(spared), name, "left_semi")
    return near.unionByName(far.select(*docs.columns))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a hint to broadcast it if it has `most` rows or fewer, which are narrow here, and to shuffle it otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def crc32_of(column: Column) -> Column:
    return F.crc32(column).cast(T.LongType())
