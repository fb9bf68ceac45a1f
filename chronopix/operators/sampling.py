"""Deterministic sampling with a 64-bit linear congruential generator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import numbered

# Multiplier and increment of the generator, and the state that stands for a seed of 0.
MULTIPLIER, INCREMENT, ZERO_SEED = 6364136223846793005, 1442695040888963407, 0x9E3779B97F4A7C15
MASK = 2**64 - 1


class Generator:
    """One stream; state s -> s * MULTIPLIER + INCREMENT modulo 2**64."""

    def __init__(self, seed: int):
        self.state = (seed & MASK) or ZERO_SEED

    def next(self) -> int:
        self.state = (self.state * MULTIPLIER + INCREMENT) & MASK
        return self.state

    def below(self, upper: int) -> int:
        return self.next() % upper


def jump(k: int) -> tuple[int, int]:
    """(a, c): k steps at once are s -> s * a + c."""
    a, c, step_a, step_c = 1, 0, MULTIPLIER, INCREMENT
    while k:
        if k & 1:
            a, c = a * step_a & MASK, (c * step_a + step_c) & MASK
        step_a, step_c = step_a * step_a & MASK, (step_c * step_a + step_c) & MASK
        k >>= 1
    return a, c


def states(seed: int, first: int, n: int) -> np.ndarray:
    """States first + 1 ... first + n of the stream, in blocks that double."""
    a, c = jump(first + 1)
    out = np.empty(n, dtype=np.uint64)
    if n:
        out[0] = (((seed & MASK) or ZERO_SEED) * a + c) & MASK
    k = 1
    while k < n:
        a, c = jump(k)
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(a) + np.uint64(c)
        k += m
    return out


def draws(spark: SparkSession, n: int, seed: int, upper: int, per_draw: int = 1) -> DataFrame:
    """Draw (from 0), value = state % upper, seed = the state after it (per_draw > 1) as an unsigned text.

    Every task jumps to its part of the stream, so draws are not made on the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            if not len(ids):
                continue
            s = states(seed, int(ids[0]) * per_draw, int(ids[-1] - ids[0] + 1) * per_draw)[: len(ids) * per_draw]
            value = (s[::per_draw] % np.uint64(upper)).astype(np.int64)
            second = s[1::per_draw] if per_draw > 1 else s
            yield pd.DataFrame({"draw": ids, "value": value, "seed": [str(x) for x in second.tolist()]})

    return spark.range(n).mapInPandas(run, "draw long, value long, seed string")


def sample_pixels(eligible: DataFrame, scene: str, order: list[str], n: int, seed: int) -> DataFrame:
    """N pixels with replacement, in the order of (scene, pixel): sample_idx, scene and order columns, n_valid.

    Eligible pixels get a global number in the order of (scene, pixel), and draws name the numbers. Both ranks are taken over
    sorted ranges, so no task orders all pixels, or all of a scene, or all draws.
    """
    spark = eligible.sparkSession
    total = eligible.count()
    if not total:
        return eligible.select(F.lit(0).cast("long").alias("sample_idx"), *eligible.columns).limit(0)
    listed = numbered(eligible, [scene, *order], "_global")
    chosen = draws(spark, n, seed, total).join(listed, F.col("value") == F.col("_global"))
    return numbered(chosen, ["_global", "draw"], "sample_idx").select("sample_idx", *eligible.columns)


def holdout_positions(tasks: DataFrame, valid: str, seed: str, least: int) -> DataFrame:
    """Adds target_index, the valid position that one draw from seed picks; NULL (skipped) with least or fewer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["target_index"] = pd.array([int(v[Generator(int(s)).below(len(v))]) if v is not None and len(v) > least else None for v, s in zip(b[valid], b[seed], strict=True)], dtype="Int64")
            yield b

    return tasks.mapInPandas(run, tasks.withColumn("target_index", F.lit(0).cast("long")).schema)
