"""Sharding by balanced label propagation, with DataFrame functions only.

Linked documents (those of one hub; here equal texts) are moved towards each other under capacity quotas:

* Every document starts in a shard by hash. The state is a table of cells (hub, shard, number of documents), a few rows
  per hub, so copies of one text never meet as pairs.
* In each round a hub's targets are its fullest shards with room for the rest of it, as many as it needs at a shard's
  capacity (one for all but very large hubs). Its documents elsewhere ask to move there. For each pair of shards a quota
  admits as many as move the other way, plus a share of the room left in the target; askers are admitted by falling gain
  (links won by the move), which running sums over (gain, salt) parts decide without sorting all askers of a pair in one task.
* Rounds go on while they join at least a 100th of the parts that hubs are still cut into.
* Where groups fill the shards, quotas stall: nothing has room to move. Then hubs that are still cut, and whole ones that a
  shard can't hold, swap places at once: they are lined up, large ones first, along the room that the others leave, and each
  goes whole where it begins. Only the hubs on the borders of two shards, one a border, may have to be cut.
* What is linked to nothing fills the shards up, so that sizes are exactly even (law `rows`: at most one apart).

Cells then become documents by the rank within their hub, ranks being taken from salted parts; hubs of a 1000th of all rows or
more (1000 at most) are broadcast, all others shuffled. All ties are broken by hashes of the data, and the number of parts
follows from the number of rows: shards do not depend on how the session deals its partitions.

Defined cases: a null text counts as empty (size 1, crc32 0) and is linked with other empty ones; rows that repeat a
doc_id, also a null one, are placed one by one; with fewer rows than shards, some shards stay empty; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, ranked, save, small, utf8

SHARDS, SALTS = 8, 512
#: Rows of one hub or shard that a task ranks, about.
PART_ROWS = 1_000_000


def text_hubs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, hub: the hub of equal texts is their SHA-256."""
    body = utf8(F.col(text_col).cast("string"))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"), F.sha2(body, 256).alias("hub")
    )


def _before(*order) -> Window:
    return Window.partitionBy("shard", "target").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _asks(cells: DataFrame, capacity: int, rooms: list[int], turn: int) -> DataFrame:
    """(hub, shard, target, n, gain): documents that ask to move, from the hub's own shares (one per shard at most).

    A hub wants ceil(all / capacity) targets. Shards where the rest of the hub fits come first, then its fullest ones, then
    a hash of hub and turn; the roomiest shard is a choice even if the hub has nothing there. Each other share goes to
    the target whose running demand its own running number falls into, in pieces where it spans two.
    """
    spare = max(range(len(rooms)), key=lambda s: rooms[s])
    hubs = cells.groupBy("hub").agg(F.sum("n").alias("all"), F.collect_list(F.struct("n", "shard")).alias("shares"))
    hubs = hubs.withColumn("need", F.ceil(F.col("all") / F.lit(capacity)).cast("int")).filter(F.size("shares") > F.col("need"))
    room = f"element_at(array({','.join(f'{r}L' for r in rooms)}), x.shard + 1)"
    more = f"concat(shares, filter(array(named_struct('n', 0L, 'shard', {spare})), y -> NOT exists(shares, z -> z.shard = y.shard)))"
    rated = f"transform({more}, x -> named_struct('fits', {room} >= least(all - x.n, {capacity}L), 'n', x.n, 'tie', pmod(xxhash64(hub, x.shard, {turn}), 65536), 'shard', x.shard, 'room', {room}))"
    hubs = hubs.withColumn("rated", F.sort_array(F.expr(rated), asc=False))
    targets = F.expr(f"transform(slice(rated, 1, need), x -> named_struct('target', x.shard, 'have', x.n, 'wants', greatest(least({capacity} - x.n, x.room), 0L)))")
    rest = F.expr("filter(slice(rated, need + 1, size(rated)), x -> x.n > 0)")
    running = lambda a, value, kind: F.expr(  # noqa: E731  each element with the sum of what stands before it
        f"aggregate({a}, named_struct('s', 0L, 'o', cast(array() as array<struct<x:{kind},low:bigint,high:bigint>>)), "
        f"(s, x) -> named_struct('s', s.s + x.{value}, 'o', concat(s.o, array(named_struct('x', x, 'low', s.s, 'high', s.s + x.{value}))))).o"
    )
    hubs = hubs.withColumn("targets", targets).withColumn("rest", rest)
    hubs = hubs.withColumn("t", running("targets", "wants", "struct<target:int,have:bigint,wants:bigint>"))
    hubs = hubs.withColumn("r", running("rest", "n", "struct<fits:boolean,n:bigint,tie:bigint,shard:int,room:bigint>"))
    met = hubs.select("hub", F.explode("r").alias("r"), "t").select("hub", "r", F.explode("t").alias("t"))
    n = F.least("r.high", "t.high") - F.greatest("r.low", "t.low")
    return met.select("hub", F.col("r.x.shard").alias("shard"), F.col("t.x.target").alias("target"), n.alias("n"), (F.col("t.x.have") - F.col("r.x.n") + 1).alias("gain")).filter("n > 0")


def propagate(cells: DataFrame, capacity: int, shards: int = SHARDS) -> DataFrame:
    """Cells (hub, shard, n) after balanced label propagation; no shard gets more linked documents than capacity, or than
    it had."""
    spark = cells.sparkSession
    turn, parts_before = 0, cells.count()
    while parts_before:
        loads = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # `shards` rows
        rooms = [max(0, capacity - loads.get(t, 0)) for t in range(shards)]
        asks = save(_asks(cells, capacity, rooms, turn), "shard-asks")
        flows = {(r.shard, r.target): r.n for r in asks.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}  # shards squared
        quotas = {k: min(n, flows.get(k[::-1], 0)) for k, n in flows.items()}
        for t in range(shards):
            room = rooms[t]
            for k in sorted((k for k in flows if k[1] == t), key=lambda k: (-flows[k], k)):
                more = min(room, flows[k] - quotas[k])
                quotas[k] += more
                room -= more
        if not any(quotas.values()):
            break
        limits = spark.createDataFrame([(s, t, q) for (s, t), q in sorted(quotas.items())], "shard int, target int, quota long")
        lined = _lined_up(asks, ["shard", "target"], F.greatest("gain", F.lit(1)), _salts(parts_before))
        room = F.least(F.col("n"), F.greatest(F.lit(0), F.col("quota") - F.col("low")))
        moves = save(lined.join(F.broadcast(limits), ["shard", "target"]).withColumn("n", room).filter("n > 0").select("hub", "shard", "target", "n"), "shard-moves")
        change = cells.select("hub", "shard", "n").unionByName(moves.select("hub", F.col("target").alias("shard"), "n")).unionByName(moves.select("hub", "shard", (-F.col("n")).alias("n")))
        cells = save(change.groupBy("hub", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "shard-cells")
        turn, parts = turn + 1, cells.count()
        if parts > 0.99 * parts_before:
            break
        parts_before = parts
    return cells


def _salts(rows: int) -> int:
    return max(SALTS, rows // PART_ROWS)


def _lined_up(rows: DataFrame, by: list[str], weight, salts: int) -> DataFrame:
    """Adds low, the sum of n of the rows before each one of the same `by`: by falling weight in powers of two, then by salts, then
    by hub, so that the running sums are taken over parts."""
    step = -F.floor(F.log2(weight.cast("double"))).cast("int")
    salted = rows.withColumn("step", step).withColumn("salt", F.pmod(F.xxhash64("hub"), F.lit(salts)).cast("int"))
    sums = salted.groupBy(*by, "step", "salt").agg(F.sum("n").alias("s"))
    before = Window.partitionBy(*by).orderBy("step", "salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select(*by, "step", "salt", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(*by, "step", "salt").orderBy("hub").rowsBetween(Window.unboundedPreceding, -1)
    own = salted.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(small(firsts), [*by, "step", "salt"])
    return own.withColumn("low", (F.col("first") + F.col("own")).cast("long")).drop("step", "salt", "first", "own")


def settle(cells: DataFrame, rooms: list[int]) -> DataFrame:
    """Cells (hub, shard, n) that fit into the rooms, all hubs whole but those that lie on the border of two shards."""
    spark = cells.sparkSession
    salts = _salts(cells.count())
    of = lambda values, shard: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), shard + 1)
    hubs = cells.groupBy("hub").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.min("shard").alias("shard"))
    whole = _lined_up(hubs.filter("parts = 1"), ["shard"], F.col("n"), salts)
    whole = whole.withColumn("fits", F.col("low") + F.col("n") <= of(rooms, F.col("shard")))
    judged = save(whole.select("hub", "shard", "n", "fits").unionByName(hubs.filter("parts > 1").select("hub", "shard", "n", F.lit(False).alias("fits"))), "shard-settling")
    kept = {r.shard: r.n for r in judged.filter("fits").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    free = [room - kept.get(s, 0) for s, room in enumerate(rooms)]
    ends = [sum(free[: s + 1]) for s in range(len(free))]
    lined = _lined_up(judged.filter("NOT fits").withColumn("_one", F.lit(0)), ["_one"], F.col("n"), salts)
    at = lambda place: F.size(F.filter(F.array(*[F.lit(int(e)).cast("long") for e in ends]), lambda e: e <= place))
    lined = save(lined.select("hub", "n", at(F.col("low")).alias("shard"), at(F.col("low") + F.col("n") - 1).alias("last")), "shard-lined")
    inside = lined.filter("shard = last")
    taken = {r.shard: r.n for r in inside.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    left = [f - taken.get(s, 0) for s, f in enumerate(free)]
    rows = []
    for r in sorted(lined.filter("shard < last").collect(), key=lambda r: (-r.n, r.hub)):  # one at each border of two shards at most
        n = r.n
        while n:
            fitting = [s for s in range(len(left)) if left[s] >= n]
            s = min(fitting, key=lambda s: (left[s], s)) if fitting else max(range(len(left)), key=lambda s: (left[s], -s))
            rows.append((r.hub, s, min(n, left[s])))
            n -= rows[-1][2]
            left[s] -= rows[-1][2]
    placed = judged.filter("fits").select("hub", "shard", "n").unionByName(inside.select("hub", "shard", "n"))
    return save(placed.unionByName(spark.createDataFrame(rows, placed.schema)), "shard-cells")


def shard_rows(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Places rows (doc_id, size, hub, ...) under the law `rows`: adds law, shard, slot, grown_shard.

    Any `hub` column will do: documents of one hub are linked.
    """
    rows = save(rows, "shard-rows")
    total = rows.count()
    salts = _salts(total)
    counts = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    linked = counts.filter("members > 1")
    many = save(lookup(rows, linked.withColumn("c", F.col("members")), ["hub"], "c", total), "shard-linked")
    room = [total // shards + (s < total % shards) for s in range(shards)]
    spread = many.filter("members IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "hub"), F.lit(shards)).cast("int"))
    cells = save(spread.groupBy("hub", F.col("_salt").alias("shard")).agg(F.count(F.lit(1)).alias("n")), "shard-cells")
    cells = settle(propagate(cells, max(1, total // shards), shards), room)
    # documents of a hub take its cells by their rank in the hub
    own = Window.partitionBy("hub").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bounds = cells.withColumn("low", F.coalesce(F.sum("n").over(own), F.lit(0)))
    bounds = bounds.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("low", (F.col("low") + F.col("n")).alias("high"), "shard"))).alias("cells"), F.sum("n").alias("c"))
    inner = many.filter("members IS NOT NULL")
    inner = ranked(inner, ["hub"], [F.col("doc_id")], "rank", salts, F.xxhash64("doc_id", "size"))
    inner = lookup(inner, bounds, ["hub"], "c", total)
    inner = inner.withColumn("shard", F.filter("cells", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["high"]))[0]["shard"])
    base = [c for c in rows.columns]
    inner = ranked(inner.select(*base, "shard"), ["shard"], [F.col("doc_id"), F.col("hub")], "slot", salts, F.xxhash64("doc_id", "hub"))
    # what is linked to nothing fills the shards up in the order of its own rank
    pool = many.filter("members IS NULL").select(*base).withColumn("_one", F.lit(0))
    pool = ranked(pool, ["_one"], [F.col("doc_id"), F.col("hub")], "rank", salts, F.xxhash64("doc_id", "hub")).drop("_one")
    taken = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    low, intervals = 0, []
    for s in range(shards):
        free = room[s] - taken.get(s, 0)
        intervals.append(F.struct(F.lit(low).cast("long").alias("low"), F.lit(low + free).cast("long").alias("high"), F.lit(s).alias("shard"), F.lit(taken.get(s, 0)).cast("long").alias("first")))
        low += free
    place = F.filter(F.array(*intervals), lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["high"]))[0]
    pool = pool.withColumn("p", place).select(*base, F.col("p.shard").alias("shard"), (F.col("p.first") + F.col("rank") - F.col("p.low")).alias("slot"))
    out = inner.select(*base, "shard", "slot").unionByName(pool)
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, hub, shard, slot, law, grown_shard of every row of docs."""
    return shard_rows(text_hubs(docs, id_col, text_col), shards)


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes documents with their texts under path, partitioned by shard and in the order of slots.

    Rows are matched by doc_id and text; equal rows are interchangeable, so each gets one of their places.
    """
    order = Window.partitionBy("doc_id", "hub")
    texts = docs.select("*", F.col(id_col).cast("long").alias("_id"), F.sha2(utf8(F.col(text_col).cast("string")), 256).alias("_hub"))
    texts = texts.withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_hub").orderBy(F.lit(0))))
    spots = placed.select("doc_id", "hub", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).withColumn("_at", F.row_number().over(order.orderBy("_shard", "_slot")))
    same = F.col("_id").eqNullSafe(F.col("doc_id_")) & (F.col("_hub") == F.col("hub_")) & (F.col("_copy") == F.col("_at"))
    joined = texts.join(spots.withColumnRenamed("doc_id", "doc_id_").withColumnRenamed("hub", "hub_"), same)
    kept = joined.select(*docs.columns, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
    kept.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
