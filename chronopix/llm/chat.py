"""Cumulative-snapshot collapse and chat rendering, with DataFrame functions only.

Logs often store a conversation again after every turn. Rolling hashes of turn prefixes find conversations that are a
prefix of longer ones; anti-joins keep the maximal ones, which are then rendered.

A conversation's turns are ordered by (turn, role, text), null turns first; repeated rows are turns of their own. Rows are
dealt in ranges of that order, so that a conversation, or a turn number, with a third of all rows spans many tasks; a row's
position is its place in its range plus what its conversation has in the ranges before. The prefix hash of the first i
turns is four sums of 32-bit lanes of hashes over (position, role, text), so it is a running sum: ranges are summed by
themselves and shifted by the sums before, and no task needs a whole conversation. Of equal conversations the one with the
smallest conv_id stays. Rendered text comes in segments of SEGMENT turns (almost always one), so rows stay bounded too.

Defined cases: null role and text count as empty; rows with a null conv_id form one conversation, whose id comes back as
null, and which no other id, whatever its text, joins; an empty text is a turn, a very long one is kept whole; texts that
differ after ORDERED characters only are ordered by their hashes; an empty table gives an empty result; other columns are not
read. Markers of the template inside texts are broken by a space, which unbroken() takes out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, save

SEGMENT, ORDERED = 256, 256
LANES = ["s1", "s2", "s3", "s4"]
NULL_ID = "-"


def positions(conversations: DataFrame) -> DataFrame:
    """(key, conv_id, span, turn, pos, n_turns, role, text): pos counts a conversation's turns from 1, span is the range of rows."""
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(NULL_ID)).alias("key"), "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid"),
    )
    rows = rows.withColumn("begin", F.substring("text", 1, ORDERED)).withColumn("hash", F.xxhash64("text"))
    order = [F.asc("key"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("begin"), F.asc("hash"), F.asc("uid")]
    dealt = rows.repartitionByRange(max(6, partitions(rows.sparkSession)), *order).sortWithinPartitions(*order)
    sorted_rows = save(dealt.select("key", "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("span")), "chat-sorted")
    counts = sorted_rows.groupBy("key", "span").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("low"))
    every = Window.partitionBy("key")
    before = every.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("key", "span", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("low") + 1).alias("shift"), F.sum("c").over(every).alias("n_turns"))
    return sorted_rows.join(firsts, ["key", "span"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift")


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """(key, pos, n_turns, s1..s4): the hash of each prefix of each conversation."""
    a, b = F.xxhash64("pos", "role", "text"), F.xxhash64(F.lit("second"), "text", "pos", "role")
    low = F.lit(0xFFFFFFFF)
    lanes = [a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32)]
    turns = placed.select("key", "span", "pos", "n_turns", *[x.alias(f"l{i}") for i, x in enumerate(lanes, 1)])
    sums = turns.groupBy("key", "span").agg(*[F.sum(f"l{i}").alias(f"t{i}") for i in range(1, 5)])
    before = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("key", "span", *[F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"f{i}") for i in range(1, 5)])
    running = Window.partitionBy("key", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = turns.select("key", "span", "pos", "n_turns", *[F.sum(f"l{i}").over(running).alias(f"r{i}") for i in range(1, 5)])
    return inside.join(shifts, ["key", "span"]).select("key", "pos", "n_turns", *[(F.col(f"r{i}") + F.col(f"f{i}")).alias(f"s{i}") for i in range(1, 5)])


def maximal(hashes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(key, n_copies): conversations that no longer one begins with; of equal ones that with the smallest id."""
    whole = hashes.filter("pos = n_turns")
    # ids compare as numbers; the null conversation comes last
    first = F.min(F.struct(F.coalesce(F.substring("key", 2, 2**31 - 1).try_cast("long"), F.lit(2**63 - 1)).alias("number"), (F.col("key") == NULL_ID).alias("none"), "key"))
    groups = whole.groupBy("pos", *LANES).agg(first.alias("first"), F.count(F.lit(1)).alias("n_copies"))
    proper = hashes.filter("pos < n_turns").select("pos", *LANES).distinct()
    return groups.join(proper, ["pos", *LANES], "left_anti").select(F.col("first.key").alias("key"), "n_copies")


def broken(text: Column) -> Column:
    """A text without the template's markers: one more space between `<` and `|`."""
    return F.regexp_replace(text, r"<( *)\|", "< $1|")


def unbroken(text: Column) -> Column:
    """The text that broken() got."""
    return F.regexp_replace(text, r"< ( *)\|", "<$1|")


def render(placed: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, rendered)."""
    safe = lambda c: broken(F.col(c))
    turn = F.concat(F.lit("<|im_start|>"), safe("role"), F.lit("\n"), safe("text"), F.lit("<|im_end|>\n"))
    parts = placed.select("key", "conv_id", "n_turns", F.floor((F.col("pos") - 1) / SEGMENT).cast("int").alias("segment"), "pos", turn.alias("turn_text"))
    groups = parts.groupBy("key", "segment").agg(
        F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "turn_text"))).alias("turns")
    )
    return groups.select("key", "conv_id", "segment", "n_turns", F.array_join(F.col("turns.turn_text"), "").alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, segment, n_turns, n_copies, rendered."""
    placed = save(positions(conversations), "chat-turns")
    kept = save(maximal(save(prefix_hashes(placed), "chat-hashes")), "chat-kept")
    chosen = placed.join(kept.select("key"), "key", "left_semi")
    return render(chosen).join(kept, "key").select("conv_id", "segment", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "rendered")


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM rows),
prefixes AS (
  SELECT conv_id, pos, n_turns,
         string_agg(length(role) || ':' || role || length(body) || ':' || body, '') OVER (PARTITION BY conv_id ORDER BY pos) AS p FROM placed),
whole AS (SELECT p, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE pos = n_turns GROUP BY p),
proper AS (SELECT DISTINCT p FROM prefixes WHERE pos < n_turns),
kept AS (SELECT conv_id, n_copies FROM whole WHERE p NOT IN (SELECT p FROM proper))
SELECT placed.conv_id, CAST((pos - 1) // 256 AS INTEGER) AS segment, any_value(n_turns) AS n_turns, any_value(n_copies) AS n_copies,
       string_agg('<|im_start|>' || regexp_replace(role, '<( *)\|', '< \1|', 'g') || chr(10) || regexp_replace(body, '<( *)\|', '< \1|', 'g') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM placed JOIN kept USING (conv_id) GROUP BY placed.conv_id, (pos - 1) // 256
"""
