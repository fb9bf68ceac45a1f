import math
import zlib
from collections import Counter

import brute
import pytest

from chronopix.llm import sharding


def check(rows, docs, shards):
    want = Counter()
    for r in docs.collect():
        raw = (r.text or "").encode()
        want[(r.doc_id, len(raw) + 1, zlib.crc32(raw))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    sizes = Counter(r.shard for r in rows)
    counts = [sizes[s] for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    groups = {}
    for r in rows:
        groups.setdefault((r.size, r.text_crc32), Counter())[r.shard] += 1
    return groups


def test_hard_cases(spark):
    docs = brute.hard_documents(spark)
    rows = sharding.shard_documents(docs, 4).collect()
    groups = check(rows, docs, 4)
    hot = max(groups.values(), key=lambda c: sum(c.values()))
    assert sum(hot.values()) == 40 and len(hot) <= math.ceil(40 / (len(rows) // 4)) + 1


def test_copies_stay_together(spark):
    rows = [(i, f"text {i % 150}") for i in range(300)] + [(1000 + i, f"alone {i}") for i in range(100)]
    docs = brute.documents(spark, rows)
    groups = check(sharding.shard_documents(docs, 8).collect(), docs, 8)
    assert sum(len(c) > 1 for c in groups.values()) <= 4


def test_a_third_of_all_rows(spark):
    rows = [(i, "the same") for i in range(200)] + [(1000 + i, f"pair {i // 2}") for i in range(100)] + [(2000 + i, f"alone {i}") for i in range(300)]
    docs = brute.documents(spark, rows)
    groups = check(sharding.shard_documents(docs, 8).collect(), docs, 8)
    assert len(groups[len("the same") + 1, zlib.crc32(b"the same")]) <= 5
    assert sum(len(c) > 1 for c in groups.values()) <= 4


FULL = {
    "pairs": [(i, f"pair {i // 2}") for i in range(2000)],
    "triples": [(i, f"triple {i // 3}") for i in range(2970)] + [(5000 + i, f"alone {i}") for i in range(30)],
    "mix": [(i, "the same") for i in range(300)] + [(1000 + i, f"pair {i // 2}") for i in range(400)] + [(3000 + i, f"seven {i // 7}") for i in range(700)],
}


@pytest.mark.parametrize("kind", FULL)
def test_groups_that_fill_the_shards(spark, kind):
    """At most a group for each border of two shards is cut, and the session's partitions do not matter."""
    docs = brute.documents(spark, FULL[kind])
    rows = sharding.shard_documents(docs, 8).collect()
    groups = check(rows, docs, 8)
    assert sum(len(c) > 1 for c in groups.values()) <= 8
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = sharding.shard_documents(docs.repartition(5), 8).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    place = lambda rows: sorted((r.doc_id, r.shard, r.slot) for r in rows)
    assert place(rows) == place(again)


@pytest.mark.parametrize("share", [0.6, 0.9])
def test_room_to_move(spark, share):
    n = int(1000 * share) // 2 * 2
    docs = brute.documents(spark, [(i, f"pair {i // 2}") for i in range(n)] + [(5000 + i, f"alone {i}") for i in range(1000 - n)])
    assert sum(len(c) > 1 for c in check(sharding.shard_documents(docs, 8).collect(), docs, 8).values()) == 0


@pytest.mark.parametrize("n", [0, 3])
def test_fewer_rows_than_shards(spark, n):
    docs = brute.documents(spark, [(i, "x") for i in range(5)]).limit(n)
    rows = sharding.shard_documents(docs, 8).collect()
    assert len(rows) == n and len({(r.shard, r.slot) for r in rows}) == n


def test_written_shards(spark, tmp_path):
    docs = brute.hard_documents(spark)
    placed = sharding.shard_documents(docs.drop("shard"), 4)
    sharding.write_shards(docs.drop("shard"), placed, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard", "slot").distinct().count() == docs.count()
