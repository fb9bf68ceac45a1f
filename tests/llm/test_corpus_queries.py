import random
from collections import Counter

import brute
import pytest
from compare import same_rows
from pyspark.sql import functions as F

from chronopix.llm import queries, tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    same_rows(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_pipeline(spark):
    import corpus_pipeline as p

    names = [n for n, _ in p.STAGES]
    assert names == ["language", "quality", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.count()
    for name, stage in p.STAGES[:-1]:
        after = p.save(stage(spark, docs, SF), f"test-{name}")
        assert after.columns == docs.columns and 0 < after.count() <= seen
        docs, seen = after, after.count()
    kept = {r.doc_id for r in docs.collect()}
    packed = p.packing_stage(spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == kept


def test_stages_do_their_work(spark):
    import corpus_pipeline as p
    from chronopix.llm import jaccard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = p.save(p.near_duplicate_stage(spark, docs, SF), "test-one")
    again = jaccard.similar_components(one)
    assert again.filter("component_id <> doc_id").count() == 0 and one.count() < docs.count()
    clean = p.save(p.decontamination_stage(spark, docs, SF), "test-clean")
    assert p.decontamination_stage(spark, clean, SF).count() == clean.count() < docs.count()


def words_of(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def planted_corpus(seed=3):
    """Clean, junk, copied and leaking documents in two languages; some without an id, some that share one."""
    rng = random.Random(seed)
    vocabulary = {k: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(60)] for k in ("aa", "bb")}
    item = "which of " + words_of(rng, vocabulary["aa"], 12) + " 7 or 9"
    clean = [(i, words_of(rng, vocabulary["ab"[i % 2] * 2], rng.randint(60, 90)), "ab"[i % 2] * 2, f"s{i % 3}.x") for i in range(120)]
    junk = [(1000 + i, "!!!" + " @@ ## 12".join(words_of(rng, vocabulary["aa"][:3], 2).upper() for _ in range(30)), "aa", "s0.x") for i in range(40)]
    rows = clean + junk
    rows += [(2000, clean[4][1], "aa", None), (2001, clean[4][1] + " more", "aa", None), (None, clean[4][1], "aa", None), (None, clean[6][1] + " tail", "aa", "s1.x")]
    rows += [(None, junk[0][1], "aa", None), (None, junk[1][1], "aa", None), (None, clean[7][1][::-1], "bb", None)]
    rows += [(3000, clean[8][1][:80] + " " + item + " " + clean[9][1][:200], "aa", None), (None, clean[10][1][:80] + " " + item.replace("7", "8") + " " + clean[11][1][:200], "aa", None)]
    rows += [(3, "!!! 123", "bb", None), (None, None, "aa", None), (4000, "", None, None), (5, clean[5][1], "bb", "s2.x")]
    labels = [(r[0], int(r[0] < 1000)) for r in clean + junk]
    return rows, labels, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rows, labels, items = planted_corpus()
    folder = tmp_path_factory.mktemp("planted")
    brute.documents(spark, rows).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}", rows, dict(labels), items


def test_pipeline_equals_brute_force(spark, planted):
    """Each stage's rows, and the packed ids, by plain versions of all operators."""
    import corpus_pipeline as p

    folder, rows, labels, items = planted
    left = sorted(set(rows) - {r for r in rows if rows.count(r) > 1}, key=str) + [r for r in dict.fromkeys(rows) if rows.count(r) > 1 for _ in range(rows.count(r))]
    docs = p.table(spark, folder, "documents")
    kept = brute_kept = None
    for (_name, stage), keep in zip(p.STAGES[:-1], (brute.keep_language, lambda x: brute.keep_quality(x, labels), brute.keep_first, lambda x: brute.keep_clean(x, items)), strict=True):
        docs = p.save(stage(spark, docs, folder), "test-stage")
        left = keep(left)
        kept, brute_kept = Counter((r.doc_id, r.text) for r in docs.collect()), Counter((r[0], r[1]) for r in left)
        assert kept == brute_kept, _name
    assert 100 < sum(kept.values()) < 125 and not any(t is None for _, t in kept)
    encode = tokens.encoder(tokens.vocabulary(), "tokenizers")
    by_doc = {}
    for r in p.run(spark, folder).collect():
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    want = {}
    for i, t in brute_kept:
        ids = [*encode(t), 0]
        want.setdefault((i, len(ids)), []).append((0, len(ids), brute.crc(ids)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}


def test_stages_take_empty_tables_and_columns_of_any_name(spark, planted):
    import corpus_pipeline as p

    folder, _, _, _ = planted
    docs = p.table(spark, folder, "documents").withColumn("row_key", F.lit("mine")).withColumn("template", F.lit(1)).withColumn("predicted", F.lit(0))
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).collect() == []
        some = stage(spark, docs, folder)
        assert some.columns == docs.columns and some.select("row_key").distinct().collect() == [("mine",)]
    assert p.packing_stage(spark, docs.limit(0), folder).collect() == []
