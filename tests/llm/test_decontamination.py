"""Leaks against a search that tries every template at every offset of every document."""

import random
from collections import Counter

import brute
import pytest

from chronopix.llm import decontaminate

def found(spark, docs, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(brute.documents(spark, list(enumerate(docs))), table).collect()
    first = {}
    for r in decontaminate.benchmark_items(table).collect():
        first[r.template] = min(r.item_id, first.get(r.template, r.item_id))
    return {(r.doc_id, first[r.template]): (r.kind, r.n_matched) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leaks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bo", "cat", "dig", "ever", "fox", "give", "hat", "in", "jar", "km"])
    token = lambda: rng.choice([word, word, word, lambda: str(rng.randint(1, 12)), lambda: rng.choice(["Anna", "Berta", "Carl"]), lambda: f"{rng.randint(1, 9)} kg", lambda: "1,5"])()
    items = [(i, " ".join(token() for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14, 25])))) for i in range(40)]
    items += [(100, "12 34 56"), (101, "Name planets"), (102, "7"), (103, None), (104, ""), (105, items[3][1]), (106, "Anna gives 5 pears to Berta and 5 to Carl")]

    def edited(text):
        parts = text.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            parts[rng.randrange(len(parts))] = token()
        return " ".join(parts)

    docs = []
    for _ in range(60):
        parts = [" ".join(token() for _ in range(rng.randint(0, 6)))]
        for _ in range(rng.randint(0, 2)):
            t = edited(rng.choice([x for x in items if x[1]])[1])
            parts += [rng.choice([t, t, t.lower()]), " ".join(token() for _ in range(rng.randint(0, 5)))]
        docs.append(" ".join(p for p in parts if p))
    docs += [None, "", "x 12 34 56 y", "then name planets", "Zoe gives 6 pears to Doris and 6 to Emil", "so Anna gives 6 pears to Doris and 7 to Emil", "lost in " * 300 + items[7][1]]
    want = brute.leaks(docs, items)
    assert len(want) > 40 and len({k for k, _ in want.values()}) == 3
    assert found(spark, docs, items) == want


def test_one_row_per_document_and_template(spark):
    """300 items of one template, 200 documents of it."""
    items = spark.createDataFrame([(i, f"Anna buys {i} apples and pays {i + 7} euros to a farmer") for i in range(300)], "item_id long, text string")
    docs = [(i, f"then Zoe buys {i + 200} apples and pays {i + 207 + (i % 2)} euros to a farmer") for i in range(200)]
    rows = decontaminate.find_leaks(brute.documents(spark, docs), items).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200)) and {r.n_items for r in rows} == {300}
    assert Counter(r.kind for r in rows) == {"reparameterised": 200}
    same = decontaminate.find_leaks(brute.documents(spark, [(1, "they say Anna buys 9 apples and pays 16 euros to a farmer")]), items).collect()
    assert [(r.item_id, r.kind) for r in same] == [(9, "exact")]


def test_short_items_are_found_but_drop_nothing(spark):
    items = spark.createDataFrame([(1, "Name planets"), (2, "42"), (None, "12 34 56")], "item_id long, text string")
    docs = brute.documents(spark, [(1, "please name planets 42 42"), (2, "name the planets"), (3, "at 12 34 56 sharp"), (4, "at 12 34 57 sharp")])
    rows = decontaminate.find_leaks(docs, items)
    assert {(r.doc_id, r.item_id, r.first_word) for r in rows.collect()} == {(1, 1, 1), (1, 2, 3), (3, None, 1)}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, rows).collect()} == {1, 2, 4}


def test_the_first_of_equally_good_alignments(spark):
    text = "which of the three rivers is the longest one"
    docs = brute.documents(spark, [(1, f"{text} . {text}"), (1, f"{text} . {text}"), (1, "x " + text)])
    rows = decontaminate.find_leaks(docs, spark.createDataFrame([(5, text), (4, text)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.n_items, r.first_word) for r in rows.collect()) == [(1, 4, 2, 0), (1, 4, 2, 1)]
