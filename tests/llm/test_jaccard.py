import random
from collections import Counter

import brute
import numpy as np
import pytest

from chronopix.llm import jaccard, shingles


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_hard_cases(spark):
    docs = brute.hard_documents(spark)
    assert found(jaccard.similar_components(docs)) == brute.jaccard_components([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert jaccard.similar_components(brute.empty_documents(spark)).collect() == []


def random_corpus(seed, n=120):
    """Families of edited copies around the threshold, a passage that many share, and loners."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(n // 6):
        base = [word() for _ in range(rng.randrange(3, 150))]
        for _ in range(rng.randrange(1, 8)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                at = rng.randrange(len(own))
                own[at:at] = passage
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpora(spark, seed):
    rows = random_corpus(seed)
    assert found(jaccard.similar_components(brute.documents(spark, rows))) == brute.jaccard_components(rows)


def test_large_clusters_in_blocks(spark, monkeypatch):
    for k, v in (("BIG", 8), ("CLUSTER", 6), ("BLOCK", 4)):
        monkeypatch.setattr(jaccard, k, v)
    rows = random_corpus(7, 200)
    base = [f"h{i}" for i in range(80)]
    rng = random.Random(5)
    for _ in range(40):  # a chain and a star of copies that are similar to some others only
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(80)] = f"z{rng.randrange(1000)}"
        rows.append((len(rows), " ".join(own)))
    assert found(jaccard.similar_components(brute.documents(spark, rows))) == brute.jaccard_components(rows)


def test_hot_shingles_in_salted_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 16)
    rows = [(i, brute.BASE + (f" end{i}" if i % 3 else "")) for i in range(60)] + [(100 + i, f"other text number {i} of its own kind here {i}") for i in range(20)]
    assert found(jaccard.similar_components(brute.documents(spark, rows))) == brute.jaccard_components(rows)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(4)
    universe = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    sets = []
    for _ in range(60):
        base = rng.choice(universe, rng.integers(5, 300), replace=False)
        for _ in range(3):
            drop = rng.random(len(base)) < 0.06
            sets.append(np.unique(np.concatenate((base[~drop], rng.choice(universe, drop.sum())))))
    n = np.array([len(s) for s in sets])
    got = {tuple(sorted(p)) for i, j in jaccard.candidate_pairs(n, [jaccard.bitmap(s) for s in sets]) for p in zip(i.tolist(), j.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert (b, a) in got
    assert len(got) < 0.2 * len(sets) ** 2 / 2


def test_word_hashes_follow_words():
    texts = ["One two", "", "one  TWO\n", "two", " x", "onetwo"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    h, at = shingles.word_hashes(data, bounds)
    assert np.diff(at).tolist() == [2, 0, 2, 1, 1, 1]
    assert h[0] == h[2] and h[1] == h[3] == h[4] and len(set(h.tolist())) == 4


def test_keep_one(spark):
    rows = [(1, brute.BASE), (2, brute.BASE), (3, "something else entirely"), (5, brute.BASE + " x"), (7, "again"), (7, "again"), (None, "no id")]
    docs = brute.documents(spark, rows)
    kept = jaccard.keep_one(docs, jaccard.similar_components(docs))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "7", "None"]


@pytest.mark.parametrize("small", [0, 1000])
def test_components_in_one_task_and_in_rounds(spark, small):
    from chronopix.llm.common import components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(-40, 40)] + [(500, 400 + i) for i in range(60)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(120)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"), small).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, find(x)) for x in up)
    assert components(spark.createDataFrame(edges, "a long, b long").limit(0), small).collect() == []


def test_long_texts_in_pieces(monkeypatch):
    """A text that is cut has the words and trigrams of one that is not, also where a word is longer than a piece."""
    from chronopix.llm import language

    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcÄ") for _ in range(rng.choice([1, 4, 9, 700]))) for _ in range(300)).encode()
    data, bounds = np.frombuffer(b"xx" + text, dtype=np.uint8), np.array([2, 2 + len(text)])
    whole, grams = shingles.word_hashes(data, bounds), language.text_grams(data, bounds)
    for size in (64, 500):
        monkeypatch.setattr(shingles, "BATCH_BYTES", size)
        monkeypatch.setattr(language, "BATCH_BYTES", size)
        assert all((a == b).all() for a, b in zip(whole, shingles.word_hashes(data, bounds), strict=True))
        assert all((a == b).all() for a, b in zip(grams, language.text_grams(data, bounds), strict=True))


def links_of(rows):
    """{row number: how many others it is linked with}"""
    sets = [brute.shingles(t) for _, t in rows]
    near = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    return Counter((rows[a][0], len(sets[a]), sum(bool(near(a, b)) for b in range(len(rows)) if b != a)) for a in range(len(rows)))


@pytest.mark.parametrize("big", [1024, 4])
def test_all_links(spark, monkeypatch, big):
    """Numbers of links, also where runs, and runs of two shingles, are larger than what a tree gets."""
    monkeypatch.setattr(jaccard, "BIG", big)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = random_corpus(9, 150) + [(None, "no id " + brute.BASE), (None, "no id " + brute.BASE), (7000, ""), (7001, None)]
    base = [f"h{i}" for i in range(60)]
    rng = random.Random(5)
    for _ in range(30):
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(60)] = f"z{rng.randrange(1000)}"
        rows.append((len(rows), " ".join(own)))
    links, members = jaccard.similar_pairs(brute.documents(spark, rows))
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in jaccard.link_counts(links, members).collect()) == links_of(rows)


def test_a_star_of_unlike_classes(spark, monkeypatch):
    """Thousands of sets with one rare shingle in common: no pair is checked, but a pair of near copies among them is found."""
    monkeypatch.setattr(jaccard, "BIG", 64)
    pairs = []
    exact = jaccard.exact_pairs
    monkeypatch.setattr(jaccard, "exact_pairs", lambda p, s: pairs.append(p.count()) or exact(p, s))
    own = lambda i: " ".join(f"u{i}x{k}" for k in range(25))
    rows = [(i, f"five words that all share {own(i)}") for i in range(3000)] + [(5000, f"five words that all share {own(17)} tail")]
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(brute.documents(spark, rows)).collect()}
    assert got == {i: i for i in range(3000)} | {5000: 17} and sum(pairs) < 100


@pytest.mark.parametrize("least", [16, 4])
def test_without_is_exact(spark, monkeypatch, least):
    """Also where the bitmap marks many rows by chance."""
    from pyspark.sql import functions as F

    from chronopix.llm import common

    if least < 16:
        marked = common.marked
        monkeypatch.setattr(common, "marked", lambda df, wanted, key, bits=22, others=False: marked(df, wanted, key, 7, others))
    docs = brute.documents(spark, [(i if i % 5 else None, f"text {i}") for i in range(600)])
    key = common.row_key("doc_id", "text")
    for share in (2, 601):
        gone = docs.filter(F.expr(f"cast(substring(text, 6) as int) % {share} = 1")).select(key.alias("row_key"))
        left = common.without(docs, gone, key)
        assert left.columns == docs.columns
        assert sorted(r.text for r in left.collect()) == sorted(f"text {i}" for i in range(600) if i % share != 1)
    assert common.without(docs, docs.limit(0).select(key.alias("row_key")), key).count() == 600


def test_pairs_that_meet_by_chance_end_as_keys(spark, monkeypatch):
    """Where the sketch tells no rare shingle from others, as on large inputs, unlike sets meet in a prefix shingle: no bitmap is sent for them."""
    monkeypatch.setattr(jaccard, "sketch_classes", lambda table: (np.zeros(1 << jaccard.SKETCH, dtype=np.uint8), 0))
    own = lambda i: " ".join(f"u{i}x{k}" for k in range(12))
    rows = [(i, f"{own(i)} five words of group{i // 4} alone {own(-i - 1)}") for i in range(400)] + [(5000, f"{own(17)} five words of group4 alone {own(-18)} tail")]
    c = jaccard.candidates(brute.documents(spark, rows))
    assert {frozenset(bytes(s) for s in r.sigs) for r in c.found.collect()} == {frozenset(bytes(r.sig) for r in c.rows.filter("doc_id IN (17, 5000)").collect())}
    rows = random_corpus(4)
    assert found(jaccard.similar_components(brute.documents(spark, rows))) == brute.jaccard_components(rows)


def test_dense_runs_send_few_copies(spark, monkeypatch):
    """Runs of a cluster with nearly the same classes, of which few are outside, are taken together; runs with none in common one by one. No pair is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    name = lambda k: k.to_bytes(16, "big")
    alike = [(run, name(k), k < 6) for run in range(20) for k in range(200) if (k + run) % 10]
    unlike = [(100 + run, name(1000 + 200 * run + k), k < 20) for run in range(6) for k in range(100)]
    roots = [(s, name(1000) if int.from_bytes(s, "big") >= 1000 else name(0)) for s in {x[1] for x in alike + unlike}]
    members = spark.createDataFrame(alike + unlike, "run long, sig binary, outside boolean")
    blocks = jaccard.dense_blocks(members, spark.createDataFrame(roots, "sig binary, root binary"))
    tasks = {}
    sent = Counter()
    for r in jaccard.dense_tasks(blocks.selectExpr("*", "sig AS tokens", "sig AS label")).collect():
        tasks.setdefault((r.root, r.i, r.j), ([], []))[r.part].append(bytes(r.sig))
        sent[int.from_bytes(r.sig, "big") >= 1000] += 1
    met = {frozenset((a, b)) for every, outside in tasks.values() for a in outside for b in every + outside}
    for run in {x[0] for x in alike + unlike}:
        own = [x for x in alike + unlike if x[0] == run]
        assert all(frozenset((bytes(a[1]), bytes(b[1]))) in met for a in own if a[2] for b in own)
    # together 200 classes for one block of outside ones and 6 for 13 blocks; apart 6 runs, each 100 for two blocks and 20 for 7
    assert sent[False] == 200 + 6 * 13
    assert sent[True] == 6 * (100 * 2 + 20 * 7)
    assert max(len(every) + len(outside) for every, outside in tasks.values()) < 80


def test_dense_runs_end_to_end(spark, monkeypatch):
    """A large cluster whose runs share most classes: links are exact, and sets are sent a few times, not once for each block of each run."""
    for k, v in (("BIG", 8), ("CLUSTER", 6), ("BLOCK", 4)):
        monkeypatch.setattr(jaccard, k, v)
    sent, gather = [], jaccard._gather
    monkeypatch.setattr(jaccard, "_gather", lambda tasks: sent.append(tasks.count()) or gather(tasks))
    rng = random.Random(11)
    rows = []
    for i in range(60):
        own = [f"h{k}" for k in range(80)]
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(80)] = f"z{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    assert found(jaccard.similar_components(brute.documents(spark, rows))) == brute.jaccard_components(rows)
    assert len(sent) == 2 and sent[1] <= 1000
