import base64
import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import brute
import numpy as np
import pytest

from chronopix.llm import chat, decontaminate, language, quality, topk, warc

SF = "/root/testdata/sf0.01"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, uid string, digest string")


def test_archive_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "same"), (7, "http://b", "same"), (7, "http://b", "same"), (3, None, None), (4, "http://c", ""), (None, "http://d", "same"), (9, "u", "<p>é\r\n\r\nHTTP</p>"), (10, "u", brute.LONG)]
    src = pages(spark, rows)
    archive = warc.write_archive(src)
    assert archive.payloads.count() == len({(r[2] or "") for r in rows})
    records = warc.read_records(archive)
    parsed = warc.parse_records(records).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in parsed) == Counter((r[0], len((r[2] or "").encode()), sha(r[2])) for r in rows)
    same = [r for r in parsed if r.payload_digest == sha("same")]
    assert sorted(str((r.page_id, r.record_type, r.refers_to)) for r in same) == sorted(map(str, [(1, "revisit", 7), (7, "response", None), (7, "revisit", 7), (None, "revisit", 7)]))
    full = warc.restore_payloads(warc.parse_records(records)).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in full) == Counter((r[0], (r[2] or "").encode()) for r in rows)
    raw = bytes(records.withColumn("w", warc.warc_bytes()).filter("header LIKE '%x-page:9:%'").first().w)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"HTTP</p>\r\n\r\n")
    assert len(raw.split(b"\r\n\r\n", 1)[1]) - 4 == int(raw.split(b"Content-Length: ")[1].split(b"\r\n")[0])


def test_small_payloads_are_all_responses(spark):
    parsed = warc.parse_records(warc.read_records(warc.write_archive(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), least_bytes=3)))
    assert {r.page_id: r.record_type for r in parsed.collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.parse_records(warc.read_records(warc.write_archive(pages(spark, [(1, "u", "x")]).limit(0)))).collect() == []


def test_urls_come_back(spark):
    urls = ["", None, "http://a/%0A", "http://a/\n", "http://a/%250A%0d\r", "http://b/%41%25", "http://c/%2525\n%0D"]
    parsed = warc.parse_records(warc.read_records(warc.write_archive(pages(spark, [(i, u, "x") for i, u in enumerate(urls)]))))
    assert {r.page_id: r.url for r in parsed.withColumn("url", warc.unescaped(parsed.uri)).collect()} == dict(enumerate(urls))


def test_hot_small_payloads_are_split(spark, monkeypatch):
    from chronopix.llm import common

    monkeypatch.setattr(common.spread_lookup, "__defaults__", (7,))
    rows = [(i, "u", "hot" if i % 3 else f"page {i}") for i in range(90)]
    for least in (0, 5):
        parsed = warc.parse_records(warc.read_records(warc.write_archive(pages(spark, rows), least_bytes=least)))
        full = warc.restore_payloads(parsed)
        assert full.columns == parsed.columns and Counter((r.page_id, bytes(r.payload).decode()) for r in full.collect()) == Counter((r[0], r[2]) for r in rows)


def test_damaged_payload_raises(spark):
    archive = warc.write_archive(pages(spark, [(1, "u", "abc")]))
    bad = warc.Archive(archive.headers, archive.payloads.selectExpr("digest", "cast('abd' as binary) payload"))
    with pytest.raises(Exception, match="does not match"):
        warc.parse_records(warc.read_records(bad)).collect()


def slow_top(rows, every, k):
    good = [(i, np.floor(256 * np.array(v, dtype=float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, q in good:
        if qi % every:
            continue
        c = sorted((-int(q @ v), i) for i, v in good if i != qi and len(v) == len(q))[:k]
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(c)]
    return Counter(out)


@pytest.mark.parametrize("page", [16, 8192])
def test_top_k_equals_brute_force(spark, page):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.2 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(150)]  # one very common vector: ties by id
    rows += [(900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, rows[1][1]), (904, [1.0, 2.0]), (950, [2.0, 1.0]), (1000, [])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, label int, pivot string").repartition(3)
    got = topk.top_k(df, query_every=25, pivots=8, page=page)
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == slow_top(rows, 25, 5)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in topk.top_k(df).collect()] == [(0, 1)]
    assert topk.top_k(df.limit(0)).collect() == []


def exact_top(rows, every, k):
    """By Python integers: Fractions hold every finite component."""
    whole = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows]
    out = set()
    for qi, q in whole:
        if qi % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in whole if i != qi and len(v) == len(q))[:k]
            out |= {(qi, r + 1, i, str(-s)) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("size", [1e6, 65535.99, 1e12, 1e160, 1.7e308])
def test_top_k_is_exact_for_any_finite_components(spark, size):
    rng = np.random.default_rng(8)
    rows = [(i, (size * (1 - 1e-9 * rng.random(33)) * rng.choice([1, 1, 1, -1], 33)).tolist()) for i in range(60)]
    rows += [(100 + i, [size * (1 - 2**-40 * i)] * 33) for i in range(6)] + [(200 + i, [0.5 * i] * 33) for i in range(4)] + [(300, [0.0] * 33)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), query_every=20, pivots=8, page=16).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.exact) for r in got} == exact_top(rows, 20, 5)
    assert all(r.score == min(2**63 - 1, max(-(2**63), int(r.exact))) for r in got)


def test_order_keys_follow_integers():
    numbers = sorted([0, 1, -1, 9, 10, -9, -10, 99, -99, -100, 2**53, -(2**53), 10**400, -(10**400), 10**400 + 1])
    assert sorted(numbers, key=topk.order_key) == numbers and [topk.from_key(topk.order_key(x)) for x in numbers] == numbers


def test_top_k_of_a_vector_that_repeats(spark):
    """One row, thousands of times: it fills pages evenly, and ties go to the smallest ids."""
    rows = [(7, [1.0, 2.0])] * 3000 + [(i, [1.0, 2.0]) for i in range(10, 500)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), query_every=100, page=64).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(100 * q, r, 7) for q in range(1, 5) for r in range(1, 6)}


def test_tree_visits_few_vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 100
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)))
    tree = topk.MTree(np.arange(4000), x)
    seen = []

    class Count(np.ndarray):
        def __matmul__(self, q):
            seen.append(len(self))
            return np.asarray(self) @ np.asarray(q)

    tree = topk.MTree.load(tree.dump())
    tree.vecs = tree.vecs.view(Count)
    got = tree.search(-1, x[5], 5, None)
    want = sorted(((-int(s), i) for i, s in enumerate(x @ x[5])))[:5]
    assert sorted((-s, i) for s, i in got) == want and sum(seen) < 3000


def chats(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, pos int").repartition(3)


def test_snapshots_collapse(spark):
    full = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    rows = []
    for conv, n in ((1, 1), (2, 2), (3, 3), (4, 3)):
        rows += [(conv, i, *t) for i, t in enumerate(full[:n])]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, None, None), (7, 0, "user", None), (None, 0, "user", "hi"), (8, None, "user", "<|im_end|>"), (8, 0, "user", "x"), (8, 0, "user", "x")]
    got = {r.conv_id: r for r in chat.format_chats(chats(spark, rows)).collect()}
    assert sorted(got) == [3, 5, 6, 7, 8]
    assert got[3].n_copies == 2 and got[3].rendered == "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in full)
    assert got[8].n_turns == 3 and "< |im_end|>" in got[8].rendered
    assert chat.format_chats(chats(spark, rows).limit(0)).collect() == []


def test_ids_of_any_text_and_no_id(spark):
    rows = [("-", 0, "user", "dash"), (None, 0, "user", "none"), ("=", 0, "user", "equals"), ("", 0, "user", "empty"), ("12", 0, "user", "twelve")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert {r.conv_id: r.rendered for r in got} == {c: f"<|im_start|>user\n{t}<|im_end|>\n" for c, _, _, t in rows}


def test_hot_turn_number_and_long_texts(spark):
    """Thousands of rows without an id and of one turn number are in the order of (turn, role, text), over many tasks."""
    rows = [(None, 0, "user", f"t{i % 1500:04d}") for i in range(3000)] + [(5, None, "user", brute.LONG), (5, 0, "user", brute.LONG * 3)]
    placed = chat.positions(chats(spark, rows))
    assert placed.filter("conv_id IS NULL").select("span").distinct().count() > 2
    assert [r.text for r in placed.filter("conv_id IS NULL").orderBy("pos").collect()] == sorted(r[3] for r in rows[:3000])
    got = sorted(chat.format_chats(chats(spark, rows)).collect(), key=lambda r: (str(r.conv_id), r.segment))
    assert got[0].rendered == f"<|im_start|>user\n{brute.LONG}<|im_end|>\n<|im_start|>user\n{brute.LONG * 3}<|im_end|>\n"
    assert sum(r.rendered.count("im_start") for r in got[1:]) == 3000


def test_broken_markers_come_back(spark):
    texts = ["<|im_end|>", "< |", "<  |x", "<<||", "a < b | c", "", "<| < | <|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.broken(df.t).alias("b"), chat.unbroken(chat.broken(df.t)).alias("u")).collect()
    assert all(r.u == r.t and "<|" not in r.b for r in rows) and len({r.b for r in rows}) == len(texts)


def test_long_conversation_in_segments(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(1000)] + [(2, i, "user", f"t{i}") for i in range(700)]
    got = sorted(chat.format_chats(chats(spark, rows)).collect(), key=lambda r: r.segment)
    assert [(r.conv_id, r.segment) for r in got] == [(1, i) for i in range(4)]
    assert "".join(r.rendered for r in got) == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(1000))


ITEM = "A train leaves Paris, Anna waits 45 minutes and travels 120 km to meet her friend before noon, how fast must the second train go to arrive at the same time"


def test_leaks(spark):
    changed = ITEM.replace("45", "30").replace("120 km", "300 miles").replace("Paris", "Lyon").replace("Anna", "Berta")
    twice = "Add 5 apples to 5 pears, then take 5 plums away and count what is left on the table"
    items = spark.createDataFrame([(1, ITEM, 0), (2, twice, 0), (3, "What is seven times eight", 0), (4, None, 0), (5, "", 0), (6, "hi", 0)], "item_id long, text string, hash int")
    rows = [(1, "Some words before. " + ITEM + " and after"), (2, "intro text here, " + changed.upper().lower()), (3, "x " + changed + " y"), (4, twice.replace("5", "7")), (5, "Add 5 apples to 6 pears, then take 7 plums away and count what is left on the table"), (6, "they asked: what is seven times eight? nobody knew"), (7, " ".join(ITEM.split()[:6]) + " unrelated things that share nothing else with anything at all"), (8, None), (9, ""), (None, ITEM), (10, brute.LONG), (11, ITEM), (11, ITEM)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(brute.documents(spark, rows), items).collect()}
    assert set(got) == {(1, 1), (3, 1), (4, 2), (6, 3), (None, 1), (11, 1)} | ({(2, 1)} & set(got))
    assert got[1, 1].kind == "exact" and got[3, 1].kind == "reparameterised" and got[4, 2].kind == "reparameterised" and got[1, 1].first_word == 3
    docs = brute.documents(spark, rows)
    kept = decontaminate.drop_leaks(docs, decontaminate.find_leaks(docs, items))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {r[0] for r in got}
    assert decontaminate.find_leaks(brute.empty_documents(spark), items).collect() == []
    assert decontaminate.find_leaks(docs, items.limit(0)).collect() == []


def test_any_common_run_meets(spark):
    """Items at every offset: windows at every fifth token lose none."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 4, 5, 6, 7, 8, 9, 10, 14, 40])]
    rows = [(100 * i + k, " ".join([word() for _ in range(k)] + [t] + [word() for _ in range(3)])) for i, t in items for k in range(11)]
    found = decontaminate.find_leaks(brute.documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(d, d // 100) for d, _ in rows}


def test_changed_items_meet_at_any_offset(spark):
    """As many words changed as COVER allows, spread so that common runs are short."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items, rows = [], []
    for i, n in enumerate([5, 7, 10, 15, 20, 29, 40]):
        words = [word() for _ in range(n)]
        items.append((i, " ".join(words)))
        spare = n - -(-4 * n // 5)
        for k in range(6):
            changed = list(words)
            for j in range(spare):
                changed[(j + 1) * n // (spare + 1)] = word()
            rows.append((100 * i + k, " ".join([word() for _ in range(k)] + changed + [word() for _ in range(3)])))
    found = decontaminate.find_leaks(brute.documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(d, d // 100) for d, _ in rows}


def test_placeholders_and_first_words_meet_at_any_offset(spark):
    """Items nearly all of numbers, and exact copies whose first word or other names only the document shows as names, or only the item."""
    items = [(0, "what is 4 5 6"), (1, "compute 7 8 9 10"), (2, "add 1 2 3 4 5 6 7 8 to get it"), (3, "What costs seven"), (4, "Which of them is seven"), (5, "Tell me whether Anna or Berta will be there at noon")]
    texts = [t for _, t in items[:5]] + [items[5][1].lower()]
    rows = [(100 * i + k, "so " * k + ("nobody knows " if i > 2 else "") + t + " or not so") for i, t in enumerate(texts) for k in range(6)]
    rows.append((1000, "nobody knows Tell me whether Carla or Doris will be there at noon"))
    found = decontaminate.find_leaks(brute.documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.kind for r in found.collect()}
    assert {k for k in got if k[0] < 1000} == {(d, d // 100) for d, _ in rows[:-1]}
    assert set(v for k, v in got.items() if k[0] < 1000) == {"exact"} and got[1000, 5] == "reparameterised"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_hard_cases(spark):
    docs = brute.hard_documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (8, 0), (9, 0), (9, 1), (None, 0), (3, None), (100, 0), (101, 0), (102, 0), (11, 1), (10, 1)], "doc_id long, quality int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(brute.empty_documents(spark), labels).collect() == []


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", (1 - labels.quality).cast("int")).filter(quality.held_out("doc_id")).unionByName(labels.filter(~quality.held_out("doc_id")))
    a = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.score_documents(docs, flipped).collect()}
    assert a == pytest.approx(b)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).collect()
    assert len(rows) == docs.count() and np.mean([r.language == r.declared for r in rows]) > 0.98
    hidden = language.identify(docs.selectExpr("doc_id", "text", "if(doc_id % 4 = 0, lang, null) lang", "source")).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([r.text_language == truth[r.doc_id] for r in hidden]) > 0.97


def test_language_hard_cases(spark):
    rows = [(1, "the cat and the dog " * 20, "en", "a.org"), (2, "le chat et le chien " * 20, "fr", "b.fr"), (3, None, "en", None), (4, "", None, "a.org"), (5, "!!! 123", "fr", "b.fr"), (6, "the dog and the cat " * 20, None, "b.fr"), (7, "the cat " * 50, "fr", "a.org"), (None, "le chien " * 30, "FR-ca", ""), (7, "the cat " * 50, "fr", "a.org")]
    docs = brute.documents(spark, rows)
    got = {}
    for r in language.identify(docs).collect():
        got[r.doc_id] = r
    assert got[1].language == "en" and got[2].language == "fr" and got[6].language == "en" and got[None].language == "fr"
    assert not got[3].kept and not got[4].kept and not got[5].kept and got[1].kept
    kept = language.keep_identified(docs, language.identify(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, 7, None}
    assert language.identify(brute.empty_documents(spark)).collect() == []
    none = language.identify(docs.withColumn("lang", docs.lang.substr(1, 0)))
    assert {r.language for r in none.collect()} == {None}


def test_language_rejects_unknown_text(spark):
    """Random and foreign texts, declared or not, in a corpus of en, de, fr and es."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    rng = random.Random(5)
    words = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(40))
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x430, 0x450)))
    foreign = [words(latin) for _ in range(30)] + [words(cyrillic) for _ in range(30)] + [base64.b64encode(rng.randbytes(200)).decode() for _ in range(30)] + [
        "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(60)), "Questa mattina siamo andati al mercato e abbiamo comprato verdure fresche e pane per tutta la famiglia, poi siamo tornati a casa.",
        "Vanochtend gingen we naar de markt en kochten we verse groenten en brood voor het hele gezin, daarna zijn we weer naar huis gegaan.",
    ]
    rows = [(10**9 + i, t, [None, "en"][i % 2], "src0") for i, t in enumerate(foreign)]
    judged = language.identify(docs.unionByName(spark.createDataFrame(rows, docs.schema))).collect()
    assert sum(r.kept for r in judged if r.doc_id >= 10**9) == 0
    assert np.mean([r.kept for r in judged if r.doc_id < 10**9]) > 0.995


def test_page_evidence(spark):
    p = spark.createDataFrame([(1, "https://News.Example.fr:80/x", '<html lang="FR"><script>var a</script><p>le chat</p></html>'), (2, None, None)], "page_id long, url string, html string")
    r = {x.doc_id: x for x in language.page_evidence(p).collect()}
    assert r[1].host == "news.example.fr" and r[1].declared == "fr" and r[1].text.split() == ["le", "chat"] and r[2].text == ""
    assert language.identify(language.page_evidence(p), declared_col="declared", host_col="host").count() == 2


def evidence_corpus():
    rng = random.Random(11)
    words = {k: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(30)] for k in ("aa", "bb", "cc")}
    rows = []
    for i in range(90):
        k = ("aa", "bb", "cc")[i % 3]
        text = " ".join(rng.choice(words[k if rng.random() < 0.8 else "aa"]) for _ in range(rng.choice([1, 2, 3, 40])))
        rows.append((i, text, None if i % 5 == 0 else k if i % 7 else "aa", [None, f"www{i % 4}.site.{k}", f"x.{k}", "localhost"][i % 4]))
    return rows + [(200, None, "bb", "x.aa"), (201, "", None, None), (202, "12", "cc", "x.cc"), (203, " ".join(words["bb"]) * 3000, "bb", None)]


@pytest.mark.parametrize("block", [64, 2])
def test_posteriors_equal_brute_force(spark, monkeypatch, block):
    """Also with more languages than a block of tables holds."""
    monkeypatch.setattr(language, "BLOCK", block)
    rows = evidence_corpus()
    want = brute.posteriors(rows)[0]
    for r in language.identify(brute.documents(spark, rows)).collect():
        top = max(want[r.doc_id].values())
        assert r.posterior == pytest.approx(top, rel=1e-3, abs=1e-9) and want[r.doc_id][r.language] == pytest.approx(top, rel=1e-3)


def test_many_languages_all_take_part(spark):
    """70 declared languages, the rarest of them among those that can be the answer."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(70):
        rng = random.Random(k)
        own = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(6)]
        rows += [(1000 * k + i, " ".join(rng.choice(own) for _ in range(30)), letters[k // 26] + letters[k % 26] + "x", None) for i in range(2 if k == 69 else 4)]
    got = language.identify(brute.documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.language == r.declared for r in got)


def test_suffix_and_markup_decide(spark):
    """A short text that fits two languages goes with its address's suffix, or with its markup's declaration."""
    rows = [(i, f"http://h{i}.example.{('xx', 'yy')[i % 2]}/", f'<html lang="{("xx", "yy")[i % 2]}"><p>{("alpha beta gamma delta", "omega sigma tau rho")[i % 2]} common words here</p></html>') for i in range(60)]
    rows += [(100, "http://new.example.xx/", "<p>common words here</p>"), (101, "http://new.example.yy/", "<p>common words here</p>"), (102, None, '<html lang="xx"><p>common words here</p></html>'), (103, None, '<html lang="yy"><p>common words here</p></html>')]
    pages = language.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.doc_id: r.language for r in language.identify(pages, declared_col="declared", host_col="host").collect()}
    assert [got[i] for i in (100, 101, 102, 103)] == ["xx", "yy", "xx", "yy"]


def test_equally_likely_languages(spark):
    rows = [(1, "same words", "bb", None), (2, "same words", "aa", None), (3, "same words", None, None)]
    assert {r.doc_id: r.language for r in language.identify(brute.documents(spark, rows)).collect()}[3] == "aa"


def test_rows_without_an_id_are_filtered(spark):
    good, junk = "the cat and the dog sat on the mat " * 8, "!!! ??? 123"
    docs = brute.documents(spark, [(i, good + str(i)) for i in range(8)] + [(None, junk), (None, good), (5, junk)])
    kept = language.keep_identified(docs, language.identify(docs))
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(i, good + str(i)) for i in range(8)] + [(None, good)])
    scored = spark.createDataFrame([(None, 0), (5, 1)], "doc_id long, predicted int").crossJoin(spark.createDataFrame([(0,)], "x int"))
    texts = {None: junk, 5: junk}
    scored = spark.createDataFrame([(r.doc_id, texts[r.doc_id], r.predicted) for r in scored.collect()], "doc_id long, text string, predicted int")
    scored = scored.withColumn("row_key", quality.row_key("doc_id", "text"))
    left = quality.keep_good(docs, scored).collect()
    assert len(left) == 10 and not any(r.doc_id is None and r.text == junk for r in left)


def test_quality_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "x1", "yes.", "no!", "a", "\n", "zeta-eta", "é"]) for _ in range(rng.randint(0, 60))) + ("!!! $$$ 123" * (i % 3 == 0))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, brute.LONG), (502, brute.LONG)]
    labels = {i: int(i % 3 != 0) for i in range(0, 150, 2)}
    got = quality.score_documents(brute.documents(spark, rows), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    want = {r[0]: s for r, s in zip(rows, brute.quality_scores(rows, labels), strict=True)}
    assert got.count() == len(rows) and all(r.score == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-9) for r in got.collect())
