"""Language identification by fusing evidence.

The posterior of a language is proportional to
  text likelihood (byte trigrams) x P(declared language | language) x prior(language | host),
where the host's prior is smoothed towards its address suffix's, and that towards the corpus's. Trigram tables, the
confusion of declared against text language, and the priors are counts over all documents, by grouped aggregation. A
document's own counts are taken out of all of them before it is judged, so no declaration confirms itself; only the tables of
a language that nothing else declares keep them.

Every text is read twice: for the counts of trigrams by declared language, and for its likelihoods. Tables have
2**GRAM_BITS entries per language and are made and sent out in blocks of BLOCK languages; with more languages, texts are
read twice for each block, and a document's likelihoods under all blocks are put together by its row key. Trigrams of one
text are not independent: its likelihood counts as that of EVIDENCE trigrams at most.

Of documents, `lang` is the declared language and `source` the host; page_evidence() takes them from web pages: the
html element's language and the url's host, whose address suffix is the level above it. identify() may count further
tables as evidence: documents and pages then share their trigrams, suffixes, confusion and corpus prior.

The posterior only compares the corpus's languages, so a second test is absolute: the mean log-likelihood of a text's
trigrams must reach what texts of its language have (absolute_limits, fitted over all documents), less an allowance for short texts.
Gibberish and languages that nothing declares fail it.

A document is kept if it has a letter, its posterior reaches `least` and it passes the absolute test. A text without a
trigram can't fail the latter.

Defined cases: a null or empty text gives no text evidence, gets the language that the rest says, and is not kept; null or
blank declarations and hosts are unknown and give no evidence; without any declared language, language is null and the
posterior 0; a very long text is read whole; of equally likely languages the first by name is taken; rows that repeat a doc_id,
also a null one, are judged one by one; an empty table gives an empty result; extra columns are not read by identify() and
kept by keep_identified().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, batch_rows, lookup, row_key, save, small, utf8, without
from .shingles import BATCH_BYTES, binary_column, slices

GRAM_BITS, BLOCK = 16, 64
EVIDENCE, SMOOTHING = 200.0, 20.0
LEAST = 0.5
#: The absolute test: deviations allowed, least trigrams of a text that limits are fitted to, bins per unit of log-likelihood.
DEVIATIONS, FIT_LEAST, BINS = 3.0, 50, 20

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_LOWER[48:58] = 48
_LETTER = np.zeros(256, dtype=np.int32)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed trigram at each byte, weight 0 where it leaves its text, letters in each text)."""
    buf, at = data[int(bounds[0]) : int(bounds[-1])], bounds - int(bounds[0])
    low = _LOWER[buf]
    n = len(buf)
    code = np.zeros(n, dtype=np.uint32)
    weight = np.zeros(n, dtype=bool)
    if n > 2:
        code[:-2] = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
        weight[:-2] = True
    for back in (1, 2):
        edge = at[1:] - back
        weight[edge[edge >= 0]] = False
    grams = ((code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)
    full = np.flatnonzero(np.diff(at))
    letters = np.zeros(len(bounds) - 1, dtype=np.int64)
    if len(full):
        letters[full] = np.add.reduceat(_LETTER[buf], at[:-1][full])
    return grams, weight, letters


def text_grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of the distinct trigrams of each text, and the texts' letters; a long text is counted in pieces."""
    rows = len(bounds) - 1
    if rows == 1 and bounds[1] - bounds[0] > 2 * BATCH_BYTES:
        counts, letters = np.zeros(1 << GRAM_BITS, dtype=np.int64), 0
        for at in range(int(bounds[0]), int(bounds[1]), BATCH_BYTES):
            end = min(at + BATCH_BYTES, int(bounds[1]))
            grams, weight, _ = trigrams(data, np.array([at, min(end + 2, int(bounds[1]))]))
            counts += np.bincount(grams[weight], minlength=len(counts))
            letters += int(_LETTER[data[at:end]].sum())
        gram = np.flatnonzero(counts)
        return np.zeros(len(gram), dtype=np.int64), gram, counts[gram], np.array([letters])
    grams, weight, letters = trigrams(data, bounds)
    of = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(bounds))
    keys, many = np.unique(of[weight] << np.uint64(GRAM_BITS) | grams[weight].astype(np.uint64), return_counts=True)
    return (keys >> np.uint64(GRAM_BITS)).astype(np.int64), (keys & np.uint64((1 << GRAM_BITS) - 1)).astype(np.int64), many, letters


def page_evidence(pages: DataFrame) -> DataFrame:
    """doc_id, text, declared, host of web pages: the html element's lang, the url's host, and the text without markup."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return pages.select(
        F.col("page_id").alias("doc_id"), bare.alias("text"), F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\blang=["']?([A-Za-z]+)""", 1)).alias("declared"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1)).alias("host"),
    )


def gram_counts(source: DataFrame, languages: list[str]) -> np.ndarray:
    """Counts (language, trigram) over all texts that declare one of the languages."""
    import pyarrow as pa

    def run(batches) -> Iterator:
        counts = np.zeros((len(languages), 1 << GRAM_BITS), dtype=np.int64)
        for batch in batches:
            which = np.array([languages.index(x) for x in batch.column(0).to_pylist()], dtype=np.int64)
            data, bounds = binary_column(batch.column(1))
            for i, j in slices(bounds):
                row, gram, many, _ = text_grams(data, bounds[i : j + 1])
                np.add.at(counts, (which[i:j][row], gram), many)
        rows = [(k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(counts) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["k", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(bytes(c)), dtype=np.int64) for c in frame["counts"])
        return pd.DataFrame({"k": frame["k"].iloc[:1], "counts": [total.astype("<i8").tobytes()]})

    own = source.filter(F.col("declared").isin(languages)).select("declared", "body").mapInArrow(run, "k int, counts binary")
    total = np.zeros((len(languages), 1 << GRAM_BITS))
    with batch_rows(source.sparkSession, ROWS):
        rows = own.groupBy("k").applyInPandas(add, "k int, counts binary").collect()  # a row per language of the block
    for r in rows:
        total[r.k] = np.frombuffer(bytes(r.counts), dtype="<i8")
    return total


def log_tables(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of trigrams."""
    return np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1]))


def absolute_limits(log: np.ndarray, fitted: dict[int, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(least mean log-likelihood, deviation of a single trigram) of each language.

    fitted: median and 84th percentile of its texts' means; junk, which every language attracts, only stretches the lower side. The
    limit lies below the median by DEVIATIONS of the two's gap, or by half the way to the nearest other language or to uniform trigrams if that is more; never below uniform trigrams.
    """
    uniform = -GRAM_BITS * np.log(2)
    cross = np.exp(log.astype(np.float64)) @ log.T.astype(np.float64)
    own = np.diag(cross)
    spread = np.sqrt(np.maximum(0, (np.exp(log) * log.astype(np.float64) ** 2).sum(1) - own**2))
    # how texts of other languages look under this one: the nearest of them, or uniform trigrams
    others = np.where(np.eye(len(log), dtype=bool), -np.inf, cross)
    nearest = np.maximum(others.max(0, initial=-np.inf), uniform)
    least = np.empty(len(log))
    for k in range(len(log)):
        median, high = fitted.get(k, (own[k], own[k]))
        least[k] = max(uniform, median - max(DEVIATIONS * (high - median), (median - nearest[k]) / 2))
    return least, spread


def text_likelihoods(row: np.ndarray, gram: np.ndarray, many: np.ndarray, rows: int, counts: np.ndarray, log: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihoods (row, language), trigrams of each row) from text_grams(): own is the language that the row is counted under
    in the tables, or -1; there the row's own trigrams are taken out first, unless the language has no others."""
    totals = counts.sum(1)
    size = np.bincount(row, many, minlength=rows)
    ll = np.column_stack([np.bincount(row, many * t[gram], minlength=rows).astype(np.float64) for t in log])
    own = np.where((own >= 0) & (totals[own] > size), own, -1) if len(totals) else own
    at = np.flatnonzero(own[row] >= 0)
    rest = np.maximum(0, counts[own[row[at]], gram[at]] - many[at])
    mine = np.bincount(row[at], many[at] * np.log(rest + 0.5), minlength=rows)
    r = np.flatnonzero(own >= 0)
    ll[r, own[r]] = mine[r] - size[r] * np.log(totals[own[r]] - size[r] + 0.5 * (1 << GRAM_BITS))
    return ll, size


def _likelihoods(source: DataFrame, languages: list[str], tables) -> DataFrame:
    """source without its texts, with letters, grams and ll: log-likelihood of each text under each language, tempered."""
    import pyarrow as pa

    def run(batches) -> Iterator:
        counts = tables.value.astype(np.float64)
        log = log_tables(counts)
        for batch in batches:
            data, bounds = binary_column(batch.column(0))
            rest = batch.columns[1:]
            names = [*batch.schema.names[1:], "letters", "grams", "ll"]
            declared = batch.column(batch.schema.names.index("declared")).to_pylist()
            which = np.array([languages.index(x) if x in languages else -1 for x in declared], dtype=np.int64)
            for i, j in slices(bounds):
                *found, letters = text_grams(data, bounds[i : j + 1])
                ll, many = text_likelihoods(*found, j - i, counts, log, which[i:j])
                ll *= (np.minimum(EVIDENCE, many) / np.maximum(many, 1))[:, None]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in rest), pa.array(letters), pa.array(many.astype(np.int64)), pa.array(list(ll), pa.list_(pa.float64()))], names=names)

    rest = [c for c in source.columns if c != "body"]
    kinds = ", ".join(f"{c} {t}" for c, t in source.dtypes if c != "body")
    return source.select("body", *rest).mapInArrow(run, f"{kinds}, letters long, grams long, ll array<double>")


def _all_likelihoods(source: DataFrame, languages: list[str]) -> tuple[DataFrame, np.ndarray]:
    """(rows with ll over all languages, log tables): a block of languages at a time."""
    spark = source.sparkSession
    logs, made = [], []
    for i in range(0, len(languages), BLOCK):
        block = languages[i : i + BLOCK]
        counts = gram_counts(source, block)
        logs.append(log_tables(counts).astype(np.float32))
        made.append(_likelihoods(source, block, spark.sparkContext.broadcast(counts.astype(np.float32))))
    if len(made) == 1:
        return made[0], logs[0]
    # equal rows have equal likelihoods: one of each is enough
    parts = [m.dropDuplicates(["row_key"]).select("row_key", F.lit(i).alias("part"), "ll") for i, m in enumerate(made)]
    union = parts[0]
    for m in parts[1:]:
        union = union.unionByName(m)
    whole = union.groupBy("row_key").agg(F.flatten(F.array_sort(F.collect_list(F.struct("part", "ll")))["ll"]).alias("ll"), F.lit(1).alias("here"))
    rows = source.select(*[c for c in source.columns if c != "body"], *_text_counts(F.col("body")))
    total = source.count()
    return lookup(rows, whole, ["row_key"], "here", total), np.concatenate(logs)


def _text_counts(body) -> list:
    """letters and grams of a text, as trigrams() counts them."""
    return [
        F.length(F.regexp_replace(F.decode(body, "ISO-8859-1"), r"[\x00-\x40\x5B-\x60\x7B-\x7F]", "")).cast("long").alias("letters"),
        F.greatest(F.octet_length(body) - 2, F.lit(0)).cast("long").alias("grams"),
    ]


def counted(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, own, here): how often each of k text languages is best among rows of each key, as an array, and their number."""
    many = rows.groupBy(*keys, "best").agg(F.count(F.lit(1)).alias("n"))
    named = F.map_from_entries(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("best", "n"))))
    held = many.groupBy(*keys).agg(named.alias("m"), F.sum("n").alias("here"))
    own = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    return held.select(*keys, own.alias("own"), "here")


def evidence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """(doc_id, declared, host, suffix, row_key, body) of every row of docs."""
    clean = lambda c: F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    declared = F.nullif(F.regexp_extract(clean(declared_col), "^[^-_]+", 0), F.lit(""))
    suffix = F.regexp_extract(F.coalesce(clean(host_col), F.lit("")), r"\.([^.]+)$", 1)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), declared.alias("declared"), clean(host_col).alias("host"), suffix.alias("suffix"),
        row_key(id_col, text_col, declared_col, host_col).alias("row_key"), utf8(F.col(text_col).cast("string")).alias("body"),
    )


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", least: float = LEAST, evidence: DataFrame | None = None
) -> DataFrame:
    """doc_id, language, posterior, text_language, declared, kept, row_key of every row of docs.

    evidence: further rows as of evidence_rows(), which are counted but not returned.
    """
    source = evidence_rows(docs, id_col, text_col, declared_col, host_col).withColumn("asked", F.lit(True))
    if evidence is not None:
        source = source.unionByName(evidence.withColumn("asked", F.lit(False)))
    seen = source.filter("declared IS NOT NULL").groupBy("declared").agg(F.count(F.lit(1)).alias("n"))
    languages = [r.declared for r in seen.orderBy("declared").select("declared").collect()]  # a row per language
    if not languages:
        none = F.lit(None).cast("string")
        return source.filter("asked").select("doc_id", none.alias("language"), F.lit(0.0).alias("posterior"), none.alias("text_language"), "declared", F.lit(False).alias("kept"), "row_key")
    k = len(languages)
    rows, log = _all_likelihoods(source, languages)
    best = F.when((F.array_max("ll") > F.array_min("ll")) & (F.col("letters") > 0), F.array_position("ll", F.array_max("ll")).cast("int"))
    if k == 1:
        best = F.when(F.col("letters") > 0, F.lit(1))
    rows = save(rows.withColumn("best", best), "language-likelihoods")
    # mean log-likelihood a trigram, in bins, by language: what the absolute test is fitted to
    mean = F.get("ll", F.col("best") - 1) / F.least(F.lit(EVIDENCE), F.col("grams"))
    bins = rows.filter((F.col("grams") >= FIT_LEAST) & F.col("best").isNotNull()).groupBy("best", F.round(mean * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    fitted = bins.groupBy("best").agg(F.percentile("bin", [0.5, 0.84], F.col("n")).alias("p")).collect()  # a row per language
    limit, spread = absolute_limits(log, {r.best - 1: (r.p[0] / BINS, r.p[1] / BINS) for r in fitted})
    # counts of the hosts, the suffixes above them, the corpus above these, and of declarations
    by_host = save(counted(rows.filter("host IS NOT NULL"), ["suffix", "host"], k), "language-hosts")
    together = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("own", i))
    by_suffix = by_host.select("suffix", F.posexplode(together).alias("i", "n")).groupBy("suffix", "i").agg(F.sum("n").alias("n"))
    by_suffix = by_suffix.groupBy("suffix").agg(F.array_sort(F.collect_list(F.struct("i", "n")))["n"].alias("above"))
    hosts = by_host.join(by_suffix, "suffix").select("host", F.col("own").alias("by_host"), F.col("above").alias("by_suffix"), "here")
    claims = save(counted(rows.filter("declared IS NOT NULL"), ["declared"], k), "language-claims")
    corpus = counted(rows, [], k).first()
    base = [float(x) for x in corpus.own] if corpus else [0.0] * k
    spoken = dict.fromkeys(range(k), 0.0) | {r.i: r.n for r in claims.select(F.posexplode("own").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()}
    floats = lambda a: F.array(*[F.lit(float(x)) for x in a])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    fused = lookup(rows, hosts, ["host"], "here", corpus.here if corpus else 0)
    fused = fused.join(small(claims.select("declared", F.col("own").alias("claim"))), "declared", "left")
    fused = fused.withColumn("mine", F.when(F.col("best").isNull(), 0.0).otherwise(1.0))
    fused = fused.withColumn("host_sum", total("by_host") - F.col("mine")).withColumn("suffix_sum", total("by_suffix") - F.col("mine"))

    def joint(ll, i):
        own = F.when(F.col("best") == i + 1, 1.0).otherwise(0.0)
        claim = F.log((F.get("claim", i) - own + 1) / (F.get(floats(spoken[j] + k for j in range(k)), i) - own))
        prior = (F.get(floats(base), i) - own + 1) / (F.lit(sum(base) + k) - F.col("mine"))
        above = (F.get("by_suffix", i) - own + SMOOTHING * prior) / (F.col("suffix_sum") + SMOOTHING)
        below = (F.get("by_host", i) - own + SMOOTHING * above) / (F.col("host_sum") + SMOOTHING)
        return ll + F.coalesce(claim, F.lit(0.0)) + F.log(F.coalesce(below, prior))

    fused = fused.withColumn("joint", F.transform("ll", joint)).withColumn("top", F.array_max("joint"))
    mass = F.aggregate("joint", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    fused = fused.withColumn("posterior", 1 / mass).withColumn("at", F.array_position("joint", F.col("top")).cast("int"))
    # neighbouring trigrams share letters: three of them count as one
    allowed = F.element_at(floats(limit), F.col("at")) - DEVIATIONS * F.element_at(floats(spread), F.col("at")) * F.sqrt(3 / F.greatest(F.lit(1), F.col("grams")))
    known = (F.col("grams") == 0) | (F.element_at("ll", F.col("at")) / F.greatest(F.lit(1.0), F.least(F.lit(EVIDENCE), F.col("grams"))) >= allowed)
    names = F.array(*[F.lit(x) for x in languages])
    return fused.filter("asked").select(
        "doc_id", F.element_at(names, F.col("at")).alias("language"), "posterior", F.when(F.col("best").isNotNull(), F.element_at(names, F.coalesce("best", F.lit(1)))).alias("text_language"),
        "declared", ((F.col("letters") > 0) & (F.col("posterior") >= least) & known).alias("kept"), "row_key",
    )


def keep_identified(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Rows of docs that identify() keeps, with all their columns; rows without an id are told apart by their row keys."""
    return without(docs, judged.filter(~F.col("kept")), row_key(id_col, text_col, declared_col, host_col))
