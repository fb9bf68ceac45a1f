"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become template tokens: lower-case words, and typed placeholders for numbers, units after numbers, and names
(capitalised words after a lower-case word, a comma or a semicolon). Items whose tokens agree but for values, and whose
slots have equal values at the same places, are of one template, which is matched once for all of them; the result has a
row per document and template, and benchmark_items() says which items a template has.

Windows of template tokens, at every token of items and documents, are hash-joined. An item of n tokens may differ in
m = n - ceil(cover n) of them; windows of floor(n / (m + 1)) tokens, WINDOW at most, are short enough that m changes can't
hit all of them: at least n - width + 1 - m width agree, and run - width + 1 where a run decides. An alignment with fewer
agreeing windows can't be a leak and is not checked, so no leak depends on its offset. Of the windows that an item can spare,
those of placeholders alone, which meet often, and those that more than COMMON templates share are left out.

Whether a name is recognised depends on letter case and on the word before, which an item's first word lacks. So texts have
two readings, and windows of both are joined: in one names are placeholders, and an item's first word may also be a name in the
document if it is the same word; in the other names are words, which must be those of an item of the template.

Each meeting is checked at its alignment against the whole item, by either reading. It is a leak if at least COVER of the
item's tokens agree or RUN successive ones do, one of them a word, and its slots are consistent: equal values in the item are
equal in the document. A leak is `exact` if all tokens and values are those of an item; `reparameterised` if only values
differ, or the first word where the document has a name; else `altered`.

Items of fewer than LEAST_WORDS tokens, and items of placeholders alone, are searched by their exact tokens and values;
drop_leaks() does not count the former.

Defined cases: null and empty texts have no tokens and no leaks, and such items are in no text; a null doc_id or item_id comes
back as null; rows that repeat a doc_id are checked one by one, rows that repeat it with its text give one row; of equally
good alignments the first one is named, of equal items the smallest item_id; very long texts are read whole; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import marked, row_key, save, small, without

WINDOW, LEAST_WORDS, COVER, RUN = 5, 3, 0.8, 13
#: Windows of items have some 50 bytes; they are broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 1_000_000
#: Items are broadcast up to so many bytes of tokens.
BROADCAST_BYTES = 32 << 20
#: A window of more templates than this is left out where an item has enough others.
COMMON = 8

# Units of measure that may follow a number.
UNITS = (
    "km kilometers kilometres m meters metres cm mm miles mile feet foot ft inches inch yards kg kilograms g grams mg lb lbs pounds oz "
    "ounces tons l liters litres ml gallons s sec seconds ms min minutes h hr hours days weeks months years mph kmh percent degrees "
    "dollars cents euros usd eur"
)
NUMBER, UNIT, NAME, POINT = "\u0002", "\u0003", "\u0004", "\u0005"


def template_tokens(text: Column, values: bool = False) -> Column:
    """A text's template tokens; with values, placeholders are followed by what they replace."""
    v = lambda i: f"${i}" if values else ""
    units = "|".join(sorted(UNITS.split(), key=len, reverse=True))
    t = F.coalesce(text, F.lit(""))
    pointed = F.regexp_replace(t, r"(?<=\d)[.,:](?=\d)", POINT)
    measured = F.regexp_replace(pointed, rf"(\d[\d{POINT}]*) ?((?i:{units}))(?![\p{{L}}\p{{N}}])", f" {NUMBER}{v(1)} {UNIT}{v(2)} ")
    plain = F.regexp_replace(measured, rf"(?<![\d{NUMBER}{POINT}])(\d[\d{POINT}]*)", f" {NUMBER}{v(1)} ")
    numbered = F.when(t.rlike(r"\d"), plain).otherwise(t)
    named = F.regexp_replace(numbered, r"(?<=[\p{Ll},;] )(\p{Lu}\p{L}*)", f"{NAME}{v(1)}")
    return F.array_remove(F.split(F.lower(named), rf"[^\p{{L}}\p{{N}}{NUMBER}-{POINT}]+"), "")


def _literal(tokens: Column) -> Column:
    """Tokens without the values of placeholders."""
    return F.transform(tokens, lambda x: F.when(x < F.lit("\u0005"), F.substring(x, 1, 1)).otherwise(x))


def _plain(tokens: Column) -> Column:
    """Tokens without the values of placeholders, but with names as their words."""
    name = lambda x: x.startswith(NAME)
    return F.transform(tokens, lambda x: F.when(name(x), F.substring(x, 2, 2**31 - 1)).when(x < F.lit("\u0005"), F.substring(x, 1, 1)).otherwise(x))


def _starts(hashes: Column, width: int) -> Column:
    return F.when(F.size(hashes) >= width, F.sequence(F.lit(0), F.size(hashes) - width)).otherwise(F.array().cast("array<int>"))


def _windows(hashes: Column, width: int, at: Column | None = None, literal: bool = False) -> Column:
    """Hashes of windows of tokens' hashes, as (pos from 0, hash); those of exact tokens have hashes of their own."""
    joint = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)], *([F.lit("exact")] if literal else []))
    return F.transform(_starts(hashes, width) if at is None else at, lambda i: F.struct(i.alias("pos"), joint(i).alias("hash")))


def _hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def _valued(tokens: Column) -> Column:
    """Tokens with the values of placeholders, names as their words."""
    return F.transform(tokens, lambda x: F.when(x.startswith(NAME), F.substring(x, 2, 2**31 - 1)).otherwise(x))


def _differing(a: Column, b: Column, width: int, at: Column | None = None) -> Column:
    """Windows of b whose tokens are not those of a."""
    other = lambda i: F.greatest(*[F.get(a, i + j) != F.get(b, i + j) for j in range(width)], F.lit(False))
    none = F.array().cast("array<int>")
    return _windows(b, width, F.when(a == b, none).otherwise(F.filter(_starts(b, width) if at is None else at, other)))


def _blank(x: Column) -> Column:
    return x < F.lit("\u0005")


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, item, form, template) of every item with a token: its tokens, the tokens with placeholders numbered by their
    first equal value, and a hash of these, which items of one template share."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), template_tokens(F.col(item_text), True).alias("item")).filter(F.size("item") > 0)
    first = lambda x: F.array_position("item", x).cast("string")
    form = F.transform("item", lambda x: F.when(_blank(x), F.concat(F.substring(x, 1, 1), first(x))).otherwise(x))
    # items that only their exact tokens can find are templates of their own
    literal = (F.size("item") < LEAST_WORDS) | F.forall("item", _blank)
    return rows.withColumn("form", form).withColumn("literal", literal).withColumn("template", F.sha2(F.array_join(F.when(F.col("literal"), _valued(F.col("item"))).otherwise(F.col("form")), " "), 256))


def _item_windows(items: DataFrame, cover: float, run: int) -> tuple[DataFrame, list[int], list[int]]:
    """((template, reading, need, item_pos, hash), widths of template windows, widths of literal windows)."""
    spare = F.col("words") - F.ceil(F.lit(cover) * F.col("words"))
    width = F.when(F.col("literal"), F.least(F.lit(WINDOW), F.col("words"))).otherwise(F.greatest(F.lit(1), F.least(F.lit(min(WINDOW, run)), F.floor(F.col("words") / (spare + 1)))))
    sized = items.withColumn("words", F.size("item")).withColumn("width", width.cast("int"))
    every = F.col("words") - F.col("width") + 1
    sized = sized.withColumn("need", F.when(F.col("literal"), every).otherwise(F.least(every - spare * F.col("width"), F.lit(run + 1) - F.col("width"))).cast("int"))
    sized = save(sized, "leak-sized")
    widths = {(r.width, r.literal) for r in sized.select("width", "literal").distinct().collect()}
    own = None
    for w, literal in sorted(widths):
        some = sized.filter((F.col("width") == w) & (F.col("literal") == literal))
        if literal:
            forms = _windows(_hashed(_valued(F.col("item"))), w, literal=True)
        else:
            some = some.withColumn("hashes", _hashed(_literal(F.col("item")))).withColumn("plain", _hashed(_plain(F.col("item"))))
            # the item with its first word as a name
            some = some.withColumn("named", F.concat(F.array(F.xxhash64(F.lit(NAME))), F.slice("hashes", 2, F.size("hashes"))))
            # windows without a word meet often: they are left out if a leak must have another
            blank = lambda i: F.forall(F.slice("item", i + 1, F.lit(w)), _blank)  # noqa: B023, E731
            some = some.withColumn("every", _starts(F.col("hashes"), w)).withColumn("worded", F.filter("every", lambda i: ~blank(i)))
            left = F.col("need") - F.size("every") + F.size("worded")
            some = some.withColumn("at", F.when(left >= 1, F.col("worded")).otherwise(F.col("every"))).withColumn("need", F.when(left >= 1, left).otherwise(F.col("need")))
            first = F.filter("at", lambda i: i == 0)
            forms = F.concat(_windows(F.col("hashes"), w, F.col("at")), _differing(F.col("hashes"), F.col("plain"), w, F.col("at")), _differing(F.col("hashes"), F.col("named"), w, first))
        some = some.select("template", "need", F.lit(literal).alias("literal"), F.explode(F.array_distinct(forms)).alias("w"))
        own = some if own is None else own.unionByName(some)
    own = own.select("template", "need", "literal", F.col("w.pos").alias("item_pos"), F.col("w.hash").alias("hash")).distinct()
    # what many templates have in common is left out where a leak must have another window
    common = own.groupBy("hash").agg(F.countDistinct("template").alias("df")).filter(F.col("df") > COMMON)
    own = save(own.join(common, "hash", "left"), "leak-windows")
    drop = own.filter("df IS NOT NULL").groupBy("template", "item_pos").agg(F.max("df").alias("d")).withColumn("rank", F.row_number().over(Window.partitionBy("template").orderBy(F.desc("d"), "item_pos")))
    drop = drop.join(own.groupBy("template").agg(F.min("need").alias("least")), "template").filter("rank < least").select("template", "item_pos")
    dropped = drop.groupBy("template").agg(F.count(F.lit(1)).cast("int").alias("less"))
    kept = own.join(drop, ["template", "item_pos"], "left_anti").join(dropped, "template", "left")
    kept = kept.select("template", (F.col("need") - F.coalesce("less", F.lit(0))).alias("need"), "literal", "item_pos", "hash")
    return save(kept, "leak-kept"), sorted(w for w, x in widths if not x), sorted(w for w, x in widths if x)


def _hits(key: DataFrame, own: DataFrame, widths: list[int], exact: list[int]) -> DataFrame:
    """(spot, template, first): alignments at which enough windows of a template meet a document's; of items that are
    searched by their exact tokens the first one. Documents that share a spot, a hash of the row, are all checked."""
    columns = [("hashes", _literal(F.col("tokens"))), ("plain", _plain(F.col("tokens")))] if widths else []
    columns += [("valued", _valued(F.col("tokens")))] if exact else []
    theirs = key.select("spot", *[_hashed(c).alias(n) for n, c in columns])
    both = [x for w in widths for x in (_windows(F.col("hashes"), w), _differing(F.col("hashes"), F.col("plain"), w))]
    both += [_windows(F.col("valued"), w, literal=True) for w in exact]
    theirs = theirs.select("spot", F.explode(F.concat(*both)).alias("w")).select("spot", F.col("w.pos").alias("pos"), F.col("w.hash").alias("hash"))
    met = theirs.join(F.broadcast(own) if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else own, "hash")
    met = met.groupBy("spot", "template", "literal", (F.col("pos") - F.col("item_pos")).alias("first"), "need").agg(F.count(F.lit(1)).alias("n"))
    met = met.filter("n >= need").groupBy("spot", "template", F.when(F.col("literal"), -1).otherwise(F.col("first")).alias("at")).agg(F.min("first").alias("first"))
    return save(met.select("spot", "template", "first"), "leak-hits")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    cover: float = COVER, run: int = RUN,
) -> DataFrame:
    """doc_id, item_id, n_items, kind, first_word, n_words, n_matched, longest_run, template, row_key: a row per document and
    leaked template.

    item_id is the item whose tokens and values the document has, else the smallest one of the template's n_items.
    """
    items = save(benchmark_items(benchmark, item_col, item_text), "leak-items")
    names = F.transform("item", lambda x: F.when(x.startswith(NAME), F.substring(x, 2, 2**31 - 1)))
    per_name = items.filter("NOT literal").select("template", F.posexplode(names).alias("pos", "name")).filter("name IS NOT NULL").groupBy("template", "pos").agg(F.collect_set("name").alias("names"))
    known = per_name.groupBy("template").agg(F.map_from_entries(F.collect_list(F.struct("pos", "names"))).alias("names"))
    templates = items.groupBy("template").agg(F.min("form").alias("form"), F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"), F.max("literal").alias("literal"))
    templates = save(templates.join(known, "template", "left").withColumn("words", F.size("form")), "leak-templates")
    members = items.select("template", F.xxhash64(_valued(F.col("item"))).alias("values"), "item_id").groupBy("template", "values").agg(F.min("item_id").alias("same_id"), F.lit(True).alias("exact"))
    bytes_of = F.octet_length(F.array_join("form", " ")) + F.coalesce(F.octet_length(F.to_json("names")), F.lit(0)) + 64
    size = templates.agg(F.sum(bytes_of)).first()[0] or 0
    if not size:
        windows, widths, exact = None, [], []
    else:
        windows, widths, exact = _item_windows(items, cover, run)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("body"))
    source = source.withColumn("spot", F.xxhash64("row_key"))
    key = source.select("spot", template_tokens(F.col("body"), True).alias("tokens"))
    if windows is not None:
        hits = _hits(key, windows, widths, exact)
    else:
        hits = save(key.filter("false").select("spot", F.lit("").alias("template"), F.lit(0).alias("first")), "leak-hits")
    wanted = hits.select("spot").distinct()
    texts = marked(source, wanted, F.col("spot")).join(wanted, "spot", "left_semi").dropDuplicates(["row_key"])
    texts = texts.select("spot", "doc_id", "row_key", template_tokens(F.col("body"), True).alias("tokens"))
    held = F.broadcast(templates) if size <= BROADCAST_BYTES else templates
    asked = hits.join(held.select("template", "words"), "template").groupBy("spot", F.floor(F.col("first") / F.lit(1 << 16)).alias("stretch")).agg(F.collect_list(F.struct("template", "first", "words")).alias("hits"))
    # the part of the document that the item would cover; positions outside of it are empty tokens
    part = lambda h: F.concat(
        F.array_repeat(F.lit(""), F.greatest(F.lit(0), -h["first"])),
        F.slice("tokens", F.greatest(F.lit(1), h["first"] + 1), F.greatest(F.lit(0), h["words"] + F.least(F.lit(0), h["first"]))),
    )
    cut = asked.join(texts, "spot").select("doc_id", "row_key", F.explode(F.transform("hits", lambda h: F.struct(h["template"].alias("template"), h["first"].alias("first"), part(h).alias("d")))).alias("h"))
    pairs = cut.select("doc_id", "row_key", "h.*").withColumn("values", F.xxhash64(_valued(F.col("d"))))
    pairs = pairs.join(small(members), ["template", "values"], "left").join(held, "template")
    pairs = pairs.withColumn("exact", F.coalesce("exact", F.lit(False))).withColumn("z", F.arrays_zip("d", F.col("form").alias("i")))
    kind = lambda x: F.when(_blank(x), F.substring(x, 1, 1)).otherwise(x)
    name = lambda x: x.startswith(NAME)
    bare = lambda x: F.when(name(x), F.substring(x, 2, 2**31 - 1)).otherwise(kind(x))
    first_name = lambda p, i: (i == 0) & name(p["d"]) & (bare(p["d"]) == p["i"])
    # a name is a name, or one of those that the template's items have there
    named = lambda p, i: name(p["i"]) & F.coalesce(F.array_contains(F.try_element_at("names", i), bare(p["d"])), F.lit(False))
    by_kind = F.transform("z", lambda p, i: F.coalesce((kind(p["d"]) == kind(p["i"])) | first_name(p, i), F.lit(False)))
    by_word = F.transform("z", lambda p, i: F.coalesce(F.when(name(p["i"]), named(p, i)).otherwise(bare(p["d"]) == kind(p["i"])), F.lit(False)))
    runs = F.aggregate(
        "agree",
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, x: F.struct(F.when(x, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["most"], F.when(x, s["now"] + 1).otherwise(0)).alias("most")),
    )
    keep = ["doc_id", "row_key", "template", "item_id", "same_id", "n_items", "literal", "exact", "first", "words"]
    read = pairs.withColumn("readings", F.array_distinct(F.array(by_kind, by_word))).select(*keep, "z", F.explode("readings").alias("agree"))
    # filled slots: placeholders that agree in the reading
    agreed = F.filter(F.arrays_zip("z", "agree"), lambda q: q["agree"] & _blank(q["z"]["i"]))
    # the first word of an item is no placeholder, but where a document has a name it stands for one
    changed = F.filter(F.transform(F.arrays_zip("z", "agree"), lambda q, i: F.when(~q["agree"] & ~((i == 0) & name(q["z"]["d"])), 1).otherwise(0)), lambda x: x == 1)
    checked = read.select(
        *keep, runs["most"].alias("longest"), F.size(F.filter("agree", lambda x: x)).alias("matched"), F.size(changed).alias("changed"),
        F.array_distinct(F.transform(agreed, lambda q: F.struct(bare(q["z"]["d"]).alias("kind"), q["z"]["d"].alias("d"), q["z"]["i"].alias("i")))).alias("slots"),
        F.exists(F.arrays_zip("z", "agree"), lambda q: q["agree"] & ~_blank(q["z"]["i"])).alias("worded"),
    )
    consistent = F.size(F.array_distinct(F.transform("slots", lambda p: p["i"]))) == F.size("slots")
    enough = (F.col("matched") >= F.ceil(F.lit(cover) * F.col("words"))) | (F.col("longest") >= run)
    leaks = checked.filter(F.col("exact") | (~F.col("literal") & enough & consistent & F.col("worded")))
    # of readings and alignments an exact one, then that with more tokens
    best = leaks.groupBy("doc_id", "row_key", "template").agg(
        F.max(F.struct("exact", "matched", "longest", (-F.col("first")).alias("earlier"), "words", (-F.col("changed")).alias("same"), "n_items", "item_id", "same_id")).alias("b")
    )
    how = F.when(F.col("b.exact"), "exact").when(F.col("b.same") == 0, "reparameterised").otherwise("altered")
    return best.select(
        "doc_id", F.when(F.col("b.exact"), F.col("b.same_id")).otherwise(F.col("b.item_id")).alias("item_id"), "b.n_items", how.alias("kind"), (-F.col("b.earlier")).cast("long").alias("first_word"),
        F.col("b.words").cast("long").alias("n_words"), F.when(F.col("b.exact"), F.col("b.words")).otherwise(F.col("b.matched")).cast("long").alias("n_matched"),
        F.when(F.col("b.exact"), F.col("b.words")).otherwise(F.col("b.longest")).cast("long").alias("longest_run"), "template", "row_key",
    )


def drop_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Documents without a leak, with all their columns; rows without an id are told apart by their row keys.

    Items of fewer than least_words tokens stand in many documents by chance: what has only such ones stays.
    """
    return without(docs, leaks.filter(F.col("n_words") >= least_words), row_key(id_col, text_col))
