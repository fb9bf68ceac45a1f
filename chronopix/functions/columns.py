"""Column expressions: masks, text and time parsing, numbers, spectral indices, gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("B2", "B3", "B4", "B8", "B11", "B12")
VALID_MIN, VALID_MAX = 0.0, 10_000.0
INDICES = ("ndvi", "evi", "ndwi", "ndsi", "ndmi", "nbr")

# The patterns of timestamps and of band file names, and date-time formats in the order they are tried.
STAMP = r"(\d{8}T\d{6})"
BAND_FILE = r"COPERNICUS_S2_HARMONIZED_(B\d+[A-Z]?)_lon(-?\d+(?:\.\d+)?)_lat(-?\d+(?:\.\d+)?)"
CHUNK = r"(?<=.)-\d{10}-\d{10}$"
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMdd'T'HHmmss")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid_reflectance(v: str | Column, low: float = VALID_MIN, high: float = VALID_MAX) -> Column:
    """Finite and strictly between the bounds; false for NULL."""
    v = col(v)
    return F.coalesce(~F.isnan(v) & (v > low) & (v < high), F.lit(False))


def valid_mask(ys: str | Column, low: float = VALID_MIN, high: float = VALID_MAX) -> Column:
    """The mask of an array of values."""
    return F.transform(col(ys), lambda v: is_valid_reflectance(v, low, high))


def count_valid(mask: str | Column) -> Column:
    return F.size(F.filter(col(mask), lambda x: x))


def masked(v: str | Column, low: float = VALID_MIN, high: float = VALID_MAX) -> Column:
    """The value, or NULL where it is not valid."""
    return F.when(is_valid_reflectance(v, low, high), col(v))


def in_range(v: str | Column, low: float, high: float) -> Column:
    """Finite and within the closed range; false for NULL."""
    v = col(v)
    return F.coalesce(~F.isnan(v) & v.between(low, high), F.lit(False))


def within(v: str | Column, low: float, high: float) -> Column:
    """P10: the value, or NULL outside the closed range."""
    return F.when(in_range(v, low, high), col(v))


def null_if_nan(v: str | Column) -> Column:
    return F.nanvl(col(v), F.lit(None).cast("double"))


def all_present(bands: str | Column) -> Column:
    """P5: every band of an array is there and finite."""
    return F.forall(col(bands), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def stamp(text: str | Column) -> Column:
    """the first YYYYMMDDTHHMMSS in a text, or NULL."""
    return F.nullif(F.regexp_extract(col(text), STAMP, 1), F.lit(""))


def band_file(name: str | Column) -> Column:
    """band, lon and lat of a band file's name, NULL where it has none."""
    part = lambda i: F.nullif(F.regexp_extract(col(name), BAND_FILE, i), F.lit(""))
    return F.struct(part(1).alias("band"), part(2).cast("double").alias("lon"), part(3).cast("double").alias("lat"))


def strip_chunk(s: str | Column) -> Column:
    """the text without a chunk suffix -##########-##########."""
    return F.regexp_replace(col(s), CHUNK, "")


def safe_component(s: str | Column) -> Column:
    """what is no letter, digit, dash or underscore becomes an underscore."""
    return F.regexp_replace(col(s), "[^A-Za-z0-9_-]", "_")


def location_token(lon: str | Column, lat: str | Column, digits: int = 4) -> Column:
    """lon%.4f_lat%.4f; output folders use six digits."""
    return F.format_string(f"lon%.{digits}f_lat%.{digits}f", col(lon), col(lat))


def stack_path(root: str, method: str | Column, source: str, lon: str | Column, lat: str | Column, when: str | Column, suffix: str = "_prediction") -> Column:
    """the path of a stack: a folder of the source and place, method, source, place and time in the name; colons in the time
    become dashes. Ground truth has the method `ground_truth` and no suffix."""
    folder = F.format_string(f"{root.rstrip('/')}/{source}_recon/%.4f_%.4f/[", col(lon).cast("double"), col(lat).cast("double"))
    return F.concat(folder, col(method), F.lit(f"]_{source}_"), location_token(lon, lat, 6), F.lit("_"), F.translate(col(when), ":", "-"), F.lit(f"{suffix}.tif"))


def prediction_name(name: str | Column) -> Column:
    """method and stem of `[method]_stem_prediction.tif`."""
    part = lambda i: F.nullif(F.regexp_extract(col(name), r"^\[([^\]]+)\]_(.*)_prediction\.tif$", i), F.lit(""))
    return F.struct(part(1).alias("method"), part(2).alias("stem"))


def preferred_frequencies(periods: str | Column) -> Column:
    """comma-separated periods in days to frequencies in Hz; tokens that are no positive number are dropped."""
    days = F.transform(F.split(col(periods), ","), lambda x: F.trim(x).try_cast("double"))
    return F.transform(F.filter(days, lambda x: x > 0), lambda x: 1 / (x * 86400.0))


def target_key(ratio: float, late: float) -> str:
    """the key under which a chosen target is kept."""
    return f"min_valid_ratio={ratio:.6f};late_fraction={late:.6f}"


def fingerprint(band: str | Column, path: str | Column, size: str | Column, modified: str | Column) -> Column:
    """F12, an aggregate: md5 of the sorted manifest of source files."""
    line = F.concat_ws("\n", F.concat(F.lit("band="), col(band)), F.concat(F.lit("path="), col(path)), F.concat(F.lit("len="), col(size).cast("string")), F.concat(F.lit("mtime="), col(modified).cast("string")))
    return F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n"))


def epoch_seconds(text: str | Column) -> Column:
    """Seconds since 1970 (UTC, whatever the session's zone) of a date-time text in one of FORMATS; NULL for others, dates
    alone included."""
    plain = F.coalesce(*[F.try_to_timestamp(F.concat(F.trim(col(text)), F.lit("+00:00")), F.lit(f + "xxx")) for f in FORMATS])
    return F.unix_seconds(plain).cast("double")


def epoch_seconds_or_raise(text: str | Column) -> Column:
    """As epoch_seconds(), but a text that is no date-time ends the query."""
    text = col(text)
    return F.coalesce(epoch_seconds(text), F.raise_error(F.concat(F.lit("not a timestamp: "), F.coalesce(text, F.lit("NULL")))).cast("double"))


def frequency_matches_any(f: str | Column, others: str | Column, tolerance: float = 1e-10) -> Column:
    """Whether a frequency is one of an array's, within the relative tolerance."""
    return F.exists(col(others), lambda x: F.abs(col(f) - x) <= tolerance * F.greatest(F.abs(x), F.lit(1e-30)))


def joined_frequencies(shared: str | Column, private: str | Column, tolerance: float) -> Column:
    """The sorted union of two arrays; neighbours within the relative tolerance become their mean, one after the other."""
    both = F.array_sort(F.concat(col(shared), col(private)))
    last = lambda a: F.element_at(a, -1)
    near = lambda a, x: F.abs(x - last(a)) / F.greatest(last(a), F.lit(1e-12)) <= max(tolerance, 0.0)
    step = lambda a, x: F.when(F.size(a) == 0, F.array(x)).when(near(a, x), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(0.5 * (last(a) + x)))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(both, F.array().cast("array<double>"), step)


def synthetic_days(n: str | Column) -> Column:
    """Days 0 to n - 1 for bands without timestamps, and none for n < 1; the last one is the target."""
    return F.when(col(n) > 0, F.transform(F.sequence(F.lit(0), F.greatest(col(n), F.lit(1)) - 1), lambda i: i.cast("double"))).otherwise(F.array().cast("array<double>"))


def band_position(descriptions: str | Column, n_bands: str | Column, band: str) -> Column:
    """A raster's band (from 1) by its description, else by its place among BANDS; NULL where there is neither."""
    named = F.array_position(col(descriptions), F.lit(band)).cast("int")
    place = BANDS.index(band) + 1 if band in BANDS else None
    fallback = F.when(col(n_bands) >= place, F.lit(place)) if place else F.lit(None).cast("int")
    return F.coalesce(F.when(named > 0, named), fallback)


def size_text(n: str | Column) -> Column:
    """bytes for people; halves go to the even digit."""
    n = col(n)
    scaled = lambda power, unit: F.concat(F.format_string("%.2f", F.bround(n / 1024.0**power, 2)), F.lit(f" {unit}"))
    return F.when(n >= 1024**3, scaled(3, "GiB")).when(n >= 1024**2, scaled(2, "MiB")).when(n >= 1024, scaled(1, "KiB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def duration_text(seconds: str | Column) -> Column:
    """a duration for people; `unknown` for what is negative or not finite."""
    s = col(seconds)
    unknown = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")) | (s < 0)
    return F.when(unknown, "unknown").when(s >= 3600, F.format_string("%.2f h", F.bround(s / 3600, 2))).when(s >= 60, F.format_string("%.1f min", F.bround(s / 60, 1))).otherwise(F.format_string("%.1f s", F.bround(s, 1)))


def day_of_year_gap(t: str | Column, target: str | Column, year: float = 365.25) -> Column:
    """Circular distance of two day counts modulo a year."""
    d = F.abs(col(t) % year - col(target) % year)
    return F.when(d > year / 2, year - d).otherwise(d)


def fractional_year(ts: str | Column) -> Column:
    """2019.5 for the middle of 2019."""
    first = F.trunc(col(ts), "year").cast("timestamp")
    after = F.add_months(F.trunc(col(ts), "year"), 12).cast("timestamp")
    return F.year(col(ts)) + (F.unix_micros(col(ts).cast("timestamp")) - F.unix_micros(first)) / (F.unix_micros(after) - F.unix_micros(first))


def next_even(n: str | Column) -> Column:
    return F.shiftright(col(n) + 1, 1) * 2


def next_power_of_two(n: str | Column) -> Column:
    return F.when(col(n) <= 2, F.lit(2)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(col(n).cast("double"))))).cast("long")


def sinc(x: str | Column) -> Column:
    x = col(x)
    return F.when(F.abs(x) < 1e-8, 1.0).otherwise(F.sin(F.pi() * x) / (F.pi() * x))


def soft_threshold(z: str | Column, t: str | Column) -> Column:
    z, t = col(z), col(t)
    return F.when(z > t, z - t).when(z < -t, z + t).otherwise(0.0)


def huber_weight(r: str | Column, delta: float) -> Column:
    d = max(delta, 1e-8)
    return F.when(F.abs(col(r)) <= d, 1.0).otherwise(d / F.abs(col(r)))


def is_high_tier(f: str | Column, days: float) -> Column:
    """M9: a positive frequency whose period is under so many days."""
    return F.coalesce((col(f) > 0) & (1 / (col(f) * 86400.0) < days), F.lit(False))


def model_order(n: str | Column) -> Column:
    """K26."""
    n = col(n)
    return F.when(n < 6, 0).when(n < 18, 1).when(n < 24, 2).otherwise(3)


def is_outlier(r: str | Column, fet: float, sf: str) -> Column:
    """K27."""
    r = col(r)
    return r < -fet if sf == "low" else r > fet if sf == "high" else F.abs(r) > fet


def band_order(name: str | Column) -> list[Column]:
    """O1: sort keys of band names: number, suffix; unknown names last, by name."""
    number = F.nullif(F.regexp_extract(col(name), r"^B(\d+)", 1), F.lit("")).cast("int")
    return [F.coalesce(number, F.lit(10_000)), F.when(number.isNull(), col(name)).otherwise(F.regexp_extract(col(name), r"^B\d+(.*)$", 1))]


def ratio(n: Column, d: Column, guard: float = 1e-6) -> Column:
    return F.when(F.abs(d) > guard, n / d)


def spectral_indices(bands: dict[str, Column] | None = None, scale: float = VALID_MAX, clamp: bool = False) -> dict[str, Column]:
    """The six indices of bands in DN; NULL unless all six bands are there and the denominator is over 1e-6.

    clamp leaves out values outside [-1, 1], as evaluation tables do.
    """
    raw = bands or {b: F.col(b) for b in BANDS}
    there = F.lit(True)
    for b in BANDS:
        there = there & raw[b].isNotNull() & ~F.isnan(raw[b])
    r = {b: raw[b] / scale for b in BANDS}
    diff = lambda a, b: ratio(r[a] - r[b], r[a] + r[b])
    out = {
        "ndvi": diff("B8", "B4"),
        "evi": ratio(2.5 * (r["B8"] - r["B4"]), r["B8"] + 6 * r["B4"] - 7.5 * r["B2"] + 1),
        "ndwi": diff("B3", "B8"),
        "ndsi": diff("B3", "B11"),
        "ndmi": diff("B8", "B11"),
        "nbr": diff("B8", "B12"),
    }
    return {k: F.when(there & (v.between(-1, 1) if clamp else F.lit(True)), v) for k, v in out.items()}


def gap_bin(v: str | Column, bins: int, top: float = 0.2) -> Column:
    """Bins of equal width over [0, top); what lies above falls into the last, below into the first."""
    return F.least(F.lit(bins - 1), F.floor(F.greatest(col(v), F.lit(0.0)) / (top / bins))).cast("int")


def gap_bin_label(i: str | Column, bins: int, top: float = 0.2) -> Column:
    """G3."""
    width = top / bins
    low = F.format_string("%.4f", col(i) * width)
    return F.when(col(i) >= bins - 1, F.concat(F.lit("["), low, F.lit(",+inf)"))).otherwise(F.concat(F.lit("["), low, F.lit(","), F.format_string("%.4f", (col(i) + 1) * width), F.lit(")")))


# Upper ends and labels of absolute-error bins (in DN and of indices), lower ends and labels of index classes.
RAW_ERROR_BINS = ((50.0, "<=50"), (100.0, "50-100"), (250.0, "100-250"), (500.0, "250-500"), (1000.0, "500-1000"), (None, ">1000"))
INDEX_ERROR_BINS = ((0.02, "<=0.02"), (0.05, "0.02-0.05"), (0.10, "0.05-0.10"), (0.20, "0.10-0.20"), (None, ">0.20"))
INDEX_CLASSES = ((0.6, ">=0.6"), (0.4, "0.4-0.6"), (0.2, "0.2-0.4"), (0.0, "0-0.2"), (None, "<0"))


def error_bin(e: str | Column, bins=RAW_ERROR_BINS) -> Column:
    """The label of the (low, high] bin of |e|; the first takes 0 too, the last is open."""
    a = F.abs(col(e))
    out = None
    for high, label in bins:
        hit = a > bins[-2][0] if high is None else a <= high
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def index_class(v: str | Column, classes=INDEX_CLASSES) -> Column:
    """The label of the [low, high) class."""
    v = col(v)
    out = None
    for low, label in classes:
        hit = v < classes[-2][0] if low is None else v >= low
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def dense_grid(low: str | Column, high: str | Column, n: int = 240) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: col(low) + (col(high) - col(low)) * i / (n - 1))


def last_at_or_before(obs: str | Column, target: str | Column) -> Column:
    """From an array of (t, v) sorted by t, the last v with t <= target, else the first; NULL for an empty array."""
    before = F.filter(col(obs), lambda o: o["t"] <= col(target))
    return F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(col(obs), F.lit(1)))["v"]
