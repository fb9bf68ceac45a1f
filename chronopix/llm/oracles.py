"""SQL of the classifier and of language identification, step by step."""

from __future__ import annotations

from . import language, quality

CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, by bytes."""
    step = "lambda c, b: xor(crc_table[xor(c, b) & 255 + 1], c >> 8)".replace("xor(c, b) & 255 + 1", "(xor(c, b) & 255) + 1")
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), {step}), 4294967295)"


def _count(pattern: str) -> str:
    return f"length(regexp_replace(body, '[^{pattern}]', '', 'g'))"


def quality_sql() -> str:
    """Statistics, moments of the classes, elimination of each shrunk covariance, and the densities' difference."""
    share = lambda x: f"ln({x} + 0.002)"
    punctuation = "!\"#$%&()*+/:;<=>?@\\[\\\\\\]^_`{|}~".replace("'", "''")
    features = [
        "ln(1 + size)", "ln(1 + words)", "ln(1 + (size - spaces) / w)", share("upper / n"), share("digits / n"), share("punct / n"), share("punct / w"), "ln(1 + lines) - ln(1 + words)",
        "different / w", "pairs / w", share("top / w"), "ln(1 + size / greatest(lines + 1, 1))", share("stops / w"),
    ]
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    keep, shrink, floor = 1 - quality.SHRINKAGE, quality.SHRINKAGE, quality.FLOOR
    steps = [f"u0 AS (SELECT y, weight, {', '.join(f'm{i}' for i in range(d))}, {', '.join(f'a{i}_{j}' for i, j in pairs)} FROM shrunk)"]
    for k in range(d):
        columns = [f"a{i}_{j} - a{k}_{i} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" if i > k else f"a{i}_{j}" for i, j in pairs]
        steps.append(f"u{k + 1} AS (SELECT y, weight, {', '.join(f'm{i}' for i in range(d))}, {', '.join(columns)} FROM u{k})")
    walk = [f"z0 AS (SELECT r, u.*, {', '.join(f'x{i} - m{i} AS x{i}' for i in range(d))}, x0 - m0 AS t0 FROM stats CROSS JOIN u{d} u)"]
    for i in range(1, d):
        inner = "".join(f" - a{k}_{i} / a{k}_{k} * t{k}" for k in range(i))
        walk.append(f"z{i} AS (SELECT *, x{i}{inner} AS t{i} FROM z{i - 1})")
    distance = " + ".join(f"t{i} * t{i} / a{i}_{i} + ln(a{i}_{i})" for i in range(d))
    blank = r"[\x20\x09-\x0D]"
    return f"""
WITH crc AS (SELECT {CRC_TABLE} AS crc_table),
rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
held AS (SELECT r, {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 1 AS held_out FROM rows, crc),
split AS (SELECT r, body, list_filter(string_split_regex(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{blank}+'), lambda x: x <> '') AS ws FROM rows),
basic AS (SELECT r, CAST(octet_length(encode(body)) AS DOUBLE) AS size, CAST(len(ws) AS DOUBLE) AS words, {_count('A-Z')} AS upper, {_count('0-9')} AS digits, {_count(punctuation)} AS punct, {_count('.!?')} AS stops, {_count(chr(92) + 'n')} AS lines,
  {_count(r'\x20\x09-\x0D')} AS spaces, len(list_distinct(ws)) AS different, CASE WHEN len(ws) > 1 THEN len(list_distinct(list_zip(ws[1:len(ws) - 1], ws[2:]))) ELSE len(ws) END AS pairs,
  coalesce(list_max(map_values(list_histogram(ws))), 0) AS top, greatest(octet_length(encode(body)), 1) AS n, greatest(len(ws), 1) AS w FROM split),
stats AS (SELECT r, {', '.join(f"CASE WHEN size > 0 THEN {x} ELSE 0 END AS x{i}" for i, x in enumerate(features))} FROM basic),
marks AS (SELECT doc_id, CAST(avg(quality) >= 0.5 AS INTEGER) AS y FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
train AS (SELECT y, stats.* FROM stats JOIN rows USING (r) JOIN held USING (r) JOIN marks ON marks.doc_id = rows.doc_id WHERE NOT held_out),
moments AS (SELECT y, count(*) AS c, {', '.join(f'avg(x{i}) AS m{i}' for i in range(d))}, {', '.join(f'sum(x{i} * x{j}) / count(*) - sum(x{i}) / count(*) * sum(x{j}) / count(*) AS v{i}_{j}' for i, j in pairs)} FROM train GROUP BY y),
pooled AS (SELECT {', '.join(f'greatest(sum(c * v{i}_{i}) / sum(c), {floor}) AS q{i}' for i in range(d))}, sum(c) AS total FROM moments),
shrunk AS (SELECT y, ln(c / total) AS weight, {', '.join(f'm{i}' for i in range(d))}, {', '.join(f'{keep} * v{i}_{j}' + (f' + {shrink} * q{i} + {floor}' if i == j else '') + f' AS a{i}_{j}' for i, j in pairs)} FROM moments, pooled),
{', '.join(steps)},
{', '.join(walk)},
density AS (SELECT r, max(CASE WHEN y = 0 THEN g END) AS g0, max(CASE WHEN y = 1 THEN g END) AS g1 FROM (SELECT r, y, weight - 0.5 * ({distance}) AS g FROM z{d - 1}) GROUP BY r),
scores AS (SELECT r, 1 / (1 + exp(least(500, greatest(-500, g0 - g1)))) AS score FROM density)
SELECT doc_id, held_out, round(score, 6) AS score, CAST(round(score, 6) >= 0.5 AS INTEGER) AS predicted FROM rows JOIN held USING (r) JOIN scores USING (r)
"""


def language_sql(pages: bool) -> str:
    """Counts of trigrams, likelihoods without the own text, the three levels of priors, and both tests."""
    e, s, dev, bits = language.EVIDENCE, language.SMOOTHING, language.DEVIATIONS, language.GRAM_BITS
    uniform = f"(-{bits} * ln(2))"
    shown = "doc_id AS page_id" if pages else "doc_id"
    return rf"""
WITH rows AS (
  SELECT row_number() OVER () AS r, * FROM (
    SELECT false AS page, doc_id, lower(trim(lang)) AS said, lower(trim(source)) AS place, coalesce(text, '') AS body FROM documents
    UNION ALL
    SELECT true, page_id, lower(regexp_extract(coalesce(html, ''), '(?i)<html[^>]*\blang=["'']?([A-Za-z]+)', 1)), lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://([^/:?#]+)', 1)),
      regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') FROM pages)),
named AS (SELECT r, page, doc_id, nullif(regexp_extract(nullif(said, ''), '^[^-_]+', 0), '') AS declared, nullif(place, '') AS host, regexp_extract(coalesce(place, ''), '\.([^.]+)$', 1) AS suffix, greatest(octet_length(encode(body)) - 2, 0) AS grams, hex(encode(body)) AS bytes FROM rows),
pair AS (SELECT r, generate_subscripts(h, 1) AS i, unnest(h) AS h FROM (SELECT r, regexp_extract_all(bytes, '..') AS h FROM named)),
byte AS (SELECT r, i, CAST('0x' || h AS BIGINT) AS b FROM pair),
letter AS (SELECT r, count(*) AS letters FROM byte WHERE b BETWEEN 65 AND 90 OR b BETWEEN 97 AND 122 OR b >= 128 GROUP BY r),
low AS (SELECT r, i, CASE WHEN b BETWEEN 65 AND 90 THEN b + 32 WHEN b BETWEEN 9 AND 13 THEN 32 WHEN b BETWEEN 48 AND 57 THEN 48 ELSE b END AS b FROM byte),
tri AS (SELECT r, b, lead(b, 1) OVER w AS c, lead(b, 2) OVER w AS d FROM low WINDOW w AS (PARTITION BY r ORDER BY i)),
own AS MATERIALIZED (SELECT r, (((b << 16) + (c << 8) + d) * 2654435761 & 4294967295) >> {32 - bits} AS g, count(*) AS n FROM tri WHERE d IS NOT NULL GROUP BY ALL),
lang AS (SELECT declared AS k, row_number() OVER (ORDER BY declared) AS ord, count(*) OVER () AS many FROM named WHERE declared IS NOT NULL GROUP BY 1),
counts AS MATERIALIZED (SELECT declared AS k, g, sum(n) AS n FROM own JOIN named USING (r) WHERE declared IS NOT NULL GROUP BY ALL),
totals AS (SELECT k, ord, many, coalesce(sum(n), 0) AS t FROM lang LEFT JOIN counts USING (k) GROUP BY ALL),
mine AS (SELECT r, k, ord, many, t, coalesce(declared = k AND t > grams, false) AS own FROM named CROSS JOIN totals),
raw AS (SELECT r, k, sum(own.n * ln(coalesce(counts.n, 0) - CASE WHEN mine.own THEN own.n ELSE 0 END + 0.5)) AS l FROM mine JOIN own USING (r) LEFT JOIN counts USING (k, g) GROUP BY ALL),
ll AS MATERIALIZED (SELECT r, k, ord, many, coalesce((l - grams * ln(t - CASE WHEN own THEN grams ELSE 0 END + {2 ** (bits - 1)})) * least({e}, grams) / greatest(grams, 1), 0) AS ll FROM mine JOIN named USING (r) LEFT JOIN raw USING (r, k)),
bests AS (SELECT r, CASE WHEN max(ll) > min(ll) AND coalesce(any_value(letters), 0) > 0 THEN arg_min(k, (-ll, ord)) END AS best, max(ll) AS most, coalesce(any_value(letters), 0) AS letters FROM ll LEFT JOIN letter USING (r) GROUP BY r),
judged AS MATERIALIZED (SELECT * FROM named JOIN bests USING (r)),
fitted AS (SELECT best AS k, quantile_cont(bin, 0.5) / {language.BINS} AS median, quantile_cont(bin, 0.84) / {language.BINS} AS high FROM (SELECT best, round(most / least({e}, grams) * {language.BINS}) AS bin FROM judged WHERE grams >= {language.FIT_LEAST} AND best IS NOT NULL) GROUP BY 1),
dense AS MATERIALIZED (SELECT k, g, ln((coalesce(n, 0) + 0.5) / (t + {2 ** (bits - 1)})) AS lp FROM totals CROSS JOIN generate_series(0, {2**bits - 1}) x(g) LEFT JOIN counts USING (k, g)),
crossed AS MATERIALIZED (SELECT a.k AS a, b.k AS b, sum(exp(a.lp) * b.lp) AS v, sum(exp(a.lp) * b.lp * b.lp) AS sq FROM dense a JOIN dense b USING (g) GROUP BY ALL),
limits AS (SELECT o.a AS k, sqrt(greatest(0, o.sq - o.v * o.v)) AS spread, greatest({uniform}, coalesce(median, o.v) - greatest({dev} * (coalesce(high, o.v) - coalesce(median, o.v)), (coalesce(median, o.v) - greatest({uniform}, coalesce(near, {uniform}))) / 2)) AS least
  FROM crossed o LEFT JOIN fitted ON fitted.k = o.a LEFT JOIN (SELECT b, max(v) AS near FROM crossed WHERE a <> b GROUP BY b) n ON n.b = o.a WHERE o.a = o.b),
by_host AS (SELECT suffix, host, best AS k, count(*) AS c FROM judged WHERE host IS NOT NULL GROUP BY ALL),
host_sum AS (SELECT host, sum(c) FILTER (k IS NOT NULL) AS all_host FROM by_host GROUP BY 1),
by_suffix AS (SELECT suffix, k, sum(c) AS c FROM by_host GROUP BY ALL),
suffix_sum AS (SELECT suffix, sum(c) FILTER (k IS NOT NULL) AS all_suffix FROM by_suffix GROUP BY 1),
corpus AS (SELECT best AS k, count(*) AS c FROM judged WHERE best IS NOT NULL GROUP BY 1),
claims AS (SELECT declared, best AS k, count(*) AS c FROM judged WHERE declared IS NOT NULL AND best IS NOT NULL GROUP BY ALL),
spoken AS (SELECT k, sum(c) AS c FROM claims GROUP BY 1),
parts AS (SELECT ll.r, ll.k, ll.ord, many, ll.ll, judged.declared, judged.host, CASE WHEN best = ll.k THEN 1 ELSE 0 END AS e, CASE WHEN best IS NULL THEN 0 ELSE 1 END AS mine, coalesce(corpus.c, 0) AS co, (SELECT coalesce(sum(c), 0) FROM corpus) AS all_co,
  coalesce(claims.c, 0) AS cl, coalesce(spoken.c, 0) AS sp, coalesce(h.c, 0) AS ho, coalesce(all_host, 0) AS all_ho, coalesce(x.c, 0) AS su, coalesce(all_suffix, 0) AS all_su
  FROM ll JOIN judged USING (r) LEFT JOIN corpus ON corpus.k = ll.k LEFT JOIN claims ON claims.declared = judged.declared AND claims.k = ll.k LEFT JOIN spoken ON spoken.k = ll.k
  LEFT JOIN by_host h ON h.host = judged.host AND h.k = ll.k LEFT JOIN host_sum ON host_sum.host = judged.host LEFT JOIN by_suffix x ON x.suffix = judged.suffix AND x.k = ll.k LEFT JOIN suffix_sum ON suffix_sum.suffix = judged.suffix),
priors AS (SELECT *, (co - e + 1) / (all_co + many - mine) AS base FROM parts),
levels AS (SELECT *, (su - e + {s} * base) / (all_su - mine + {s}) AS above FROM priors),
joint AS (SELECT *, ll + CASE WHEN declared IS NULL THEN 0 ELSE ln((cl - e + 1) / (sp + many - e)) END + ln(CASE WHEN host IS NULL THEN base ELSE (ho - e + {s} * above) / (all_ho - mine + {s}) END) AS j FROM levels),
fused AS (SELECT r, arg_min(k, (-j, ord)) AS k, arg_min(ll, (-j, ord)) AS ll, max(j) AS top FROM joint GROUP BY r),
mass AS (SELECT joint.r, 1 / sum(exp(j - top)) AS posterior FROM joint JOIN fused USING (r) GROUP BY 1)
SELECT {shown}, fused.k AS language, round(posterior, 6) AS posterior, best AS text_language, declared,
  letters > 0 AND posterior >= {language.LEAST} AND (grams = 0 OR fused.ll / greatest(1, least({e}, grams)) >= least - {dev} * spread * sqrt(3 / greatest(1, grams))) AS kept
FROM judged JOIN fused USING (r) JOIN mass USING (r) JOIN limits USING (k) WHERE page = {str(pages).lower()}
"""
