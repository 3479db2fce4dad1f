"""DuckDB SQL of the operators that SQL can express on whole tables."""

_RATES = {"symbol_rate": ("n_symbols", "n_words", 250), "dup_rate": ("n_dup_lines", "n_lines", 400), "repeat_rate": ("n_repeat_words", "n_words", 250), "word_length": ("word_chars", "n_words", 1500)}
_SHIFT = "greatest(length(bin(v)) - 6, 0)"
_START = "((b - 32 * greatest(b // 32 - 1, 0)) * CAST(pow(2, greatest(b // 32 - 1, 0)) AS BIGINT))"

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
p AS (SELECT r, count(DISTINCT i + o) AS n FROM s, range(0, 8) AS t(o) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN p ON w.r = p.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {least} AS least, {a} * 1000 // {b} AS v FROM f WHERE NOT base_failed AND {b} > 0" for k, (a, b, least) in _RATES.items())}),
c AS (SELECT lang, source, measure, least, {_SHIFT} * 32 + (v >> {_SHIFT}) AS b, count(*) AS n FROM v GROUP BY ALL),
n AS (SELECT lang, measure, least, b, sum(n) AS n FROM c GROUP BY ALL),
a AS (SELECT measure, b, sum(n) AS n FROM c GROUP BY ALL),
z AS (SELECT lang, measure, least, b, n * 1500000 // sum(n) OVER (PARTITION BY lang, measure) AS w FROM n
      UNION ALL SELECT k.lang, k.measure, k.least, o.b, o.w FROM (SELECT DISTINCT lang, measure, least FROM n) k
      JOIN (SELECT measure, b, n * 500000 // sum(n) OVER (PARTITION BY measure) AS w FROM a) o ON k.measure = o.measure),
l AS (SELECT 0 AS k, lang, source, measure, least, b, n * 10000 AS w FROM c
      UNION ALL SELECT 0, z.lang, k.source, z.measure, z.least, z.b, z.w FROM (SELECT DISTINCT lang, source, measure FROM c) k
      JOIN z ON z.lang IS NOT DISTINCT FROM k.lang AND z.measure = k.measure
      UNION ALL SELECT 1, lang, NULL, measure, least, b, w FROM z),
e AS (SELECT k, lang, source, measure, least, {_START} AS v, sum(w) AS w FROM l GROUP BY ALL),
u AS (SELECT *, sum(w) OVER (PARTITION BY k, lang, source, measure ORDER BY v) * 2 >= sum(w) OVER (PARTITION BY k, lang, source, measure) AS enough FROM e),
i AS (SELECT *, min(CASE WHEN enough THEN v END) OVER (PARTITION BY k, lang, source, measure) AS median FROM u),
j AS (SELECT *, abs(v - median) AS off FROM i),
x AS (SELECT *, sum(w) OVER (PARTITION BY k, lang, source, measure ORDER BY off) * 2 >= sum(w) OVER (PARTITION BY k, lang, source, measure) AS close FROM j),
h AS (SELECT k, lang, source, measure, median, greatest(min(CASE WHEN close THEN off END) * 6, least) AS reach FROM x GROUP BY k, lang, source, measure, median, least),
y AS (SELECT o.lang, o.source, o.measure, o.median, least(o.reach, 4 * g.reach) AS reach FROM h o JOIN h g ON g.k = 1 AND g.lang IS NOT DISTINCT FROM o.lang AND g.measure = o.measure WHERE o.k = 0),
t AS (SELECT lang, source, {", ".join(f"max(CASE WHEN measure = '{m}' THEN median + reach END) AS {m}_high" for m in _RATES)},
      max(CASE WHEN measure = 'word_length' THEN median - reach END) AS word_length_low FROM y GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"coalesce({a} * 1000 // nullif({b}, 0) <= {k}_high, true)" for k, (a, b, _) in _RATES.items())}
  AND coalesce(word_chars * 1000 // nullif(n_words, 0) >= word_length_low, true) AS kept
FROM f LEFT JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""

#: Base32 of SHA-1: the digest's 160 bits as 32 groups of five.
WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
t AS (SELECT *, array_to_string(list_transform(range(0, 40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (position(substr(hex, CAST(i + 1 AS BIGINT), 1) IN '0123456789abcdef') - 1) + 1, 4)), '') AS bits FROM d),
o AS (SELECT *, min(page_id) OVER (PARTITION BY hex, n) AS first,
      array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, CAST(5 * k + j + 1 AS BIGINT), 1) = '1' THEN CAST(pow(2, 4 - j) AS BIGINT) ELSE 0 END)) AS BIGINT), 1)), '') AS payload_digest FROM t)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM o
"""

FILTER_INTERACTION = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
b AS (SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text),
      regexp_matches(text, '[#$%&*|]'), coalesce(first < doc_id, false)] AS f FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM b LEFT JOIN l ON b.doc_id = l.doc_id),
g AS (SELECT part, f, count(*) AS n, sum(CAST(good AS BIGINT)) AS good, sum(CAST(toxic AS BIGINT)) AS toxic FROM x GROUP BY ALL),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, e.i, h.i] AS o FROM k a, k b, k c, k e, k h WHERE len(list_distinct([a.i, b.i, c.i, e.i, h.i])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda j: substr('ABCDE', CAST(j AS BIGINT), 1)), '') AS filter_order, k.i AS step, o[k.i] AS this, o[1:k.i - 1] AS before FROM o, k),
e AS (SELECT *, f[this] AS fails, len(list_filter(before, lambda j: f[j])) > 0 AS gone, len(list_filter(f, lambda v: v)) AS failing FROM g, s),
r AS (SELECT part, filter_order, step, this, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND failing = 1 THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, this) AS BIGINT) AS shapley FROM r
"""
