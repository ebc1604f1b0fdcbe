"""DuckDB SQL for the operators that SQL can express whole."""

from __future__ import annotations

import math

from tillstone.llm import hosts, urls
from tillstone.llm import mixing as mixing_op

_SPACE = r"[\x20\x09-\x0D]"


def host_rules() -> str:
    """The measures, the hosts' shrunk rates and the verdicts of ``hosts.judged``."""
    low, high = hosts.MEAN_WORD_CHARS
    size = hosts.WINDOW
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + {size - 1}], ' ')) AS times
  FROM w, unnest(range(1, len(ws) - {size - 2})) AS u(i)),
repeats AS (
  SELECT r, count(DISTINCT i + j) AS n FROM windows, range(0, {size}) AS k(j) WHERE times > 1 GROUP BY r),
m AS (
  SELECT w.r, doc_id, source, len(ws) AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeats ON w.r = repeats.r),
b AS (
  SELECT *, n_words < {hosts.MIN_WORDS} OR 100 * n_repeat_words > {hosts.MAX_REPEAT_PCT} * n_words AS base_failed FROM m),
f AS (
  SELECT *, base_failed OR 100 * n_symbols > {hosts.MAX_SYMBOLS_PER_100_WORDS} * n_words
         OR 100 * n_dup_lines > {hosts.MAX_DUP_LINE_PCT} * n_lines
         OR word_chars < {low} * n_words OR word_chars > {high} * n_words AS failed FROM b),
h AS (SELECT source, count(*) AS n, CAST(sum(CAST(failed AS INT)) AS BIGINT) AS bad FROM f GROUP BY source),
a AS (
  SELECT sum(bad) / sum(n) AS mean, sum(bad * bad / n) / sum(n) AS squares, (count(*) - 1) / sum(n) AS share FROM h),
v AS (SELECT mean, squares - mean * mean - share * (mean * (1 - mean)) AS spread FROM a),
s AS (
  SELECT mean, CASE WHEN spread > 1e-12 THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1e6) ELSE 1e6 END AS strength
  FROM v),
r AS (SELECT source, n, strength, mean, (bad + mean * strength) / (n + strength) AS rate FROM h, s),
strict AS (
  SELECT source FROM r WHERE rate - {hosts.DOUBTS} * sqrt(rate * (1.0 - rate) / (n + (strength + 1))) > {hosts.MARGIN} * mean)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (failed AND EXISTS (SELECT 1 FROM strict WHERE strict.source IS NOT DISTINCT FROM f.source)) AS kept
FROM f"""


def url_filter() -> str:
    """The rules, both models, the threshold and the verdicts of ``urls.judged``."""
    order = urls.ORDER
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    truth = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    levels = [f"""
l{order} AS (
  SELECT gram, CAST(sum(CASE WHEN role = 'allow' THEN 1 ELSE 0 END) AS BIGINT) AS good,
         CAST(sum(CASE WHEN role = 'block' THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM g GROUP BY gram)"""]
    for n in range(order - 1, -1, -1):
        levels.append(f"""
l{n} AS (
  SELECT right(gram, {n + 1}) AS gram, CAST(sum(good) AS BIGINT) AS good, CAST(sum(bad) AS BIGINT) AS bad
  FROM l{n + 1} GROUP BY 1)""")
    for n in range(order + 1):
        sides = ", ".join(
            f"""CASE WHEN sum({s}) OVER c > 0 THEN ({s} + sum(CASE WHEN {s} > 0 THEN 1 ELSE 0 END) OVER c * below_{s})
              / (sum({s}) OVER c + sum(CASE WHEN {s} > 0 THEN 1 ELSE 0 END) OVER c) ELSE below_{s} END AS {s}"""
            for s in ("good", "bad"))
        below = (f"SELECT gram, good, bad, CAST({1 / urls.ALPHABET} AS DOUBLE) AS below_good, CAST({1 / urls.ALPHABET} AS DOUBLE) AS below_bad FROM l0" if n == 0 else
                 f"SELECT l{n}.gram, l{n}.good, l{n}.bad, p{n - 1}.good AS below_good, p{n - 1}.bad AS below_bad FROM l{n} JOIN p{n - 1} ON p{n - 1}.gram = right(l{n}.gram, {n})")
        levels.append(f"""
p{n} AS (SELECT gram, {sides} FROM ({below}) x WINDOW c AS (PARTITION BY left(gram, {n})))""")
    return f"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (
  SELECT r, page_id, rest, translate(raw, '{urls._UPPER}', '{urls._SMALL}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u) x),
t AS (SELECT *, {rule} AS rule, {truth} AS truth FROM v),
d AS (
  SELECT *, CASE WHEN truth IS NOT NULL AND {_md5_fold('rest')} = 0 THEN 'calibrate' ELSE truth END AS role FROM t),
g AS (
  SELECT r, role, substr(repeat(chr(2), {order}) || rest || chr(3), CAST(i AS BIGINT), {order + 1}) AS gram
  FROM d, unnest(range(1, length(rest) + 2)) AS k(i) WHERE rest <> ''),
{",".join(levels)},
q AS (SELECT gram, CAST(round(1e6 * (ln(good) - ln(bad))) AS BIGINT) AS ratio FROM p{order}),
z AS (
  SELECT r, sum(ratio) / (count(*) * CAST(1e6 AS DOUBLE)) AS score FROM g JOIN q ON g.gram = q.gram GROUP BY r),
e AS (SELECT d.*, score FROM d LEFT JOIN z ON d.r = z.r),
bins AS (
  SELECT floor(score * 100) AS bin, sum(CASE WHEN truth = 'allow' THEN 1 ELSE 0 END) AS good,
         sum(CASE WHEN truth = 'block' THEN 1 ELSE 0 END) AS bad
  FROM e WHERE role = 'calibrate' AND score IS NOT NULL GROUP BY 1),
cut AS (
  SELECT bin, coalesce(sum(good) OVER before, 0) AS missed, sum(bad) OVER () - coalesce(sum(bad) OVER before, 0) AS passed,
         sum(good) OVER () AS goods, sum(bad) OVER () AS bads
  FROM bins WINDOW before AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bound AS (
  SELECT coalesce((SELECT bin / 100 FROM cut WHERE goods > 0 AND bads > 0 ORDER BY missed * bads + passed * goods, bin LIMIT 1), 0.0) AS least)
SELECT page_id, host, path, rule, coalesce(truth, CASE WHEN score >= least THEN 'allow' ELSE 'block' END) AS verdict, score
FROM e, bound"""


def _md5_fold(column: str) -> str:
    return f"CAST(('0x' || substr(md5({column}), 1, 8)) AS BIGINT) % {urls.FOLDS}"


def mixing() -> str:
    """The targets, the random order and the words taken of ``mixing.shares``."""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing_op.WEIGHTS))
    scale = math.prod(set(mixing_op.WEIGHTS))
    digits = mixing_op.KEY_BITS // 4
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing_op.WORD}')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('{mixing_op.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {digits})) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, {mixing_op.MAX_EPOCHS} * source_size AS bound,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing_op.WEIGHTS)} {weight} END AS weight FROM s),
l AS (
  SELECT *, bound * ({scale} // weight) AS ratio FROM w),
c AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(bound) OVER before, 0) AS remaining,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS shared
  FROM l WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT ratio AS from_ratio, CAST(remaining AS HUGEINT) AS remaining, CAST(shared AS HUGEINT) AS shared
  FROM c WHERE remaining * weight <= bound * shared ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN ratio < from_ratio THEN CAST(bound AS DOUBLE)
              ELSE CAST(weight * remaining AS DOUBLE) / CAST(shared AS DOUBLE) END AS target FROM l, f),
b AS (
  SELECT *, CAST(round(target) AS HUGEINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(round(target) AS HUGEINT) // source_size ELSE 0 END AS epochs FROM t),
o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, o.source, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(start AS BIGINT) AS start,
       CAST(size * epochs + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source"""
