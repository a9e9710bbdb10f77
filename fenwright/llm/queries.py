"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from fenwright.llm import decontaminate, filter_audit, html_extract, language_id, lexical_search, mix_sources, near_dedup, quality_rules, secret_scan, suffix_dedup, token_output, url_filter, warc

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.judge(table(spark, sf_dir, "documents"), word_tokenizer())


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def _hit(term: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::BIGINT"


OP2_SQL = rf"""
WITH p AS (SELECT page_id, translate(coalesce(url, ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS low,
  translate(regexp_extract(coalesce(url, ''), '{url_filter.PARTS}', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '{url_filter.PARTS}', 2) AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
  {" + ".join(map(_hit, url_filter.STRICT))} AS n_strict,
  {" + ".join(_hit(w) for w, _ in url_filter.SOFT)} AS n_soft,
  {" + ".join(f"{n} * {_hit(w)}" for w, n in url_filter.SOFT)} AS soft_weight FROM p)
SELECT page_id, host, path, rule, n_strict, n_soft, soft_weight,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN n_strict > 0 OR (n_soft >= {url_filter.MIN_SOFT} AND soft_weight >= {url_filter.MIN_WEIGHT}) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.judge(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.judge(table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN m USING (h)
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.judge(table(spark, sf_dir, "documents"), words=suffix_dedup.WORDS)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS p
  FROM items, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0),
windows AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
  FROM lowered, (SELECT DISTINCT n FROM patterns), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
found AS (SELECT doc_id, item_id, i, n FROM windows JOIN patterns USING (n, p)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.judge(table(spark, sf_dir, "documents"), size=4, percent=80)


OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '{WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(4, len(w)) - 1), ' ') AS s
      FROM d, LATERAL (SELECT unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.judge(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.judge(table(spark, sf_dir, "documents"))


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, [3, 1, 2][rnk % 3 + 1] AS weight, source_size * 2 AS cap FROM r),
l AS (SELECT *, row_number() OVER o AS nth,
        (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, rnk)),
c AS (SELECT *, cap <= level * weight AS capped FROM l),
f AS (SELECT *, min_by(level, nth) FILTER (WHERE NOT capped) OVER () AS water FROM c),
t AS (SELECT source, source_size, (CASE WHEN capped OR water IS NULL THEN cap ELSE water * weight END)::DOUBLE AS target FROM f),
p AS (SELECT d.*, t.source_size, t.target,
        (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target)::BIGINT - start)) + greatest(0, least(size, floor(target)::BIGINT - start - source_size)))::BIGINT AS taken,
  CASE WHEN target > 0 THEN (start + size)::DOUBLE / target ELSE 0 END AS virtual_finish
FROM p
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _beyond_sql() -> str:
    """Of each rule: how many of its cutoffs a document's figure is beyond."""
    return "[" + ", ".join(f"len(list_filter({list(grid)}::DOUBLE[], lambda c: CASE WHEN {d} > 0 THEN {n}::DOUBLE / {d} ELSE 0 END > c))" for _, n, d, grid in quality_rules.RULES) + "]"


def _rejected_sql(beyond: str, places: str) -> str:
    return "(" + " OR ".join(f"({places}[{r}] >= 0 AND {beyond}[{r}] >= {len(grid)} - {places}[{r}])" for r, (*_, grid) in enumerate(quality_rules.RULES, 1)) + ")"


_SIZES = str([len(grid) for *_, grid in quality_rules.RULES])
_ERROR = f"({quality_rules.DELTA} / (SELECT count(DISTINCT coalesce(s, chr(0))) + 1 FROM cells WHERE NOT pooled))"

# Each path takes, step by step, the cutoff that rejects most further bad documents. A step's exact upper bound is within the risk
# if so few rejections of good documents or fewer would be rarer at the risk than the error allows; the first step beyond ends the path.
OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS x FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_beyond_sql()} AS beyond FROM (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id))),
judged AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
labelled AS MATERIALIZED (SELECT lang, q > 0 AS good, beyond FROM f JOIN judged USING (doc_id) WHERE NOT base_failed),
cells AS MATERIALIZED (SELECT false AS pooled, lang AS s, good, beyond, count(*) AS n FROM labelled GROUP BY ALL
  UNION ALL SELECT true, NULL, good, beyond, count(*) FROM labelled GROUP BY ALL),
grid(r, i) AS (VALUES {", ".join(f"({r}, {i})" for r, (*_, cutoffs) in enumerate(quality_rules.RULES, 1) for i in range(len(cutoffs)))}),
path AS (
  SELECT DISTINCT pooled, s, 0 AS step, {[-1] * len(quality_rules.RULES)} AS before, 0 AS r, 0 AS i, {[-1] * len(quality_rules.RULES)} AS places FROM cells
  UNION ALL
  SELECT pooled, s, step + 1, places, r, i, list_transform(places, lambda x, k: CASE WHEN k = r THEN i ELSE x END) FROM (
    SELECT *, row_number() OVER (PARTITION BY pooled, s ORDER BY gain DESC, i, r) AS nth FROM (SELECT p.pooled, p.s, p.step, p.places, g.r, g.i, sum(c.n) AS gain
    FROM path p JOIN cells c ON c.pooled = p.pooled AND c.s IS NOT DISTINCT FROM p.s AND NOT c.good AND NOT {_rejected_sql("c.beyond", "p.places")}
      JOIN grid g ON g.i > p.places[g.r] AND c.beyond[g.r] >= {_SIZES}[g.r] - g.i
    GROUP BY ALL)) WHERE nth = 1),
steps AS (SELECT DISTINCT p.pooled, p.s, step, j, list_transform(before, lambda x, k: CASE WHEN k = r THEN j ELSE x END) AS places
  FROM (SELECT p.*, {_SIZES}[p.r] - c.beyond[p.r] AS j FROM path p JOIN cells c ON p.step > 0 AND c.pooled = p.pooled AND c.s IS NOT DISTINCT FROM p.s AND NOT c.good AND NOT {_rejected_sql("c.beyond", "p.before")}) p
  WHERE j > before[r] AND j <= i),
total AS (SELECT pooled, s, coalesce(sum(n) FILTER (good), 0) AS n FROM cells GROUP BY pooled, s),
lost AS (SELECT st.pooled, st.s, step, j, places, any_value(t.n) AS n, coalesce(sum(c.n) FILTER (c.good AND {_rejected_sql("c.beyond", "st.places")}), 0) AS k
  FROM steps st JOIN total t ON t.pooled = st.pooled AND t.s IS NOT DISTINCT FROM st.s JOIN cells c ON c.pooled = st.pooled AND c.s IS NOT DISTINCT FROM st.s GROUP BY ALL),
tails AS (SELECT pooled, s, step, j, places, k < n AND sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality_rules.RISK}) + (n - i) * ln(1 - {quality_rules.RISK}))) <= {_ERROR} AS held
  FROM lost, LATERAL (SELECT unnest(range(0, (least(k, n) + 1)::BIGINT)) AS i) GROUP BY pooled, s, step, j, places, k, n),
kept_steps AS (SELECT pooled, s, step, j, places, bool_and(held) OVER (PARTITION BY pooled, s ORDER BY step, j) AS stands FROM tails),
last AS (SELECT pooled, s, max_by(places, step * 1000 + j) AS places FROM kept_steps WHERE stands GROUP BY pooled, s),
cutoffs AS (SELECT t.s, l.places FROM total t JOIN last l ON CASE WHEN t.n >= ceil(ln({_ERROR}) / ln(1 - {quality_rules.RISK})) THEN NOT l.pooled AND l.s IS NOT DISTINCT FROM t.s ELSE l.pooled END WHERE NOT t.pooled)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND NOT coalesce({_rejected_sql("beyond", "places")}, false) AS kept
FROM f LEFT JOIN cutoffs ON lang IS NOT DISTINCT FROM s
"""


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.judge(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '{TERM}') AS w FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '{TERM}')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
held AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
tfs AS (SELECT row, doc_id, n, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tfs, total GROUP BY term),
scores AS (SELECT item_id, row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term), total GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= {lexical_search.TOP}
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Each document is followed through each order, step by step.
OP13_SQL = rf"""
WITH letters(letter, bit) AS (VALUES {", ".join(f"('{c}', {1 << i})" for i, c in enumerate(filter_audit.FILTERS))}),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, bits[step] AS bit, list_sum(bits[:step - 1])::INTEGER AS earlier FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
told AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END AS mask FROM d LEFT JOIN told USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY ALL),
told_steps AS (SELECT part, filter_order, step, filter,
    sum(CASE WHEN mask & (coalesce(earlier, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & coalesce(earlier, 0) = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & coalesce(earlier, 0) > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & coalesce(earlier, 0) = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & coalesce(earlier, 0) = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM told_steps
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_output, op2_url_filter, op3_suffix_dedup, op4_decontaminate, op5_html_extract, op6_warc, op7_near_dedup, op8_secret_scan, op9_mix_sources, op10_quality_rules, op11_language_id, op12_lexical_search, op13_filter_audit)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op4_decontaminate": OP4_SQL, "op6_warc": OP6_SQL, "op7_near_dedup": OP7_SQL, "op9_mix_sources": OP9_SQL, "op10_quality_rules": OP10_SQL, "op12_lexical_search": OP12_SQL, "op13_filter_audit": OP13_SQL}
