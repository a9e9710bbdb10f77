"""Text queries: documents as details of an owner (their language), labels as confirmed errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwright.functions import privacy
from fenwright.functions import text as X
from fenwright.operators import grams, learn, rules
from fenwright.operators.cut import cut, dealt
from fenwright.plans import domain as D
from fenwright.registry import query

NORMAL = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '<(?:전화번호|성명|이메일|식별번호)>', ' ', 'g'), '[^가-힣a-z]+', ' ', 'g'))"
WORDS = "list_filter(string_split(n, ' '), lambda t: t <> '')"
DOCS = f"WITH d AS (SELECT doc_id AS id, lang AS owner, {NORMAL.format('text')} AS n, text, n_chars FROM documents), w AS (SELECT *, {WORDS} AS w FROM d)"


def grams_sql(size: int, source: str = "w") -> str:
    return f"SELECT DISTINCT id, owner, {size} AS size, array_to_string(list_slice(w, i, i + {size - 1}), ' ') AS g FROM {source}, LATERAL (SELECT unnest(range(1, len(w) - {size - 2})) AS i) WHERE len(w) >= {size}"


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.spread(D.table(spark, sf_dir, "documents"))
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("owner"), X.normal(F.col("text")).alias("normal"), "text", "n_chars")


@query(f"{DOCS} SELECT id, md5(n) AS normal_md5, md5(regexp_replace(lower(text), '[^가-힣a-z]+', '', 'g')) AS signature_md5 FROM d")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details(spark, sf_dir).select("id", F.md5("normal").alias("normal_md5"), F.md5(X.signature(F.col("text"))).alias("signature_md5"))


@query(f"{DOCS}, g AS ({grams_sql(3)}) SELECT g AS gram, count(*) AS texts FROM g GROUP BY g")
def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.texts(details(spark, sf_dir).select(X.words(F.col("normal")).alias("w"), F.length("text").alias("n_chars")), range(3), "gram")


RULES = [("en", "token", "the", None), ("en", "phrase", "of the", None), ("de", "token", "und", None), ("fr", "phrase", "de la", None), ("es", "combo", "que", "los"), ("fr", "combo", "la", "une"), ("es", "sentence", "reorea nd", None)]
RULES_SQL = "r(owner, kind, key, key2) AS (VALUES " + ", ".join("({})".format(", ".join("NULL" if v is None else f"'{v}'" for v in row)) for row in RULES) + ")"
MATCHED = f"""{DOCS}, {RULES_SQL}, g AS ({grams_sql(1)} UNION ALL {grams_sql(2)}),
hits AS (SELECT id, r.owner FROM g JOIN r ON g.g = r.key WHERE kind IN ('token', 'phrase')
  UNION SELECT a.id, r.owner FROM r JOIN g a ON a.g = r.key JOIN g b ON b.g = r.key2 AND a.id = b.id WHERE kind = 'combo'
  UNION SELECT id, r.owner FROM d JOIN r ON d.n = r.key WHERE kind = 'sentence'),
matched AS (SELECT id, list_sort(list(DISTINCT owner)) AS owners FROM hits GROUP BY id)"""


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "owner string, kind string, key string, key2 string")


@query(f"{MATCHED} SELECT id, array_to_string(owners, ',') AS owners FROM matched")
def pattern_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.owners(details(spark, sf_dir).select("id", "normal"), _rules(spark)).select("id", F.array_join("owners", ",").alias("owners"))


@query(f"""{MATCHED}, f AS (SELECT d.id, coalesce(list_contains(owners, d.owner), false) AS own, coalesce(len(list_filter(owners, lambda o: o <> d.owner)) > 0, false) AS hard_other,
  coalesce(quality = 0, false) AS exact, coalesce(toxic = 1, false) AS exact_review, n LIKE 'an %' AS dominant, CASE WHEN n LIKE 'the %' THEN 'normal' WHEN n LIKE 'de %' THEN 'auto_error' END AS shape
  FROM d LEFT JOIN matched USING (id) LEFT JOIN labels ON doc_id = id),
x AS (SELECT *, coalesce(shape = 'auto_error', false) OR exact AS is_auto, coalesce(shape <> 'normal', true) AND (exact_review OR dominant) AS lock FROM f),
y AS (SELECT *, coalesce(shape = 'normal', false) OR (NOT is_auto AND NOT lock AND own AND NOT hard_other) AS is_normal FROM x)
SELECT id, is_auto, is_normal, NOT is_auto AND NOT is_normal AS is_candidate, NOT is_auto AND NOT is_normal AND lock AS locked FROM y""")
def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = details(spark, sf_dir)
    found = rules.owners(d.select("id", "normal"), _rules(spark))
    labels = D.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    own = F.array_contains("owners", F.col("owner"))
    flags = d.join(found, "id", "left").join(labels, "id", "left").select(
        "id", F.when(F.col("normal").startswith("the "), "normal").when(F.col("normal").startswith("de "), "auto_error").alias("shape"), (F.col("quality") == 0).alias("exact"), F.lit(False).alias("phrase"), (F.col("toxic") == 1).alias("exact_review"), F.lit(False).alias("phrase_review"), F.col("normal").startswith("an ").alias("dominant"), F.lit(False).alias("context"), F.lit(False).alias("override"), own.alias("own"), rules.other_than(F.col("owners"), F.col("owner")).alias("hard_other")
    )
    return rules.decide(flags).select("id", "is_auto", "is_normal", "is_candidate", "locked")


CONTEXTS = [("x", "of the"), ("x", "and the"), ("x", "the"), ("y", "de la"), ("y", "la les"), ("z", "und der")]


@query(f"{DOCS}, c(owner, key) AS (VALUES {', '.join(map(str, CONTEXTS))}), g AS ({grams_sql(1)} UNION ALL {grams_sql(2)}), h AS (SELECT id, c.owner, key, string_split(key, ' ') AS p FROM g JOIN c ON g.g = c.key WHERE c.owner <> g.owner) SELECT DISTINCT a.id, a.owner AS foreign FROM h a JOIN h b ON a.id = b.id AND a.owner = b.owner AND a.key < b.key WHERE NOT list_has_all(b.p, a.p) AND NOT list_has_all(a.p, b.p)".replace(" AS foreign", ' AS "foreign"'))
def body_context_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = details(spark, sf_dir).select("id", F.col("owner").alias("own"), "normal")
    return rules.context_conflict(d, spark.createDataFrame(CONTEXTS, "owner string, key string"))


def _learning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = D.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return details(spark, sf_dir).join(labels, "id", "left").withColumn("confirmed", F.col("quality").isNotNull()).withColumn("signature", X.signature(F.col("text")))


LEARN = f"{DOCS}, lr AS (SELECT w.*, quality IS NOT NULL AS confirmed, md5(regexp_replace(lower(text), '[^가-힣a-z]+', '', 'g')) AS s, regexp_replace(lower(text), '[^가-힣a-z]+', '', 'g') <> '' AS filled FROM w LEFT JOIN labels ON doc_id = id)"


@query(f"{LEARN} SELECT owner, s AS signature, count(*) AS total, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (NOT confirmed) AS normal FROM lr WHERE filled GROUP BY ALL")
def signature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.signature_counts(_learning_rows(spark, sf_dir)).withColumn("signature", F.md5("signature"))


@query(f"{LEARN} SELECT owner, s AS signature, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (NOT confirmed) AS normal, CASE WHEN count(*) FILTER (NOT confirmed) = 0 THEN 'active' ELSE 'ambiguous' END AS status FROM lr WHERE filled GROUP BY owner, s HAVING count(*) FILTER (confirmed) > 0")
def exact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.exact_rules(learn.signature_counts(_learning_rows(spark, sf_dir))).withColumn("signature", F.md5("signature"))


MINE = f"{LEARN}, u AS (SELECT any_value(id) AS id, owner, s, any_value(w) AS w, count(*) AS weight FROM lr WHERE confirmed AND filled GROUP BY owner, s), g AS ({grams_sql(2, 'u')} UNION ALL {grams_sql(3, 'u')} UNION ALL {grams_sql(4, 'u')})"


def _confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _learning_rows(spark, sf_dir).where("confirmed and signature <> ''")
    return dealt(rows, "owner", "signature").groupBy("owner", "signature").agg(F.first("normal").alias("normal"), F.count("*").alias("weight"))


@query(f"{MINE} SELECT g.owner, g AS phrase, size, sum(weight)::BIGINT AS support, count(*) AS signatures FROM g JOIN u USING (id) WHERE len(list_filter(string_split(g, ' '), lambda t: len(t) >= 2)) > 0 AND len(replace(g, ' ', '')) >= 5 GROUP BY g.owner, g, size HAVING sum(weight) >= CASE size WHEN 2 THEN 3 ELSE 2 END")
def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.supported_phrases(_confirmed(spark, sf_dir))


# Words at the places 0, a and b (0, if there are two only) of a window of seven.
CORE_SHAPES = ", ".join(f"({a}, {b})" for a in range(1, 7) for b in (0, *range(a + 1, 7)) if max(a, b) > (2 if b else 1))


@query(f"""{MINE}, shapes(a, b) AS (VALUES {CORE_SHAPES}),
m AS (SELECT id, owner, weight, CASE WHEN b = 0 THEN 2 ELSE 3 END AS size, unnest([CASE WHEN len(w[i]) >= 2 AND len(w[i + a]) >= 2 AND (b = 0 OR len(w[i + b]) >= 2) THEN w[i] || ' ' || w[i + a] || CASE WHEN b = 0 THEN '' ELSE ' ' || w[i + b] END END FOR i IN range(1, len(w) - greatest(a, b) + 1)]) AS phrase FROM u, shapes),
p AS (SELECT DISTINCT id, owner, weight, phrase, size FROM m WHERE phrase IS NOT NULL)
SELECT owner, phrase, size, sum(weight)::BIGINT AS support, count(*) AS signatures FROM p WHERE len(replace(phrase, ' ', '')) >= 5 GROUP BY owner, phrase, size HAVING sum(weight) >= CASE size WHEN 2 THEN 3 ELSE 2 END AND count(*) >= 2""")
def core_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.supported_core(_confirmed(spark, sf_dir))


# The match, word by word: where the next word is inside one or two adjacent words, among the seven ahead (all, for the first).
ORDERED = "".join(f", s{n} AS (SELECT *, list_position(list_transform({'adj' if n == 1 else f'adj[at{n - 1} + 1:at{n - 1} + 7]'}, lambda x: contains(x, k[{n}])), true) AS p{n}, {0 if n == 1 else f'at{n - 1}'} + p{n} + CASE WHEN contains(w[{0 if n == 1 else f'at{n - 1}'} + p{n}], k[{n}]) THEN 0 ELSE 1 END AS at{n} FROM {'c' if n == 1 else f's{n - 1}'}{'' if n == 1 else f' WHERE p{n - 1} > 0'})" for n in (1, 2, 3, 4))


@query(f"""{MINE}, e AS (SELECT g.owner, g AS phrase, sum(weight)::BIGINT AS support, string_split(g, ' ') AS k FROM g JOIN u USING (id) WHERE size = 4 AND len(list_filter(string_split(g, ' '), lambda t: len(t) >= 2)) > 0 AND len(replace(g, ' ', '')) >= 5 GROUP BY g.owner, g HAVING sum(weight) >= 2),
t AS (SELECT owner, n, any_value(w) AS w, count(*) FILTER (confirmed) AS sure, count(*) FILTER (NOT confirmed) AS other, replace(n, ' ', '') AS packed FROM lr WHERE filled GROUP BY owner, n), a AS (SELECT *, list_transform(w, lambda x, i: x || coalesce(w[i + 1], '')) AS adj FROM t),
c AS (SELECT e.owner, phrase, k, w, adj, sure, other FROM e JOIN a ON a.owner = e.owner AND contains(packed, k[1]) AND contains(packed, k[2]) AND contains(packed, k[3]) AND contains(packed, k[4])){ORDERED},
f AS (SELECT owner, phrase, sum(sure)::BIGINT AS confirmed, sum(other)::BIGINT AS normal FROM s4 WHERE p4 > 0 GROUP BY ALL)
SELECT e.owner, e.phrase, support, coalesce(confirmed, 0)::BIGINT AS confirmed, coalesce(normal, 0)::BIGINT AS normal, CASE WHEN coalesce(normal, 0) = 0 THEN 'active' ELSE 'audit' END AS status FROM e LEFT JOIN f USING (owner, phrase)""")
def ordered_phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of four words from confirmed texts, looked for in all texts."""
    rows = _learning_rows(spark, sf_dir).where("signature <> ''")
    weighed = rows.select("owner", "normal", F.col("confirmed").cast("long").alias("confirmed"), (~F.col("confirmed")).cast("long").alias("normal_count"))
    best = cut(learn.supported_phrases(_confirmed(spark, sf_dir), {4: 2}), "supported")
    return learn.confirm(best, weighed).select("owner", "phrase", "support", "confirmed", "normal", "status")


EVIDENCE = f"{DOCS}, g AS ({grams_sql(2)} UNION ALL {grams_sql(3)} UNION ALL {grams_sql(4)}), o AS (SELECT owner, g AS pattern, size, count(*) AS support, count(DISTINCT id % 11) AS dates, count(DISTINCT id % 5) AS people, count(*) FILTER (id % 4 = 0) AS coverage FROM g GROUP BY ALL), e AS (SELECT *, (sum(support) OVER (PARTITION BY pattern))::BIGINT - support AS \"foreign\" FROM o), k AS (SELECT * FROM e WHERE support >= 2)"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.evidence(details(spark, sf_dir).select("id", "owner", "normal", (F.col("id") % 11).alias("date"), (F.col("id") % 5).alias("person"), (F.col("id") % 4 == 0).alias("candidate")))


@query(f"{EVIDENCE} SELECT * FROM k")
def ngram_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir)


@query(f"{EVIDENCE} SELECT * FROM k WHERE \"foreign\" = 0 AND (((size = 2 AND support >= 8 AND dates >= 3 AND people >= 2) OR (size >= 3 AND support >= 5 AND dates >= 2 AND people >= 2)) AND coverage BETWEEN 1 AND 3 OR (support >= 20 AND dates >= 3 AND people >= 2 AND coverage >= 5))")
def promotion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.promotable(_evidence(spark, sf_dir))


@query(f"{EVIDENCE} SELECT owner, pattern, size, sum(support)::BIGINT AS support, sum(dates)::BIGINT AS dates, max(people) AS people, sum(coverage)::BIGINT AS coverage, sum(\"foreign\")::BIGINT AS \"foreign\" FROM (SELECT * FROM k UNION ALL SELECT * FROM k WHERE size = 2) GROUP BY ALL")
def evidence_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    twice = F.explode(F.when(F.col("size") == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return learn.accumulate(e.withColumn("snapshot", twice))


def _signatures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Those of details, and of benchmark items, as of one owner."""
    sig = lambda c: X.signature(F.col(c))
    every = details(spark, sf_dir).select("id", F.lit("all").alias("owner"), sig("text").alias("sig"))
    return every, D.table(spark, sf_dir, "benchmark").select(F.lit("all").alias("owner"), sig("text").alias("sig"))


# Cosines to twelve places, so that the order of a sum's terms makes no difference; of equal ones the greater signature.
COSINES = """WITH c AS (SELECT DISTINCT regexp_replace(lower(text), '[^가-힣a-z]+', '', 'g') AS sig FROM documents), r AS (SELECT DISTINCT regexp_replace(lower(text), '[^가-힣a-z]+', '', 'g') AS ref FROM benchmark),
cg AS (SELECT sig, g, count(*) AS n FROM (SELECT sig, unnest([sig[i:i + 1] FOR i IN range(1, greatest(len(sig), 2))]) AS g FROM c WHERE sig <> '') GROUP BY ALL), rg AS (SELECT ref, g, count(*) AS m FROM (SELECT ref, unnest([ref[i:i + 1] FOR i IN range(1, greatest(len(ref), 2))]) AS g FROM r WHERE ref <> '') GROUP BY ALL),
cn AS (SELECT sig, sqrt(sum(n * n)) AS norm FROM cg GROUP BY sig), rn AS (SELECT ref, sqrt(sum(m * m)) AS norm FROM rg GROUP BY ref), dots AS (SELECT sig, ref, sum(n * m) AS dot FROM cg JOIN rg USING (g) GROUP BY ALL),
cosines AS (SELECT c.sig, r.ref, coalesce(dot / (cn.norm * rn.norm), 0) AS cos FROM c CROSS JOIN r LEFT JOIN dots USING (sig, ref) LEFT JOIN cn ON cn.sig = c.sig LEFT JOIN rn ON rn.ref = r.ref)"""


@query(f"{COSINES} SELECT md5(sig) AS signature, md5(ref) AS nearest, round(cos, 9) AS cosine, row_number() OVER (PARTITION BY sig ORDER BY round(cos, 12) DESC, ref DESC) AS nth FROM cosines QUALIFY nth <= 5")
def similarity_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five benchmark items of largest cosine for each text, whatever its length."""
    found = rules.nearest(*_signatures(spark, sf_dir), 5)
    return found.select(F.md5("sig").alias("signature"), F.md5("ref").alias("nearest"), F.round("cos", 9).alias("cosine"), "nth")


@query()
def similarity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of details to benchmark items: the best of all."""
    every, items = _signatures(spark, sf_dir)
    return every.join(rules.closest(every, items), ["owner", "sig"]).select("id", F.round("score", 6).alias("score"))


@query()
def mask_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = privacy.mask_frame(D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text")), "text")[0]
    return masked.select("doc_id", F.md5("text").alias("masked_md5"), F.length("text").alias("n_chars"))


@query()
def mask_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.mask_frame(D.spread(D.table(spark, sf_dir, "documents").select("doc_id", "text")), "text")[1]


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)(?:^|[^a-z0-9._%+-])[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}'))::INT AS n FROM documents WHERE regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}')")
def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses by document, also those that masking leaves for what stands behind them."""
    d = D.table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(privacy.ANY_EMAIL)).alias("n"))
    return d.where("n > 0")
