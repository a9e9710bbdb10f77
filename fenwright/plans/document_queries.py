"""Queries on rule documents: parts as rules (brand as owner, name as text), orders as what they are learnt from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwright.operators import documents, learn
from fenwright.plans import domain as D
from fenwright.registry import query

SPLIT, NUMBER = "DATE '1998-01-01'", "order_number::BIGINT"
KIND = "['contiguous', 'unordered_parts', 'exact_normalized', 'token'][p_partkey % 4 + 1]"
RULES = f"""p AS (SELECT p_partkey AS n, p_brand AS owner, {KIND} AS kind, lower(p_name) AS name, lower(p_type) AS type FROM part),
rules AS (SELECT *, CASE kind WHEN 'unordered_parts' THEN name || ' + ' || type WHEN 'token' THEN type ELSE name END AS value FROM p)"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, name, kind = F.col("p_partkey"), F.lower("p_name"), F.col("kind")
    parts = D.table(spark, sf_dir, "part").withColumn("kind", F.element_at(F.array(*map(F.lit, ("contiguous", "unordered_parts", "exact_normalized", "token"))), (n % 4 + 1).cast("int")))
    value = F.when(kind == "unordered_parts", F.concat(name, F.lit(" + "), F.lower("p_type"))).when(kind == "token", F.lower("p_type")).otherwise(name)
    cross = F.element_at(F.array(*map(F.lit, ("none", "soft", "hard"))), (n % 3 + 1).cast("int"))
    return parts.select(n.alias("n"), F.col("p_brand").alias("owner"), "kind", value.alias("value"), F.when(n % 11 == 0, "retired").otherwise("active").alias("status"), (n % 2 == 0).alias("own"), (n % 5 == 0).alias("override"), cross.alias("cross"), (n % 7 == 0).alias("dominant"))


@query(f"""WITH {RULES}, k AS (SELECT n, owner, CASE kind WHEN 'unordered_parts' THEN 'combo' WHEN 'exact_normalized' THEN 'sentence' WHEN 'token' THEN 'token' ELSE 'phrase' END AS kind,
  CASE kind WHEN 'unordered_parts' THEN name WHEN 'token' THEN type ELSE name END AS key, CASE kind WHEN 'unordered_parts' THEN type END AS key2 FROM rules WHERE n % 11 <> 0)
SELECT DISTINCT lookup, owner, kind, key, key2 FROM (SELECT 'own' AS lookup, * FROM k WHERE n % 2 = 0 UNION ALL SELECT 'collision', * FROM k WHERE n % 3 > 0 UNION ALL SELECT 'hard', * FROM k WHERE n % 3 = 2
  UNION ALL SELECT 'override', * FROM k WHERE n % 5 = 0 UNION ALL SELECT 'dominant', * FROM k WHERE n % 7 = 0)""")
def rule_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.lookups(_rules(spark, sf_dir))


@query("""WITH i AS (SELECT p_brand AS owner, 'exact_normalized' AS kind, lower(p_name) AS value, 'active' AS status FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_brand, 'ordered_distinct_tokens', lower(p_name), CASE WHEN p_partkey % 4 = 0 THEN 'active' ELSE 'ambiguous' END FROM part WHERE p_partkey % 3 <> 0)
SELECT owner, kind, value, min(status) AS status, CASE WHEN min(status) = 'active' THEN 'auto_error' ELSE 'audit_only' END AS decision, CASE WHEN min(status) = 'ambiguous' THEN 'audit' WHEN kind = 'exact_normalized' THEN 'exact' ELSE 'phrase' END AS strength, count(*)::INT AS origins
FROM i GROUP BY owner, kind, value HAVING count(DISTINCT status) = 1""")
def error_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, n = D.table(spark, sf_dir, "part"), F.col("p_partkey")
    exact = parts.where(n % 3 == 0).select(F.col("p_brand").alias("owner"), F.col("p_name").alias("signature"), F.lit("active").alias("status"), "p_size")
    phrases = parts.where(n % 3 != 0).select(F.col("p_brand").alias("owner"), F.col("p_name").alias("phrase"), F.when(n % 4 == 0, "active").otherwise("ambiguous").alias("status"), "p_size")
    return documents.error_rules(exact, phrases)[0].select("owner", "kind", "value", "status", "decision", "strength", F.size("origins").alias("origins"))


@query(f"""WITH {D.ORDER_ROWS_SQL}, r AS (SELECT business AS owner, subcategory AS signature, is_error AS confirmed FROM order_rows WHERE order_date < {SPLIT}
  UNION ALL SELECT business, subcategory, true FROM order_rows WHERE order_date >= {SPLIT} AND is_error AND {NUMBER} % 3 = 0
  UNION ALL SELECT business, subcategory, false FROM order_rows WHERE order_date >= {SPLIT} AND NOT is_error AND {NUMBER} % 5 = 0)
SELECT owner, signature, count(*) AS total, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (NOT confirmed) AS normal FROM r GROUP BY ALL""")
def learning_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.order_rows(spark, sf_dir).withColumns({"owner": F.col("business"), "signature": F.col("subcategory")})
    old, n = F.col("order_date") < F.lit("1998-01-01").cast("date"), F.col("order_number").cast("long")
    truth, _ = documents.truth(rows.where(old & F.col("is_error")), rows.where(~old & F.col("is_error") & (n % 3 == 0)))
    return learn.signature_counts(documents.population(rows.where(old), truth, rows.where(~old & ~F.col("is_error") & (n % 5 == 0))))


@query(f"""WITH {RULES}, o AS (SELECT DISTINCT owner, kind, value, CASE WHEN n % 2 = 0 THEN 'manual' ELSE 'auto' END AS source, n FROM rules), e AS (SELECT DISTINCT owner, kind, value FROM rules WHERE n % 6 = 1)
SELECT owner, source, count(*) AS rules FROM (SELECT owner, source FROM o WHERE source = 'auto' OR (owner, kind, value) NOT IN (SELECT (owner, kind, value) FROM e) UNION ALL SELECT owner, 'manual' FROM e) GROUP BY ALL""")
def manual_rules_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rules(spark, sf_dir)
    origins = rules.select(*documents.KEY, F.when(F.col("n") % 2 == 0, "manual").otherwise("auto").alias("source"), "status")
    return documents.upsert_manual(origins, rules.where("n % 6 = 1")).groupBy("owner", "source").agg(F.count("*").alias("rules"))


@query(f"WITH {D.ORDER_ROWS_SQL} SELECT business, count(*) AS learnt FROM order_rows WHERE order_date < {SPLIT} AND NOT (is_error AND {NUMBER} % 2 = 0) GROUP BY business")
def deferred_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.order_rows(spark, sf_dir)
    approved = rows.where(F.col("is_error") & (F.col("order_number").cast("long") % 2 == 0))
    left = documents.closed_review(rows.where("order_date < date'1998-01-01'"), approved, ("1992-01-01", "1997-12-31"), ("1998-01-01", "1998-12-31"))
    return left.groupBy("business").agg(F.count("*").alias("learnt"))


@query(f"WITH {D.ORDER_ROWS_SQL} SELECT business, count(*) FILTER (is_error) AS errors, count(*) FILTER (NOT is_error AND {NUMBER} % 4 = 0) AS candidates FROM order_rows GROUP BY business")
def reclassified_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows decided anew, of which a quarter was up for review before."""
    decided = D.order_rows(spark, sf_dir).withColumns({"is_auto": F.col("is_error"), "is_candidate": ~F.col("is_error")})
    candidates, errors = documents.reclassify(decided, decided.where(F.col("order_number").cast("long") % 4 == 0))
    both = candidates.select("business", F.lit(0).alias("e")).unionByName(errors.select("business", F.lit(1).alias("e")))
    return both.groupBy("business").agg(F.count_if(F.col("e") == 1).alias("errors"), F.count_if(F.col("e") == 0).alias("candidates"))
