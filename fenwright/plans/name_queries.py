"""Queries of names and templates: names made of customers' keys, texts of orders that mention them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwright.operators import names
from fenwright.plans import domain as D
from fenwright.registry import query

FIRST, SECOND = "김이박최정강물들마사", "민수영희철준호지은경"
_NAME = "substr('{f}', ({{0}} % 10 + 1)::INT, 1) || substr('{s}', ({{0}} // 10 % 10 + 1)::INT, 1) || substr('{s}', ({{0}} // 100 % 10 + 1)::INT, 1)".format(f=FIRST, s=SECOND)


def _name(n):
    letter = lambda letters, i: F.substring(F.lit(letters), (i % 10 + 1).cast("int"), F.lit(1))
    return F.concat(letter(FIRST, n), letter(SECOND, F.floor(n / 10)), letter(SECOND, F.floor(n / 100)))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer's name; some are no names by their first letter."""
    c = D.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    people = c.select(_name(F.col("c_custkey")).alias("생성인"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), _name(F.col("c_custkey") + 7))).alias("마감자"))
    return names.known_names(people, spark.createDataFrame([("홍길동",), ("bob",), (None,)], "name string"))


SURNAMES_HERE = "".join(c for c in FIRST if c in names.privacy.SURNAMES)
NAMES = f"""WITH n AS (SELECT DISTINCT name FROM (SELECT {_NAME.format('c_custkey')} AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT {_NAME.format('(c_custkey + 7)')} FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT '홍길동') WHERE contains('{SURNAMES_HERE}홍', substr(name, 1, 1)))"""


@query(f"{NAMES} SELECT name FROM n")
def proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)


# Texts of seven kinds around a name: bare, titled, beside a word that goes with names, as part of a longer word, and twice.
KINDS = ("{} 방문 요청", "계량기 {}님 통화", "담당자 {} 확인", "{}씨네 검침", "요금 {}기사님 {}", "검침 담당 요금", "{}")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("o_orderkey"), _name(F.col("o_custkey"))
    kinds = F.array(*(F.concat(*(x for i, part in enumerate(t.split("{}")) for x in ([name] if i else []) + [F.lit(part)])) for t in KINDS))
    return D.table(spark, sf_dir, "orders").select(k.alias("id"), F.element_at(kinds, (k % len(KINDS) + 1).cast("int")).alias("text"))


_KINDS_SQL = ", ".join("'" + t.replace("{}", "' || name || '") + "'" for t in KINDS)


@query(f"""{NAMES}, t AS (SELECT o_orderkey AS id, [{_KINDS_SQL}][o_orderkey % {len(KINDS)} + 1] AS text, name, o_orderkey % {len(KINDS)} AS kind, name IN (SELECT name FROM n) AS known, contains('{SURNAMES_HERE}', substr(name, 1, 1)) AS is_like FROM (SELECT *, {_NAME.format('o_custkey')} AS name FROM orders))
SELECT id, CASE kind WHEN 0 THEN CASE WHEN known THEN '방문 요청' ELSE text END WHEN 1 THEN CASE WHEN known OR is_like THEN '계량기 통화' ELSE text END WHEN 2 THEN CASE WHEN known OR is_like THEN '담당자 확인' ELSE text END
  WHEN 4 THEN CASE WHEN known THEN '요금' WHEN is_like THEN '요금 ' || name ELSE text END WHEN 6 THEN CASE WHEN known THEN '' ELSE text END ELSE text END AS text FROM t""")
def names_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.without_names(_texts(spark, sf_dir), _names(spark, sf_dir))


@query("""WITH s AS (SELECT o_orderpriority AS owner, CASE o_custkey % 5 WHEN 0 THEN '계량기교체요청' WHEN 1 THEN '체납 금액 안내' WHEN 2 THEN '두달 체납' ELSE '검침 방문' END || ' ' || o_orderstatus AS signature, o_orderkey % 4 = 0 OR o_orderstatus = 'F' AS error FROM orders),
t AS (SELECT owner, signature, count(*) AS total, count(*) FILTER (error) AS errors FROM s GROUP BY ALL)
SELECT DISTINCT owner, replace(replace(lower(signature), ' 금액 ', ' 금액값 '), '두달', '기간값') AS template FROM t WHERE total > errors""")
def normal_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of what was normal work; texts of finished orders never were."""
    n = F.col("o_custkey") % 5
    said = F.when(n == 0, "계량기교체요청").when(n == 1, "체납 금액 안내").when(n == 2, "두달 체납").otherwise("검침 방문")
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("owner"), F.concat_ws(" ", said, "o_orderstatus").alias("signature"), ((F.col("o_orderkey") % 4 == 0) | (F.col("o_orderstatus") == "F")).alias("error"))
    return names.normal_templates(rows.groupBy("owner", "signature").agg(F.count("*").alias("total")), rows.where("error").select("owner", "signature"))
