"""Field queries: names, numbers, dates and texts of order rows, and addresses built from customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenwright.functions import address, privacy
from fenwright.functions import text as X
from fenwright.operators import clean, learn
from fenwright.plans import domain as D
from fenwright.registry import query

ROADS, DONGS, GUS = ("계룡로", "한밭대로", "대학로 12번길", "문예로", "은행길"), ("둔산동", "탄방동", "궁동", "은행동", "오류동", "관저동"), ("서구", "중구", "유성구", "동구")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], n: str) -> str:
    return f"{list(values)}[{n} % {len(values)} + 1]"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, dong, address of each customer: city, district, road and number, mostly with the older form in parentheses."""
    k = F.col("c_custkey")
    lot = F.concat((k % 90 + 1).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("-"), (k % 7 + 1).cast("string"))).otherwise(""))
    dong, gap = _pick(DONGS, k % 11), F.when(k % 4 == 0, F.lit("  ")).otherwise(" ")
    road = F.concat(F.lit("대전 "), _pick(GUS, k % 13), gap, _pick(ROADS, k % 17), F.lit(" "), (k % 200 + 1).cast("string"))
    whole = F.when(k % 6 == 5, road).otherwise(F.concat(road, F.lit(" ("), dong, F.lit(" "), lot, F.when(k % 5 == 0, " 상가").otherwise(""), F.lit(")")))
    return D.table(spark, sf_dir, "customer").select(k.alias("id"), dong.alias("dong"), whole.alias("address"))


ADDRESSES = f"""addresses AS (SELECT id, dong, CASE WHEN id % 6 = 5 THEN road ELSE road || ' (' || dong || ' ' || lot || CASE WHEN id % 5 = 0 THEN ' 상가' ELSE '' END || ')' END AS address FROM (
  SELECT c_custkey AS id, {_pick_sql(DONGS, '(c_custkey % 11)')} AS dong, (c_custkey % 90 + 1) || CASE WHEN c_custkey % 3 = 0 THEN '-' || (c_custkey % 7 + 1) ELSE '' END AS lot,
    '대전 ' || {_pick_sql(GUS, '(c_custkey % 13)')} || CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE ' ' END || {_pick_sql(ROADS, '(c_custkey % 17)')} || ' ' || (c_custkey % 200 + 1) AS road FROM customer))"""
BASE = "trim(regexp_replace(regexp_replace({0}, '\\s*\\([^)]*\\)', '', 'g'), '\\s+', ' ', 'g'))"
SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(f"WITH {ADDRESSES}, p AS (SELECT id, trim(address) AS a, strpos(trim(address), '(') AS pos FROM addresses), s AS (SELECT id, CASE WHEN pos > 1 AND a LIKE '%)' THEN trim(substr(a, 1, pos - 1)) ELSE a END AS road, CASE WHEN pos > 1 AND a LIKE '%)' THEN trim(substr(a, pos + 1, length(a) - pos - 1)) ELSE a END AS old FROM p) SELECT id, road, old, coalesce(nullif(regexp_extract(old, '(?:^|[\\s(])([가-힣]+(?:동|읍|면|가))(?:[\\s)]|$)', 1), ''), nullif(regexp_extract(road, '(?:^|[\\s(])([가-힣]+(?:동|읍|면|가))(?:[\\s)]|$)', 1), '')) AS area FROM s")
def address_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(spark, sf_dir).select("id", clean.split_address(F.col("address")).alias("p")).select("id", "p.*")


@query(f"""WITH {ADDRESSES}, p AS (SELECT id, address, {BASE.format('address')} AS base, {SQUEEZED.format("split_part(address, '(', 1)")} AS front, {SQUEEZED.format("regexp_extract(address, '[(]([^)]+)[)]', 1)")} AS "inner" FROM addresses),
w AS (SELECT *, string_split("inner", ' ') AS iw, string_split(front, ' ') AS fw FROM p),
x AS (SELECT *, list_filter(iw, lambda t: regexp_full_match(t, '[0-9]+(-[0-9]+)?'))[-1] AS number, coalesce(list_position(list_transform(fw, lambda t: regexp_matches(t, '[0-9]|(로|길)$')), true), 0) AS stop, coalesce(list_position(list_transform(iw, lambda t: regexp_matches(t, '[0-9]')), true), 0) AS upto FROM w),
y AS (SELECT *, array_to_string(CASE WHEN stop = 0 THEN fw ELSE fw[1:stop - 1] END, ' ') AS locality, array_to_string(CASE WHEN upto = 0 THEN iw ELSE iw[1:upto] END, ' ') AS short FROM x),
z AS (SELECT *, CASE WHEN short = '' THEN '' ELSE trim(locality || ' ' || short) END AS hint, {SQUEEZED.format('address')} AS squeezed FROM y)
SELECT id, base, trim(regexp_replace(front, '\\s+[0-9][0-9-]*$', '')) AS stem, iw[1] AS dong, try_cast(string_split(number, '-')[1] AS INT) AS main, try_cast(string_split(number, '-')[2] AS INT) AS sub, locality, hint,
  array_to_string(list_filter([hint, CASE WHEN squeezed <> hint THEN squeezed ELSE '' END, CASE WHEN base <> hint AND base <> squeezed THEN base ELSE '' END], lambda t: t <> ''), '|') AS asked FROM z""")
def address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("address")
    found = addresses(spark, sf_dir).select("id", address.base(a).alias("base"), address.street_stem(a).alias("stem"), address.lot(a).alias("lot"), address.locality(a).alias("locality"), address.lot_hint(a).alias("hint"), F.array_join(address.queries(a), "|").alias("asked"))
    return found.select("id", "base", "stem", "lot.*", "locality", "hint", "asked")


@query("WITH p AS (SELECT c_custkey AS id, '3017010100' || CASE WHEN c_custkey % 9 = 0 THEN '2' ELSE '1' END || lpad((c_custkey % 1500)::VARCHAR, 4, '0') || lpad((c_custkey % 4)::VARCHAR, 4, '0') || CASE WHEN c_custkey % 50 = 0 THEN 'x' ELSE '' END AS pnu FROM customer) SELECT id, CASE WHEN regexp_full_match(pnu, '[0-9]{19}') THEN CASE WHEN pnu[11] = '2' THEN '산' ELSE '' END || pnu[12:15]::INT || CASE WHEN pnu[16:19]::INT > 0 THEN '-' || pnu[16:19]::INT ELSE '' END END AS lot FROM p")
def parcel_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pnu = F.concat(F.lit("3017010100"), F.when(k % 9 == 0, "2").otherwise("1"), F.lpad((k % 1500).cast("string"), 4, "0"), F.lpad((k % 4).cast("string"), 4, "0"), F.when(k % 50 == 0, "x").otherwise(""))
    return D.table(spark, sf_dir, "customer").select(k.alias("id"), address.parcel_lot(pnu).alias("lot"))


@query(f"""WITH RECURSIVE {ADDRESSES}, known AS (SELECT address, dong, 36 + id * 1e-5::DOUBLE AS lat, 127 + id * 1e-5::DOUBLE AS lon, {BASE.format('address')} AS base FROM addresses WHERE id % 3 = 0),
exact AS (SELECT address, min({{'lat': lat, 'lon': lon}}) AS e FROM known GROUP BY address), bases AS (SELECT base, min({{'lat': lat, 'lon': lon}}) AS b FROM known GROUP BY base HAVING count(*) = 1), middles AS (SELECT dong, avg(lat) AS lat, avg(lon) AS lon FROM known GROUP BY dong),
unit(i, u) AS (SELECT 0, 1::BIGINT UNION ALL SELECT i + 1, u * 256 % 100000000 FROM unit WHERE i < 300), units AS (SELECT list(u ORDER BY i) AS us FROM unit),
code AS (SELECT *, hex(encode(address)) AS h, {BASE.format('address')} AS base FROM addresses),
digest AS (SELECT code.*, (list_sum([('0x' || substr(h, 2 * i + 1, 2))::BIGINT * us[i + 1] FOR i IN range(length(h) // 2)]) % 100000000)::BIGINT AS d FROM code, units)
SELECT id, round(coalesce(e.lat, b.lat, coalesce(middles.lat, 36.3504119) + ((d % 10000) / 10000.0::DOUBLE - 0.5) * 0.006), 7) AS lat, round(coalesce(e.lon, b.lon, coalesce(middles.lon, 127.3845475) + ((d // 10000) % 10000 / 10000.0::DOUBLE - 0.5) * 0.006), 7) AS lon,
  CASE WHEN e IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'base_match' ELSE 'district_estimate' END AS coord_source
FROM digest LEFT JOIN exact USING (address) LEFT JOIN bases USING (base) LEFT JOIN middles USING (dong)""")
def coordinate_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = addresses(spark, sf_dir)
    known = rows.where("id % 3 = 0").select("address", "dong", (36 + F.col("id") * 1e-5).alias("lat"), (127 + F.col("id") * 1e-5).alias("lon"))
    return address.resolve(rows, known).select("id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "coord_source")


CLERK = "lpad((o_custkey % 1000)::VARCHAR, 3, '0')"


@query("""SELECT o_orderkey AS id, CASE upper(trim(c)) WHEN 'H051' THEN 'H073' ELSE upper(trim(c)) END AS center, map {'1': '김철수', '2': '이영희'}[o_shippriority_text] AS creator,
  coalesce(CASE p WHEN 'S3EX99' THEN '동부' END, CASE p[1:5] WHEN 'S3EX1' THEN '중부' WHEN 'S3EX2' THEN '북부' END, CASE WHEN existing IN ('남부', '서부') THEN existing END, CASE CASE upper(trim(c)) WHEN 'H051' THEN 'H073' ELSE upper(trim(c)) END WHEN 'H073' THEN '남부' WHEN 'H074' THEN '서부' END) AS business
FROM (SELECT o_orderkey, ' h0' || (o_orderkey % 4 * 8 + 50 + (o_orderkey % 4 > 1)::INT * 6 + (o_orderkey % 4 = 0)::INT) || ' ' AS c, (o_orderkey % 3)::VARCHAR AS o_shippriority_text, CASE o_orderkey % 7 WHEN 0 THEN 'S3EX99' WHEN 1 THEN 'S3EX12' WHEN 2 THEN 'S3EX21' ELSE 'Z0' END AS p, CASE o_orderkey % 5 WHEN 0 THEN '남부' WHEN 1 THEN '없음' END AS existing FROM orders)""")
def center_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.concat(F.lit(" h0"), (k % 4 * 8 + 50 + (k % 4 > 1).cast("int") * 6 + (k % 4 == 0).cast("int")).cast("string"), F.lit(" "))
    prefix = F.when(k % 7 == 0, "S3EX99").when(k % 7 == 1, "S3EX12").when(k % 7 == 2, "S3EX21").otherwise("Z0")
    existing = F.when(k % 5 == 0, "남부").when(k % 5 == 1, "없음")
    center = clean.center(code, {"H051": "H073"})
    found = clean.business(prefix, existing, center, {"S3EX1": "중부", "S3EX2": "북부"}, {"H073": "남부", "H074": "서부"}, {"S3EX99": "동부"})
    return D.table(spark, sf_dir, "orders").select(k.alias("id"), center.alias("center"), clean.lookup((k % 3).cast("string"), {"1": "김철수", "2": "이영희"}).alias("creator"), found.alias("business"))


@query("SELECT o_orderstatus AS clerk, NULL::VARCHAR AS memo, o_orderkey AS number, o_totalprice::DOUBLE AS price FROM orders")
def schema_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed schema: columns in its order, an absent one null, others gone."""
    kinds = T.StructType([T.StructField("clerk", T.StringType()), T.StructField("memo", T.StringType()), T.StructField("number", T.LongType()), T.StructField("price", T.DoubleType())])
    named = D.table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderstatus": "clerk", "o_orderkey": "number", "o_totalprice": "price"})
    return clean.to_schema(named, kinds)


WRITTEN = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN ' ' || strftime(o_orderdate, '%Y.%m.%d') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') WHEN 3 THEN 'soon' ELSE ' ' END"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    form = lambda f: F.date_format(d, f)
    text = F.when(k % 5 == 0, form("yyyy-MM-dd")).when(k % 5 == 1, F.concat(F.lit(" "), form("yyyy.MM.dd"))).when(k % 5 == 2, form("yyyyMMdd")).when(k % 5 == 3, "soon").otherwise(" ")
    return D.table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("접수일"))


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 THEN o_orderdate::DATE END AS "접수일" FROM orders""", dates=("접수일",))
def dates_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written(spark, sf_dir)
    return clean.parse_dates(rows, clean.date_columns(rows))[0]


@query('SELECT count(*) FILTER (o_orderkey % 5 = 3) AS "접수일" FROM orders')
def dates_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _written(spark, sf_dir)
    return clean.parse_dates(rows, clean.date_columns(rows))[1]


@query("""SELECT v, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN (o_custkey % 50) || '' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '' ELSE (o_custkey % 50) || '.05' END AS v FROM orders) GROUP BY v""")
def filter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a filter menu shows: floats that are whole, midnights, nulls, and what is neither."""
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 50).cast("string")
    raw = F.when(k % 4 == 0, F.concat(c, F.lit(".0"))).when(k % 4 == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00"))).when(k % 4 == 3, F.concat(c, F.lit(".05")))
    return D.table(spark, sf_dir, "orders").select(clean.filter_text(raw).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


CRC = "list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)))"


@query(f"WITH t AS (SELECT {CRC} AS t), s AS (SELECT o_orderkey::VARCHAR AS s FROM orders) SELECT s AS order_number, 1000000000 + (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(s)), lambda i: ascii(s[i + 1])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) & 1073741823) AS row_id FROM s, t")
def pasted_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey").cast("string")
    return D.table(spark, sf_dir, "orders").select(n.alias("order_number"), clean.row_id(n).alias("row_id"))


@query("SELECT c_custkey AS id, trim(regexp_replace(replace(c_name, '#', '  '), '\\s+', ' ', 'g')) AS squeezed, length(c_name) > 0 AS filled FROM customer")
def squeezed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode spaces (here ideographic and no-break ones) are as good as plain ones."""
    odd = F.concat(F.lit("　"), F.regexp_replace("c_name", "#", "　 "), F.lit(" "))
    return D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), clean.squeeze(odd).alias("squeezed"), clean.blank_to_null(odd).isNotNull().alias("filled"))


@query("SELECT p_partkey AS id, len(list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^가-힣a-z]+', ' ', 'g')), ' '), lambda t: len(t) >= 2)))::INT AS informative, len(list_filter(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^가-힣a-z]+', ' ', 'g')), ' '), lambda t: len(t) >= 2))::INT AS tokens FROM part")
def informative_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.normal(F.concat_ws(" ", "p_name", "p_type", F.lit("고객 요청")))
    rows = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("n"))
    return rows.select("id", X.informative(X.words(F.col("n"))).alias("informative"), (F.size(X.tokens(F.col("n"))) - 2).alias("tokens"))


@query("""SELECT p_partkey AS id, 'normal_' || sha256('{"kind":"normal","source_subcategory":"' || p_brand || '","value":"' || p_name || '"}')[1:20] AS rule_id FROM part""")
def rule_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), learn.rule_id("normal", F.col("p_brand"), F.col("p_name")).alias("rule_id"))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("전화 0"), (10 + k % 2).cast("string"), F.lit("-"), (1000 + k % 9000).cast("string"), F.lit("-"), (1000 + k * 7 % 9000).cast("string"), F.lit(" "), _pick(("김철수", "박스", "홍길동님", "고객"), k), F.lit(", 성명: "), _pick(("이영희", "Ann Lee"), k), F.lit(" 메일 a"), k.cast("string"), F.lit("@mail.example.com, "), F.lpad((k % 999999).cast("string"), 6, "0"), F.lit("-1"), F.lpad((k * 3 % 999999).cast("string"), 6, "0"))
    return D.spread(D.table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(k.alias("id"), text.alias("detail"), F.when(k % 3 > 0, F.col("c_name")).alias("주소"), F.when(k % 4 == 0, " ").otherwise("x").alias("구 주소"))


@query("""WITH made AS (SELECT c_custkey AS id, c_custkey AS k FROM customer)
SELECT id, '전화 <전화번호> ' || ['<성명>', '박스', '<성명>', '고객'][k % 4 + 1] || ', 성명: <성명>' || CASE WHEN k % 2 = 0 THEN ' ' ELSE '' END || '메일 <이메일>, <식별번호>' AS detail, CASE WHEN k % 3 > 0 THEN '***' END AS "주소", CASE WHEN k % 4 = 0 THEN ' ' ELSE '***' END AS "구 주소" FROM made""")
def mask_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a phone number, a name behind it (or a word that is none), a labelled name, an e-mail and a resident id; and addresses."""
    return privacy.mask_frame(_personal(spark, sf_dir), "detail")[0]


@query("SELECT count(*) AS changed, count(*) AS phones, (count(*) + count(*) FILTER (c_custkey % 2 = 0))::BIGINT AS names, count(*) AS emails, count(*) AS ids, (count(*) FILTER (c_custkey % 3 > 0) + count(*) FILTER (c_custkey % 4 > 0))::BIGINT AS addresses FROM customer")
def mask_personal_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.mask_frame(_personal(spark, sf_dir), "detail")[1]


@query("SELECT c_custkey AS id, '***' AS address, CASE WHEN c_custkey % 2 = 0 THEN '<성명> -> <성명>' ELSE '김철수 -> 이영희' END AS memo FROM customer")
def mask_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of texts: addresses whole, names beside arrows in one category only."""
    k = F.col("c_custkey")
    category = F.when(k % 2 == 0, privacy.CUSTOMER_INFO).otherwise("그 밖")
    rows = D.spread(D.table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(k.alias("id"), F.create_map(F.lit("주소"), F.col("c_name"), F.lit("메모"), F.lit("김철수 -> 이영희")).alias("payload"), category.alias("category"))
    masked = rows.select("id", privacy.mask_payload(F.col("payload"), F.col("category")).alias("p"))
    return masked.select("id", F.col("p")["주소"].alias("address"), F.col("p")["메모"].alias("memo"))


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.missing'), ''), json_extract_string(props, '$.k')) AS detail, try_cast(json_extract_string(props, '$.k') AS INT) AS number, coalesce(try_cast('x' || event_type AS DOUBLE), 0)::DOUBLE AS fallback FROM events")
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload's first filled field, and numbers that may not be any."""
    field = lambda n: F.nullif(F.get_json_object("props", f"$.{n}"), F.lit(""))
    number = lambda c, kind: c.try_cast(kind)
    return D.table(spark, sf_dir, "events").select("event_id", F.coalesce(field("missing"), field("k")).alias("detail"), number(field("k"), "int").alias("number"), F.coalesce(number(F.concat(F.lit("x"), F.col("event_type")), "double"), F.lit(0.0)).alias("fallback"))


@query(f"WITH {D.ORDER_ROWS_SQL} SELECT order_number, row_number() OVER (ORDER BY CASE WHEN is_error THEN order_date END ASC NULLS LAST, subcategory ASC NULLS LAST, order_number ASC NULLS LAST) AS place FROM order_rows WHERE is_error OR order_number::BIGINT % 5 = 0")
def classified_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place by date, category and number, nulls last."""
    rows = D.order_rows(spark, sf_dir).where(F.col("is_error") | (F.col("order_number").cast("long") % 5 == 0)).withColumn("day", F.when(F.col("is_error"), F.col("order_date")))
    return clean.numbered(rows, [F.asc_nulls_last("day"), F.asc_nulls_last("subcategory"), F.asc_nulls_last("order_number")], "place").select("order_number", "place")


@query(f"WITH {D.POINTS_SQL} SELECT id, 'd' || (label % 7) || '-AB' || lpad((row_number() OVER (PARTITION BY label % 7 ORDER BY x * 0.6::DOUBLE + y * 0.8::DOUBLE, id))::VARCHAR, 4, '0') AS code FROM points")
def sequence_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers inside a district, along an axis."""
    p = D.points(spark, sf_dir).withColumn("district", F.concat(F.lit("d"), F.col("label") % 7))
    nth = F.row_number().over(Window.partitionBy("district").orderBy(F.col("x") * 0.6 + F.col("y") * 0.8, "id"))
    return p.select("id", F.concat("district", F.lit("-AB"), F.lpad(nth.cast("string"), 4, "0")).alias("code"))


@query("SELECT p_partkey AS id, trim(regexp_replace(p_name || ' / ' || p_type || '?.xlsx', '[\\\\/:*?\"<>|]+', '_', 'g'), ' .') AS name FROM part")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), clean.file_name(F.concat("p_name", F.lit(" / "), "p_type", F.lit("?.xlsx"))).alias("name"))
