"""Spatial queries: embeddings as points in the plane, a lattice of squares as parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenwright.functions import geo
from fenwright.operators import graph, route, spatial, streets
from fenwright.plans import domain as D
from fenwright.registry import query

POINTS = f"WITH RECURSIVE {D.POINTS_SQL}"
SIDE, REACH = 700.0, 250.0


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of a lattice in which points are, every third one missing."""
    cell = lambda c: F.floor(F.col(c) / SIDE)
    n = D.points(spark, sf_dir).select(cell("x").alias("i"), cell("y").alias("j")).distinct().where(F.pmod(F.col("i") + 2 * F.col("j"), F.lit(3)) != 0)
    n = n.withColumn("polygon", (F.col("i") + 5000) * 10000 + F.col("j") + 5000)
    at = lambda c, more: (F.col(c) + more) * SIDE
    corner = lambda a, b: F.struct(at("i", a).alias("x"), at("j", b).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(1.0, 0.0), corner(1.0, 1.0), corner(0.0, 1.0))
    shaped = n.select("polygon", geo.segments(ring).alias("segs"), at("i", 0.0).alias("x1"), at("j", 0.0).alias("y1"), at("i", 1.0).alias("x2"), at("j", 1.0).alias("y2"))
    middle = geo.centroid(F.col("segs"))
    return shaped.withColumn("area", F.abs(geo.signed_area(F.col("segs")))).withColumn("cx", middle["x"]).withColumn("cy", middle["y"])


PARCELS = f"cells AS (SELECT DISTINCT floor(x / {SIDE})::BIGINT AS i, floor(y / {SIDE})::BIGINT AS j FROM points), parcels AS (SELECT (i + 5000) * 10000 + j + 5000 AS polygon, i, j, (i * {SIDE})::DOUBLE AS x1, (j * {SIDE})::DOUBLE AS y1 FROM cells WHERE ((i + 2 * j) % 3 + 3) % 3 <> 0)"


@query(f"{POINTS}, {PARCELS}, d AS (SELECT id, polygon, sqrt(greatest(x1 - x, 0, x - x1 - {SIDE}) ** 2 + greatest(y1 - y, 0, y - y1 - {SIDE}) ** 2) AS distance FROM points JOIN parcels ON x BETWEEN x1 - 30 AND x1 + {SIDE + 30} AND y BETWEEN y1 - 30 AND y1 + {SIDE + 30}) SELECT id, polygon FROM d WHERE distance <= 30 QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, polygon) = 1")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.locate(D.points(spark, sf_dir), parcels(spark, sf_dir)).select("id", "polygon")


PAIRS = f"{POINTS}, pairs AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM points a JOIN points b ON a.id < b.id AND abs(a.x - b.x) <= 250 AND abs(a.y - b.y) <= 250 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 250)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.within(D.points(spark, sf_dir), REACH)


@query(f"{PAIRS} SELECT a, b, round(distance, 3) AS distance FROM pairs")
def grid_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.round("distance", 3).alias("distance"))


@query(f"{PAIRS} SELECT a, b, CASE WHEN distance <= 50 THEN 'touches' WHEN distance <= 120 THEN 'near' ELSE 'far' END AS relation FROM pairs")
def edge_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("distance")
    return _pairs(spark, sf_dir).select("a", "b", F.when(d <= 50, "touches").when(d <= 120, "near").otherwise("far").alias("relation"))


@query(f"{PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a) SELECT node, min(reached) AS component FROM r GROUP BY node")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.components(D.points(spark, sf_dir), REACH)


@query(f"{PAIRS} SELECT pairs.a, pairs.b, round(2 * 6371000.0 * asin(least(1.0, sqrt(sin(radians((b.y - a.y) / 100000) / 2) ** 2 + cos(radians(a.y / 100000)) * cos(radians(b.y / 100000)) * sin(radians((b.x - a.x) / 100000) / 2) ** 2))), 2) AS metres FROM pairs JOIN points a ON a.id = pairs.a JOIN points b ON b.id = pairs.b")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    deg = lambda c: F.col(c) / 100000
    side = lambda n: D.points(spark, sf_dir).select(F.col("id").alias(n), deg("x").alias(f"{n}_lon"), deg("y").alias(f"{n}_lat"))
    near = _pairs(spark, sf_dir).select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return near.select("a", "b", F.round(geo.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")), 2).alias("metres"))


@query(f"{PAIRS}, l AS (SELECT least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, distance FROM pairs JOIN points p ON p.id = pairs.a JOIN points q ON q.id = pairs.b WHERE p.label <> q.label) SELECT a, b, round(min(distance), 3) AS distance FROM l GROUP BY a, b")
def contract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = D.points(spark, sf_dir).select(F.col("id").alias("node"), F.col("label").alias("block"))
    return spatial.between_blocks(D.points(spark, sf_dir), labels, REACH).withColumn("distance", F.round("distance", 3))


@query(f"{PAIRS}, e AS (SELECT a AS node, b AS neighbour, distance FROM pairs UNION ALL SELECT b, a, distance FROM pairs) SELECT node, neighbour, row_number() OVER (PARTITION BY node ORDER BY distance, neighbour) AS nth FROM e QUALIFY nth <= 3")
def top_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(D.points(spark, sf_dir), REACH, 3).select("node", "neighbour", "nth")


@query(f"{POINTS} SELECT label AS block, count(*) AS members, sum(orders)::BIGINT AS orders, round(sum(x * orders) / sum(orders), 4) AS cx, round(sum(y * orders) / sum(orders), 4) AS cy, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM points GROUP BY label")
def block_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.points(spark, sf_dir)
    found = spatial.blocks(p, p.select(F.col("id").alias("node"), F.col("label").cast("long").alias("component")))
    return found.select(F.col("block").cast("int").alias("block"), "members", "orders", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), "min_x", "max_x", "min_y", "max_y")


def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.points(spark, sf_dir).select(F.concat(F.lit("s"), F.col("label") % 4).alias("scope"), F.col("id").alias("pos"), "id", "x", "y", F.col("orders").cast("long").alias("orders"), F.floor(F.col("id") / 3).alias("block"))


ROUTE = f"{POINTS}, route AS (SELECT 's' || (label % 4) AS scope, id AS pos, id, x, y, orders, id // 3 AS block FROM points), m AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS jump, (sum(orders) OVER w)::BIGINT AS running FROM route WINDOW w AS (PARTITION BY scope ORDER BY pos))"


@query(f"{ROUTE} SELECT scope, pos, running FROM m")
def route_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.measured(_route(spark, sf_dir)).select("scope", "pos", "running")


@query(f"{ROUTE} SELECT scope, round(max(jump), 3) AS largest FROM m GROUP BY scope")
def route_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.measured(_route(spark, sf_dir)).groupBy("scope").agg(F.round(F.max("jump"), 3).alias("largest"))


@query(f"{ROUTE} SELECT scope, pos, (sum((jump > 500)::INT) OVER (PARTITION BY scope ORDER BY pos))::BIGINT AS \"group\" FROM m")
def route_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.measured(_route(spark, sf_dir)).select("scope", "pos", "group")


@query(f"""{POINTS}, r AS (SELECT 's' || (label % 4) AS scope, id, x, y FROM points), s AS (SELECT *, greatest(1, least(24, round(sqrt(count(*) OVER (PARTITION BY scope)))::INT)) AS n, min(y) OVER (PARTITION BY scope) AS low, greatest(max(y) OVER (PARTITION BY scope) - min(y) OVER (PARTITION BY scope), 1e-9) AS height FROM r),
t AS (SELECT *, least(floor((y - low) / height * n), n - 1) AS band FROM s) SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY band, CASE WHEN band % 2 = 1 THEN -x ELSE x END, id) AS rank FROM t""")
def serpentine_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.serpentine(_route(spark, sf_dir)).select("scope", "id", "rank")


@query(f"{ROUTE}, c AS (SELECT scope, pos, block % 5 AS block, lag(block % 5) OVER (PARTITION BY scope ORDER BY pos) AS prev FROM route) SELECT scope, block, pos FROM c WHERE block IS DISTINCT FROM prev QUALIFY row_number() OVER (PARTITION BY scope, block ORDER BY pos) > 1")
def reentry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.reentries(_route(spark, sf_dir).withColumn("block", F.col("block") % 5))


#: Routes in short: twenty points each, an eighth of the distances, so that some jumps are over the limit; people of each.
LENGTH, PEOPLE = 20, 4


def _short_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    return D.points(spark, sf_dir).select(F.concat(F.lit("s"), F.floor(n / LENGTH)).alias("scope"), (n % LENGTH).alias("pos"), "id", (F.col("x") / 8).alias("x"), (F.col("y") / 8).alias("y"), F.col("orders").cast("long").alias("orders"))


SHORT = f"""{POINTS}, r AS (SELECT 's' || (id // {LENGTH}) AS scope, id % {LENGTH} AS pos, row_number() OVER (PARTITION BY id // {LENGTH} ORDER BY id) AS n, id, x / 8 AS x, y / 8 AS y, orders::DOUBLE AS orders FROM points),
m AS (SELECT *, sum(orders) OVER w AS run, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS jump FROM r WINDOW w AS (PARTITION BY scope ORDER BY n)),
t AS (SELECT scope, count(*) AS len, sum(orders) / {PEOPLE} AS target, floor(sum(orders) / {PEOPLE} * (1 - 0.1::DOUBLE)) AS low, ceil(sum(orders) / {PEOPLE} * (1 + 0.1::DOUBLE)) AS high, list(jump ORDER BY n) AS jumps FROM m GROUP BY scope),
seg AS (SELECT a.scope, a.n - 1 AS s, b.n AS e, b.run - a.run + a.orders AS load, t.*  EXCLUDE (scope), coalesce(list_max(t.jumps[a.n + 1:b.n]), 0) AS longest FROM m a JOIN m b ON a.scope = b.scope AND a.n <= b.n JOIN t ON t.scope = a.scope)"""


def _best(cost: str, allowed: str) -> str:
    """Costs of the first e points in k parts, as one step for each k."""
    steps = [f"c AS (SELECT *, {cost} AS cost FROM seg WHERE {allowed})", "d0 AS (SELECT scope, 0::BIGINT AS e, 0.0::DOUBLE AS cost FROM t)"]
    steps += [f"d{k} AS (SELECT c.scope, c.e, min(d.cost + c.cost) AS cost FROM d{k - 1} d JOIN c ON c.scope = d.scope AND c.s = d.e GROUP BY c.scope, c.e)" for k in range(1, PEOPLE + 1)]
    every = " UNION ALL ".join(f"SELECT scope, {k} AS parts, e, cost FROM d{k}" for k in range(1, PEOPLE + 1))
    return ", ".join([*steps, f"best AS ({every})"])


def _parts(found: DataFrame) -> DataFrame:
    """(scope, person, load, longest, last, target, low, high) of a cut route."""
    w = Window.partitionBy("scope", "person").orderBy("pos")
    jump = geo.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w))
    target = F.sum("orders").over(Window.partitionBy("scope")) / PEOPLE
    parts = found.withColumn("jump", jump).withColumn("target", target).where("person is not null").groupBy("scope", "person", "target").agg(F.sum("orders").cast("double").alias("load"), F.coalesce(F.max("jump"), F.lit(0.0)).alias("longest"), F.count("*").alias("points"), F.sort_array(F.collect_list(F.struct("pos", "x", "y", "jump"))).alias("route"))
    return parts.withColumns({"low": F.floor(F.col("target") * (1 - route.BAND)), "high": F.ceil(F.col("target") * (1 + route.BAND))})


NEXT = "CASE WHEN NOT list_contains(g.seen, p.id) THEN (p.x - g.x) ** 2 + (p.y - g.y) ** 2 END"


@query(f"""{SHORT}, g AS (SELECT scope, 1 AS pos, id, x, y, [id] AS seen FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY y DESC, x, id) AS first FROM r) WHERE first = 1
  UNION ALL SELECT scope, pos, id, x, y, seen FROM (SELECT g.scope, g.pos + 1 AS pos, p.id, p.x, p.y, list_append(g.seen, p.id) AS seen, row_number() OVER (PARTITION BY g.scope ORDER BY (p.x - g.x) ** 2 + (p.y - g.y) ** 2, p.id) AS nearest FROM g JOIN r p ON p.scope = g.scope AND NOT list_contains(g.seen, p.id)) WHERE nearest = 1)
SELECT scope, id, pos FROM g""")
def route_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.greedy(_short_route(spark, sf_dir).drop("pos")).select("scope", "id", F.col("pos").cast("int").alias("pos"))


@query(f"""{SHORT}, {_best("55 * (load - target) ** 2 + 1e6 * (greatest(0, low - load) + greatest(0, load - high)) ** 2 + 1e8 * (greatest(0, low - load) + greatest(0, load - high)) + 20 * longest", "longest <= 500")},
f AS (SELECT best.*, row_number() OVER (PARTITION BY scope ORDER BY (parts = least({PEOPLE}, len) AND e = len) DESC, e DESC, cost, parts) AS nth FROM best JOIN t USING (scope))
SELECT scope, parts, e AS points, round(cost, 2) AS cost FROM f WHERE nth = 1""")
def partition_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(route.split(_short_route(spark, sf_dir), PEOPLE))
    out = F.greatest(F.lit(0), F.col("low") - F.col("load")) + F.greatest(F.lit(0), F.col("load") - F.col("high"))
    cost = route.DEVIATION * F.pow(F.col("load") - F.col("target"), F.lit(2)) + route.OVER_SQUARED * out * out + route.OVER * out + route.FAR * F.col("longest")
    return parts.groupBy("scope").agg(F.count("*").cast("int").alias("parts"), F.sum("points").alias("points"), F.round(F.sum(cost), 2).alias("cost"))


PENALTY = "CASE WHEN {0} <= 400 THEN 0 WHEN {0} <= 800 THEN ({0} - 400) * 7 WHEN {0} <= 1000 THEN 9000 + ({0} - 800) * 14 ELSE 28000 + ({0} - 1000) * 60 END"


@query(f"""{SHORT}, {_best(f"abs(load - target) * 120 + 1e5 * coalesce(list_sum(list_transform(jumps[s + 2:e], lambda j: {PENALTY.format('j')})), 0) - 0.18 * least(CASE WHEN e < len THEN {PENALTY.format('jumps[e + 1]')} ELSE 0 END, 12000)", "load BETWEEN low AND high")}
SELECT scope, round(cost, 2) AS cost FROM best JOIN t USING (scope) WHERE parts = {PEOPLE} AND e = len""")
def partition_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the routes that can be cut within the bounds."""
    rows = _short_route(spark, sf_dir)
    w = Window.partitionBy("scope").orderBy("pos")
    jump = F.coalesce(geo.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w)), F.lit(0.0))
    after = F.coalesce(geo.distance(F.col("x"), F.col("y"), F.lead("x").over(w), F.lead("y").over(w)), F.lit(0.0))
    price = lambda c: F.when(c <= 400, F.lit(0.0)).when(c <= 800, (c - 400) * 7).when(c <= 1000, 9000 + (c - 800) * 14).otherwise(28000 + (c - 1000) * 60)
    found = route.split_bounded(rows, PEOPLE).withColumn("jump", jump).withColumn("after", after)
    part = Window.partitionBy("scope", "person").orderBy("pos")
    marked = found.withColumn("inside", F.when(F.lag("pos").over(part).isNotNull(), price(F.col("jump"))).otherwise(0.0)).withColumn("behind", F.when(F.lead("pos").over(part).isNull(), F.least(price(F.col("after")), F.lit(12_000.0))).otherwise(0.0))
    target = F.sum("orders").over(Window.partitionBy("scope")) / PEOPLE
    parts = marked.withColumn("target", target).groupBy("scope", "person", "target").agg(F.sum("orders").alias("load"), F.sum("inside").alias("inside"), F.sum("behind").alias("behind"))
    good = (F.col("load") >= F.floor(F.col("target") * (1 - route.BAND))) & (F.col("load") <= F.ceil(F.col("target") * (1 + route.BAND)))
    cost = route.OFF * F.abs(F.col("load") - F.col("target")) + route.INSIDE * F.col("inside") - route.REWARD * F.col("behind")
    return parts.groupBy("scope").agg(F.bool_and(good).alias("good"), F.count("*").alias("parts"), F.round(F.sum(cost), 2).alias("cost")).where(F.col("good") & (F.col("parts") == PEOPLE)).select("scope", "cost")


@query(f"""{SHORT}, {_best("(load - target) ** 2", "true")}
SELECT scope, parts, round(cost, 4) AS cost FROM best JOIN t USING (scope) WHERE parts = least({PEOPLE}, len) AND e = len""")
def partition_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(route.split_even(_short_route(spark, sf_dir), PEOPLE))
    return parts.groupBy("scope").agg(F.count("*").cast("int").alias("parts"), F.round(F.sum(F.pow(F.col("load") - F.col("target"), F.lit(2))), 4).alias("cost"))


@query(f"""{SHORT}, a AS (SELECT *, pos // 5 + 1 AS person FROM r), j AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS jump FROM a WINDOW w AS (PARTITION BY scope, person ORDER BY pos)),
p AS (SELECT scope, person, sum(orders) AS orders, count(*) FILTER (jump > 500) AS jumps FROM j GROUP BY ALL)
SELECT scope, count(*) FILTER (abs(p.orders - target) > 0.1 * target) AS outside, sum(p.jumps)::BIGINT AS jumps, {PEOPLE} - count(*) AS idle FROM p JOIN t USING (scope) GROUP BY scope""")
def route_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = _short_route(spark, sf_dir).withColumn("person", F.floor(F.col("pos") / 5) + 1)
    return route.quality(assigned, PEOPLE)


@query(f"""{POINTS}, b AS (SELECT 's' || (label % 4) AS scope, CASE WHEN id % 37 = 36 AND id % 3 > 0 THEN id + 100 ELSE id % 37 END AS component, id, x / 8 AS x, y / 8 AS y, orders FROM points), c AS (SELECT scope, component, count(*) AS members, sum(orders)::BIGINT AS orders FROM b GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY orders DESC, component) = 1 AS main FROM c),
n AS (SELECT p.scope, p.component, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS d FROM b p JOIN k ON k.scope = p.scope AND k.component = p.component AND NOT k.main JOIN k z ON z.scope = p.scope AND z.main JOIN b q ON q.scope = p.scope AND q.component = z.component GROUP BY ALL)
SELECT scope, component, members, orders, CASE WHEN d <= 1500 THEN round(d, 3) END AS nearest, CASE WHEN main THEN NULL WHEN members = 1 AND orders <= 24 THEN 'small_isolated_block' WHEN orders <= 40 AND d > 1500 THEN 'medium_far_component' WHEN orders <= 24 AND d > 500 THEN 'small_far_island_component' END AS reason
FROM k LEFT JOIN n USING (scope, component)""")
def residual_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    blocks = D.points(spark, sf_dir).select(F.concat(F.lit("s"), F.col("label") % 4).alias("scope"), F.when((n % 37 == 36) & (n % 3 > 0), n + 100).otherwise(n % 37).alias("component"), "id", (F.col("x") / 8).alias("x"), (F.col("y") / 8).alias("y"), "orders")
    return route.residual_components(blocks).withColumn("nearest", F.round("nearest", 3))


@query(f"""{SHORT}, s AS (SELECT m.*, t.* EXCLUDE (scope), jump > 500 AS new FROM m JOIN t USING (scope)), g AS (SELECT *, sum(new::INT) OVER (PARTITION BY scope ORDER BY n) AS grp FROM s), o AS (SELECT scope, grp, sum(orders) AS orders, any_value(target) AS target FROM g GROUP BY ALL)
SELECT scope, grp::BIGINT AS "group", orders::BIGINT AS orders, orders < target * (1 - 0.1::DOUBLE) AS island, round(coalesce(sum(orders) FILTER (NOT orders < target * (1 - 0.1::DOUBLE)) OVER (PARTITION BY scope), 0) / {PEOPLE}, 6) AS target FROM o""")
def route_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.islands(_short_route(spark, sf_dir), PEOPLE).withColumn("target", F.round(F.coalesce("target", F.lit(0.0)), 6))


@query(f"""{POINTS}, c AS (SELECT 's' || (label % 4) AS scope, label AS cluster, sum(orders)::DOUBLE AS orders, count(*) AS units FROM points GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY cluster) AS nth, count(*) OVER (PARTITION BY scope) AS clusters, sum(orders) OVER (PARTITION BY scope) / 20 AS target FROM c),
p AS (SELECT scope, nth, clusters, n, greatest(0, abs(orders / n - target) - 0.1 * target) AS over, n * (1e6 * over ** 2 + 1e8 * over + 55 * (orders / n - target) ** 2) AS cost FROM k, LATERAL (SELECT unnest(range(1, least(20, units) + 1)) AS n)),
w AS (SELECT scope, nth, clusters, n AS used, cost FROM p WHERE nth = 1 UNION ALL SELECT w.scope, p.nth, p.clusters, w.used + p.n, w.cost + p.cost FROM w JOIN p ON p.scope = w.scope AND p.nth = w.nth + 1 WHERE w.used + p.n <= 20),
f AS (SELECT scope, used, min(cost) AS cost FROM w WHERE nth = clusters GROUP BY ALL) SELECT scope, max(used)::BIGINT AS people, round(max_by(cost, used), 2) AS cost FROM f GROUP BY scope""")
def people_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = D.points(spark, sf_dir).groupBy(F.concat(F.lit("s"), F.col("label") % 4).alias("scope"), F.col("label").alias("cluster")).agg(F.sum("orders").alias("orders"), F.count("*").alias("units"))
    target = F.sum("orders").over(Window.partitionBy("scope")) / 20
    off = F.abs(F.col("orders") / F.col("people") - F.col("target"))
    over = F.greatest(F.lit(0.0), off - route.BAND * F.col("target"))
    cost = F.col("people") * (route.OVER_SQUARED * over * over + route.OVER * over + route.DEVIATION * off * off)
    return route.allocate(clusters, 20).withColumn("target", target).groupBy("scope").agg(F.sum("people").alias("people"), F.round(F.sum(cost), 2).alias("cost"))


@query(f"{POINTS}, {PARCELS} SELECT least(a.polygon, b.polygon) AS a, greatest(a.polygon, b.polygon) AS b, 'touches' AS relation, 0::DOUBLE AS border, CASE WHEN a.i = b.i OR a.j = b.j THEN {SIDE}::DOUBLE ELSE 0::DOUBLE END AS shared, round(sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2), 3) AS centres FROM parcels a JOIN parcels b ON a.polygon < b.polygon AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1")
def parcel_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.neighbours(parcels(spark, sf_dir)).select("a", "b", "relation", F.round("border", 3).alias("border"), F.round("shared", 3).alias("shared"), F.round("centres", 3).alias("centres"))


@query(f"""{POINTS}, {PARCELS}, e AS (SELECT x1 AS ax, y1 AS ay, x1 + {SIDE}::DOUBLE AS bx, y1 AS "by" FROM parcels UNION ALL SELECT x1, y1 + {SIDE}::DOUBLE, x1 + {SIDE}::DOUBLE, y1 + {SIDE}::DOUBLE FROM parcels UNION ALL SELECT x1, y1, x1, y1 + {SIDE}::DOUBLE FROM parcels UNION ALL SELECT x1 + {SIDE}::DOUBLE, y1, x1 + {SIDE}::DOUBLE, y1 + {SIDE}::DOUBLE FROM parcels)
SELECT ax, ay, bx, "by" FROM e GROUP BY ALL HAVING count(*) = 1""")
def union_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = parcels(spark, sf_dir).select("polygon", F.explode("segs").alias("s")).select("polygon", "s.*")
    return spatial.outline(segs)


_METRES = "2 * 6371000.0 * asin(least(1.0, sqrt(sin(radians({2} - {0}) / 2) ** 2 + cos(radians({0})) * cos(radians({2})) * sin(radians({3} - {1}) / 2) ** 2)))"
# Each street in the order of its lots; the head of a run is carried along it. A street's runs are its components.
STREETS = f"""{POINTS}, r AS (SELECT id, label, id % 10 AS road, id // 10 AS m, 36 + y / 10000000 AS lat, 127 + x / 10000000 AS lon, row_number() OVER (PARTITION BY label, id % 10 ORDER BY id // 10, id) AS n FROM points),
w AS (SELECT id, label, road, n, m, lat, lon, id AS head, m AS hm, lat AS hlat, lon AS hlon FROM r WHERE n = 1
  UNION ALL SELECT id, label, road, n, m, lat, lon, CASE WHEN near THEN head ELSE id END, CASE WHEN near THEN hm ELSE m END, CASE WHEN near THEN hlat ELSE lat END, CASE WHEN near THEN hlon ELSE lon END
  FROM (SELECT *, (d <= 22 AND score <= 95) OR (d <= 55 AND score <= 118 AND lots <= 4) OR (d <= 38 AND score <= 108 AND lots <= 8) AS near
    FROM (SELECT *, d + least(lots * 4, 80) AS score FROM (SELECT r.*, head, hm, hlat, hlon, abs(r.m - hm) AS lots, {_METRES.format("hlat", "hlon", "r.lat", "r.lon")} AS d FROM w JOIN r ON r.label = w.label AND r.road = w.road AND r.n = w.n + 1)))),
o AS (SELECT *, lag(m) OVER s AS pm, lag(lat) OVER s AS plat, lag(lon) OVER s AS plon, count(*) OVER (PARTITION BY head) AS held FROM w WINDOW s AS (PARTITION BY head ORDER BY m, lat, lon, id)),
b AS (SELECT *, sum(CASE WHEN pm IS NULL OR abs(m - pm) > 10 OR {_METRES.format("plat", "plon", "lat", "lon")} > 65 THEN 1 ELSE 0 END) OVER (PARTITION BY head ORDER BY m, lat, lon, id) AS run FROM o),
c AS (SELECT *, (row_number() OVER (PARTITION BY head, run ORDER BY m, lat, lon, id) - 1) // 80 AS part FROM b)"""


@query(f"{STREETS} SELECT id, head AS component, CASE WHEN held <= 80 THEN 0 ELSE dense_rank() OVER (PARTITION BY head ORDER BY run, part) - 1 END::BIGINT AS piece FROM c")
def street_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as addresses of ten streets, about 1 degree to 100 km."""
    p = D.points(spark, sf_dir)
    records = p.select(F.lit("s").alias("scope"), "id", F.col("label").cast("string").alias("dong"), (F.col("id") % 10).cast("string").alias("road_stem"), (F.col("id") / 10).cast("int").alias("lot_main"), F.lit(None).cast("int").alias("lot_sub"), (36 + F.col("y") / 10_000_000).alias("lat"), (127 + F.col("x") / 10_000_000).alias("lon"))
    return streets.blocks(records)


EDGES = f"""{PAIRS}, walls AS (SELECT id, x AS ax, y AS ay, x + 60 AS bx, y + 80 AS "by" FROM points WHERE id % 5 = 0), k AS (SELECT pairs.a, pairs.b, distance, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS "by" FROM pairs JOIN points p ON p.id = pairs.a JOIN points q ON q.id = pairs.b)"""


TURN = "CASE WHEN abs(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0})) <= 1e-9 THEN 0 ELSE sign(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0})) END"
ON = "(abs(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0})) <= 1e-9 AND {4} BETWEEN least({0}, {2}) - 1e-9 AND greatest({0}, {2}) + 1e-9 AND {5} BETWEEN least({1}, {3}) - 1e-9 AND greatest({1}, {3}) + 1e-9)"
_S, _O = ("k.ax", "k.ay", "k.bx", 'k."by"'), ("w.ax", "w.ay", "w.bx", 'w."by"')
CROSS = f"(({TURN.format(*_S, *_O[:2])}) <> ({TURN.format(*_S, *_O[2:])}) AND ({TURN.format(*_O, *_S[:2])}) <> ({TURN.format(*_O, *_S[2:])})) OR {ON.format(*_S, *_O[:2])} OR {ON.format(*_S, *_O[2:])} OR {ON.format(*_O, *_S[:2])} OR {ON.format(*_O, *_S[2:])}"


@query(f"{EDGES} SELECT DISTINCT a, b FROM k JOIN walls w ON {CROSS}")
def barrier_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spatial.met(D.points(spark, sf_dir), REACH)
    walls = D.points(spark, sf_dir).where("id % 5 = 0").select(F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 60).alias("bx"), (F.col("y") + 80).alias("by"))
    return spatial.meeting(edges.select("a", "b", "ax", "ay", "bx", "by"), walls, REACH).select("a", "b")


MEASURED = "border AS (SELECT a, b, distance / 10 AS border, (a + b) % 4 AS shared, distance AS centres, (a + b) % 7 = 0 AS barrier, a % 10 <> b % 10 AND (a + b) % 3 = 0 AS other FROM pairs)"
RELATION = "CASE WHEN NOT ((border <= 3 AND shared >= 1) OR (border <= 18 AND centres <= 90)) THEN NULL WHEN other THEN 'across_admin_boundary' WHEN barrier THEN 'across_transport_barrier' WHEN border <= 3 AND shared >= 1 THEN 'touches' ELSE 'near' END"


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, d = F.col("a"), F.col("b"), F.col("distance")
    return _pairs(spark, sf_dir).select("a", "b", (d / 10).alias("border"), ((a + b) % 4).alias("shared"), d.alias("centres"), ((a + b) % 7 == 0).alias("barrier"), ((a % 10 != b % 10) & ((a + b) % 3 == 0)).alias("other"))


@query(f"{PAIRS}, {MEASURED} SELECT a, b, {RELATION} AS relation FROM border")
def edge_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("a", "b", spatial.relation(*map(F.col, ("border", "shared", "centres", "barrier", "other"))).alias("relation"))


@query(f"{PAIRS}, {MEASURED}, r AS (SELECT a % 20 AS block, {RELATION} AS relation FROM border) SELECT block, relation, count(*) AS edges FROM r WHERE relation IS NOT NULL GROUP BY ALL")
def relation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measured(spark, sf_dir).select((F.col("a") % 20).alias("block"), spatial.relation(*map(F.col, ("border", "shared", "centres", "barrier", "other"))).alias("relation"))
    return rows.where("relation is not null").groupBy("block", "relation").agg(F.count("*").alias("edges"))


@query(f"{PAIRS}, {MEASURED} SELECT a, b, CASE WHEN border <= 3 AND shared >= 1 THEN 'touches' WHEN border <= 18 AND centres * 3 <= 90 THEN 'near' WHEN centres * 3 <= 500 THEN 'weak_bridge' ELSE 'over_500m_jump' END AS link FROM border")
def route_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.link_types(_measured(spark, sf_dir).withColumn("distance", F.col("centres") * 3)).select("a", "b", "link")


@query(f"""{SHORT}, u AS (SELECT *, sum(orders) OVER (PARTITION BY scope) AS whole FROM r), g AS (SELECT scope, pos, orders, 0 AS unit, orders AS load, whole, n FROM u WHERE n = 1
  UNION ALL SELECT u.scope, u.pos, u.orders, CASE WHEN cut THEN g.unit + 1 ELSE g.unit END, CASE WHEN cut THEN u.orders ELSE g.load + u.orders END, u.whole, u.n FROM g, u, LATERAL (SELECT u.whole > 78 AND g.load >= 12 AND (g.load + u.orders > 25 OR abs(g.load - 18) <= abs(g.load + u.orders - 18)) AS cut) WHERE u.scope = g.scope AND u.n = g.n + 1)
SELECT scope, pos, unit::BIGINT AS unit FROM g""")
def block_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each short route as a block of one scope: one unit, or parts where it holds more than 78 orders."""
    found = route.units(_short_route(spark, sf_dir).withColumn("block", F.lit(1)), 18.0, 12.0, 78.0)
    return found.select("scope", "pos", "unit")


TRIANGLE = "t AS (SELECT id, x AS ax, y AS ay, x + 10 + id % 7 AS bx, y + id % 5 AS \"by\", x + id % 3 AS cx, y + 20 - id % 40 AS cy FROM points), s AS (SELECT *, ((ax * \"by\" - bx * ay) + (bx * cy - cx * \"by\") + (cx * ay - ax * cy)) / 2 AS area FROM t)"


@query(f"""{POINTS}, {TRIANGLE} SELECT id, round(area, 4) AS area, 3::INT AS segments, round((ax + bx + cx) / 3, 3) AS mx, round((ay + "by" + cy) / 3, 3) AS my, round(greatest(0, greatest(ax, bx, cx) - 1e3, -1e3 - least(ax, bx, cx)), 3) AS beyond FROM s WHERE abs(area) > 1""")
def triangle_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings left open and closed: segments, signed area, centroid, and how far the box reaches beyond a kilometre."""
    n, x, y = F.col("id"), F.col("x"), F.col("y")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    first = corner(x, y)
    ring = F.array(first, corner(x + 10 + n % 7, y + n % 5), corner(x + n % 3, y + 20 - n % 40))
    shaped = D.points(spark, sf_dir).select("id", F.when(n % 2 == 0, ring).otherwise(geo.closed(ring)).alias("ring")).select("id", "ring", geo.segments(F.col("ring")).alias("segs"))
    middle = geo.centroid(F.col("segs"))
    xs = F.transform("ring", lambda p: p.x)
    beyond = F.greatest(F.lit(0.0), F.array_max(xs) - 1e3, F.lit(-1e3) - F.array_min(xs))
    area = geo.signed_area(F.col("segs"))
    return shaped.where(F.abs(area) > 1).select("id", F.round(area, 4).alias("area"), F.size("segs").alias("segments"), F.round(middle["x"], 3).alias("mx"), F.round(middle["y"], 3).alias("my"), F.round(beyond, 3).alias("beyond"))


#: Scopes of a hundred points each; components are joined by links of 250 m, clusters by steps of 500 m.
SCOPE = 100
TOWN = f"""{POINTS}, blocks AS (SELECT id // {SCOPE} AS scope, id, x / 2 AS x, y / 2 AS y, orders FROM points),
near AS (SELECT a.scope, a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM blocks a JOIN blocks b ON a.scope = b.scope AND a.id <> b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 250),
reached AS (SELECT id AS node, id AS got FROM blocks UNION SELECT r.node, n.b FROM reached r JOIN near n ON r.got = n.a), component AS (SELECT node AS id, min(got) AS component FROM reached GROUP BY node),
placed AS (SELECT * FROM blocks JOIN component USING (id)),
apart AS (SELECT p.scope, p.component AS a, q.component AS b, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS distance FROM placed p JOIN placed q ON p.scope = q.scope AND p.component <> q.component GROUP BY ALL HAVING min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) <= 500),
joined AS (SELECT DISTINCT scope, component AS node, component AS got FROM placed UNION SELECT j.scope, j.node, d.b FROM joined j JOIN apart d ON j.got = d.a), clusters AS (SELECT scope, node AS component, min(got) AS cluster FROM joined GROUP BY ALL)"""


def _town(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks (scope, component, id, x, y, orders), and the links between them that make components."""
    p = D.points(spark, sf_dir).select(F.floor(F.col("id") / SCOPE).alias("scope"), "id", (F.col("x") / 2).alias("x"), (F.col("y") / 2).alias("y"), F.col("orders").cast("long").alias("orders"))
    # Within half a cell's reach points of different scopes never meet: scopes are set far apart.
    spread = p.select("id", (F.col("x") + F.col("scope") * 1e6).alias("x"), "y")
    links = spatial.within(spread, 250.0).join(p.select(F.col("id").alias("a"), "scope"), "a").select("scope", "a", "b", "distance")
    member = graph.connected_components(links, "a", "b").select(F.col("node").alias("id"), "component")
    return p.join(member, "id", "left").withColumn("component", F.coalesce("component", "id")), links


@query(f"{TOWN} SELECT scope, a, b, round(distance, 3) AS distance FROM apart WHERE a < b")
def component_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.component_distances(_town(spark, sf_dir)[0]).withColumn("distance", F.round("distance", 3))


@query(f"{TOWN} SELECT * FROM clusters")
def jump_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.jump_clusters(_town(spark, sf_dir)[0])


# Links as measured borders; three in seven are blocked by kind. Of the blocks not yet on the route: those of the component first, by link, within reach, others.
BLOCK_ROUTE = f"""{TOWN}, measured AS (SELECT scope, a, b, distance / 10 AS border, (a + b) % 4 AS shared, distance FROM near),
links AS (SELECT scope, a, b FROM measured WHERE (border <= 3 AND shared >= 1) OR (border <= 18 AND distance <= 90)),
of AS (SELECT p.*, cluster FROM placed p JOIN clusters USING (scope, component)),
sized AS (SELECT *, greatest(1, least(24, round(sqrt(count(*) OVER w))::INT)) AS n, max(y) OVER w AS high, greatest(max(y) OVER w - min(y) OVER w, 1e-9) AS height,
  sum(x * greatest(orders, 1)) OVER w / sum(greatest(orders, 1)) OVER w AS mx, sum(y * greatest(orders, 1)) OVER w / sum(greatest(orders, 1)) OVER w AS my FROM of WINDOW w AS (PARTITION BY scope, component)),
banded AS (SELECT *, least(floor((high - y) / height * n), n - 1) AS band FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scope, component ORDER BY band, CASE WHEN band % 2 = 1 THEN -x ELSE x END, id) AS rank FROM banded),
corners AS (SELECT *, abs(mx - min(mx) OVER (PARTITION BY scope, cluster)) + abs(max(my) OVER (PARTITION BY scope, cluster) - my) AS far_component, abs(x - min(x) OVER (PARTITION BY scope, component)) + abs(max(y) OVER (PARTITION BY scope, component) - y) AS far_block FROM ranked),
walk AS (SELECT scope, cluster, component, id, x, y, rank, 1 AS pos, [id] AS seen FROM (SELECT *, row_number() OVER (PARTITION BY scope, cluster ORDER BY round(far_component, 6), component, round(far_block, 6), rank, id) AS first FROM corners) WHERE first = 1
  UNION ALL SELECT scope, cluster, component, id, x, y, rank, pos, seen FROM (
    SELECT c.*, row_number() OVER (PARTITION BY scope, cluster ORDER BY NOT same, CASE WHEN same THEN kind ELSE 0 END, CASE WHEN same THEN rank < was ELSE false END, CASE WHEN NOT same THEN heart WHEN kind = 0 THEN steps ELSE metres END, CASE WHEN same THEN 0 ELSE component END,
      CASE WHEN same AND kind > 0 THEN steps ELSE metres END, rank, id) AS nth FROM (
      SELECT r.scope, r.cluster, r.component, r.id, r.x, r.y, r.rank, w.rank AS was, w.pos + 1 AS pos, list_append(w.seen, r.id) AS seen, r.component = w.component AS same, round(sqrt((r.x - w.x) ** 2 + (r.y - w.y) ** 2), 6) AS metres, round(sqrt((r.mx - w.x) ** 2 + (r.my - w.y) ** 2), 6) AS heart, abs(r.rank - w.rank) AS steps,
        CASE WHEN l.a IS NOT NULL THEN 0 WHEN sqrt((r.x - w.x) ** 2 + (r.y - w.y) ** 2) <= 500 THEN 1 ELSE 2 END AS kind
      FROM walk w JOIN ranked r ON r.scope = w.scope AND r.cluster = w.cluster AND NOT list_contains(w.seen, r.id) LEFT JOIN links l ON l.scope = w.scope AND l.a = w.id AND l.b = r.id) c) WHERE nth = 1)
SELECT scope, cluster, component, id, rank, pos FROM walk"""


@query(BLOCK_ROUTE)
def block_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way through each cluster: by admissible links in serpentine order, else by jumps."""
    blocks, near = _town(spark, sf_dir)
    placed = blocks.join(route.jump_clusters(blocks), ["scope", "component"])
    measured = near.select("scope", "a", "b", (F.col("distance") / 10).alias("border"), ((F.col("a") + F.col("b")) % 4).alias("shared"), "distance")
    return route.block_route(placed, route.admissible(measured)).select("scope", "cluster", "component", "id", "rank", F.col("pos").cast("int").alias("pos"))


@query(f"""{SHORT}, b AS (SELECT scope, pos // 4 AS block, avg(x) AS x, avg(y) AS y FROM r GROUP BY ALL), a AS (SELECT scope, block, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS ax, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS ay FROM b WINDOW w AS (PARTITION BY scope ORDER BY block))
SELECT r.scope, a.block, id, row_number() OVER (PARTITION BY r.scope, a.block ORDER BY CASE WHEN abs(ax) + abs(ay) < 1e-7 THEN x - y ELSE x * ax + y * ay END, id) AS pos FROM r JOIN a ON a.scope = r.scope AND a.block = r.pos // 4""")
def records_along_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four points a block; blocks follow each other as they stand."""
    rows = _short_route(spark, sf_dir).withColumn("block", F.floor(F.col("pos") / 4)).drop("pos")
    way = rows.groupBy("scope", "block").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("pos", F.col("block"))
    return route.along_axis(rows, way).select("scope", "block", "id", "pos")


@query(f"""{POINTS}, p AS (SELECT id, radians(36 + y / 100000) AS f, 127 + x / 100000 AS lon FROM points), c AS (SELECT (1 / 298.257222101::DOUBLE) * (2 - 1 / 298.257222101::DOUBLE) AS e2), v AS (SELECT p.*, e2, e2 / (1 - e2) AS ep2, 6378137 / sqrt(1 - e2 * sin(f) ** 2) AS n, tan(f) ** 2 AS t, e2 / (1 - e2) * cos(f) ** 2 AS c, radians(lon - 127) * cos(f) AS a,
  [6378137 * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * g - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * g) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * g) - (35 * e2 ** 3 / 3072) * sin(6 * g)) FOR g IN [f, radians(38.0)]] AS m FROM p, c)
SELECT id, round(200000 + n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a ** 5 / 120), 3) AS x, round(600000 + m[1] - m[2] + n * tan(f) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a ** 6 / 720), 3) AS y FROM v""")
def plane_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = geo.to_plane(36 + F.col("y") / 100_000, 127 + F.col("x") / 100_000)
    return D.points(spark, sf_dir).select("id", F.round(at["x"], 3).alias("x"), F.round(at["y"], 3).alias("y"))


@query(f"{POINTS}, r AS (SELECT id, (label % 6)::VARCHAR AS code, CASE WHEN id % 4 > 0 THEN 'd' || (label % 6) END AS dong FROM points), names(code, name) AS (VALUES ('0', 'zero'), ('1', 'one'), ('2', 'two')), m AS (SELECT code, dong, count(*) AS n, min(id) AS first FROM r WHERE dong IS NOT NULL GROUP BY ALL), o AS (SELECT code, min_by(dong, {{'n': -n, 'first': first}}) AS common FROM m GROUP BY code) SELECT id, coalesce(name, common) AS dong FROM r LEFT JOIN names USING (code) LEFT JOIN o USING (code)")
def district_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A district by the code of the parcel, else the one that most records of the code name."""
    n = F.col("id")
    rows = D.points(spark, sf_dir).select("id", (F.col("label") % 6).cast("string").alias("code"), F.when(n % 4 > 0, F.concat(F.lit("d"), F.col("label") % 6)).alias("dong"))
    return spatial.districts(rows, spark.createDataFrame([("0", "zero"), ("1", "one"), ("2", "two")], "code string, name string"))


@query(f"{POINTS}, b AS (SELECT label AS block, sum(CASE WHEN label % 3 = 0 THEN 0 ELSE orders END)::BIGINT AS orders FROM points GROUP BY label) SELECT count(*) AS blocks, count(*) FILTER (orders > 0) AS active FROM b")
def active_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = D.points(spark, sf_dir).groupBy("label").agg(F.sum(F.when(F.col("label") % 3 == 0, 0).otherwise(F.col("orders"))).alias("orders"))
    return sums.agg(F.count("*").alias("blocks"), F.count_if(F.col("orders") > 0).alias("active"))


@query(f"""{PAIRS}, r AS (SELECT id, (label % 3)::VARCHAR AS dong, (id % 5)::VARCHAR AS stem, CASE WHEN id % 6 > 0 THEN id // 10 END AS main, CASE WHEN id % 4 = 0 THEN id % 9 END AS sub FROM points)
SELECT pairs.a, pairs.b, round(distance + CASE WHEN l.dong <> r.dong THEN 90 ELSE 0 END + CASE WHEN l.stem <> r.stem THEN 50 + CASE WHEN distance > 70 THEN 45 ELSE 0 END ELSE 0 END + CASE WHEN l.main IS NULL OR r.main IS NULL THEN 0 ELSE least(abs(l.main - r.main) * 4, 80) END + CASE WHEN l.sub IS NULL OR r.sub IS NULL THEN 0 ELSE least(abs(l.sub - r.sub) * 2, 24) END, 3) AS score FROM pairs JOIN r l ON l.id = pairs.a JOIN r ON r.id = pairs.b""")
def address_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    record = F.struct((F.col("label") % 3).cast("string").alias("dong"), (n % 5).cast("string").alias("road_stem"), F.when(n % 6 > 0, F.floor(n / 10)).alias("lot_main"), F.when(n % 4 == 0, n % 9).alias("lot_sub"))
    side = lambda c, name: D.points(spark, sf_dir).select(n.alias(c), record.alias(name))
    both = _pairs(spark, sf_dir).join(side("a", "l"), "a").join(side("b", "r"), "b")
    return both.select("a", "b", F.round(streets.affinity("l", "r", F.col("distance")), 3).alias("score"))
