"""Routes: figures of an ordered route by windows; ordering and splitting one scope's blocks as grouped work.

A scope is one center in one month, some hundred to some thousand blocks; its order is a sequence by
nature, so scopes are the unit of work and Spark spreads them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenwright.functions import geo
from fenwright.operators import scan
from fenwright.operators.cut import cut as table
from fenwright.operators.graph import connected_components

# What ends a group, weights of a partition's cost, share of the target that counts as even.
JUMP = 500.0
DEVIATION, OVER_SQUARED, OVER, FAR = 55.0, 1e6, 1e8, 20.0
BAND = 0.1
# Of the partition with hard bounds: what a jump costs from each length on, a unit of deviation, weight of jumps inside,
# share and most of a jump between two parts that is given back; how far beyond the bound and for how long jumps the fallback looks.
JUMP_COST = ((400.0, 0.0, 7.0), (800.0, 9000.0, 14.0), (1000.0, 28000.0, 60.0))
OFF, INSIDE, REWARD, MOST_REWARD = 120.0, 1e5, 0.18, 12_000.0
SLACK, LONG_JUMP, BONUS_METRES, OUT_WEIGHT, REST_WEIGHT = 80.0, 900.0, 60.0, 10.0, 0.05
# Of components that stay outside the routes: orders of small ones, of middling ones, metres from the main one.
SMALL_ORDERS, MIDDLING_ORDERS, SMALL_METRES, MIDDLING_METRES = 24, 40, 500.0, 1500.0


def _scope(*order: str) -> Window:
    return Window.partitionBy("scope").orderBy(*order)


def measured(route: DataFrame) -> DataFrame:
    """route (scope, pos, id, x, y, orders) with jump (to the one before), group (a new one after a jump over JUMP) and running orders."""
    placed = scan.with_previous(scan.ranged(route, ["scope"], ["pos"]), ["scope"], ["pos"], ["x", "y"])
    jump = F.coalesce(geo.distance(F.col("x"), F.col("y"), F.col("previous.x"), F.col("previous.y")), F.lit(0.0))
    out = table(placed.withColumn("jump", jump).drop("previous"), "jumps")
    return scan.with_running(out, ["scope"], ["pos"], {"group": (F.col("jump") > JUMP).cast("int"), "running": F.col("orders")}).drop(scan.PART)


def serpentine(points: DataFrame) -> DataFrame:
    """points (scope, id, x, y) with rank: rows by y, every other row backwards; about as many rows as the root of the number, 24 at most."""
    n = F.greatest(F.lit(1), F.least(F.lit(24), F.round(F.sqrt(F.count("*"))).cast("int")))
    sizes = points.groupBy("scope").agg(n.alias("rows"), F.min("y").alias("low"), F.greatest(F.max("y") - F.min("y"), F.lit(1e-9)).alias("height"))
    row = F.least(F.floor((F.col("y") - F.col("low")) / F.col("height") * F.col("rows")), F.col("rows") - 1)
    placed = points.join(sizes.withColumnRenamed("scope", "_scope"), F.col("scope").eqNullSafe(F.col("_scope"))).drop("_scope").withColumn("row", row).drop("rows", "low", "height").withColumn("along", F.when(F.col("row") % 2 == 1, -F.col("x")).otherwise(F.col("x")))
    order = ["row", "along", "id"]
    return scan.with_running(scan.ranged(placed, ["scope"], order), ["scope"], order, {"rank": F.lit(1)}).drop("along", scan.PART)


def reentries(route: DataFrame) -> DataFrame:
    """(scope, block, pos) where a route (scope, pos, block) comes back to a block that it had left."""
    placed = scan.with_previous(scan.ranged(route.select("scope", "pos", "block"), ["scope"], ["pos"]), ["scope"], ["pos"], ["block"])
    begins = table(placed.where(F.col("previous").isNull() | ~F.col("block").eqNullSafe(F.col("previous.block"))).select("scope", "block", "pos"), "begins")
    first = begins.groupBy(F.col("scope").alias("s"), F.col("block").alias("b")).agg(F.min("pos").alias("first"))
    return begins.join(first, F.col("scope").eqNullSafe(F.col("s")) & F.col("block").eqNullSafe(F.col("b"))).where("pos > first").select("scope", "block", "pos")


def link_types(links: DataFrame) -> DataFrame:
    """links (border, shared, distance) with `link`: touches, near, weak_bridge, or over_500m_jump."""
    return links.withColumn("link", F.when((F.col("border") <= 3) & (F.col("shared") >= 1), "touches").when((F.col("border") <= 18) & (F.col("distance") <= 90), "near").when(F.col("distance") <= JUMP, "weak_bridge").otherwise("over_500m_jump"))


def islands(route: DataFrame, people: int) -> DataFrame:
    """Groups (scope, group, orders, island): an island has fewer orders than the least even share; shares count without islands after."""
    groups = measured(route).groupBy("scope", "group").agg(F.sum("orders").alias("orders"))
    least = F.sum("orders").over(Window.partitionBy("scope")) / people * (1 - BAND)
    marked = groups.withColumn("island", F.col("orders") < least)
    return marked.withColumn("target", F.sum(F.when(~F.col("island"), F.col("orders"))).over(Window.partitionBy("scope")) / people)


def _nearest(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
    xy = pdf[["x", "y"]].to_numpy(float)
    left = np.ones(len(pdf), bool)
    at = int(np.lexsort((pdf["id"], xy[:, 0], -xy[:, 1]))[0])
    order = []
    for _ in range(len(pdf)):
        order.append(at)
        left[at] = False
        if left.any():
            at = int(np.argmin(np.where(left, ((xy - xy[at]) ** 2).sum(1), np.inf)))
    return pdf.iloc[order].assign(pos=range(1, len(order) + 1))


def greedy(points: DataFrame) -> DataFrame:
    """points (scope, id, x, y, orders) with pos: from the north-west corner always to the nearest left, by id among equals."""
    schema = T.StructType([*points.schema.fields, T.StructField("pos", T.LongType())])
    return points.groupBy("scope").applyInPandas(lambda pdf: _nearest(pdf)[schema.fieldNames()], schema)


def bounds(target: float) -> tuple[int, int]:
    """Whole orders that count as even."""
    return math.floor(target * (1 - BAND)), math.ceil(target * (1 + BAND))


def _best_ends(n: int, people: int, cost: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of the first `end` items in k parts, and where the last of these parts begins. cost(end) gives the cost of
    items begin .. end - 1 as one part for every begin (infinite: not allowed); it is worked out once for all k."""
    best, came = np.full((people + 1, n + 1), np.inf), np.zeros((people + 1, n + 1), np.int64)
    best[0, 0] = 0.0
    for end in range(1, n + 1):
        total = best[:people, :end] + cost(end)
        begin = total.argmin(1)
        best[1:, end], came[1:, end] = total[np.arange(people), begin], begin
    return best, came


def _parts(came: np.ndarray, people: int, end: int) -> list[int]:
    """Ends of the parts."""
    ends = []
    for k in range(people, 0, -1):
        ends.append(end)
        end = int(came[k, end])
    return ends[::-1]


def even_cuts(sums: np.ndarray, people: int) -> list[int]:
    """Ends of the parts of least summed squared deviation from an even share; no part is empty while there are items."""
    n, target = len(sums) - 1, float(sums[-1]) / people
    _, came = _best_ends(n, min(people, n), lambda end: (sums[end] - sums[:end] - target) ** 2)
    return _parts(came, min(people, n), n)


def zone_cuts(sums: np.ndarray, jumps: np.ndarray, people: int, target: float) -> list[int]:
    """Ends of the parts of least cost in which no jump is over JUMP; what is behind the last end has no part.

    A part costs for its deviation, for what it is outside the bounds, and for its longest jump. jumps[i] leads to item i. If the whole
    cannot be cut into that many parts, as much of it as can be is, at least cost, in as few parts.
    """
    n, (low, high) = len(sums) - 1, bounds(target)
    people = min(people, n)

    def cost(end: int) -> np.ndarray:
        load = sums[end] - sums[:end]
        longest = np.append(np.maximum.accumulate(jumps[end - 1 : 0 : -1])[::-1], 0.0)  # of the jumps inside begin .. end - 1
        out = np.maximum(0.0, low - load) + np.maximum(0.0, load - high)
        return np.where(longest > JUMP, np.inf, DEVIATION * (load - target) ** 2 + OVER_SQUARED * out**2 + OVER * out + FAR * longest)

    best, came = _best_ends(n, people, cost)
    if people and not np.isfinite(best[people, n]):
        n = int(np.flatnonzero(np.isfinite(best[1:]).any(0)).max())
        people = 1 + int(np.argmin(best[1:, n]))
    return _parts(came, people, n)


def jump_cost(metres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(metres))
    for least, base, slope in JUMP_COST:
        out = np.where(metres > least, base + (metres - least) * slope, out)
    return out


def bounded_cuts(sums: np.ndarray, jumps: np.ndarray, people: int) -> list[int]:
    """Ends of exactly `people` parts within the bounds at least cost: deviation, jumps inside, less a reward for jumps between
    parts. Without such parts, they are chosen one after another."""
    n, target = len(sums) - 1, float(sums[-1]) / people
    low, high = bounds(target)
    lone = jump_cost(jumps)
    inside = np.cumsum(lone)
    after = np.append(lone[1:], 0.0)

    def cost(end: int) -> np.ndarray:
        load = sums[end] - sums[:end]
        made = OFF * np.abs(load - target) + INSIDE * (inside[end - 1] - inside[:end]) - REWARD * min(after[end - 1], MOST_REWARD)
        return np.where((load >= low) & (load <= high), made, np.inf)

    best, came = _best_ends(n, people, cost) if n else (np.full((people + 1, 1), np.inf), None)
    return _parts(came, people, n) if np.isfinite(best[people, n]) else _cuts_in_turn(sums, jumps, people)


def _cuts_in_turn(sums: np.ndarray, jumps: np.ndarray, people: int) -> list[int]:
    """Each part ends where it is nearest to its share among the ends that leave the others theirs, or else where all is least off."""
    n, target = len(sums) - 1, float(sums[-1]) / people
    low, high = bounds(target)
    ends, begin = [], 0
    for others in range(people - 1, 0, -1):
        end = np.arange(begin + 1, n + 1)
        load, rest = sums[end] - sums[begin], sums[-1] - sums[end]
        leaves = (others * low <= rest) & (rest <= others * high)
        stop = np.flatnonzero((load >= high) & leaves)
        seen = (load <= high + SLACK) & (np.arange(len(end)) <= (stop[0] if len(stop) else len(end)))
        end, load, rest, leaves = end[seen], load[seen], rest[seen], leaves[seen]
        jump = np.append(jumps, 0.0)[end] if len(end) else np.zeros(0)
        good = leaves & (load >= low) & (load <= high)
        cost = np.abs(load - target) - np.where(jump > JUMP, np.minimum(jump, LONG_JUMP) / BONUS_METRES, 0.0)
        off = np.abs(load - target) + OUT_WEIGHT * (np.maximum(0, low - load) + np.maximum(0, load - high)) + REST_WEIGHT * np.abs(rest - others * target)
        if good.any():
            begin = int(end[good][np.argmin(cost[good])])
        else:
            begin = int(end[np.argmin(off)]) if len(end) else n
        ends.append(begin)
    return [*ends, n]


def _split(route: DataFrame, cuts: Callable[[np.ndarray, np.ndarray], list[int]]) -> DataFrame:
    schema = T.StructType([*route.schema.fields, T.StructField("person", T.LongType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        sums = np.concatenate([[0.0], np.cumsum(pdf["orders"].to_numpy(float))])
        jumps = np.hypot(pdf["x"].diff().fillna(0.0), pdf["y"].diff().fillna(0.0)).to_numpy()
        ends = cuts(sums, jumps)
        person = pd.Series(np.searchsorted(ends, np.arange(len(pdf)), "right") + 1, dtype="Int64")
        return pdf.assign(person=person.mask(np.arange(len(pdf)) >= (ends[-1] if ends else 0)))[schema.fieldNames()]

    return route.groupBy("scope").applyInPandas(one, schema)


def split(route: DataFrame, people: int) -> DataFrame:
    """route (scope, pos, id, x, y, orders) with person: stretches of the route without jumps over JUMP (`zone_cuts`); null for what is left over."""
    return _split(route, lambda sums, jumps: zone_cuts(sums, jumps, people, float(sums[-1]) / people))


def split_bounded(route: DataFrame, people: int) -> DataFrame:
    """route with person, all of it, within hard bounds where that can be (`bounded_cuts`)."""
    return _split(route, lambda sums, jumps: bounded_cuts(sums, jumps, people))


def split_even(route: DataFrame, people: int) -> DataFrame:
    """route with person, all of it, in the most even parts (`even_cuts`)."""
    return _split(route, lambda sums, jumps: even_cuts(sums, people))


def residual_components(blocks: DataFrame) -> DataFrame:
    """(scope, component, members, orders, nearest, reason) of blocks (scope, component, id, x, y, orders); reason is null for
    components that are routed. A scope's main component is the one of most orders (the least of equals). nearest is the distance of
    the nearest two blocks of a component and the main one, null beyond MIDDLING_METRES: they meet in grid cells."""
    sums = blocks.groupBy("scope", "component").agg(F.count("*").alias("members"), F.sum("orders").alias("orders"))
    first = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("orders"), "component")) == 1
    ranked = sums.withColumn("main", first)
    placed = blocks.join(ranked.select("scope", "component", "main"), ["scope", "component"])
    cell = lambda c: F.floor(F.col(c) / MIDDLING_METRES)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    main = placed.where("main").select("scope", F.col("x").alias("mx"), F.col("y").alias("my"), F.explode(F.transform(around, lambda i: cell("x") + i)).alias("gx"), "y").select("*", F.explode(F.transform(around, lambda i: cell("y") + i)).alias("gy")).drop("y")
    rest = placed.where("not main").select("scope", "component", "x", "y", cell("x").alias("gx"), cell("y").alias("gy"))
    metres = geo.distance(F.col("x"), F.col("y"), F.col("mx"), F.col("my"))
    near = rest.join(main, ["scope", "gx", "gy"]).withColumn("nearest", metres).where(F.col("nearest") <= MIDDLING_METRES).groupBy("scope", "component").agg(F.min("nearest").alias("nearest"))
    far = F.coalesce("nearest", F.lit(float("inf")))
    reason = (
        F.when(F.col("main"), None)
        .when((F.col("members") == 1) & (F.col("orders") <= SMALL_ORDERS), "small_isolated_block")
        .when((F.col("orders") <= MIDDLING_ORDERS) & (far > MIDDLING_METRES), "medium_far_component")
        .when((F.col("orders") <= SMALL_ORDERS) & (far > SMALL_METRES), "small_far_island_component")
    )
    return ranked.join(near, ["scope", "component"], "left").withColumn("reason", reason).select("scope", "component", "members", "orders", "nearest", "reason")


def _around(c: str, cell: float, reach: int) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda i: F.floor(F.col(c) / cell) + i))


def component_distances(blocks: DataFrame, reach: float = JUMP) -> DataFrame:
    """(scope, a, b, distance) of a scope's components a < b whose nearest two blocks are at most `reach` apart. blocks
    (scope, component, id, x, y) meet in grid cells of that size; of a cell's pairs only the nearest of each two components is shuffled."""
    own = blocks.select("scope", F.col("component").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / reach).alias("gx"), F.floor(F.col("y") / reach).alias("gy"))
    looks = blocks.select("scope", F.col("component").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    looks = looks.select("*", _around("ax", reach, 1).alias("gx")).select("*", _around("ay", reach, 1).alias("gy"))
    met = looks.join(own, ["scope", "gx", "gy"]).where("a < b").withColumn("distance", geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return met.where(F.col("distance") <= reach).groupBy("scope", "a", "b").agg(F.min("distance").alias("distance"))


def jump_clusters(blocks: DataFrame, reach: float = JUMP) -> DataFrame:
    """(scope, component, cluster) of all components: those that steps of `reach` at most join, with the least of them as the cluster.

    All blocks of a cell of side reach / sqrt(2) are within reach, so their components join the least of the cell's, and cells join
    by their outermost blocks; both are linear. Only blocks of near cells that this leaves in different clusters are compared one by one.
    """
    side = reach / math.sqrt(2) * (1 - 1e-9)
    placed = blocks.select("scope", F.struct("scope", "component").alias("node"), "x", "y", F.floor(F.col("x") / side).alias("gx"), F.floor(F.col("y") / side).alias("gy"))
    corners = [f(F.struct(F.col("x") * u + F.col("y") * v, "x", "y")) for u, v in ((1, 0), (0, 1), (1, 1), (1, -1)) for f in (F.min, F.max)]
    cells = table(placed.groupBy("scope", "gx", "gy").agg(F.min("node").alias("first"), F.array_distinct(F.transform(F.array(*corners), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))).alias("outer")), "cells")
    inside = placed.join(cells.select("scope", "gx", "gy", "first"), ["scope", "gx", "gy"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()

    def near(of: DataFrame) -> DataFrame:
        """Pairs of rows (scope, gx, gy, and others) of different cells at most two apart, as l and r."""
        looks = of.select(F.struct("*").alias("l"), "scope", _around("gx", 1.0, 2).alias("gx"), "gy").select("l", "scope", "gx", _around("gy", 1.0, 2).alias("gy"))
        return looks.join(of.select(F.struct("*").alias("r"), "scope", "gx", "gy"), ["scope", "gx", "gy"]).where("l.gx < r.gx or l.gx = r.gx and l.gy < r.gy")

    apart = lambda p, q: geo.distance(p["x"], p["y"], q["x"], q["y"])
    met = near(cells).where(F.exists("l.outer", lambda p: F.exists("r.outer", lambda q: apart(p, q) <= reach)))
    edges = inside.unionByName(met.select(F.col("l.first").alias("a"), F.col("r.first").alias("b")))
    known = table(connected_components(edges, "a", "b"), "joined")
    at = cells.join(known.select(F.col("node").alias("first"), "component"), "first", "left").select("scope", "gx", "gy", F.coalesce("component", "first").alias("cluster"))
    # All of a cell is in one cluster by now, so what is left to compare are cells.
    open_cells = near(at).where("l.cluster <> r.cluster").select("scope", F.col("l.cluster").alias("a"), F.col("r.cluster").alias("b"), *(F.col(f"{s}.{c}").alias(s + c) for s in "lr" for c in ("gx", "gy")))
    of_cell = lambda s: placed.select("scope", F.col("gx").alias(s + "gx"), F.col("gy").alias(s + "gy"), F.struct("x", "y").alias(s))
    late = open_cells.join(of_cell("l"), ["scope", "lgx", "lgy"]).join(of_cell("r"), ["scope", "rgx", "rgy"]).where(apart(F.col("l"), F.col("r")) <= reach).select("a", "b").distinct()
    last = connected_components(late, "a", "b").select(F.col("node").alias("cluster"), F.col("component").alias("least"))
    named = blocks.select(F.struct("scope", "component").alias("node")).distinct().join(known, "node", "left").withColumn("cluster", F.coalesce("component", "node")).drop("component")
    return named.join(last, "cluster", "left").select("node.scope", "node.component", F.coalesce("least", "cluster")["component"].alias("cluster"))


def admissible(links: DataFrame) -> DataFrame:
    """(scope, a, b) of the links (scope, a, b, border, shared, distance) that a route may follow: the best of each pair if it touches or
    is near. Links of other kinds are blocked; their blocks are reached by a jump, if at all."""
    typed = link_types(links.withColumns({"p": F.least("a", "b"), "q": F.greatest("a", "b")}).where("p <> q"))
    order = F.struct(F.when(F.col("link") == "touches", 0).when(F.col("link") == "near", 1).otherwise(2).alias("kind"), F.col("border"), -F.col("shared"), F.col("distance"))
    return typed.groupBy("scope", F.col("p").alias("a"), F.col("q").alias("b")).agg(F.min(order).alias("best")).where("best.kind < 2").select("scope", "a", "b")


def _first(keys: tuple[np.ndarray, ...]) -> int:
    """Where the least row is; the first key counts most."""
    return int(np.lexsort(keys[::-1])[0])


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """One cluster's blocks with pos. From the north-west component to the component nearest to where the last one ended; in each, from
    block to block by links while there is one, else by a jump."""
    pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
    xy, rank, ids = pdf[["x", "y"]].to_numpy(float), pdf["rank"].to_numpy(), pdf["id"].to_numpy()
    place = {b: i for i, b in enumerate(ids.tolist())}
    links = [[place[b] for b in n if b in place] if n is not None else [] for n in pdf["neighbours"]]
    share = np.maximum(pdf["orders"].to_numpy(float), 1.0)
    members = {c: g.to_numpy() for c, g in pdf.groupby("component", sort=True).apply(lambda g: g.index, include_groups=False).items()}
    middle = {c: (xy[m] * share[m, None]).sum(0) / share[m].sum() for c, m in members.items()}
    order: list[int] = []
    at = None
    while members:
        names = list(members)
        heart = np.array([middle[c] for c in names])
        corner = lambda p: np.abs(p[:, 0] - p[:, 0].min()) + np.abs(p[:, 1].max() - p[:, 1])
        far = lambda p: np.hypot(*(p - at).T)  # noqa: E731, B023
        own = members.pop(names[int(np.argmin(corner(heart) if at is None else far(heart)))])
        now = int(own[_first((corner(xy[own]) if at is None else far(xy[own]), rank[own], ids[own]))])
        left = np.zeros(len(pdf), bool)
        left[own] = True
        while True:
            order.append(now)
            left[now] = False
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            linked = np.array([j for j in links[now] if left[j]], int)
            near = rest[np.hypot(*(xy[rest] - xy[now]).T) <= JUMP] if not len(linked) else linked
            pick = near if len(near) else rest
            metres, steps = np.hypot(*(xy[pick] - xy[now]).T), np.abs(rank[pick] - rank[now])
            now = int(pick[_first((rank[pick] < rank[now], *((steps, metres) if len(linked) else (metres, steps)), ids[pick]))])
        at = xy[now]
    return pdf.iloc[order].assign(pos=range(1, len(order) + 1))


def block_route(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """blocks (scope, cluster, component, id, x, y, orders) with rank (serpentine from the north in its component) and pos in its
    cluster's route. links (scope, a, b) are those that `admissible` gives. A route goes on to a linked block that is not yet on it: first
    those ahead in rank, then those nearest in rank, in metres and by id. Without one it jumps to the nearest block ahead, within JUMP if there
    is any, then to others. A cluster is one task's work; a scope's clusters are spread."""
    keys = ["scope", "cluster", "component"]
    south = blocks.select(F.struct(*keys).alias("scope"), "id", "x", (-F.col("y")).alias("y"))
    ranked = blocks.join(serpentine(south).select("scope.*", "id", "rank"), [*keys, "id"])
    ends = links.unionByName(links.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("scope", F.col("a").alias("id")).agg(F.collect_set("b").alias("neighbours"))
    joined = ranked.join(ends, ["scope", "id"], "left")
    schema = T.StructType([*ranked.schema.fields, T.StructField("pos", T.LongType())])
    return joined.groupBy("scope", "cluster").applyInPandas(lambda pdf: _walk(pdf)[schema.fieldNames()], schema)


def along_axis(records: DataFrame, way: DataFrame) -> DataFrame:
    """records (scope, block, id, x, y) with pos in their block: by place along the line from the block before to the block after on the
    way (scope, block, pos, x, y), then by id. At an end of the way the block's own place stands in for the missing one; a way of one
    block, or of blocks at one place, is followed to the south-east."""
    w = _scope("pos")
    end = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    axes = way.select("scope", "block", end("x").alias("ax"), end("y").alias("ay"))
    still = F.abs("ax") + F.abs("ay") < 1e-7
    along = F.col("x") * F.when(still, 1.0).otherwise(F.col("ax")) + F.col("y") * F.when(still, -1.0).otherwise(F.col("ay"))
    placed = records.join(axes, ["scope", "block"]).withColumn("along", along)
    return placed.withColumn("pos", F.row_number().over(Window.partitionBy("scope", "block").orderBy("along", "id"))).drop("ax", "ay", "along")


def quality(assigned: DataFrame, people: int) -> DataFrame:
    """Per scope: parts outside the band, jumps inside parts, people without work. assigned (scope, pos, x, y, orders, person)."""
    w = Window.partitionBy("scope", "person").orderBy("pos")
    jump = geo.distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w))
    parts = assigned.where("person is not null").withColumn("jump", jump).groupBy("scope", "person").agg(F.sum("orders").alias("orders"), F.count_if(F.col("jump") > JUMP).alias("jumps"))
    target = F.sum("orders").over(Window.partitionBy("scope")) / people
    return parts.withColumn("outside", F.abs(F.col("orders") - target) > BAND * target).groupBy("scope").agg(F.count_if("outside").alias("outside"), F.sum("jumps").alias("jumps"), (F.lit(people) - F.count("*")).alias("idle"))


def _shares(orders: np.ndarray, units: np.ndarray, people: int) -> np.ndarray:
    """People of each cluster at least cost: at least one, at most its units; a table of the best cost for each number of people."""
    target = orders.sum() / people
    best, came = np.full(people + 1, np.inf), np.zeros((len(orders), people + 1), np.int64)
    best[0] = 0.0
    for i, (o, most) in enumerate(zip(orders, np.clip(units, 1, people))):
        k = np.arange(1, most + 1)
        off = np.abs(o / k - target)
        over = np.maximum(0.0, off - BAND * target)
        cost = k * (OVER_SQUARED * over**2 + OVER * over + DEVIATION * off**2)
        now = np.full(people + 1, np.inf)
        for n in range(1, people + 1):
            take = k[k <= n]
            total = best[n - take] + cost[: len(take)]
            j = int(np.argmin(total))
            now[n], came[i, n] = total[j], take[j]
        best = now
    left = int(np.flatnonzero(np.isfinite(best)).max(initial=0))
    out = np.zeros(len(orders), np.int64)
    if not np.isfinite(best[left]) or not left:
        return out
    for i in range(len(orders) - 1, -1, -1):
        out[i] = came[i, left]
        left -= out[i]
    return out


def allocate(clusters: DataFrame, people: int) -> DataFrame:
    """clusters (scope, cluster, orders, units) with people: all of a scope's people, or as many as the clusters' units take.
    A scope with more clusters than people gets none, as nothing can be decided there."""
    schema = T.StructType([*clusters.schema.fields, T.StructField("people", T.LongType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster", kind="stable").reset_index(drop=True)
        return pdf.assign(people=_shares(pdf["orders"].to_numpy(float), pdf["units"].to_numpy(int), people))[schema.fieldNames()]

    return clusters.groupBy("scope").applyInPandas(one, schema)


def units(records: DataFrame, target: float, low: float, high: float) -> DataFrame:
    """records (scope, block, pos, orders) with unit: a block is one unit, or, with more than `high` orders, parts in order of
    about `target`: a part of `low` or more ends where the next record would pass `high` or lead away from the target."""
    schema = T.StructType([*records.schema.fields, T.StructField("unit", T.LongType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        parts, part, load, some = [], 0, 0.0, False
        whole = pdf["orders"].sum() <= high
        for o in pdf["orders"].to_numpy(float):
            if some and not whole and load >= low and (load + o > high or abs(load - target) <= abs(load + o - target)):
                part, load = part + 1, 0.0
            load, some = load + o, True
            parts.append(part)
        return pdf.assign(unit=parts)[schema.fieldNames()]

    return records.groupBy("scope", "block").applyInPandas(one, schema)
