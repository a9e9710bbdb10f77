"""Jump clusters, the block route and the order inside blocks, against brute force and on small maps."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fenwright.operators import route

BLOCKS = "scope string, component long, id long, x double, y double, orders long"


def scattered(seed: int, n: int, width: float, components: int):
    """Points of a few dense places, some far apart, each point with a component of its place."""
    r = random.Random(seed)
    places = [(r.uniform(0, width), r.uniform(0, width)) for _ in range(components)]
    return [("s", c, i, places[c][0] + r.gauss(0, 60), places[c][1] + r.gauss(0, 60), 1) for i in range(n) for c in [r.randrange(components)]]


def clusters_of(rows, reach):
    parent = {c: c for _, c, *_ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for _, a, _, ax, ay, _ in rows:
        for _, b, _, bx, by, _ in rows:
            if math.hypot(ax - bx, ay - by) <= reach and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in parent}


@pytest.mark.parametrize(("seed", "n", "width", "components"), [(1, 300, 6000, 30), (2, 120, 3000, 60), (3, 40, 20_000, 12)])
def test_jump_clusters_against_all_pairs(spark, seed, n, width, components):
    rows = scattered(seed, n, width, components)
    blocks = spark.createDataFrame([*rows, *(("other", c, i, x, y, o) for _, c, i, x, y, o in rows[:20])], BLOCKS)
    got = {(r.scope, r.component): r.cluster for r in route.jump_clusters(blocks).collect()}
    assert {c: k for (s, c), k in got.items() if s == "s"} == clusters_of(rows, route.JUMP)
    assert {c: k for (s, c), k in got.items() if s == "other"} == clusters_of(rows[:20], route.JUMP)
    pairs = {}
    for _, a, _, ax, ay, _ in rows:
        for _, b, _, bx, by, _ in rows:
            if a < b and (d := math.hypot(ax - bx, ay - by)) <= route.JUMP:
                pairs[a, b] = min(d, pairs.get((a, b), d))
    near = {(r.a, r.b): r.distance for r in route.component_distances(blocks.where("scope = 's'")).collect()}
    assert near.keys() == pairs.keys() and all(abs(near[k] - pairs[k]) < 1e-6 for k in pairs)


def test_jump_clusters_at_the_bound(spark):
    """Components of single blocks in a row: steps of 500 m join, longer ones do not; nothing to join is no fault."""
    row = [0.0, 500.0, 1000.0, 1500.001, 2000.0, 2600.0]
    blocks = spark.createDataFrame([("s", i, i, x, -7.0, 1) for i, x in enumerate(row)], BLOCKS)
    assert {r.component: r.cluster for r in route.jump_clusters(blocks).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert {r.component: r.cluster for r in route.jump_clusters(blocks.where("id in (0, 5)")).collect()} == {0: 0, 5: 5}
    assert route.jump_clusters(blocks.limit(0)).count() == 0


def grid(columns, rows, step, component=1):
    """Blocks in a grid, ids from the north-west by row."""
    return [("s", 1, component, 10 * j + i, i * step, -j * step, 2) for j in range(rows) for i in range(columns)]


def ways(spark, blocks, links):
    schema = "scope string, cluster long, component long, id long, x double, y double, orders long"
    found = route.block_route(spark.createDataFrame(blocks, schema), spark.createDataFrame(links, "scope string, a long, b long"))
    return [r.id for r in found.orderBy("scope", "cluster", "pos").collect()]


def test_route_turns_at_the_end_of_each_row(spark):
    blocks = grid(3, 3, 100.0)
    links = [("s", a, b) for *_, a, ax, ay, _ in blocks for *_, b, bx, by, _ in blocks if a < b and abs(ax - bx) + abs(ay - by) == 100]
    assert ways(spark, blocks, links) == [0, 1, 2, 12, 11, 10, 20, 21, 22]
    # A wall between the first two rows but at their west end: the route goes where links lead, then back.
    walled = [x for x in links if (x[1], x[2]) not in ((1, 11), (2, 12))]
    assert ways(spark, blocks, walled) == [0, 1, 2, 12, 11, 10, 20, 21, 22]  # from 2 no link is left: it jumps to the nearest ahead
    assert ways(spark, blocks, []) == [0, 1, 2, 12, 11, 10, 20, 21, 22]


def test_route_prefers_links_to_nearer_blocks_without(spark):
    # 1 is linked to the far 3, not to the near 2.
    blocks = [("s", 1, 1, 1, 0.0, 0.0, 1), ("s", 1, 1, 2, 50.0, 0.0, 1), ("s", 1, 1, 3, 400.0, 0.0, 1), ("s", 1, 1, 4, 450.0, 0.0, 1)]
    assert ways(spark, blocks, [("s", 1, 3)]) == [1, 3, 4, 2]
    assert ways(spark, blocks, []) == [1, 2, 3, 4]
    # Beyond the reach of a jump the nearest ahead is taken, else the nearest behind.
    far = [("s", 1, 1, 1, 0.0, 0.0, 1), ("s", 1, 1, 2, 5000.0, 0.0, 1), ("s", 1, 1, 3, 9000.0, 0.0, 1)]
    assert ways(spark, far, []) == [1, 2, 3]


def test_route_goes_on_to_the_nearest_component(spark):
    blocks = grid(2, 1, 100.0) + [("s", 1, 2, 50, 5000.0, 0.0, 1), ("s", 1, 3, 60, 600.0, 0.0, 1), ("s", 1, 3, 61, 700.0, 0.0, 1), ("s", 2, 9, 70, 0.0, 0.0, 1)]
    assert ways(spark, blocks, []) == [0, 1, 60, 61, 50, 70]


def test_best_link_of_a_pair_decides(spark):
    links = [("s", 1, 2, 30.0, 0.0, 80.0), ("s", 2, 1, 2.0, 5.0, 300.0), ("s", 1, 3, 10.0, 0.0, 95.0), ("s", 4, 3, 18.0, 0.0, 90.0), ("s", 5, 5, 0.0, 9.0, 0.0), ("t", 1, 3, 3.0, 0.5, 91.0)]
    found = route.admissible(spark.createDataFrame(links, "scope string, a long, b long, border double, shared double, distance double"))
    assert sorted((r.scope, r.a, r.b) for r in found.collect()) == [("s", 1, 2), ("s", 3, 4)]


def test_records_follow_the_way(spark):
    way = spark.createDataFrame([("s", "a", 1, 0.0, 0.0), ("s", "b", 2, 100.0, 0.0), ("s", "c", 3, 100.0, 100.0), ("t", "a", 1, 5.0, 5.0)], "scope string, block string, pos int, x double, y double")
    records = [("s", "a", i, float(x), 0.0) for i, x in ((1, 9), (2, -9), (3, 9))] + [("s", "b", 4, 100.0, 9.0), ("s", "b", 5, 91.0, 0.0), ("s", "c", 6, 0.0, 105.0), ("s", "c", 7, 0.0, 95.0), ("t", "a", 8, 0.0, 1.0), ("t", "a", 9, 0.0, 2.0)]
    found = route.along_axis(spark.createDataFrame(records, "scope string, block string, id long, x double, y double"), way)
    assert [r.id for r in found.orderBy("scope", "block", "pos").collect()] == [2, 1, 3, 5, 4, 7, 6, 9, 8]


def test_serpentine_reads_from_the_north(spark):
    blocks = spark.createDataFrame([("s", 1, *b[2:]) for b in grid(3, 3, 10.0)], "scope string, cluster long, component long, id long, x double, y double, orders long")
    ranks = {r.id: r["rank"] for r in route.block_route(blocks, spark.createDataFrame([], "scope string, a long, b long")).collect()}
    assert sorted(ranks, key=ranks.get) == [0, 1, 2, 12, 11, 10, 20, 21, 22]
