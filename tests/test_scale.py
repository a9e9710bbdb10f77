"""Work that must not grow faster than its input: each against brute force, with bounds set low."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from fenwright import catalog
from fenwright.functions import text
from fenwright.operators import grams, graph, learn, names, rules, spatial
from fenwright.operators.cut import cut


def told(name, tables):
    """Rows that DuckDB gives for a query's SQL over these tables (name to folder), sorted."""
    import duckdb

    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return sorted(map(tuple, con.execute(catalog.oracle_sql()[name]).fetchall()))


def held(spark, folder, **tables):
    """Tables as Parquet in a folder, as queries read them."""
    paths = {name: f"{folder}/{name}.parquet" for name in tables}
    for name, df in tables.items():
        df.write.parquet(paths[name])
    return paths


def test_barriers_are_met_where_edges_are(spark, monkeypatch):
    """Edges against walls in several passes, as all pairs say; no edge becomes a row for each wall."""
    rng = random.Random(3)
    segment = lambda long: (x := rng.uniform(-300, 300), y := rng.uniform(-300, 300), x + rng.uniform(-long, long), y + rng.uniform(-long, long))
    edges = [(n, *segment(90)) for n in range(300)] + [(300, 0.0, 0.0, 0.0, 0.0), (301, None, 1.0, 2.0, 3.0), (302, 5.0, 5.0, 9.0, 9.0)]
    walls = [segment(40) for _ in range(70)] + [(9.0, 9.0, 9.0, 20.0), (None, 1.0, 1.0, 1.0)]
    sound = np.array([w for w in walls if None not in w])
    expected = [e[0] for e in edges if None not in e and spatial.geo.crossed(np.repeat([e[1:]], len(sound), 0), sound).any()]
    table = spark.createDataFrame(edges, "edge int, ax double, ay double, bx double, by double")
    barriers = spark.createDataFrame(walls, "ax double, ay double, bx double, by double")
    pairs = table.alias("s").crossJoin(barriers.alias("o")).where(spatial.geo.cross(*(spatial.F.struct(*(f"{t}.{c}" for c in ("ax", "ay", "bx", "by"))) for t in "so"))).select("edge").distinct()
    assert sorted(r.edge for r in pairs.collect()) == expected and 302 in expected
    for most, cell in ((1 << 20, 80.0), (30, 25.0)):
        monkeypatch.setattr(spatial, "BARRIERS", most)
        found = spatial.meeting(table, barriers, cell)
        assert sorted(r.edge for r in found.collect()) == expected
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert spatial.crossing(table, barriers.limit(0)).count() == 0


def test_addresses_with_marks_behind_them(spark, tmp_path):
    """An address at the end of a sentence, or with a digit behind it, counts as the SQL counts it."""
    texts = ["Write to a@b.com. Then c@d.org", "x@y.co1 and z@w.net_", "a@b@c.com", "A@B.COM,b@c.de;c@d.e", "\u212Aa@b.com \u017F@s.com \u0131@b.com", "p.q@r.s-t.uk-", "no@one", "", None, "a@b.co\nc@d.co%", "..@..aa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    paths = held(spark, tmp_path, documents=docs)
    assert sorted(map(tuple, catalog.queries()["mask_email"](spark, str(tmp_path)).collect())) == told("mask_email", paths)


def test_snapshots_of_late_years(spark, tmp_path):
    """Years of five digits are written as the SQL writes them."""
    paths = held(spark, tmp_path, part=spark.range(1, 1_200_000, 1000).withColumnRenamed("id", "p_partkey").unionByName(spark.createDataFrame([(20,), (21,), (40,)], "p_partkey long")))
    assert sorted(map(tuple, catalog.queries()["snapshots_kept"](spark, str(tmp_path)).collect())) == told("snapshots_kept", paths)


def said(rng, many, words=9):
    """Texts of few words, some of them the same, some empty."""
    return ["", "a", *(" ".join(rng.choice(["aa", "bb", "c", "dd", "ee", "fff", "요금", "고객"]) for _ in range(rng.randrange(1, words))) for _ in range(many))]


def test_evidence_is_counted_by_digest(spark):
    """Texts of several owners, days and people; no sequence goes over the wire before it is known to count."""
    rng = random.Random(8)
    rows = [(n, rng.choice(["x", "y", None]), t, rng.randrange(3), rng.choice([1, 2, None]), rng.random() < 0.3) for n, t in enumerate(said(rng, 150))]
    seen = {}
    for _, owner, text, day, person, candidate in rows:
        w = text.split()
        for size in (2, 3, 4):
            for g in {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}:
                seen.setdefault((owner, g, size), []).append((day, person, candidate))
    total = {}
    for (_, g, _), found in seen.items():
        total[g] = total.get(g, 0) + len(found)
    expected = {(*k, len(v), len({d for d, _, _ in v}), len({p for _, p, _ in v if p is not None}), sum(c for *_, c in v), total[k[1]] - len(v)) for k, v in seen.items() if len(v) >= 2}
    found = learn.evidence(spark.createDataFrame(rows, "id long, owner string, normal string, date long, person long, candidate boolean"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert "LeftSemi" not in found._jdf.queryExecution().executedPlan().toString()


def test_frequent_patterns_are_counted_by_digest(spark):
    rng = random.Random(5)
    rows = [(n, rng.choice(["x", "y"]), t) for n, t in enumerate(said(rng, 200))]
    seen = {}
    for _, owner, text in rows:
        w = text.split()
        for k in {(owner, " ".join(w[i : i + size]), size) for size in (2, 3, 4) for i in range(len(w) - size + 1)}:
            seen[k] = seen.get(k, 0) + 1
    found = learn.frequent(spark.createDataFrame(rows, "id long, owner string, normal string"), 4)
    assert sorted(map(tuple, found.collect())) == sorted((*k, n) for k, n in seen.items() if n >= 4)


def test_nearest_by_growing_reach(spark):
    """The nearest points and the best distance between blocks, crowded and lonely ones, as all pairs say."""
    rng = random.Random(6)
    spots = [(rng.gauss(0, 20), rng.gauss(0, 20)) for _ in range(120)] + [(rng.uniform(-600, 600), rng.uniform(-600, 600)) for _ in range(60)] + [(5.0, 5.0)] * 5 + [(2000.0, 2000.0)]
    label = [9 if n == 185 else 8 if n >= 150 else n % 3 for n in range(len(spots))]
    points = spark.createDataFrame([(n, x, y) for n, (x, y) in enumerate(spots)], "id long, x double, y double")
    far = lambda a, b: float(np.hypot(spots[a][0] - spots[b][0], spots[a][1] - spots[b][1]))
    near = {a: sorted((far(a, b), b) for b in range(len(spots)) if b != a and far(a, b) <= 250)[:3] for a in range(len(spots))}
    got = spatial.nearest(points, 250.0, 3).select("node", "neighbour", "nth").collect()
    assert sorted(map(tuple, got)) == sorted((a, b, n + 1) for a, found in near.items() for n, (_, b) in enumerate(found))
    best = {}
    for a in range(len(spots)):
        for b in range(a):
            if label[a] != label[b] and far(a, b) <= 250:
                k = tuple(sorted((label[a], label[b])))
                best[k] = min(best.get(k, 1e9), far(a, b))
    blocks = spark.createDataFrame(list(enumerate(label)), "node long, block long")
    found = {(r.a, r.b): r.distance for r in spatial.between_blocks(points, blocks, 250.0).collect()}
    assert {k: round(v, 9) for k, v in found.items()} == {k: round(v, 9) for k, v in best.items()}


def test_contexts_are_looked_for_in_the_text(spark, monkeypatch):
    """Few keys or many, the same rows; few make no row of every sequence of words."""
    texts = spark.createDataFrame([(1, "a", "b c d e f"), (2, "x", "b c d e f"), (3, "a", "b c"), (4, "a", ""), (5, None, "e f d"), (6, "a", "b b c d")], "id int, own string, normal string")
    contexts = spark.createDataFrame([("x", "b c"), ("x", "e f"), ("x", "b"), ("y", "c d"), ("y", "d"), ("z", "b c d e f"), ("z", None), ("x", "d")], "owner string, key string")
    few = rules.context_conflict(texts, contexts)
    got = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(rules, "FEW_KEYS", 1)
    assert got == sorted(map(tuple, rules.context_conflict(texts, contexts).collect())) == [(1, "x"), (6, "x")]
    assert "array_intersect" in few._jdf.queryExecution().executedPlan().toString()


def test_templates_are_made_of_what_was_counted(spark):
    """What is asked of a template is not asked of each row that was counted."""
    rows = spark.createDataFrame([("o", "체납 금액 안내")] * 3 + [("o", "두달 체납"), ("o", "12"), ("p", "두달 체납")], "owner string, signature string")
    found = names.normal_templates(rows.groupBy("owner", "signature").agg(F.count("*").alias("total")), rows.where("owner = 'p'"))
    assert "count(" not in found._jdf.queryExecution().optimizedPlan().toString()  # once the template's condition stood below the counting
    assert sorted(map(tuple, found.collect())) == [("o", "기간값 체납"), ("o", "체납 금액값 안내")]


def test_masking_is_spread_over_the_cores(spark, tmp_path):
    """A table of one row group is not one task's masking; and counters say what the SQL says."""
    paths = held(spark, tmp_path, customer=spark.range(200).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name").coalesce(1))
    for name in ("mask_personal", "mask_payloads"):
        found = catalog.queries()[name](spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == 200
    for name in ("mask_personal", "mask_payloads", "mask_personal_counters"):
        assert sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()), key=str) == sorted(told(name, paths), key=str)


def test_components_without_all_pairs(spark):
    """As the pairs within reach say, for crowds, lone points, chains just within and just beyond reach; a crowd makes no pairs of its points."""
    rng = random.Random(5)
    for spread, n in ((400, 250), (4000, 250), (12000, 300)):
        rows = [(i, round(rng.uniform(-spread, spread), 2), round(rng.uniform(-spread, spread), 2)) for i in range(n)]
        rows += [(1000 + i, 20000.0 + 250.0 * i, 0.0) for i in range(4)] + [(2000 + i, 30000.0 + 250.01 * i, 7.0) for i in range(4)]
        rows += [(3000, 50000.0, 1.0), (3001, 50000.0, 1.0), (3002, None, 1.0), (3003, float("nan"), 1.0), (3004, float("inf"), 1.0), (3005, float("inf"), 1.0)]
        points = spark.createDataFrame(rows, "id long, x double, y double")
        expected = sorted(map(tuple, graph.connected_components(spatial.within(points.where("abs(x) < 1e9"), 250.0), "a", "b").collect()))
        assert sorted(map(tuple, spatial.components(points, 250.0).collect())) == expected
    # 40,000 points of one place have 800 million pairs.
    crowd = spark.range(40000).selectExpr("id", "id % 200 / 2 AS x", "floor(id / 200) / 2 AS y")
    assert [tuple(r) for r in spatial.components(crowd, 250.0).groupBy("component").count().collect()] == [(0, 40000)]


def test_all_sequences_are_counted_by_tasks_that_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grams, "LETTERS_A_TASK", 10)
    rows = [(1, "a b c d a b c", "en", "s", 13), (2, "A, b c!", "en", "s", 7), (3, None, None, "s", 0), (4, "x y", "de", "s", 3), (5, "", "de", "s", 0), (6, "가 나 다 " * 40, "ko", "s", 240)]
    paths = held(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    found = catalog.queries()["token_ngrams"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 27  # 263 letters
    assert sorted(map(tuple, found.collect())) == told("token_ngrams", paths)


def sequences(rows, shapes):
    """How many rows (owner, text) of an owner hold each sequence, and their weight."""
    seen = {}
    for owner, text, weight in rows:
        w = [t for t in text.split(" ")]
        for k in {(owner, " ".join(w[i + p] for p in s), len(s)) for s in shapes for i in range(len(w) - s[-1]) if all(w[i + p] for p in s)}:
            n, total = seen.get(k, (0, 0))
            seen[k] = n + 1, total + weight
    return seen


def test_sequences_are_counted_in_passes(spark, monkeypatch):
    """Many chunks, buckets and passes, several owners, none of them or of days: the rows of brute force; and no row of a shuffle is a sequence."""
    for k, v in (("CHUNK", 300), ("A_PASS", 200), ("A_BUCKET", 60), ("CHUNKS_A_TASK", 2)):
        monkeypatch.setattr(grams, k, v)
    rng = random.Random(12)
    rows = [(rng.choice(["x", "y", None]), t, rng.randrange(1, 4), rng.choice([None, 1, 2]), rng.choice([None, 1, 2]), rng.random() < 0.5) for t in [*said(rng, 250), "", " ".join(f"w{n}" for n in range(400))]]
    table = spark.createDataFrame(rows, "owner string, normal string, weight int, day int, person int, good boolean")
    shapes = [(0, 1), (0, 2), (0, 1, 3)]
    expected = {(*k, *v) for k, v in sequences([r[:3] for r in rows], shapes).items() if v[0] >= 2 and v[1] >= 5}
    found = grams.grouped(table, ["owner"], F.split("normal", " "), shapes, "g", {"n": ("n", None), "weight": ("weight", None)}, 2, 5)
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected) > 50
    days, people, good, every = {}, {}, {}, {}
    for owner, text, _, day, person, flag in rows:
        for k in sequences([(owner, text, 1)], [(0, 1)]):
            days.setdefault(k, set()).add(day), people.setdefault(k, set()).add(person)
            good[k], every[k[1]] = good.get(k, 0) + flag, every.get(k[1], 0) + 1
    measures = {"n": ("n", None), "days": ("different", "day"), "people": ("different", "person"), "good": ("where", "good"), "others": ("other", None)}
    got = grams.grouped(table, ["owner", "day", "person", "good"], F.split("normal", " "), [(0, 1)], "g", measures, 3)
    assert {tuple(r) for r in got.collect()} == {(*k, n, len(days[k] - {None}), len(people[k] - {None}), good[k], every[k[1]] - n) for k, (n, _) in sequences([(o, t, 1) for o, t, *_ in rows], [(0, 1)]).items() if n >= 3}


def test_what_was_shuffled_for_a_table_goes(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}
    before = files()
    table = cut(spark.range(1000).repartition(3, "id"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == 1000


def test_frequent_patterns_send_no_sequence(spark):
    """What a chunk tells a bucket of its sequences is one row."""
    rows = spark.createDataFrame([(n, "x", " ".join(f"w{(n * 7 + i) % 90}" for i in range(60))) for n in range(40)], "id long, owner string, normal string")
    status = lambda: sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before = status()
    assert learn.frequent(rows, 4).count() > 100
    assert status() - before < 500  # once one for each of thousands of sequences


def test_error_hits_are_looked_for_by_digest(spark, monkeypatch):
    """Patterns in several passes; sequences of error texts are not shuffled."""
    monkeypatch.setattr(grams, "PATTERNS", 20, raising=False)
    rng = random.Random(9)
    errors = [(rng.choice(["x", "y", None]), t) for t in said(rng, 80)]
    patterns = [(o, " ".join(w), n) for n, (o, w) in enumerate(dict.fromkeys((rng.choice(["x", "y", "z"]), tuple(rng.choice(["aa", "bb", "c", "dd", "요금"]) for _ in range(rng.randrange(1, 6)))) for _ in range(150)))]
    inside = lambda p, t: 2 <= len(p.split()) <= 4 and f" {p} " in f" {t} "
    found = learn.error_hits(spark.createDataFrame(patterns, "owner string, pattern string, n int"), spark.createDataFrame(errors, "owner string, normal string"))
    assert {tuple(r) for r in found.select("owner", "pattern", "n", "error_hits").collect()} == {(o, p, n, len({t for q, t in errors if q == o and inside(p, t)})) for o, p, n in patterns}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_phrases_are_matched_as_a_tree(spark, monkeypatch):
    """All phrases at once, in one pass or several, as each by itself; and no text meets phrases by a join."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    texts = [(rng.choice(["x", "y", None]), " ".join(word() for _ in range(rng.randint(0, 30))), rng.randint(0, 2), rng.randint(0, 1)) for _ in range(150)] + [("x", "ab " * 3 + "b" * 60 + " a ba", 1, 0)]
    phrases = sorted({(rng.choice(["x", "y", "z"]), " ".join(word() for _ in range(rng.randint(1, 4)))) for _ in range(500)})
    t, p = spark.createDataFrame(texts, "owner string, normal string, confirmed int, normal_count int"), spark.createDataFrame(phrases, "owner string, phrase string")
    pairs = t.join(p, "owner").select("owner", "phrase", "confirmed", "normal_count", text.words(F.col("normal")).alias("w")).where(text.holds_phrase(F.col("w"), F.col("phrase")))
    one = {(r.owner, r.phrase): (r.c, r.n) for r in pairs.groupBy("owner", "phrase").agg(F.sum("confirmed").alias("c"), F.sum("normal_count").alias("n")).collect()}
    assert len(one) > 200
    for k, most in (("PHRASES", 1 << 18), ("PHRASES", 70)):
        monkeypatch.setattr(learn, k, most, raising=False)
        found = learn.confirm(p, t)
        assert {(r.owner, r.phrase): (r.confirmed, r.normal, r.status) for r in found.collect()} == {k: (*one.get(k, (0, 0)), "audit" if one.get(k, (0, 0))[1] else "active") for k in phrases}
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_best_reference_need_not_be_among_the_nearest(spark, monkeypatch):
    """The best likeness is that of all references, however few are compared first."""
    rng = random.Random(4)
    made = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    refs, sigs = [made(rng.randint(1, 40)) for _ in range(60)], [made(rng.randint(0, 60)) for _ in range(80)]
    expected = {s: max(text._likeness(s, r) for r in refs) for s in sigs}
    for letters in (rules.REFERENCE_LETTERS, 300):
        monkeypatch.setattr(rules, "REFERENCE_LETTERS", letters)
        for first in (1, 5):
            found = rules.closest(spark.createDataFrame([("o", s) for s in sigs], "owner string, sig string"), spark.createDataFrame([("o", r) for r in refs], "owner string, sig string"), first)
            got = {r.sig: r.score for r in found.collect()}
            assert got.keys() == expected.keys() and all(abs(got[s] - v) < 1e-9 for s, v in expected.items())
