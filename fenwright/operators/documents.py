"""Rule documents as tables: what rules look up, how documents are built, edited and read, and when they are learnt.

Rules: owner, kind (token, contiguous, unordered_parts, exact_normalized), value, status, own, override, cross (none, soft,
hard), dominant. Origins: owner, kind, value, source, status and what else their maker knows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenwright.functions import text as X

# States of rules out of use and of records in use, old names of kinds, what a learnt state decides.
OUT_OF_USE = ("inactive", "blocked_error", "disabled", "retired")
SCOPED_IN_USE = ("active", "enabled", "확정", "정상")
KINDS = {"token": ("token", "single", "단일키워드"), "combo": ("unordered_parts", "unordered", "비연속조합"), "sentence": ("exact_normalized", "exact", "sentence", "반복문장")}
DECISIONS = {("active", "exact_normalized"): ("auto_error", "exact"), ("active", "ordered_distinct_tokens"): ("auto_error", "phrase"), ("ambiguous", "exact_normalized"): ("review_lock", "review"), ("ambiguous", "ordered_distinct_tokens"): ("audit_only", "audit")}
DOMINANT_WORDS, DOMINANT_SUPPORT = 3, 10

KEY = ["owner", "kind", "value"]


def state(c: Column, absent: str = "") -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(absent))))


def in_use(rules: DataFrame) -> DataFrame:
    """Rules that count; a rule without a state does. One without owner or value stops the job."""
    blank = (F.trim(F.coalesce("owner", F.lit(""))) == "") | (F.trim(F.coalesce("value", F.lit(""))) == "")
    checked = F.when(blank, F.raise_error(F.lit("a rule in use has no owner or no value")).cast("string")).otherwise(F.trim("value"))
    return rules.where(~state(F.col("status"), "active").isin(*OUT_OF_USE)).withColumn("value", checked)


def keyed(rules: DataFrame) -> DataFrame:
    """rules with kind, key and key2 as `rules.owners` takes them: values in normal form, the two parts of a combination
    apart. A phrase of one word is a token. What leaves no word is gone."""
    words = lambda c: F.array_join(X.tokens(X.normal(c)), " ")
    parts = F.split("value", r"\+")
    named = F.when(F.col("kind").isin(*KINDS["combo"]), "combo").when(F.col("kind").isin(*KINDS["sentence"]), "sentence")
    cut = rules.withColumn("_kind", named).withColumn("key", F.when(F.col("_kind") == "combo", words(F.get(parts, F.lit(0)))).when(F.col("_kind") == "sentence", X.normal(F.col("value"))).otherwise(words(F.col("value"))))
    cut = cut.withColumn("key2", F.when(F.col("_kind") == "combo", words(F.get(parts, F.lit(1)))))
    whole = (F.col("key") != "") & F.coalesce((F.size(parts) == 2) & (F.col("key2") != ""), F.lit(False)) | (F.col("key") != "") & (F.coalesce("_kind", F.lit("")) != "combo")
    return cut.where(whole).withColumn("kind", F.coalesce("_kind", F.when(F.col("key").contains(" "), "phrase").otherwise("token"))).drop("_kind")


def lookups(rules: DataFrame) -> DataFrame:
    """(lookup, owner, kind, key, key2): which rules are looked up as own, collision, hard, override and dominant. The sixth
    lookup, context, is what `rules.strict_contexts` leaves of the origins."""
    cross = state(F.col("cross"), "none")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    asked = {"own": flag("own"), "collision": cross.isin("hard", "soft"), "hard": cross == "hard", "override": flag("override"), "dominant": flag("dominant")}
    names = F.array_compact(F.array(*[F.when(on, name) for name, on in asked.items()]))
    return keyed(in_use(rules)).select(F.explode(names).alias("lookup"), "owner", "kind", "key", "key2").distinct()


def error_rules(exact: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, conflicts) of learnt signatures (owner, signature, status, ...) and phrases (owner, phrase, status, ...).

    Rules have KEY, rule_id, status, decision, strength and their origins, as JSON, in order: what was known of each, with
    its raw text. Equal rules with unequal states are conflicts, and no rules.
    """
    from fenwright.operators import learn

    def of(rows: DataFrame, raw: str, kind: str) -> DataFrame:
        known = [c for c in rows.columns if c not in ("owner", raw, "status")]
        origin = F.to_json(F.struct(F.col(raw).alias("raw_pattern"), state(F.col("status")).alias("status"), *known))
        return rows.select("owner", F.lit(kind).alias("kind"), X.normal(F.col(raw), drop_marks=False).alias("value"), state(F.col("status")).alias("status"), origin.alias("origin"))

    items = of(exact, "signature", "exact_normalized").unionByName(of(phrases, "phrase", "ordered_distinct_tokens"))
    made = items.groupBy(*KEY).agg(F.min("status").alias("status"), F.count_distinct("status").alias("states"), F.array_sort(F.collect_list("origin")).alias("origins"))
    decided = F.map_from_arrays(F.array(*[F.lit(f"{s} {k}") for s, k in DECISIONS]), F.array(*[F.struct(F.lit(d).alias("decision"), F.lit(s).alias("strength")) for d, s in DECISIONS.values()]))
    made = made.withColumn("d", F.try_element_at(decided, F.concat_ws(" ", "status", "kind"))).select(*KEY, learn.rule_id("error", F.col("owner"), F.struct("kind", "value")).alias("rule_id"), "status", "d.decision", "d.strength", "states", "origins")
    good = (F.col("states") == 1) & F.col("decision").isNotNull() & (F.coalesce("owner", F.lit("")) != "") & (F.col("value") != "")
    return made.where(good).drop("states"), made.where(~good).select(*KEY, "status", "states", "origins")


def digest(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """(rows, digest): a digest of a table's rows that does not depend on their order, in one pass without sorting."""
    row = F.sha2(F.to_json(F.struct(*(columns or sorted(df.columns)))), 256)
    part = lambda i: F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(part(i)), F.lit(0)).cast("string") for i in range(4)]
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", *sums), 256).alias("digest"))


def summary(rules: DataFrame) -> DataFrame:
    """(decision, status, rules, origins) of error rules: how many of each, and how many origins they merge."""
    return rules.groupBy("decision", "status").agg(F.count("*").alias("rules"), F.sum(F.size("origins")).alias("origins"))


def catalogue(rules: DataFrame) -> DataFrame:
    """(owner, kind, role, values, many): what people read of a document, sorted; the role is that of the rule's state."""
    role = F.when(F.col("override"), "override").when(F.col("cross") == "hard", "hard").when(F.col("own"), "own").otherwise("other")
    return in_use(rules).withColumn("role", role).groupBy("owner", "kind", "role").agg(F.array_sort(F.collect_set("value")).alias("values"), F.count_distinct("value").alias("many"))


def truth(historical: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(truth, doubled): confirmed errors (order_number, owner, signature) of both sources; orders named twice, for which
    there is no truth to learn from, are told."""
    both = historical.select("order_number", "owner", "signature", F.lit(False).alias("current")).unionByName(approved.select("order_number", "owner", "signature", F.lit(True).alias("current")))
    times = F.count("*").over(Window.partitionBy("order_number"))
    counted = both.withColumn("times", times)
    return counted.where("times = 1").drop("times"), counted.where("times > 1").select("order_number", "times").distinct()


def population(historical: DataFrame, truth: DataFrame, negatives: DataFrame) -> DataFrame:
    """Rows (owner, signature, confirmed) to learn from: every historical order (order_number, owner, signature), of the
    current ones only those a person approved, and what was excluded as no error. Unlabelled current rows say nothing."""
    old = truth.where("not current").select("order_number").distinct().withColumn("confirmed", F.lit(True))
    rows = historical.join(old, "order_number", "left").select("owner", "signature", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
    new = truth.where("current").select("owner", "signature", F.lit(True).alias("confirmed"))
    return rows.unionByName(new).unionByName(negatives.select("owner", "signature", F.lit(False).alias("confirmed")))


def fingerprint(spark: SparkSession, paths: Sequence[str], versions: Sequence[str] = ()) -> str:
    """A digest of files' names, sizes and times, and of versions: equal as long as nothing changed. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    return digest(files.unionByName(spark.createDataFrame([(v, -1, -1) for v in versions], "path string, length long, at long"))).first()["digest"]


def baseline(spark: SparkSession, root: str, mark: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made for a fingerprint: read again where it stands complete, else made, written and read. A job that died
    while writing left no mark of success, and its table is written anew."""
    path = f"{root.rstrip('/')}/baseline-{mark}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def automatic(origins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, broken) of automatic origins (owner, pattern_type, pattern, status, source, ...): those with all of these,
    each once, without the source; the others are broken."""
    need = ["owner", "pattern_type", "pattern", "status"]
    filled = F.lit(True)
    for c in need:
        filled = filled & (F.trim(F.coalesce(c, F.lit(""))) != "")
    auto = origins.where("source = 'auto'").withColumn("_ok", filled & (F.count("*").over(Window.partitionBy(*need[:3])) == 1)).drop("source")
    return auto.where("_ok").drop("_ok"), auto.where("not _ok").drop("_ok")


def upsert_manual(origins: DataFrame, entries: DataFrame) -> DataFrame:
    """origins (KEY, source, status) with a manual one for each entry (KEY), in place of the manual one of that rule, if any.
    Entries given twice count once; the same entries again change nothing."""
    new = entries.select(*KEY).distinct()
    manual = F.coalesce(F.col("source") == "manual", F.lit(False))
    kept = origins.where(~manual).unionByName(origins.where(manual).join(new, KEY, "left_anti").select(*origins.columns))
    return kept.unionByName(new.withColumns({"source": F.lit("manual"), "status": F.lit("active")}), allowMissingColumns=True)


def without_priority(patterns: DataFrame, priority: DataFrame) -> DataFrame:
    """Patterns without those that only serve their owner and must not contradict others."""
    return patterns.join(priority.select(*KEY).distinct(), KEY, "left_anti").select(*patterns.columns)


def precise(patterns: DataFrame) -> DataFrame:
    """Patterns of conflict without single words, which say too little."""
    return patterns.where(~F.coalesce(F.col("kind").isin(*KINDS["token"]), F.lit(False)))


def active_patterns(records: DataFrame) -> DataFrame:
    """(KEY) of automatic records (KEY, status) in force."""
    return records.where(state(F.col("status")) == "active").select(*KEY).distinct()


def scoped_patterns(records: DataFrame) -> DataFrame:
    """(KEY) of records that hold for one owner alone; one without a state does."""
    return records.where(state(F.col("status"), "active").isin(*SCOPED_IN_USE)).select(*KEY).distinct()


def dominant_patterns(records: DataFrame) -> DataFrame:
    """(KEY) of automatic records, proposed ones too, long and well supported, with neither foreign rows nor errors:
    they cast doubt on other owners' rows."""
    long = F.size(X.words(X.normal(F.col("value")))) >= DOMINANT_WORDS
    pure = (F.coalesce("foreign", F.lit(0)) == 0) & (F.coalesce("error_hits", F.lit(0)) == 0)
    return records.where(state(F.col("status")).isin("active", "proposed") & long & (F.coalesce("support", F.lit(0)) >= DOMINANT_SUPPORT) & pure).select(*KEY).distinct()


def reclassify(decided: DataFrame, reviewable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, errors) of rows decided anew (order_number, is_auto, is_candidate) after texts were masked: errors may
    come from any row, candidates only from rows that were up for review before, or are errors now."""
    errors = decided.where("is_auto")
    scope = reviewable.select("order_number").unionByName(errors.select("order_number")).distinct()
    return decided.where("is_candidate").join(scope, "order_number", "left_semi"), errors


def closed_review(candidates: DataFrame, approved: DataFrame, reviewed: tuple[str, str], current: tuple[str, str]) -> DataFrame:
    """Candidates (order_number, ...) of an earlier upload that now count as normal: those left over once a person approved
    at least one of them and an upload of another period has come. Otherwise none."""
    apart = reviewed[1] < current[0] or current[1] < reviewed[0]
    orders = approved.select("order_number").distinct()
    reviewed_at_all = apart and candidates.join(orders, "order_number", "left_semi").limit(1).count() > 0
    rest = candidates.join(orders, "order_number", "left_anti")
    return rest if reviewed_at_all else rest.limit(0)
