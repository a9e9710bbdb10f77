"""Person names: which there are, and texts without them; known normal texts by owner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenwright.functions import privacy
from fenwright.functions import text as X
from fenwright.operators import clean
from fenwright.operators.cut import cut
from fenwright.operators.rules import few

# Columns of names, titles, words beside which a name stands, words that look like names and are none.
NAME_COLUMNS = ("생성인", "부서확인자", "배정된기사", "마감자")
TITLES = ("매니저님", "기사님", "과장님", "대리님", "사원님", "매니저", "기사", "과장", "대리", "사원", "님")
BESIDE = ("배정", "배정요청", "매니저", "기사", "담당", "담당자", "확인자", "접수자")
NO_NAMES = ("안전", "민원", "고객", "담당", "현장", "검침", "요금", "전입", "전출", "공급", "서비스", "시설", "설치", "송달", "청구서", "고지서", "계량기", "타이머", "자원")


def looks_like_name(c: Column) -> Column:
    """Two to five Hangul letters that begin with a surname."""
    return F.coalesce(c.rlike(f"^(?=[{privacy.SURNAMES}])[가-힣]{{2,5}}$"), F.lit(False))


def known_names(rows: DataFrame, creators: DataFrame | None = None, columns: Sequence[str] = NAME_COLUMNS) -> DataFrame:
    """(name): the different values of the columns of names there are, and of creators (name), that look like names."""
    held = [c for c in columns if c in rows.columns]
    found = rows.select(F.explode(F.array(*(F.col(c).cast("string") for c in held))).alias("name")) if held else rows.select(F.lit(None).cast("string").alias("name")).limit(0)
    if creators is not None:
        found = found.unionByName(creators.select(F.col("name").cast("string")))
    return found.select(clean.strip(F.col("name")).alias("name")).where(looks_like_name(F.col("name"))).distinct()


def _bases(word: Column) -> Column:
    """The word without each title that it ends with, longest titles first."""
    return F.filter(F.array(*(F.when(word.endswith(t) & (F.length(word) > len(t)), F.substring(word, 1, F.length(word) - len(t))) for t in TITLES)), lambda b: b.isNotNull())


def without_names(texts: DataFrame, names: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """(id, text): texts (id, text) without names: known ones, ones with a title, ones beside a word that goes with a name.

    Only words that may be a known name, whole or before a title, are looked up in the names; the texts' words stay where they are, and
    the places of names come back to them by id. Rows of one id are one text.
    """
    listed = texts.select(F.col(id).alias("id"), X.words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    maybe = listed.select("id", F.explode(F.array_distinct(F.flatten(F.transform("w", lambda t: F.concat(F.array(t), _bases(t)))))).alias("name"))
    met = maybe.where(looks_like_name(F.col("name"))).join(few(names.select("name").distinct()), "name").groupBy("id").agg(F.collect_set("name").alias("known"))
    joined = listed.join(met, "id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    is_known = lambda t: F.array_contains("known", t)
    like = lambda t: looks_like_name(t) & ~t.isin(*NO_NAMES)
    titled = lambda t: F.exists(_bases(t), lambda b: is_known(b) | like(b))
    near = lambda i: F.coalesce(F.get("w", i).isin(*BESIDE), F.lit(False))
    kept = F.filter("w", lambda t, i: ~(is_known(t) | titled(t) | (like(t) & (near(i - 1) | near(i + 1)))))
    return joined.select(F.col("id").alias(id), F.array_join(kept, " ").alias(text))


def normal_templates(counts: DataFrame, truth: DataFrame) -> DataFrame:
    """(owner, template): the different templates of texts that an owner has had as normal work: counts (owner, signature, total) of which
    truth (owner, signature), a row for each confirmed error, leaves some."""
    errors = truth.groupBy("owner", "signature").agg(F.count("*").alias("errors"))
    # A table, as Spark would carry what is asked of templates down to the rows that were counted, and make a template of each.
    left = cut(counts.join(errors, ["owner", "signature"], "left").where(F.col("total") - F.coalesce("errors", F.lit(0)) > 0), "normal")
    return left.select("owner", X.template(F.col("signature"), privacy.SURNAMES, privacy.NOT_NAMES).alias("template")).where("template <> ''").distinct()
