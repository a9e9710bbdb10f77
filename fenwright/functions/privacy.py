"""Masking of personal data as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenwright.operators.clean import strip

# Marks, patterns, surnames, words that are no names, the category in which arrows join names.
PHONE_MARK, NAME_MARK, EMAIL_MARK, ID_MARK, ADDRESS_MARK = "<전화번호>", "<성명>", "<이메일>", "<식별번호>", "***"
EMAIL = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}(?![a-z0-9._%+-])"
# What is counted as an address, whatever stands behind it: `mask` leaves one that a point or a digit follows. Case as RE2 folds it, by which the long s and the Kelvin sign are letters.
_LETTER = r"a-zA-Z\u017F\u212A"
ANY_EMAIL = rf"(?<![{_LETTER}0-9._%+-])[{_LETTER}0-9._%+-]+@[{_LETTER}0-9.-]+\.[{_LETTER}]{{2,}}"
RESIDENT_ID = r"(?<!\d)\d{6}[-.\s]?[1-8]\d{6}(?!\d)"
PHONE = r"(?<!\d)(?:\+?82[-.\s]?)?(?:01[016789]|02|0[3-6]\d)[-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)"
LABELLED = r"(?i)((?:고객명|성명|명의자|이름)(?:\s*(?:변경|수정|오등록))?\s*(?::|=|은|는)?\s+)(?:[가-힣]{2,5}|[A-Za-z][A-Za-z .'’-]{1,60})"
ARROW = r"(?:[가-힣]{2,5}|[A-Za-z][A-Za-z .'’-]{1,50}?)\s*(→|->)\s*(?:[가-힣]{2,5}|[A-Za-z][A-Za-z .'’-]{1,50})"
SURNAMES = "김이박최정강조윤장임한오서신권황안송전홍유고문양손배백허남심노하곽성차주우구민류나진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용예봉사부가복태목형피두감음빈동온호범좌팽승간상시갈단"
NOT_NAMES = ("고객명", "성명", "명의자", "이름", "이상", "이하", "이전", "이후", "김장", "박스", "정상", "한도", "요금", "고객", "담당", "현장", "검침", "전입", "전출", "공급", "서비스", "시설", "설치", "문의", "요청", "변경", "수정", "연락처", "배우자", "대표자", "신청자", "요청자")
ADDRESS_COLUMNS = ("주소", "구주소")
CUSTOMER_INFO = "고객정보 추가/수정"

# The greedy name takes up to five letters, so a word that is no name is refused only as a whole.
AFTER_PHONE = rf"({PHONE_MARK}\s*(?:(?:로|에서|:|=)\s*)?)(?!(?:{'|'.join(NOT_NAMES)})(?![가-힣]))(?=[{SURNAMES}])[가-힣]{{2,5}}"


def mask(detail: Column, subcategory: Column | None = None) -> Column:
    """Texts without e-mails, resident ids, phone numbers and names that a label, an arrow or a phone number betrays; in this order."""
    text = F.regexp_replace(strip(detail), EMAIL, EMAIL_MARK)
    text = F.regexp_replace(text, RESIDENT_ID, ID_MARK)
    text = F.regexp_replace(text, PHONE, PHONE_MARK)
    if subcategory is not None:
        arrows = F.regexp_replace(text, ARROW, f"{NAME_MARK} $1 {NAME_MARK}")
        text = F.when(F.coalesce(strip(subcategory) == CUSTOMER_INFO, F.lit(False)), arrows).otherwise(text)
    text = F.regexp_replace(text, LABELLED, f"$1{NAME_MARK}")
    return F.regexp_replace(text, AFTER_PHONE, f"$1{NAME_MARK}")


def mask_address(c: Column) -> Column:
    """Any filled address as the mark; null and blank stay."""
    return F.when(F.coalesce(strip(c), F.lit("")) == "", c).otherwise(F.lit(ADDRESS_MARK))


def mask_frame(df: DataFrame, detail: str, subcategory: str | None = None) -> tuple[DataFrame, DataFrame]:
    """df masked, and one row of counters: changed rows, marks of each kind that masking added, addresses masked."""
    addresses = [c for c in df.columns if c.replace(" ", "") in ADDRESS_COLUMNS]
    masked = mask(F.col(detail), F.col(subcategory) if subcategory else None)
    added = lambda m: F.coalesce(F.sum(F.regexp_count("_masked", F.lit(m)) - F.regexp_count("_detail", F.lit(m))), F.lit(0))
    hidden = sum((F.when(~F.col(f"`{c}`").eqNullSafe(mask_address(F.col(f"`{c}`"))), 1).otherwise(0) for c in addresses), F.lit(0))
    told = df.select(F.col(detail).alias("_detail"), masked.alias("_masked"), hidden.alias("_hidden"))  # a column, so that each text is masked once
    counters = told.agg(F.count_if(~F.col("_masked").eqNullSafe(F.col("_detail"))).alias("changed"), *(added(m).alias(n) for n, m in (("phones", PHONE_MARK), ("names", NAME_MARK), ("emails", EMAIL_MARK), ("ids", ID_MARK))), F.coalesce(F.sum("_hidden"), F.lit(0)).alias("addresses"))
    return df.withColumns({detail: masked, **{c: mask_address(F.col(f"`{c}`")) for c in addresses}}), counters


def mask_payload(payload: Column, subcategory: Column | None = None) -> Column:
    """A map of texts, each masked; addresses whole."""
    return F.transform_values(payload, lambda k, v: F.when(F.regexp_replace(k, " ", "").isin(*ADDRESS_COLUMNS), mask_address(v)).otherwise(mask(v, subcategory)))
