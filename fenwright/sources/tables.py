"""Reading order workbooks, shapes, pasted rows, JSON configuration; writing versions that readers switch to at once."""

from __future__ import annotations

import csv
import io
import itertools
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fenwright.operators import clean

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 0, cells as text) of a workbook, sheet by sheet, without holding a sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{NS}sheet"):
            target = targets[sheet.get(REL)]
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{NS}row":
                        continue
                    cells: list[str | None] = []
                    for c in row.iter(f"{NS}c"):
                        at = _column_number(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        value = c.find(f"{NS}v")
                        if c.get("t") == "inlineStr":
                            cells[at] = "".join(t.text or "" for t in c.iter(f"{NS}t"))
                        elif value is not None and value.text is not None:
                            cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                    yield sheet.get("name"), int(row.get("r", 1)) - 1, cells
                    row.clear()


def header_row(rows: Iterator[tuple[str, int, list[str | None]]], signature: Sequence[str], within: int = 30) -> tuple[str, int] | None:
    """(sheet, row) of the first row among the first `within` of a sheet that holds all names of the signature."""
    wanted = set(signature)
    for sheet, n, cells in rows:
        if n < within and wanted <= {(c or "").strip() for c in cells}:
            return sheet, n
    return None


class WorkbookSource(DataSource):
    """Format `workbook`: option `paths` (comma-separated) and `signature` (names of the header). Rows come as (path, sheet,
    row, cells); each workbook is a partition."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, sheet string, row int, cells array<string>"

    def reader(self, schema: object) -> DataSourceReader:
        return WorkbookReader(self.options["paths"].split(","))


class WorkbookReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            data = f.read()
        for sheet, n, cells in sheet_rows(data):
            yield partition.value, sheet, n, cells


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of all workbooks under a path, of any file system that Spark reads."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, data in zip(frame["path"], frame["content"]):
                rows = [(where, *r) for r in sheet_rows(data)]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def with_header(cells: DataFrame, signature: Sequence[str], columns: Sequence[str], within: int = 30) -> DataFrame:
    """Rows below the header of each workbook's best sheet (the one with a header and most rows), by column name."""
    trimmed = cells.withColumn("cells", F.transform("cells", clean.blank_to_null))
    is_header = (F.col("row") < within) & (F.size(F.array_except(F.array(*map(F.lit, signature)), F.col("cells"))) == 0)
    heads = trimmed.where(is_header).groupBy("path", "sheet").agg(F.min_by(F.struct("row", "cells"), "row").alias("head"))
    sizes = trimmed.groupBy("path", "sheet").agg(F.count("*").alias("n"))
    best = heads.join(sizes, ["path", "sheet"]).groupBy("path").agg(F.max_by(F.struct("sheet", "head"), F.struct("n", "sheet")).alias("b")).select("path", "b.sheet", F.col("b.head.row").alias("top"), F.col("b.head.cells").alias("names"))
    below = trimmed.join(best, ["path", "sheet"]).where(F.col("row") > F.col("top"))
    value = lambda c: F.when(F.array_position("names", c) > 0, F.get("cells", (F.array_position("names", c) - 1).cast("int")))
    return below.select("path", *(value(c).alias(c) for c in columns)).na.drop(how="all", subset=list(columns))


# Fixed value: names of the monthly workbooks.
WORKBOOK_NAME = r"^(H\d{3})_(\d{4}\.\d{2})_안전점검\.xlsx$"


def matching_workbooks(files: DataFrame, pattern: str = WORKBOOK_NAME) -> DataFrame:
    """(path, center, month) of files (path) whose names fit."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.rlike(pattern)).select("path", F.regexp_extract(name, pattern, 1).alias("center"), F.regexp_extract(name, pattern, 2).alias("month"))


# Headers of an order number; shapes of codes by which a row without a header is understood; centers by business;
# columns that whole rows must have.
ORDER_HEADERS = ("오더번호", "오더no", "order_number")
CENTER_HEADERS = ("고객서비스처리센터", "서비스처리센터")
WHOLE_ROW = ("오더번호", "오더생성일", "오더생성자", "상태", "소분류", "내역")
CENTER, CREATOR, ORDER, NUMBER = r"^H0(?:5[1-5]|7[1-5])$", r"^CSC\d{4,}$", r"^\d{7,10}$", r"^\d+(?:\.\d+)?$"
CENTERS = {"중부": "H071", "북부": "H072", "남부": "H073", "동부": "H074", "서부": "H075"}
MOST_ROWS, MOST_CHARACTERS, HEADER_WITHIN = 500, 1_000_000, 5


def header_key(name: str | None) -> str:
    return re.sub(r"\s+", "", (name or "").lstrip("\ufeff")).casefold()


def pasted_cells(spark: SparkSession, text: str) -> tuple[DataFrame, list[str] | None]:
    """(row, cells) of pasted tab-separated text, and its header, if one of the first rows names the order number. A request is
    small by rule (MOST_CHARACTERS), so the text is cut where it arrives; all else is DataFrame work."""
    if len(text) > MOST_CHARACTERS:
        raise ValueError("the text is too long")
    rows = [r for r in csv.reader(io.StringIO(text), delimiter="\t") if any(c.strip() for c in r)]
    head = next((i for i, r in enumerate(rows[:HEADER_WITHIN]) if any(header_key(c) in ORDER_HEADERS for c in r)), None)
    body = rows if head is None else rows[head + 1 :]
    cells = spark.createDataFrame(list(enumerate(body)), "row int, cells array<string>").withColumn("cells", F.transform("cells", clean.strip))
    return cells, None if head is None else [c.strip().lstrip("\ufeff") for c in rows[head]]


def _few(rows: DataFrame) -> DataFrame:
    """rows, or an error if there are more than may come at once."""
    count = F.count("*").over(Window.partitionBy())
    return rows.withColumn("row", F.when(count > MOST_ROWS, F.raise_error(F.lit(f"at most {MOST_ROWS} rows at once")).cast("int")).otherwise(F.col("row")))


def pasted(spark: SparkSession, text: str, known: DataFrame) -> DataFrame:
    """(order_number, times, known) of pasted rows: from the order number's column, or, without a header, the first cell of
    each row that is a known order."""
    cells, header = pasted_cells(spark, text)
    orders = known.select("order_number").distinct().withColumn("known", F.lit(True))
    if header is not None:
        at = next(i for i, c in enumerate(header) if header_key(c) in ORDER_HEADERS)
        named = cells.select("row", clean.order_number(F.get("cells", F.lit(at))).alias("order_number")).where("order_number <> ''")
    else:
        each = cells.select("row", F.posexplode("cells").alias("at", "cell")).select("row", "at", clean.order_number(F.col("cell")).alias("order_number"))
        named = each.join(orders, "order_number", "left_semi").groupBy("row").agg(F.min_by("order_number", "at").alias("order_number"))
    counted = _few(named).groupBy("order_number").agg(F.count("row").alias("times"))
    return counted.join(orders, "order_number", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def _first(fits: Column) -> Column:
    """The place, from 0, of the first true; null if there is none."""
    return F.nullif(F.array_position(fits, F.lit(True)), F.lit(0)) - 1


def anchored(cells: DataFrame) -> DataFrame:
    """Whole rows without a header, understood from what stands in them: the center's code, the order number with a state
    after it, and the creator's code. A row without one of these, a text or a date has null for its order number."""
    row = F.col("cells")
    number = F.transform(row, clean.order_number)
    is_order = F.transform(number, lambda c, i: c.rlike(ORDER) & (i < F.size(row) - 4) & F.coalesce(~F.get(row, i + 1).rlike(NUMBER) & (F.get(row, i + 1) != ""), F.lit(False)))
    is_creator = F.transform(row, lambda c, i: F.upper(c).rlike(CREATOR) & (i >= 2) & (i + 3 < F.size(row)))
    placed = cells.select("row", "cells", number.alias("numbers"), _first(F.transform(row, lambda c: F.upper(c).rlike(CENTER))).alias("c"), _first(is_order).alias("o"), _first(is_creator).alias("p"))
    get = lambda at, by=0: F.get("cells", (F.col(at) + by).cast("int"))
    end = F.when(F.col("c") > F.col("o"), F.col("c")).otherwise(F.col("p"))
    between = F.slice("cells", (F.col("o") + 6).cast("int"), F.greatest(end - F.col("o") - 5, F.lit(0)).cast("int"))
    detail = F.array_join(F.filter(between, lambda c: (c != "") & ~c.rlike(NUMBER)), " ")
    values = {"서비스처리센터": F.upper(get("c")), "상태": get("o", 1), "대분류": get("o", 2), "중분류": get("o", 3), "소분류": get("o", 4), "내역": detail, "오더생성일": get("p", -2), "오더생성시간": get("p", -1), "오더생성자": F.upper(get("p")), "생성인": get("p", 1), "생성부서": get("p", 2), "사업부": get("p", 3)}
    dated = F.try_to_timestamp(F.regexp_replace(get("p", -2), r"[./]", "-")).isNotNull()
    good = F.coalesce((detail != "") & dated & F.col("c").isNotNull(), F.lit(False))
    return placed.select("row", F.when(good, F.get("numbers", F.col("o").cast("int"))).alias("오더번호"), *[v.alias(k) for k, v in values.items()])


def pasted_rows(spark: SparkSession, text: str, columns: Sequence[str]) -> DataFrame | None:
    """Pasted whole rows by column name: below their header, or without one as many cells as `columns` (or all but the
    center), or by `anchored`. None if they are not whole; where the center is absent, the business tells it."""
    cells, header = pasted_cells(spark, text)
    shape = cells.agg(F.max(F.size("cells")), F.max(F.exists(F.slice("cells", F.lit(2), F.greatest(F.size("cells"), F.lit(1))), lambda c: F.upper(c).rlike(CENTER)))).first()
    if header is None:
        fixed = next((c for c in (list(columns), [c for c in columns if c not in CENTER_HEADERS]) if len(c) == shape[0]), None)
        if shape[1] or fixed is None or not set(WHOLE_ROW) <= set(fixed):
            found = anchored(cells)
            if (shape[1] or fixed) and not found.where(F.col("오더번호").isNull()).limit(1).count():
                return _few(found)
            if fixed is None or not set(WHOLE_ROW) <= set(fixed):
                return None
        names = list(enumerate(fixed))
    else:
        names = [(i, c) for i, c in enumerate(header) if c]
        if len({c for _, c in names}) < len(names):
            raise ValueError("two columns have the same name")
    have = {header_key(c) for _, c in names}
    if not set(WHOLE_ROW) <= have:
        return None
    out = cells.select("row", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in names])
    out = out.where(F.exists(F.array(*[F.col(f"`{c}`") for _, c in names]), lambda c: c != ""))
    if not have & set(CENTER_HEADERS):
        if "사업부" not in [c for _, c in names]:
            return None
        out = out.withColumn("서비스처리센터", F.try_element_at(F.create_map(*[F.lit(x) for kv in CENTERS.items() for x in kv]), F.col("사업부")))
    return _few(out)


def polygons_of(data: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """(record number, rings) of the polygons of a shape file."""
    at = 100
    while at + 12 <= len(data):
        number, words = struct.unpack(">ii", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
            continue
        parts, points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        base = 44 + 4 * parts
        xy = [struct.unpack("<dd", body[base + 16 * i : base + 16 * i + 16]) for i in range(points)]
        yield number, [xy[a:b] for a, b in zip(starts, starts[1:])]


def polygons(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(path, record, rings, x1, y1, x2, y2) of shape files under a path; a box is applied before rows leave the reader."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, data in zip(frame["path"], frame["content"]):
                rows = []
                for number, rings in polygons_of(data):
                    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
                    x1, y1, x2, y2 = min(xs), min(ys), max(xs), max(ys)
                    if not box or (x1 <= box[2] and x2 >= box[0] and y1 <= box[3] and y2 >= box[1]):
                        rows.append((where, number, [[{"x": x, "y": y} for x, y in r] for r in rings], x1, y1, x2, y2))
                yield pd.DataFrame(rows, columns=["path", "record", "rings", "x1", "y1", "x2", "y2"])

    schema = "path string, record int, rings array<array<struct<x: double, y: double>>>, x1 double, y1 double, x2 double, y2 double"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path", "content").mapInPandas(run, schema)


# encodings' other names and the usual one; codes and words of roads that part blocks.
KOREAN, KOREAN_NAMES = "cp949", ("euckr", "ksc5601", "ksx1001")
ROAD_CODES = ("UQS100", "UQS103", *(f"UQS{n}" for n in range(111, 123)))
NO_ROAD_CODES = ("UQS200", "UQS210", "UQS520")
ROAD_WORDS, NO_ROAD_WORDS = "광로|대로|중로|소로|도로", "기타 도로시설|주차|철도"
BARRIER_MARGIN, SHAPE_MARGIN = 420.0, 260.0


def encoding_of(cpg: bytes | None) -> str:
    """The encoding that a .cpg file names; Korean ones, and none, are cp949."""
    name = (cpg or b"").decode("ascii", "ignore").strip()
    return KOREAN if name.replace("-", "").lower() in ("", *KOREAN_NAMES) else name


def records_of(data: bytes, encoding: str = KOREAN) -> Iterator[tuple[int, dict[str, str | None]]]:
    """(record number from 1, values as trimmed text; blank ones null) of a .dbf file. Deleted records are left out, but counted."""
    count, head, size = struct.unpack("<iHH", data[4:12])
    fields, at = [], 1
    for d in range(32, head - 1, 32):
        if data[d] == 0x0D:
            break
        fields.append((data[d : d + 11].split(b"\0")[0].decode(encoding, "replace"), at, at + data[d + 16]))
        at += data[d + 16]
    for n in range(count):
        record = data[head + n * size : head + (n + 1) * size]
        if len(record) == size and record[:1] != b"*":
            yield n + 1, {name: record[a:b].decode(encoding, "replace").strip(" \0") or None for name, a, b in fields}


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, attributes) of the .dbf files under a path, in the encoding of the .cpg file beside each. path is without
    its ending, so that it and record join with `polygons`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{dbf,cpg}").load(path).select(F.regexp_replace("path", r"\.[a-z]+$", "").alias("stem"), F.col("path").endswith(".cpg").alias("is_cpg"), "content")
    pairs = files.where("not is_cpg").select("stem", "content").join(files.where("is_cpg").select("stem", F.col("content").alias("cpg")), "stem", "left").select("stem", "content", "cpg")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for stem, data, cpg in zip(frame["stem"], frame["content"], frame["cpg"]):
                rows = records_of(data, encoding_of(cpg))
                while part := list(itertools.islice(rows, 10_000)):
                    yield pd.DataFrame([(stem, n, v) for n, v in part], columns=["path", "record", "attributes"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return pairs.mapInPandas(run, "path string, record int, attributes map<string,string>")


def shapes(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, margin: float = SHAPE_MARGIN) -> DataFrame:
    """Polygons within a margin of a box, with their attributes and a key: parcel number, else district's object, else place."""
    wide = box and (box[0] - margin, box[1] - margin, box[2] + margin, box[3] + margin)
    found = polygons(spark, path, wide).withColumn("path", F.regexp_replace("path", r"\.[a-z]+$", ""))
    joined = found.join(attributes(spark, path), ["path", "record"], "left")
    value = lambda c: F.try_element_at("attributes", F.lit(c))
    return joined.withColumn("source_key", F.coalesce(value("PNU"), value("SGG_OID"), F.concat(F.lit("shape_"), F.col("record") - 1)))


def is_transport_barrier(code: Column, name: Column) -> Column:
    """Whether a transport area parts blocks: by its code, else if its name says road and neither parking nor rail."""
    said = F.coalesce(name, F.lit(""))
    return F.when(F.coalesce(code.isin(*NO_ROAD_CODES), F.lit(False)), False).when(F.coalesce(code.isin(*ROAD_CODES), F.lit(False)), True).otherwise(said.contains("도로") & ~said.rlike("주차|철도"))


def is_road_barrier(name: Column, grade: Column, code: Column) -> Column:
    """Whether a road parts blocks: by its code or words, unless words say it is a facility, parking or rail."""
    said = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (name, grade, code)])
    return ~said.rlike(NO_ROAD_WORDS) & (F.coalesce(code.isin(*ROAD_CODES), F.lit(False)) | said.rlike(ROAD_WORDS))


def transport_barriers(shapes: DataFrame) -> DataFrame:
    """shapes that part blocks, with source, code and name."""
    code, name = F.try_element_at("attributes", F.lit("A5")), F.try_element_at("attributes", F.lit("A6"))
    return shapes.where(is_transport_barrier(code, name)).withColumns({"source": F.lit("transport"), "code": code, "name": name})


def road_barriers(shapes: DataFrame) -> DataFrame:
    """shapes of roads that part blocks, with source, code and name. Rings stay in the file's coordinates; `geo` projects them."""
    value = lambda c: F.try_element_at("attributes", F.lit(c))
    kept = shapes.where(is_road_barrier(value("DGM_NM"), value("GRAD_SE"), value("ATRB_SE")))
    return kept.withColumns({"source": F.lit("road"), "code": F.coalesce(value("ATRB_SE"), value("ROAD_TY")), "name": F.coalesce(value("DGM_NM"), value("GRAD_SE"))})


def legal_dongs(attributes: DataFrame) -> DataFrame:
    """(code, name, district) of the records of areas; the last record of a code counts."""
    value = lambda c: F.try_element_at("attributes", F.lit(c))
    named = attributes.select(value("EMD_CD").alias("code"), F.struct(F.coalesce(value("EMD_NM"), F.lit("")).alias("name"), F.coalesce(value("COL_ADM_SE"), F.lit("")).alias("district")).alias("v"), "record").where("code is not null")
    return named.groupBy("code").agg(F.max_by("v", "record").alias("v")).select("code", "v.*")


class Versions:
    """Tables under a folder, each write a new version; numbered pointer files, the last of which says what is current.

    A pointer is created only where none of its number is, so of two writers that replace the same version one fails; there
    is a current version at any time, whenever a writer dies. A pointer that a writer left empty counts for nothing, and after
    STALE seconds stands in nobody's way.
    """

    STALE = 600

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[tuple[int, str | None, float]]:
        """(number, version or None, age in seconds), the latest first."""
        folder, out = self.path(f"{self.root}/_current"), []
        if self.files.exists(folder):
            now = self.jvm.java.lang.System.currentTimeMillis()
            for status in self.files.listStatus(folder):
                if status.getPath().getName().isdigit():
                    stream = self.files.open(status.getPath())
                    text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                    stream.close()
                    try:
                        version = json.loads(text)["version"]
                    except ValueError:  # its writer has not come so far
                        version = None
                    out.append((int(status.getPath().getName()), version, (now - status.getModificationTime()) / 1000))
        return sorted(out, reverse=True)

    def write(self, tables: dict[str, DataFrame], expected: str | None = None, **partition_by: Sequence[str]) -> str:
        """Write all tables as one version and make it current, unless another writer was faster (`expected` is not current any more)."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.partitionBy(*partition_by.get(name, ())).parquet(f"{self.root}/{version}/{name}")
        pointers = self._pointers()
        faster = expected is not None and (self.current() != expected or any(v is None and age < self.STALE for _, v, age in pointers[:1]))
        if not faster:
            try:
                out = self.files.create(self.path(f"{self.root}/_current/{pointers[0][0] + 1 if pointers else 1:012d}"), False)
                out.write(json.dumps({"version": version, "tables": sorted(tables)}).encode())
                out.close()
            except Py4JJavaError as e:
                if "Exist" not in e.java_exception.getClass().getName() and "exist" not in str(e.java_exception.getMessage()):
                    raise
                faster = True
        if faster:
            self.files.delete(self.path(f"{self.root}/{version}"), True)
            raise RuntimeError("another version has become current")
        return version

    def current(self) -> str | None:
        return next((version for _, version, _ in self._pointers() if version), None)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()}/{name}")
