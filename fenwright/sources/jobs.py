"""Results of a job: as workbooks that others open, and as tables from which the job is restored whole or not at all."""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from datetime import date
from typing import NamedTuple
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from fenwright.functions import privacy
from fenwright.operators import clean
from fenwright.sources.tables import Versions

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
#: Fixed value: rows of a sheet.
SHEET_ROWS = 1_048_576
NO_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def write_sheets(stream: object, name: str, header: list[str], rows: Iterator[tuple], most: int = SHEET_ROWS) -> int:
    """Write rows as a workbook to a stream, row by row; sheets of `most` rows at most, each with the header. The number of rows."""
    letters = [_letters(i) for i in range(len(header))]

    def cell(at: int, n: int, v: object) -> str:
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{letters[at]}{n}"><v>{v}</v></c>'
        return f'<c r="{letters[at]}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(NO_XML.sub("", str(v)))}</t></is></c>'

    total, sheets, more = 0, 0, True
    rows = iter(rows)
    line = lambda n, values: f'<row r="{n}">{"".join(cell(i, n, v) for i, v in enumerate(values))}</row>'.encode()
    waiting = next(rows, None)
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
        while more:
            sheets += 1
            with z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as f:
                f.write(f'<worksheet xmlns="{NS}"><sheetData>'.encode() + line(1, header))
                n = 1
                while waiting is not None and n < most:
                    n += 1
                    f.write(line(n, waiting))
                    waiting = next(rows, None)
                f.write(b"</sheetData></worksheet>")
            total += n - 1
            more = waiting is not None
        title = lambda i: escape(name if sheets == 1 else f"{name} {i}", {'"': "&quot;"})
        numbers = range(1, sheets + 1)
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{title(i)}" sheetId="{i}" r:id="r{i}"/>' for i in numbers) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{overrides}</Types>')
    return total


#: The file that says that a job has not ended.
ALIVE = "_alive"


class Part(WriterCommitMessage):
    def __init__(self, file: str | None, rows: int) -> None:
        self.file, self.rows = file, rows


class WorkbookSink(DataSource):
    """Format `workbook_parts`: a workbook for each task that has rows, under the option `path`; option `sheet` names the sheets."""

    @classmethod
    def name(cls) -> str:
        return "workbook_parts"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        made = WorkbookWriter(self.options["path"], self.options.get("sheet", "Sheet"), schema.fieldNames(), overwrite)
        made.begin()
        return made


class WorkbookWriter(DataSourceWriter):
    """Tasks write beside the result; only the commit of all moves their workbooks there, and an abort takes them away.

    Other tasks may still run when one fails and the job is aborted. So the driver makes the folder, with a file that says the job is alive;
    a task that no longer finds that file writes nothing, and takes away what it has written.
    """

    def __init__(self, path: str, sheet: str, header: list[str], overwrite: bool) -> None:
        self.path, self.sheet, self.header, self.overwrite = path, sheet, header, overwrite
        self.job = uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), self.path)
        return files, root.rstrip("/")

    def _folder(self, root: str) -> str:
        return f"{root}/_temporary-{self.job}"

    def begin(self) -> None:
        files, root = self._place()
        files.create_dir(self._folder(root), recursive=True)
        with files.open_output_stream(f"{self._folder(root)}/{ALIVE}"):
            pass

    def _check(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{self._folder(root)}/{ALIVE}").type != fs.FileType.File:
            self._clear(files, root)
            raise RuntimeError("the job was aborted")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        first = next(iterator, None)
        if first is None:
            return Part(None, 0)
        files, root = self._place()
        self._check(files, root)
        file = f"{self._folder(root)}/{uuid.uuid4().hex}.xlsx"

        def rows() -> Iterator[tuple]:
            yield tuple(first)
            yield from map(tuple, iterator)

        with files.open_output_stream(file) as out:
            n = write_sheets(out, self.sheet, self.header, rows())
        self._check(files, root)
        return Part(file, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = self._place()
        files.create_dir(root, recursive=True)
        before = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".xlsx")]
        for n, m in enumerate(m for m in messages if m and m.file):
            files.move(m.file, f"{root}/part-{n:05d}-{self.job}.xlsx")
        if self.overwrite:
            for f in before:
                files.delete_file(f)
        self._clear(files, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*self._place())

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        folder = self._folder(root)
        if files.get_file_info(f"{folder}/{ALIVE}").type == fs.FileType.File:
            files.delete_file(f"{folder}/{ALIVE}")
        for left in range(5, 0, -1):  # a task may open its file while the folder is emptied
            try:
                if files.get_file_info(folder).type == fs.FileType.Directory:
                    files.delete_dir(folder)
                return
            except OSError:
                if left == 1:
                    raise


def save_workbook(df: DataFrame, path: str, sheet: str, detail: str | None = None, subcategory: str | None = None, mode: str = "overwrite") -> None:
    """df for people: personal data of the detail masked, formulas escaped, in workbooks."""
    df.sparkSession.dataSource.register(WorkbookSink)
    shown = privacy.mask_frame(df, detail, subcategory)[0] if detail else df
    texts = [f.name for f in shown.schema if not isinstance(f.dataType, (T.NumericType, T.StringType))]
    clean.escape_formulas(shown.withColumns({c: F.col(f"`{c}`").cast("string") for c in texts})).write.format("workbook_parts").options(path=path, sheet=sheet).mode(mode).save()


# Fixed value: what makes a text a formula.
FORMULA = ("=", "+", "-", "@")


def unescape_formulas(df: DataFrame) -> DataFrame:
    """df without the quotation marks that `clean.escape_formulas` puts before texts that would be formulas."""
    def plain(c: Column) -> Column:
        rest = F.substring(c, 2, F.length(c))
        return F.when(c.startswith("'") & (F.length(c) > 1) & F.substring(F.regexp_replace(rest, r"(?U)^\s+", ""), 1, 1).isin(*FORMULA), rest).otherwise(c)

    return df.withColumns({f.name: plain(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, T.StringType)})


class JobDamaged(ValueError):
    pass


class Job(NamedTuple):
    manifest: dict
    tables: dict[str, DataFrame]


MANIFEST = "manifest"
NEEDED = {"version": int, "job_id": str, "source_name": str, "created_at": str, "period": dict, "summaries": dict, "tables": dict}


def digest(df: DataFrame) -> dict[str, object]:
    """What a table holds, whatever the order of its rows: their number, the sum of their hashes, the columns."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return {"rows": n, "hash": str(int(total)), "columns": [[f.name, f.dataType.simpleString()] for f in df.schema]}


class JobStore:
    """The current job under a folder. Saving makes a whole new version current at once; restoring checks all of it first."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.versions = spark, Versions(spark, root)

    def save(self, job_id: str, source_name: str, created_at: str, period: tuple[date, date], tables: Mapping[str, DataFrame], summaries: Mapping[str, object] | None = None, expected: str | None = None) -> str:
        if not tables or MANIFEST in tables:
            raise ValueError("a job has tables, none of which is its manifest")
        kept = {name: clean.escape_formulas(df) for name, df in tables.items()}
        manifest = {"version": 1, "job_id": job_id, "source_name": source_name, "created_at": created_at, "period": {"start": period[0].isoformat(), "end": period[1].isoformat()}, "summaries": dict(summaries or {}), "tables": {name: digest(df) for name, df in kept.items()}}
        return self.versions.write(kept | {MANIFEST: self.spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "json string")}, expected)

    def manifest(self) -> dict:
        """The current job's manifest, whose every field is as it must be."""
        if self.versions.current() is None:
            raise JobDamaged("there is no job")
        try:
            (row,) = self.versions.read(MANIFEST).collect()
            found = json.loads(row["json"])
        except Exception as e:
            raise JobDamaged("the manifest cannot be read") from e
        wrong = [k for k, kind in NEEDED.items() if not isinstance(found.get(k), kind) or found.get(k) in ("", {}) and k != "summaries"]
        if wrong or found["version"] != 1:
            raise JobDamaged(f"the manifest lacks {', '.join(wrong) or 'a known version'}")
        try:
            start, end = (date.fromisoformat(found["period"][k]) for k in ("start", "end"))
        except (KeyError, TypeError, ValueError) as e:
            raise JobDamaged("the manifest's period is none") from e
        if start > end:
            raise JobDamaged("the manifest's period ends before it starts")
        return found

    def restore(self) -> Job:
        """The current job as it was saved: every table is there, holds what the manifest says, and has its formulas back."""
        manifest, tables = self.manifest(), {}
        for name, told in manifest["tables"].items():
            try:
                df = self.versions.read(name)
                held = digest(df)
            except Exception as e:
                raise JobDamaged(f"table {name} cannot be read") from e
            if held != told:
                raise JobDamaged(f"table {name} is not what was saved: {', '.join(k for k in told if held.get(k) != told[k])} differ")
            tables[name] = unescape_formulas(df)
        return Job(manifest, tables)
