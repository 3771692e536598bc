"""Python data sources: scans that take filters into their requests, in batches or as a stream, and worksheets in xlsx files."""

from __future__ import annotations

import math
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta, timezone
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

SCAN = "source string, keyword string, posted timestamp, body string"
COLUMNS = ("source", "keyword", "posted", "body")


class Portion(InputPartition):
    """A file's row group, and the request that it answers."""

    def __init__(self, file: str, group: int, request: dict):
        super().__init__((file, group))
        self.file, self.group, self.request = file, group, request


def _function(name: str) -> Callable:
    import importlib

    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _files(path: str) -> tuple[Any, list[str]]:
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(folder)
    if info.is_file:
        return system, [folder]
    found = system.get_file_info(fs.FileSelector(folder))
    return system, sorted(i.path for i in found if i.is_file and i.base_name.endswith(".parquet") and i.base_name[0] not in "._")


class Answers:
    """What a table of items answers: the columns of a scan under the names that the options give them. One portion a row group, so that a large file is several tasks."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.names = {c: options.get(f"{c}column", c) for c in COLUMNS}
        self.fetch = options.get("fetcher", "")

    def portions(self, request: dict) -> list[InputPartition]:
        import pyarrow.parquet as pq

        system, files = _files(self.path)
        out = []
        for file in files:
            with system.open_input_file(file) as f:
                meta = pq.ParquetFile(f).metadata
            out += [Portion(file, g, request) for g in range(meta.num_row_groups) if not self._outside(meta.row_group(g), request)]
        return out

    def _outside(self, group: Any, request: dict) -> bool:
        """Whether a row group's least and greatest posted time say that it holds nothing that is asked for."""
        low, high = self._range(group)
        return high is not None and (("since" in request and high < _time(request["since"])) or ("after" in request and high <= _time(request["after"])) or ("upto" in request and low > _time(request["upto"])))

    def _range(self, group: Any) -> tuple[datetime | None, datetime | None]:
        for k in range(group.num_columns):
            column = group.column(k)
            if column.path_in_schema == self.names["posted"] and column.statistics and column.statistics.has_min_max:
                return _utc(column.statistics.min), _utc(column.statistics.max)
        return None, None

    def newest(self) -> datetime | None:
        """The greatest posted time, from the files' statistics alone where they have them."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        system, files = _files(self.path)
        found = []
        for file in files:
            with system.open_input_file(file) as f:
                told = pq.ParquetFile(f)
                for g in range(told.metadata.num_row_groups):
                    high = self._range(told.metadata.row_group(g))[1]
                    if high is None:
                        high = pc.max(told.read_row_group(g, columns=[self.names["posted"]]).column(0)).as_py()
                    if high is not None:
                        found.append(_utc(high))
        return max(found, default=None)

    def rows(self, portion: Portion) -> Iterator[pa.RecordBatch]:
        """The items of a row group that the request names, through the fetcher if there is one: fetch(request, batches) sees what the table holds."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        system, _ = _files(portion.file)
        asked = portion.request
        with system.open_input_file(portion.file) as f:
            batches = pq.ParquetFile(f).iter_batches(row_groups=[portion.group], columns=list(dict.fromkeys(self.names.values())), batch_size=8192)
            for batch in _function(self.fetch)(asked, batches) if self.fetch else batches:
                got = {c: batch.column(n) for c, n in self.names.items()}
                out = pa.RecordBatch.from_arrays([got[c].cast(pa.timestamp("us", "UTC") if c == "posted" else pa.string()) for c in COLUMNS], names=list(COLUMNS))
                keep = pa.array([True] * out.num_rows, pa.bool_())
                for c in ("source", "keyword"):
                    if c in asked:
                        keep = pc.and_(keep, pc.fill_null(pc.is_in(out.column(c), value_set=pa.array(asked[c], pa.string())), False))
                for name, test in (("since", pc.greater_equal), ("after", pc.greater), ("upto", pc.less_equal)):
                    if name in asked:
                        keep = pc.and_(keep, pc.fill_null(test(out.column("posted"), pa.scalar(_time(asked[name]), pa.timestamp("us", "UTC"))), False))
                yield out.filter(keep)


def _utc(t: datetime) -> datetime:
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def _time(text: str) -> datetime:
    return _utc(datetime.fromisoformat(text))


class ScanReader(DataSourceReader):
    """Filters become the request: equal sources and keywords exactly, a lower bound of posted as the least of `days` that covers it, counted back from
    `now`. A day's window is wider than the bound, so that filter stays with Spark, as do all others."""

    def __init__(self, options: dict):
        self.answers = Answers(options)
        self.now = _time(options["now"]) if "now" in options else datetime.now(timezone.utc)
        self.days = [int(d) for d in options.get("days", "1,3,7,14").split(",")]
        self.request: dict = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, In)) and name in ("source", "keyword"):
                said = [f.value] if isinstance(f, EqualTo) else list(f.value)
                known = self.request.get(name)
                self.request[name] = said if known is None else [v for v in known if v in said]
                continue
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == "posted":
                needed = math.ceil((self.now - _utc(f.value)) / timedelta(days=1))
                day = next((d for d in self.days if needed <= d), None)
                if day is not None:
                    since = self.now - timedelta(days=day)
                    self.request["since"] = max(since, _time(self.request["since"])).isoformat() if "since" in self.request else since.isoformat()
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        return self.answers.portions(self.request)

    def read(self, partition: Portion) -> Iterator[pa.RecordBatch]:
        yield from self.answers.rows(partition)


class ScanStream(DataSourceStreamReader):
    """Offsets are the greatest posted time that has been read: a batch is what lies between two of them, so one that fails is read again as it was.
    Items that come later with a time that has passed are not new to it; a buffer keeps the mark that far behind the newest."""

    def __init__(self, options: dict):
        self.answers = Answers(options)
        self.buffer = timedelta(seconds=float(options.get("bufferseconds", 0)))

    def initialOffset(self) -> dict:
        return {"posted": "0001-01-02T00:00:00+00:00"}

    def latestOffset(self) -> dict:
        newest = self.answers.newest()
        return self.initialOffset() if newest is None else {"posted": (newest - self.buffer).isoformat()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.answers.portions({"after": start["posted"], "upto": end["posted"]})

    def read(self, partition: Portion) -> Iterator[pa.RecordBatch]:
        yield from self.answers.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class ScanSource(DataSource):
    """spark.read or readStream.format("scans"): items of a parquet folder as source, keyword, posted and body. Options: path, <column>Column (its name
    there), now, days, fetcher (`package.module:function`), bufferSeconds. Pushing needs spark.sql.python.filterPushdown.enabled. Spark 4.1 keeps what was pushed
    last with a loaded relation when it is read again without any filter, so load() anew for such a read."""

    @classmethod
    def name(cls) -> str:
        return "scans"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema) -> DataSourceReader:
        return ScanReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ScanStream(self.options)


NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def column_number(ref: str) -> int:
    n = 0
    for ch in re.sub(r"\d", "", ref):
        n = 26 * n + ord(ch) - 64
    return n - 1


def column_name(n: int) -> str:
    """1 is A, 27 is AA."""
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def resolve_sheet(names: list[str], asked: str) -> str:
    if not asked or asked == "latest":
        return names[-1]
    if asked not in names:
        raise ValueError(f"no sheet {asked}")
    return asked


def read_sheet(path: str, asked: str = "") -> Iterator[tuple[int, list[str]]]:
    """(row number, cells) of a worksheet; short rows are padded by the caller."""
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(f"{{{NS['r']}}}id")] for s in book.iterfind("m:sheets/m:sheet", NS)}
        target = sheets[resolve_sheet(list(sheets), asked)]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        with z.open("xl/" + target.lstrip("/").removeprefix("xl/")) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{NS['m']}}}row":
                    continue
                cells: dict[int, str] = {}
                for c in row.iterfind("m:c", NS):
                    v, inline, formula = c.find("m:v", NS), c.find("m:is", NS), c.find("m:f", NS)
                    got = "=" + (formula.text or "") if formula is not None else "".join(t.text or "" for t in inline.iter(f"{{{NS['m']}}}t")) if inline is not None else "" if v is None else v.text or ""
                    cells[column_number(c.get("r"))] = shared[int(got)] if c.get("t") == "s" else got
                yield int(row.get("r")), [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
                row.clear()


def write_sheet(path: str, name: str, rows: list[list[str]]) -> None:
    """A workbook of one worksheet of texts, bounded by what a worksheet holds."""
    from xml.sax.saxutils import escape, quoteattr

    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{column_name(k)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for k, v in enumerate(r, 1) if v) + "</row>" for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS["m"]}" xmlns:r="{NS["r"]}"><sheets><sheet name={quoteattr(name)} sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{NS["m"]}"><sheetData>{body}</sheetData></worksheet>')


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet = options["path"], options.get("sheet", "")

    def read(self, _) -> Iterator[tuple]:
        rows = read_sheet(self.path, self.sheet)
        _, header = next(rows, (1, []))
        while header and not header[-1].strip():
            header.pop()
        for number, cells in rows:
            yield number, header, (cells + [""] * len(header))[: len(header)]


class XlsxSource(DataSource):
    """spark.read.format("worksheet"): row_number (as in the sheet, data from 2), headers, cells."""

    @classmethod
    def name(cls) -> str:
        return "worksheet"

    def schema(self) -> str:
        return "row_number int, headers array<string>, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return XlsxReader(self.options)


def register(spark) -> None:
    for source in (ScanSource, XlsxSource):
        spark.dataSource.register(source)
