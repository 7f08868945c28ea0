"""Workbooks (xlsx) as a Spark data source: `spark.read.format("workbook")` and `df.write.format("workbook")`.

A partition of a read is a block of rows of one sheet. Its task inflates the sheet, skips to its first row without parsing,
and parses its own rows only. A sheet has at most 16 blocks, since each inflates what stands before it: the work of a read grows
with the sheets, whatever the rows of a block. A write gives one workbook per partition. Files are opened through Arrow's file systems,
by path or URI, so that every executor reads the same store.
"""

from __future__ import annotations

import datetime
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of one partition, partitions of one sheet, and bytes inflated at a time.
BLOCK, PARTS, CHUNK = 50_000, 16, 1 << 18

# Limits of a sheet, number formats that are dates, and names of parts of a workbook.
MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384
DATE_FORMATS = set(range(14, 23)) | set(range(27, 37)) | set(range(45, 48)) | set(range(50, 59))
MAIN, RELATIONS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"

_ROW = re.compile(rb"<(?:\w+:)?row(?=[\s/>])[^>]*>")
_NUMBER = re.compile(rb'\sr\s*=\s*["\'](\d+)')
_MERGE = re.compile(rb'<(?:\w+:)?mergeCell\s[^>]*?ref\s*=\s*["\']([A-Z]+)(\d+):([A-Z]+)(\d+)')
_SIZE = re.compile(rb'<(?:\w+:)?dimension\s[^>]*?ref\s*=\s*["\'](?:[A-Z]+\d+:)?([A-Z]+)(\d+)["\']')
_TAG = re.compile(rb'<(?:\w+:)?(row|c)(?=[\s/>])(?:[^>]*?\sr\s*=\s*["\']([A-Z]*)(\d+)["\'])?[^>]*>')
_END = re.compile(rb"</(?:\w+:)?sheetData\s*>|<(?:\w+:)?sheetData\s*/>")


def column_number(letters: str | bytes) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for x in letters.encode() if isinstance(letters, str) else letters:
        n = 26 * n + x - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _store(path: str):
    from pyarrow import fs

    if re.match(r"^\w+://?", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def workbook_files(path: str) -> list[str]:
    """The workbooks under a path: the file itself, or those of a folder in order of their names, without hidden ones."""
    from pyarrow import fs

    store, inside = _store(path)
    found = store.get_file_info(inside)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        return [path]
    prefix = path[:len(path) - len(inside)] if path.endswith(inside) else ""
    files = store.get_file_info(fs.FileSelector(inside))
    return [prefix + f.path for f in sorted(files, key=lambda f: f.path) if f.base_name.lower().endswith(".xlsx") and f.base_name[0] not in "._~"]


def _open(path: str) -> zipfile.ZipFile:
    store, inside = _store(path)
    return zipfile.ZipFile(store.open_input_file(inside))


def _elements(data: Iterator[bytes]) -> Iterator[tuple[str, dict, str]]:
    """(tag without prefix, attributes, text) of each element when it ends; the text is that of the element itself."""
    done: list[tuple[str, dict, str]] = []
    stack: list[list] = []
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = lambda tag, attrs: stack.append([tag.rpartition(":")[2], attrs, []])

    def text(x: str) -> None:
        if stack:
            stack[-1][2].append(x)

    def end(_: str) -> None:
        tag, attrs, parts = stack.pop()
        done.append((tag, attrs, "".join(parts)))

    def refuse(*_) -> None:
        raise ValueError("a workbook declares no entities")

    parser.CharacterDataHandler, parser.EndElementHandler, parser.EntityDeclHandler = text, end, refuse
    for chunk in data:
        parser.Parse(chunk, False)
        yield from done
        done.clear()


def _chunks(book: zipfile.ZipFile, part: str) -> Iterator[bytes]:
    with book.open(part) as f:
        while chunk := f.read(CHUNK):
            yield chunk


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part of the archive) of each sheet, in their order."""
    names = [(a["name"], a.get("r:id") or next(v for k, v in a.items() if k.endswith(":id"))) for tag, a, _ in _elements(_chunks(book, "xl/workbook.xml")) if tag == "sheet"]
    targets = {a["Id"]: a["Target"] for tag, a, _ in _elements(_chunks(book, "xl/_rels/workbook.xml.rels")) if tag == "Relationship"}
    return [(name, targets[i].lstrip("/") if targets[i].startswith("/") else f"xl/{targets[i]}") for name, i in names]


def _shared(book: zipfile.ZipFile) -> list[str]:
    """The strings that cells point to; runs of one string are put together, phonetic hints left out."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out, parts = [], []
    for tag, _, text in _elements(_chunks(book, "xl/sharedStrings.xml")):
        if tag == "t":
            parts.append(text)
        elif tag == "rPh":
            parts.pop()
        elif tag == "si":
            out.append("".join(parts))
            parts.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> tuple[set[int], int]:
    """Numbers of the cell styles that show dates, and the day that is number 0 (as days since 1899-12-30)."""
    base = 1462 if any(tag == "workbookPr" and a.get("date1904") in ("1", "true") for tag, a, _ in _elements(_chunks(book, "xl/workbook.xml"))) else 0
    if "xl/styles.xml" not in book.namelist():
        return set(), base
    formats, styles, cells = {}, [], []
    for tag, a, _ in _elements(_chunks(book, "xl/styles.xml")):
        if tag == "numFmt":
            formats[int(a["numFmtId"])] = a.get("formatCode", "")
        elif tag == "xf":
            styles.append(int(a.get("numFmtId", 0)))
        elif tag == "cellStyleXfs":
            styles.clear()
        elif tag == "cellXfs":
            cells = list(styles)
    own = {k for k, v in formats.items() if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]|_.|\*.', "", v.lower())) and "general" not in v.lower()}
    return {i for i, f in enumerate(cells) if f in own or (f in DATE_FORMATS and f not in formats)}, base


def number_text(raw: str) -> str:
    """A number as it is written by hand: whole ones without point, others with at most 15 digits, as a sheet keeps them."""
    if re.fullmatch(r"-?\d{1,18}", raw):
        return raw
    value = float(raw)
    text = f"{value:.15g}"
    if "e" in text:
        text = f"{value:.0f}" if abs(value) >= 1 else f"{value:.20f}".rstrip("0")
    return text


def date_text(raw: str, base: int) -> str:
    days = float(raw) + base
    seconds = round(days % 1 * 86400)
    moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=int(days // 1), seconds=seconds)
    return moment.strftime("%Y-%m-%d") if not seconds else moment.strftime("%Y-%m-%d %H:%M:%S")


@dataclass
class Block(InputPartition):
    """Rows `first` to `last` (from 1; no end: None) of a sheet; the first row of the sheet is position `at`."""

    file: str
    part: str
    first: int
    last: int | None
    at: int


def _from_row(book: zipfile.ZipFile, part: str, first: int) -> tuple[int, Iterator[bytes]]:
    """The number of the first row from `first` on, and the bytes of the sheet from there."""
    held, n, source = b"", 0, _chunks(book, part)
    for chunk in source:
        held += chunk
        place = 0
        for found in _ROW.finditer(held):
            told = _NUMBER.search(found[0])
            n, place = int(told[1]) if told else n + 1, found.end()
            if n >= first:
                rest = held[found.start():]

                def data(rest=rest) -> Iterator[bytes]:
                    yield rest
                    yield from source

                return n, data()
        held = held[max(place, held.rfind(b"<")):] if b"<" in held[place:] else b""
    return 0, iter(())


def _row_data(data: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes up to the end of the sheet's rows, under a root of their own."""
    yield b"<rows>"
    held = b""
    for chunk in data:
        held += chunk
        found = _END.search(held)
        if found:
            yield held[:found.start()]
            break
        yield held[:-64]
        held = held[-64:]
    else:
        yield held
    yield b"</rows>"


def read_block(block: Block) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of the rows of a block; missing rows are left out."""
    with _open(block.file) as book:
        n, data = _from_row(book, block.part, block.first)
        if not n or (block.last and n > block.last):
            return
        shared = _shared(book)
        dates, base = _date_styles(book)
        cells: list[str | None] = []
        value = inline = None
        row, column = n - 1, -1
        for tag, a, text in _elements(_row_data(data)):
            if tag == "v":
                value = text
            elif tag == "t":
                inline = (inline or "") + text
            elif tag == "c":
                column = column_number(re.match("[A-Z]+", a["r"])[0]) if "r" in a else column + 1
                kind, out = a.get("t", "n"), None
                if kind == "s" and value is not None:
                    out = shared[int(value)]
                elif kind == "inlineStr":
                    out = inline
                elif kind == "b" and value is not None:
                    out = "True" if value == "1" else "False"
                elif kind == "n" and value is not None and value.strip():
                    out = date_text(value, base) if int(a.get("s", 0)) in dates else number_text(value.strip())
                elif kind in ("str", "e", "d"):
                    out = value
                cells += [None] * (column + 1 - len(cells))
                cells[column] = out
                value = inline = None
            elif tag == "row":
                row = int(a["r"]) if "r" in a else row + 1
                if block.last and row > block.last:
                    return
                yield row, cells
                cells, column = [], -1


def merged_cells(book: zipfile.ZipFile, part: str) -> list[tuple[int, int, int, int]]:
    """(top row, left column, bottom row, right column) of the merged ranges of a sheet, which stand behind its rows."""
    held, out = b"", []
    for chunk in _chunks(book, part):
        held += chunk
        place = 0
        for m in _MERGE.finditer(held):
            out.append((int(m[2]), column_number(m[1]), int(m[4]), column_number(m[3])))
            place = m.end()
        held = held[max(place, len(held) - 512):]
    return out


def sheet_size(book: zipfile.ZipFile, part: str) -> tuple[int, int]:
    """Rows and columns of a sheet: as it says itself, or else by its cells, which are found without parsing."""
    head = next(_chunks(book, part), b"")
    told = _SIZE.search(head)
    if told and (told[1], told[2]) != (b"A", b"1"):
        return int(told[2]), column_number(told[1]) + 1
    row = column = rows = columns = 0
    held = b""
    for chunk in _chunks(book, part):
        held += chunk
        place = 0
        for m in _TAG.finditer(held):
            place = m.end()
            if m[1] == b"row":
                row, column = int(m[3]) if m[3] else row + 1, 0
            else:
                column = column_number(m[2]) + 1 if m[2] else column + 1
            rows, columns = max(rows, row), max(columns, column)
        held = held[max(place, held.rfind(b"<")):] if b"<" in held[place:] else b""
    return rows, columns


def wanted_sheets(path: str, wanted: str) -> list[tuple[str, str]]:
    """(file, part of the archive) of the sheets asked for, in order of files and sheets."""
    found = []
    for file in workbook_files(path):
        with _open(file) as book:
            kept = [(file, p) for i, (name, p) in enumerate(sheet_parts(book)) if wanted in ("*", name, str(i))]
        if not kept:
            raise ValueError(f"no sheet {wanted!r} in {file}")
        found += kept
    return found


def measured(sheet: tuple[str, str]) -> tuple[str, str, int, int]:
    """(file, part, rows, columns) of a sheet."""
    with _open(sheet[0]) as book:
        return (*sheet, *sheet_size(book, sheet[1]))


class WorkbookSource(DataSource):
    """Options: `path` (file, or folder of files), `sheet` (name or number; all sheets: `*`; the first one otherwise), `block`
    (rows in a partition, or a 16th of the sheet if that is more). Columns: `_rid` and the cells `_c0` ... as text, null where empty. `_rid` is the row's position in its
    sheet; each further sheet begins at the next multiple of a sheet's largest size. Rows without cells give rows of nulls where rows with cells
    follow. Merged cells all have the text of the first. Numbers are written plainly, dates as ISO text, formulas as their last value."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _sheets(self) -> list[tuple[str, str, int, int]]:
        if not hasattr(self, "_found"):
            if "sizes" in self.options:  # as `read_workbook` found them in tasks
                self._found = [tuple(x) for x in json.loads(self.options["sizes"])]
            else:
                self._found = [measured(x) for x in wanted_sheets(self.options["path"], self.options.get("sheet", "0"))]
        return self._found

    def schema(self) -> str:
        width = max([columns for *_, columns in self._sheets()], default=0)
        return ", ".join(["_rid long", *[f"_c{i} string" for i in range(width)]])

    def reader(self, schema: StructType) -> DataSourceReader:
        block, parts = int(self.options.get("block", BLOCK)), []
        for k, (file, part, rows, _) in enumerate(self._sheets()):
            step = max(block, -(-rows // PARTS))
            firsts = list(range(1, max(rows, 1) + 1, step))
            parts += [Block(file, part, a, a + step - 1 if a != firsts[-1] else None, k * MAX_ROWS) for a in firsts]
        return WorkbookReader(parts, len(schema) - 1)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options["path"], schema.names, overwrite)


class WorkbookReader(DataSourceReader):
    def __init__(self, blocks: list[Block], width: int):
        self.blocks, self.width = blocks, width

    def partitions(self) -> list[Block]:
        return self.blocks

    def read(self, block: Block) -> Iterator[tuple]:
        with _open(block.file) as book:
            merged = merged_cells(book, block.part)
        corners = {(top, left): None for top, left, *_ in merged}
        above = [top for top, *_, bottom, _ in merged if top < block.first <= bottom]
        if above:  # texts of ranges that begin in an earlier block
            for row, cells in read_block(Block(block.file, block.part, min(above), block.first - 1, 0)):
                corners.update({(row, c): v for c, v in enumerate(cells) if (row, c) in corners})
        ends = sorted(merged)
        due, live, expected = 0, [], block.first

        def filled(row: int, cells: list[str | None]) -> tuple:
            nonlocal due, live
            while due < len(ends) and ends[due][0] <= row:
                live.append(ends[due])
                due += 1
            live = [m for m in live if m[2] >= row]
            out = (cells + [None] * self.width)[:self.width]
            for top, left, _, right in live:
                if top == row:
                    corners[top, left] = out[left]
                out[left:right + 1] = [corners[top, left]] * len(out[left:right + 1])
            return (block.at + row - 1, *out)

        for row, cells in read_block(block):
            for gap in range(expected, row):
                yield filled(gap, [])
            yield filled(row, cells)
            expected = row + 1
        for gap in range(expected, (block.last or 0) + 1):
            yield filled(gap, [])


@dataclass
class Written(WriterCommitMessage):
    draft: str
    final: str


class WorkbookWriter(DataSourceWriter):
    """One workbook per partition, with a header row; text and dates as text, numbers as numbers. A sheet that is full is
    followed by another. Files get their names when the whole write has ended."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.run = path.rstrip("/"), names, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        store, inside = _store(self.path)
        store.create_dir(inside, recursive=True)
        n = TaskContext.get().partitionId()
        draft, final = f"{inside}/.{self.run}-{uuid.uuid4().hex}", f"{inside}/part-{n:05d}-{self.run}.xlsx"
        with store.open_output_stream(draft) as out:
            write_sheets(out, self.names, rows)
        return Written(draft, final)

    def commit(self, messages: list) -> None:
        store, inside = _store(self.path)
        if self.overwrite:
            for old in workbook_files(self.path):
                store.delete_file(_store(old)[1])
        for m in messages:
            if m is not None:
                store.move(m.draft, m.final)

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.draft)


#: How the characters of a text are written that stand for themselves in no sheet, or in none at all.
_WRITTEN = {c: None for c in (*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF)} | {ord(c): x for c, x in {"&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#13;"}.items()}


def _cell_xml(place: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        if value == value and abs(value) != float("inf"):
            return f'<c r="{place}"><v>{value}</v></c>'
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{str(value).translate(_WRITTEN)}</t></is></c>'


def write_sheets(out, names: list[str], rows: Iterator, limit: int = MAX_ROWS) -> None:
    """Write a workbook of as many sheets as `rows` need to the stream `out`, row by row."""
    letters = [column_letters(i) for i in range(len(names))]
    rows, sheets, waiting = iter(rows), 0, True
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        while waiting or not sheets:
            sheets += 1
            with book.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
                n, waiting = 1, False
                f.write(_row_xml(n, letters, names))
                for row in rows:
                    n += 1
                    f.write(_row_xml(n, letters, row))
                    if n == limit:
                        waiting = True
                        break
                f.write(b"</sheetData></worksheet>")
        ids = range(1, sheets + 1)
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>' + "".join(f'<sheet name="Sheet{i}" sheetId="{i}" r:id="rId{i}"/>' for i in ids) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(
            f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>")
        book.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        book.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                      f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(
                          f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in ids) + "</Types>")


def _row_xml(n: int, letters: list[str], values) -> bytes:
    return (f'<row r="{n}">' + "".join(_cell_xml(f"{c}{n}", v) for c, v in zip(letters, values)) + "</row>").encode()


def read_workbook(spark: SparkSession, path: str, sheet: str = "0", block: int = BLOCK) -> DataFrame:
    """The cells of a sheet of the workbooks under `path` as a grid, as `read_grid` gives it for delimited files."""
    spark.dataSource.register(WorkbookSource)
    sheets = wanted_sheets(path, sheet)
    # a sheet that does not tell its size is inflated for it, so that each has a task of its own
    sizes = spark.sparkContext.parallelize(sheets, len(sheets)).map(measured).collect() if sheets else []
    return spark.read.format("workbook").options(path=path, sheet=sheet, block=str(block), sizes=json.dumps(sizes)).load()


def write_workbooks(df: DataFrame, path: str) -> None:
    """One workbook per partition of `df` in the folder `path`; what is there goes."""
    df.sparkSession.dataSource.register(WorkbookSource)
    df.write.format("workbook").mode("overwrite").option("path", path).save()
