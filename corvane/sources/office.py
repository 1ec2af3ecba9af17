"""Office files and HTML tables: DOCX texts and tables, XLSX sheets, tables with spans, and Markdown of all of these.

Files come as rows of Spark's ``binaryFile`` reader (path, content), so that Spark lists and
deals them. Parts of a package are read as streams, and elements are let go once read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a part of a package, unpacked, beyond which the file is refused.
MAX_PART = 1 << 28
#: The most rows and columns that HTML lets a cell span.
ROW_SPAN, COLUMN_SPAN = 65_534, 1000
TABLE = "struct<name: string, headers: array<string>, rows: array<array<string>>>"
#: Names of the file formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
#: What XML 1.0 has no way to write.
NOT_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content, length, modificationTime) of the files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def _part(package: zipfile.ZipFile, name: str) -> io.BufferedIOBase:
    if package.getinfo(name).file_size > MAX_PART:
        raise ValueError(f"{name} has more than {MAX_PART} bytes")
    return package.open(name)


def _read(content: bytes, of: Callable[[zipfile.ZipFile], object]):
    """What ``of`` makes of the package, and the reason if it cannot be read."""
    if content is None:
        return None, "no content"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            return of(package), None
    except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError, EOFError, NotImplementedError) as e:
        return None, f"{type(e).__name__}: {e}"[:300]


def _words(paragraph: ElementTree.Element) -> str:
    """A paragraph's text; tabs and line breaks are as in the text."""
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join((e.text or "") if e.tag == f"{W}t" else marks.get(e.tag, "") for e in paragraph.iter())


def docx_paragraphs(package: zipfile.ZipFile) -> list[str]:
    """All paragraphs in order, those of tables included."""
    found = []
    with _part(package, "word/document.xml") as part:
        for _, e in ElementTree.iterparse(part):
            if e.tag == f"{W}p":
                found.append(_words(e))
                e.clear()
    return found


def docx_tables_of(package: zipfile.ZipFile) -> list[dict]:
    """Tables of the body: the first row's cells are headers; a cell over several columns stands in each. Tables within cells are part of their text."""
    tables, depth = [], 0
    with _part(package, "word/document.xml") as part:
        for event, e in ElementTree.iterparse(part, events=("start", "end")):
            if e.tag == f"{W}tbl":
                depth += 1 if event == "start" else -1
                if event == "end" and not depth:
                    rows = []
                    for row in e.findall(f"{W}tr"):
                        cells = []
                        for cell in row.findall(f"{W}tc"):
                            text = "\n".join(_words(p) for p in cell.iter(f"{W}p")).strip()
                            span = cell.find(f"{W}tcPr/{W}gridSpan")
                            cells += [text] * (int(span.get(f"{W}val", "1")) if span is not None else 1)
                        rows.append(cells)
                    tables.append({"name": str(len(tables)), "headers": rows[0] if rows else [], "rows": rows[1:]})
                    e.clear()
            elif e.tag == f"{W}p" and event == "end" and not depth:
                e.clear()
    return tables


def xlsx_tables_of(package: zipfile.ZipFile) -> list[dict]:
    """A table of each sheet, in the workbook's order: headers are the first row's filled cells, rows those below with any filled cell."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in package.namelist():
        with _part(package, "xl/sharedStrings.xml") as part:
            for _, e in ElementTree.iterparse(part):
                if e.tag == f"{S}si":
                    shared.append("".join(t.text or "" for t in e.iter(f"{S}t")))
                    e.clear()
    with _part(package, "xl/_rels/workbook.xml.rels") as part:
        targets = {e.get("Id"): e.get("Target").removeprefix("/xl/") for e in ElementTree.parse(part).getroot()}
    with _part(package, "xl/workbook.xml") as part:
        sheets = [(e.get("name"), targets[e.get(f"{R}id")]) for e in ElementTree.parse(part).getroot().iter(f"{S}sheet")]
    tables = []
    for name, target in sheets:
        grid: dict[int, dict[int, str]] = {}
        with _part(package, f"xl/{target}") as part:
            for _, e in ElementTree.iterparse(part):
                if e.tag == f"{S}row":
                    number = int(e.get("r", len(grid) + 1))
                    for k, cell in enumerate(e.findall(f"{S}c")):
                        if (value := _cell(cell, shared)) is not None:
                            grid.setdefault(number, {})[_column(cell.get("r"), k)] = value
                    e.clear()
        width = 1 + max((c for row in grid.values() for c in row), default=-1)
        headers = [v for _, v in sorted(grid.get(1, {}).items())]
        rows = [[row.get(c, "") for c in range(width)] for number, row in sorted(grid.items()) if number > 1]
        tables.append({"name": name, "headers": headers, "rows": [row for row in rows if any(row)]})
    return tables


def _column(place: str | None, otherwise: int) -> int:
    """C7 is column 2."""
    letters = re.match("[A-Z]*", place or "")[0]
    number = 0
    for letter in letters:
        number = 26 * number + ord(letter) - 64
    return number - 1 if letters else otherwise


def _cell(cell: ElementTree.Element, shared: list[str]) -> str | None:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{S}t"))
    value = cell.findtext(f"{S}v")
    if value is None:
        return None
    return {"s": lambda: shared[int(value)], "b": lambda: str(value == "1")}.get(cell.get("t"), lambda: value)()


def docx_documents(rows: DataFrame, between: str = "\n\n", content: str = "content") -> DataFrame:
    """``rows`` with ``text`` (paragraphs with ``between``), n_paragraphs, and ``problem``, which says why a file could not be read (then text is null)."""

    @F.pandas_udf("text string, n_paragraphs int, problem string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_read(c, docx_paragraphs) for c in batch]
            yield pd.DataFrame([(between.join(p), len(p), None) if p is not None else (None, None, why) for p, why in found], columns=["text", "n_paragraphs", "problem"]).astype({"n_paragraphs": "Int32"})

    return rows.withColumn("_read", read(F.col(content))).select("*", "_read.*").drop("_read", content)


def _tables(rows: DataFrame, of: Callable[[zipfile.ZipFile], list[dict]], content: str) -> DataFrame:
    @F.pandas_udf(f"tables array<{TABLE}>, problem string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_read(c, of) for c in batch], columns=["tables", "problem"])

    return _one_row_each(rows.withColumn("_read", read(F.col(content))).select("*", "_read.*").drop("_read", content))


def _one_row_each(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c != "tables"]
    return rows.select(*others, F.posexplode("tables").alias("table_no", "t")).select(*others, "table_no", "t.*").withColumn("markdown", markdown("headers", "rows"))


def docx_tables(rows: DataFrame, content: str = "content") -> DataFrame:
    """A row for each table of DOCX files: the other columns, table_no, name, headers, rows, markdown. Files that cannot be read have none (``docx_documents`` says why)."""
    return _tables(rows, docx_tables_of, content)


def xlsx_tables(rows: DataFrame, content: str = "content") -> DataFrame:
    """The same for the sheets of XLSX files; numbers are as the file has them."""
    return _tables(rows, xlsx_tables_of, content)


def markdown(headers: Column | str, rows: Column | str) -> Column:
    """A table as Markdown, rows cut to the number of headers; empty if there are no rows."""
    h, r = (F.col(c) if isinstance(c, str) else c for c in (headers, rows))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |"))
    head = F.when(F.size(h) > 0, F.array(line(h), line(F.transform(h, lambda _: F.lit("---"))))).otherwise(F.array().cast("array<string>"))
    body = F.transform(r, lambda row: line(F.slice(row, 1, F.size(h))))
    return F.when(F.size(r) > 0, F.array_join(F.concat(head, body), "\n")).otherwise("")


class _Tables(HTMLParser):
    """Tables of a page as grids. A cell over several rows or columns stands in each place; tables within cells are tables of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list[list[str]]] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append({"rows": [], "below": {}, "cell": None, "place": len(self.found)})
            self.found.append([])
        elif self.open and tag == "tr":
            self._end_row()
            self.open[-1]["row"] = {}
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            if self.open[-1].get("row") is None:
                self.open[-1]["row"] = {}
            spans = dict(attrs) if attrs else {}
            self.open[-1]["cell"] = ([], self._span(spans.get("rowspan"), ROW_SPAN), max(1, self._span(spans.get("colspan"), COLUMN_SPAN))) if spans else ([], 1, 1)
        elif self.open and self.open[-1]["cell"] and tag in ("br", "p", "div", "li"):
            self.open[-1]["cell"][0].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        if tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "thead", "tbody", "tfoot"):
            self._end_row()
            if tag != "tr":
                self.open[-1]["below"] = {}  # cells do not reach over the end of a group
        elif tag == "table":
            self._end_row()
            table = self.open.pop()
            self.found[table["place"]] = table["rows"]

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][0].append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self.handle_endtag("table")

    @staticmethod
    def text(parts: list) -> str:
        """A cell's text, of the pieces that stand in it."""
        return " ".join("".join(parts).split())

    @staticmethod
    def _span(value: str | None, most: int) -> int:
        """A rowspan of 0 reaches to the end of its group."""
        if not value:
            return 1
        digits = re.match(r"\s*(\d{1,6})", value)
        return (min(most, int(digits[1])) or most) if digits else 1

    def _fill(self, row: dict[int, str], upto: int | None = None) -> int:
        """The first free column, after cells from above have come into those before it."""
        below, at = self.open[-1]["below"], 0
        if not below:
            # nothing from above: the row has no gaps
            return max(len(row), upto or 0)
        while at in row or (at in below and below[at][0] > 0) or (upto is not None and at < upto):
            if at not in row and at in below and below[at][0] > 0:
                row[at] = below[at][1]
                below[at] = (below[at][0] - 1, below[at][1])
            at += 1
        return at

    def _end_cell(self) -> None:
        table = self.open[-1]
        if table["cell"] is None:
            return
        parts, down, across = table["cell"]
        table["cell"] = None
        text = self.text(parts)
        at = self._fill(table["row"])
        for k in range(at, at + across):
            table["row"][k] = text
            if down > 1:
                table["below"][k] = (down - 1, text)

    def _end_row(self) -> None:
        self._end_cell()
        table = self.open[-1]
        row = table.pop("row", None)
        if row is None:
            return
        self._fill(row, 1 + max((k for k, (n, _) in table["below"].items() if n > 0), default=-1))
        if row:
            table["rows"].append([row.get(k, "") for k in range(1 + max(row))])


#: A tag as most pages write it, of which HTMLParser reads the same; its parts; its attributes.
_SPACE = r"[ \t\n\r\f]"
_PARTS = rf"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:{_SPACE}+[a-zA-Z-]+(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^ \t\n\r\f\v"'<>=`&/]+))?)*){_SPACE}*(/?)>"""
_TAG, _PARTS = re.compile("(" + re.sub(r"\((?!\?)", "(?:", _PARTS) + ")"), re.compile(_PARTS)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:=(?:"([^"]*)"|'([^']*)'|([^ \t\n\r\f]+)))?""")
#: Elements in which tags are text.
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "math", "svg"))
#: Layouts that a Python worker remembers at a time, and characters of the tags and cells of one at most.
LAYOUTS, LAYOUT_SIZE = 1024, 1 << 12
_known: dict[str, list | None] = {}


class _Layout(_Tables):
    """Tables whose cells are the places of their texts among a page's texts, and spaces."""

    text = staticmethod(tuple)


def _layout(tags: str) -> list[list[list[tuple]]] | None:
    """The tables of pages that have just these tags; None if the parser has to see their texts."""
    found = _PARTS.findall(tags)
    if any(name.lower() in _RAW or (attributes and (slash or own)) for slash, name, attributes, own in found):
        return None
    layout = _Layout()
    for place, (slash, name, attributes, own) in enumerate(found, 1):
        if not slash:
            layout.handle_starttag(name.lower(), [(a.lower(), x or y or z) for a, x, y, z in _ATTRIBUTE.findall(attributes)])
        if slash or own:
            layout.handle_endtag(name.lower())
        layout.handle_data(place)
    layout.close()
    return layout.found


def _known_layout(tags: str) -> list[list[list[tuple]]] | None:
    """``_layout``, small ones remembered."""
    if tags in _known:
        return _known[tags]
    layout = _layout(tags)
    if len(tags) <= LAYOUT_SIZE and sum(len(row) for rows in layout or () for row in rows) <= LAYOUT_SIZE:
        if len(_known) >= LAYOUTS:
            _known.clear()
        _known[tags] = layout
    return layout


def _grids(page: str) -> list[list[list[str]]]:
    """The tables of a page. Pages with the same tags have the same layout, which is found once for all of them."""
    pieces = _TAG.split(page)
    tags = "".join(pieces[1::2])
    if page.count("<") == len(pieces) // 2:
        layout = _known_layout(tags)
        if layout is not None:
            texts = [unescape(t) if "&" in t else t for t in pieces[::2]]
            cell = lambda parts: " ".join("".join([texts[x] if x.__class__ is int else x for x in parts]).split()) if len(parts) != 1 else " ".join(texts[parts[0]].split()) if parts[0] != " " else ""
            return [[[cell(parts) for parts in row] for row in rows] for rows in layout]
    parser = _Tables()
    parser.feed(page)
    parser.close()
    return parser.found


def html_tables_of(page: str | None) -> list[dict]:
    return [{"name": str(k), "headers": rows[0] if rows else [], "rows": rows[1:]} for k, rows in enumerate(_grids(page or ""))]


_TABLES = pa.list_(pa.struct([("name", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))]))


def html_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each table of HTML pages: the other columns, table_no, name, headers, rows, markdown. Null pages have none."""

    @F.arrow_udf(f"array<{TABLE}>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([html_tables_of(page) for page in batch.to_pylist()], _TABLES)

    return _one_row_each(pages.withColumn("tables", read(F.col(html))).drop(html))


def docx_of(text: str) -> bytes:
    """A DOCX file of a text, a paragraph for each line; characters that XML cannot hold are left out."""
    lines = NOT_XML.sub("", text).split("\n")
    body = "".join(f'<w:p><w:r>{"<w:tab/>".join(f"<w:t xml:space=\"preserve\">{escape(piece, {chr(13): "&#13;"})}</w:t>" for piece in line.split("\t"))}</w:r></w:p>' for line in lines)
    document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, data in (("[Content_Types].xml", TYPES), ("_rels/.rels", RELS), ("word/document.xml", document)):
            package.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def as_docx(docs: DataFrame, text: str = "text", out: str = "content") -> DataFrame:
    """``docs`` with the text as a DOCX file in column ``out``; null texts have none."""

    @F.pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else docx_of(t) for t in batch])

    return docs.withColumn(out, pack(F.col(text)))
