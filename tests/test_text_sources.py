"""Segmentation by a dictionary, office files, tables."""

import io
import itertools
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.operators import retrieval, segmentation
from corvane.sources import office


def plain_cut(run: str, costs: dict[str, int], unknown: int) -> list[str]:
    """The cheapest of all ways to cut a short run; of equals the one with longer words first."""
    best = None
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        ends = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(run)]
        words = [run[a:b] for a, b in itertools.pairwise(ends)]
        if all(w in costs or len(w) == 1 for w in words):
            key = (sum(costs.get(w, unknown) for w in words), [-len(w) for w in words])
            best = min(best, (key, words)) if best else (key, words)
    return best[1]


@pytest.fixture(scope="module")
def words(spark):
    rows = [("研究", 40), ("研究生", 12), ("生命", 30), ("生", 5), ("命", 2), ("起源", 9), ("的", 200), ("源", 3), ("大学", 20), ("大学生", 15), ("学生", 18), ("", 9), ("无", 0), (None, 3), ("的", 10)]
    return segmentation.dictionary(spark.createDataFrame(rows, "word string, n long"), spark.createDataFrame([("生命起源", 8), ("学生", 60)], "word string, n long"))


def test_segments_are_the_cheapest_paths(spark, words):
    costs = {r.word: r.cost for r in words.collect()}
    total = 40 + 12 + 30 + 5 + 2 + 9 + 210 + 3 + 20 + 15 + 60 + 8
    assert costs["学生"] == round(1e6 * math.log(total / 60)) and costs["的"] == round(1e6 * math.log(total / 210)) and "无" not in costs
    rng = random.Random(2)
    texts = ["".join(rng.choices("研究生命起源的大学X1 ", k=rng.randint(0, 14))) for _ in range(60)] + ["", None, "Plain text, 42", "研究生命起源。大学生的生命"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    import re

    want = {(i, k): plain_cut(run, costs, round(1e6 * math.log(total))) for i, t in enumerate(texts) for k, run in enumerate(re.findall("[一-鿿]+", (t or "").lower()))}
    assert {(r.id, r.run_no): r.words for r in segmentation.segmented(rows, words, "id").collect()} == want
    cut = segmentation.segmenter(words)
    got = {r.id: r.tokens for r in rows.select("id", cut("text").alias("tokens")).collect()}
    assert all((got[i] or []) == [w for (a, _), ws in sorted(want.items()) if a == i for w in ws] + re.findall("[a-z0-9]+", re.sub("[一-鿿]+", " ", (t or "").lower())) for i, t in enumerate(texts))
    docs = rows.where("text is not null").select(F.col("id").alias("doc_id"), "text")
    assert retrieval.postings(docs, tokenizer=cut).where("term = '大学生'").count() > 0


def test_large_dictionaries_do_not_go_to_tasks(spark, words, monkeypatch):
    monkeypatch.setattr(segmentation, "BROADCAST_WORDS", 3)
    with pytest.raises(ValueError, match="too large"):
        segmentation.segmenter(words)
    assert segmentation.segmented(spark.createDataFrame([(1, "的的")], "id long, text string"), words.limit(0), "id").first().words == ["的", "的"]


def _package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        for name, data in parts.items():
            package.writestr(name, data)
    return out.getvalue()


def test_docx_round_trip_and_broken_files(spark, tmp_path):
    texts = ["One\nTwo\tTabbed  spaces \n\nLast & <least>", "", "é中🙂\r\nend", None, "bell\x07gone"]
    made = office.as_docx(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    for r in made:
        if r.content is not None:
            (tmp_path / f"{r.id}.docx").write_bytes(bytes(r.content))
    (tmp_path / "9.docx").write_bytes(b"no zip at all")
    (tmp_path / "8.docx").write_bytes(_package({"other.xml": "<a/>"}))
    (tmp_path / "7.txt").write_text("not a docx")
    read = office.docx_documents(office.files(spark, str(tmp_path), "*.docx"), between="\n")
    got = {r.path.rsplit("/")[-1]: (r.text, r.n_paragraphs, r.problem) for r in read.collect()}
    assert {k: v[0] for k, v in got.items()} == {"0.docx": texts[0], "1.docx": "", "2.docx": texts[2], "4.docx": "bellgone", "8.docx": None, "9.docx": None}
    assert got["0.docx"][1] == 4 and got["0.docx"][2] is None and "BadZipFile" in got["9.docx"][2] and "KeyError" in got["8.docx"][2]
    assert office.docx_documents(office.files(spark, str(tmp_path), "*.docx").limit(0)).count() == 0


def test_docx_and_xlsx_tables(spark):
    cell = lambda t, span="": f"<w:tc>{span}<w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:p><w:r><w:t>before</w:t></w:r></w:p><w:tbl><w:tr>{cell('A')}{cell('B')}</w:tr><w:tr>{cell('both', '<w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr>')}</w:tr><w:tr>{cell(' 1 ')}<w:tc><w:tbl><w:tr>{cell('in')}</w:tr></w:tbl><w:p/></w:tc></w:tr></w:tbl>"
    docx = _package({"word/document.xml": f'<w:document xmlns:w="{office.W[1:-1]}"><w:body>{body}</w:body></w:document>'})
    rows = spark.createDataFrame([("t.docx", docx), ("bad", b"x"), ("none", None)], "path string, content binary")
    got = office.docx_tables(rows).collect()
    assert [(r.path, r.table_no, r.headers, r.rows) for r in got] == [("t.docx", 0, ["A", "B"], [["both", "both"], ["1", "in"]])]
    assert got[0].markdown == "| A | B |\n| --- | --- |\n| both | both |\n| 1 | in |"
    s, r = office.S[1:-1], office.R[1:-1]
    xlsx = _package({
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="First" r:id="x2"/><sheet name="Empty" r:id="x1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="x1" Target="worksheets/b.xml"/><Relationship Id="x2" Target="/xl/worksheets/a.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>Name</t></si><si><r><t>Wor</t></r><r><t>th</t></r></si></sst>',
        "xl/worksheets/a.xml": f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>x</t></is></c><c r="B3"><v>2.5</v></c><c r="C3" t="b"><v>1</v></c></row><row r="4"><c r="A4"/></row></sheetData></worksheet>',
        "xl/worksheets/b.xml": f'<worksheet xmlns="{s}"><sheetData/></worksheet>',
    })
    got = office.xlsx_tables(spark.createDataFrame([("t.xlsx", xlsx)], "path string, content binary")).collect()
    assert [(r.name, r.headers, r.rows, r.markdown) for r in got] == [("First", ["Name", "Worth"], [["x", "2.5", "True"]], "| Name | Worth |\n| --- | --- |\n| x | 2.5 |"), ("Empty", [], [], "")]


def test_html_tables_with_spans():
    page = """<table><tr><th>A<th colspan=2>B</tr><tr><td rowspan=3>1<td>2<td>3<tr><td rowspan="2" colspan="2">x <table><tr><td>inner</table> y<tr><tr><td>last</table>
      <table><tbody><tr><td rowspan=0>g</td><td>1</td></tr><tr><td>2</td></tr></tbody><tbody><tr><td>h<td>3</tr></tbody><table><td>open"""
    got = office.html_tables_of(page)
    assert [t["headers"] for t in got] == [["A", "B", "B"], ["inner"], ["g", "1"], ["open"]]
    assert got[0]["rows"] == [["1", "2", "3"], ["1", "x y", "x y"], ["1", "x y", "x y"], ["last"]]
    assert got[2]["rows"] == [["g", "2"], ["h", "3"]]
    assert office.html_tables_of(None) == office.html_tables_of("<p>none</p>") == []
