"""Office files: workbooks with twelve blocks, word-processor files with merged cells and formulas, trees, cursors."""

import io
import zipfile
from decimal import Decimal
from xml.etree import ElementTree

import pytest

from fathomline.functions import cursors, mathml
from fathomline.operators import assets
from fathomline.operators import workbook as op
from fathomline.plans.office import hub_sheet
from fathomline.sources import office

M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def frame(spark, *files):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")


def test_cells_round_trip_and_bad_files(spark):
    rows = [["a", None, 1.5], [], ["<&>", "=A1", 3]]
    good = office.workbook({"one": rows, "two": [[0.1]]})
    found = office.cells(frame(spark, ("x/good.xlsx", good), ("x/bad.xlsx", b"no zip"), ("x/empty.xlsx", b""))).collect()
    got = {(r.sheet, r.row, r.col): (r.value, r.formula) for r in found if r.problem is None}
    assert got == {("one", 1, 1): ("a", False), ("one", 1, 3): ("1.5", False), ("one", 3, 1): ("<&>", False), ("one", 3, 2): (None, True), ("one", 3, 3): ("3", False), ("two", 1, 1): ("0.1", False)}
    assert {r.file for r in found if r.problem} == {"x/bad.xlsx", "x/empty.xlsx"}


def test_profiles(spark):
    model = {s: [[None] * 81 + ["x"]] for s in op.MODEL_SHEETS}
    short = {s: [["x"]] for s in op.MODEL_SHEETS}
    hub = office.workbook({op.HUB_SHEET: hub_sheet([])})
    few = office.workbook({op.HUB_SHEET: [["Table 1"]]})
    files = frame(spark, ("d/hub-2024.xlsx", hub), ("d/hub.xlsx", hub), ("d/few-2024.xlsx", few), ("d/model.xlsx", office.workbook(model)), ("d/short.xlsx", office.workbook(short)), ("d/other.xlsx", office.workbook({"x": [["=1+1"]]})), ("d/bad.xlsx", b""))
    got = {r.file[2:-5]: r for r in op.profiles(office.cells(files)).collect()}
    assert {k: r.problem for k, r in got.items()} == {"hub-2024": None, "hub": "NO_EDITION_YEAR", "few-2024": "TABLES_DIFFER", "model": None, "short": "COLUMNS_MISSING", "other": "UNKNOWN_TEMPLATE", "bad": "UNREADABLE"}
    assert got["hub-2024"].edition_year == 2024 and got["hub-2024"].table_count == 12 and got["model"].version_label == "v1" and got["other"].formula_count == 1


def test_factors_of_the_twelve_tables(spark):
    content = office.workbook({op.HUB_SHEET: hub_sheet([("R1", "North", 1.5), ("R2", "South", 2)])})
    got = [r.asDict() for r in op.factors(spark, office.cells(frame(spark, ("d/hub-2024.xlsx", content)))).collect()]
    by = lambda code: [r for r in got if r["table_code"] == code]
    assert {r["table_code"] for r in got} == set(op.TABLES.values())
    coal = by("stationary_combustion")
    assert len(coal) == 7 and {r["category"] for r in coal} == {"Coal and Coke"} and {r["gas"]: r["denominator_unit"] for r in coal if r["gas"] == "HEAT_CONTENT"} == {"HEAT_CONTENT": "short ton"}
    assert sorted((r["gas"], r["denominator_unit"], r["factor_value"]) for r in coal if r["gas"] == "CO2") == [("CO2", "mmBtu", Decimal("103.69")), ("CO2", "short ton", Decimal(2602))]
    assert {(r["activity_name"], r["fuel_type"], r["model_year_raw"]) for r in by("mobile_onroad_alternative")} == {("Passenger Cars", "Diesel", "2020"), ("Passenger Cars", "Diesel", "2021"), ("Passenger Cars", "Biodiesel", "2021")}
    assert len(by("electricity")) == 14 and {r["source_note"] for r in by("electricity")} == {"Notes: by subregion\nsecond line"}
    waste = by("scope3_waste")
    assert sorted((r["treatment_method"], r["applicability"]) for r in waste) == [("Combusted", "AVAILABLE"), ("Composted", "NOT_APPLICABLE"), ("Landfilled", "AVAILABLE"), ("Recycled", "AVAILABLE")]
    gwp = {r["gas"]: (r["factor_value"], r["denominator_unit"], r["factor_basis"]) for r in by("gwp")}
    assert gwp == {"CO2": (1, "kg CO2", "100_YEAR_GWP"), "Old gas": (5, "kg Old gas", "100_YEAR_GWP_LOWER_BOUND")}
    assert [(r["gas"], r["category"]) for r in by("blended_refrigerant_gwp")] == [("R-401A", "53% HCFC-22")]
    assert {r["edition_year"] for r in got} == {2024} and list(got[0]) == [f.split()[0] for f in op.COLUMNS.split(", ")]


def test_no_workbooks(spark):
    none = office.cells(frame(spark).limit(0))
    assert op.factors(spark, none).count() == 0 and op.profiles(none).count() == 0


def test_word_blocks(spark):
    w = 'xmlns:w="urn:w"'
    cell = "<w:tc><w:tcPr>{}</w:tcPr><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>".format
    table = f"<w:tbl><w:tr>{cell('<w:gridSpan w:val=%s/>' % repr('2'), 'h')}</w:tr><w:tr>{cell('<w:vMerge w:val=%s/>' % repr('restart'), 'a|b')}{cell('', '1')}</w:tr><w:tr>{cell('<w:vMerge/>', '')}{cell('', '2')}</w:tr></w:tbl>"
    body = f"<w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>x is</w:t></w:r><m:oMath {M}><m:r><m:t>2</m:t></m:r></m:oMath><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:p/>{table}"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    got = [(r.block, r.kind, r.level, r.body) for r in office.blocks(frame(spark, ("a.docx", out.getvalue()))).orderBy("block").collect()]
    assert got == [(0, "heading", 2, "Title"), (1, "paragraph", 0, "x is $2$"), (2, "table", 0, "| h | h |\n| a\\|b | 1 |\n| a\\|b | 2 |")]
    assert office.blocks(frame(spark, ("a.docx", b"PK"))).first().problem


R = "<m:r><m:t>{}</m:t></m:r>".format


@pytest.mark.parametrize(
    "source, wanted",
    [
        (f"<m:f><m:num>{R('a')}</m:num><m:den>{R('b')}</m:den></m:f>", "\\frac{a}{b}"),
        (f"<m:sSubSup><m:e>{R('x')}</m:e><m:sub>{R('i')}</m:sub><m:sup>{R('2')}</m:sup></m:sSubSup>", "{x}_{i}^{2}"),
        (f"<m:rad><m:radPr><m:degHide m:val='1'/></m:radPr><m:deg/><m:e>{R('x')}</m:e></m:rad>", "\\sqrt{x}"),
        (f"<m:rad><m:deg>{R('3')}</m:deg><m:e>{R('x')}</m:e></m:rad>", "\\sqrt[3]{x}"),
        (f"<m:nary><m:naryPr><m:chr m:val='∑'/></m:naryPr><m:sub>{R('i')}</m:sub><m:sup>{R('n')}</m:sup><m:e>{R('x')}</m:e></m:nary>", "\\sum_{i}^{n}{x}"),
        (f"<m:d><m:dPr><m:begChr m:val='['/><m:endChr m:val=''/></m:dPr><m:e>{R('x')}</m:e></m:d>", "\\left[x\\right."),
        (f"<m:m><m:mr><m:e>{R('a')}</m:e><m:e>{R('b')}</m:e></m:mr><m:mr><m:e>{R('c')}</m:e><m:e>{R('d')}</m:e></m:mr></m:m>", "\\begin{matrix}a & b \\\\ c & d\\end{matrix}"),
        (f"<m:func><m:fName>{R('sin')}</m:fName><m:e>{R('x')}</m:e></m:func>", "\\sin{x}"),
        (R("50% of α"), "50\\% of \\alpha "),
    ],
)
def test_latex(source, wanted):
    assert mathml.latex(ElementTree.fromstring(f"<m:oMath {M}>{source}</m:oMath>")) == wanted


def test_file_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.pdf").write_bytes(b"123")
    (tmp_path / "y.pdf").write_bytes(b"1")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "z.txt").write_bytes(b"1")
    got = sorted((r.folders, r.depth, r.name, r.n_bytes) for r in office.file_tree(spark, str(tmp_path), "*.pdf").collect())
    assert got == [([], 0, "y.pdf", 1), (["a", "b"], 2, "x.pdf", 3)]


def test_cursors():
    key = cursors.signing_key("secret")
    c = cursors.encode(key, "wiki", {"q": "é"}, {"at": 3}, 1000)
    assert cursors.decode(key, c, "wiki", {"q": "é"}, 1000 + cursors.LIFETIME - 1) == {"at": 3}
    for changed, branch, bound, now in ((c, "other", {"q": "é"}, 1000), (c, "wiki", {"q": "e"}, 1000), (c, "wiki", {"q": "é"}, 1000 + cursors.LIFETIME), (c[:-2], "wiki", {"q": "é"}, 1000), ("x" + c, "wiki", {"q": "é"}, 1000), ("", "wiki", {"q": "é"}, 1000), (c.replace(".", "=."), "wiki", {"q": "é"}, 1000)):
        with pytest.raises(cursors.CursorError):
            cursors.decode(key, changed, branch, bound, now)
    with pytest.raises(cursors.CursorError):
        cursors.decode(cursors.signing_key("other"), c, "wiki", {"q": "é"}, 1000)
    with pytest.raises(ValueError):
        cursors.signing_key("")


def test_images_and_their_policy(spark):
    text = """![Logo](a.png) <!-- ODL_PAGE:2 -->\n<IMG alt='Flowchart of x' src="b c.png"> ![](<c chart.png>)\n<!-- ODL_PAGE:3 -->![x](d.png "t")<img alt="no source">"""
    found = assets.images(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    got = [(r.doc_id, r.occurrence, r.page, r.source_ref, r["class"]) for r in found.orderBy("doc_id", "occurrence").collect()]
    assert got == [(1, 1, None, "a.png", "decorative"), (1, 2, 2, "b c.png", "flowchart"), (1, 3, 2, "c chart.png", "chart"), (1, 4, 3, "d.png", "unknown")]
    said = spark.createDataFrame([(1, 2, 2, "steps of the process"), (1, 3, 3, "values of the year"), (1, 4, 3, "short")], "doc_id long, occurrence int, source_page int, summary string")
    judged = {r.occurrence: (r.status, r.searched, r.warnings) for r in assets.image_policy(found, said).collect()}
    assert judged == {
        1: ("NOT_REQUIRED", False, ["MISSING_IMAGE_PAGE_PROVENANCE", "PREVIEW_ONLY_CATEGORY"]),
        2: ("COMPLETE", True, []),
        3: ("INVALID", False, ["VISUAL_DESCRIPTION_PAGE_MISMATCH"]),
        4: ("INVALID", False, ["VISUAL_DESCRIPTION_TOO_SHORT"]),
    }
    none = assets.image_policy(found, said.limit(0)).where("doc_id = 1 and occurrence = 4").first()
    assert none.status == "REQUIRED" and none.warnings == ["VISUAL_DESCRIPTION_REQUIRED"]
