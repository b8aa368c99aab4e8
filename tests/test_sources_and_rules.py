"""PDF files, line edits, rules as tables."""

import zlib

import pytest

from lodestack.functions import edits
from lodestack.operators import rules
from lodestack.sources import files, pdf
from pyspark.sql import functions as F


def make_pdf(pages, compress=True, fonts=b"/F1 90 0 R", extra=()):
    """A file with one content stream a page."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))) + b"] /Count %d /Resources << /Font << " % len(pages) + fonts + b" >> >> >>", 90: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    for i, content in enumerate(pages):
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        body = zlib.compress(content) if compress else content
        objects[11 + 2 * i] = b"<< /Length %d %s>>\nstream\n" % (len(body), b"/Filter /FlateDecode " if compress else b"") + body + b"\nendstream"
    objects |= dict(extra)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_lines_and_pages(compress):
    first = rb"BT /F1 12 Tf 72 700 Td (Hello ) Tj (there \(you\)) Tj 0 -14 Td [(Sec) 20 (ond) -300 (line)] TJ T* ET"
    second = b"q 1 0 0 1 0 50 cm BT /F1 9 Tf 14 TL 1 0 0 1 72 600 Tm (caf\\351) Tj (next) ' ET Q"
    assert pdf.pages(make_pdf([first, b"", second], compress)) == ["Hello there (you)\nSecond line", "café\nnext"]
    assert pdf.convert(make_pdf([first], compress)) == [("", "Hello there (you)\nSecond line")]


def test_pdf_composite_fonts():
    cmap = b"2 beginbfchar <0001> <0041> <0002> <00E9> endbfchar 1 beginbfrange <0003> <0005> <0061> endbfrange 1 beginbfrange <0006> <0007> [<0078> <D83DDE00>] endbfrange"
    extra = {91: b"<< /Type /Font /Subtype /Type0 /ToUnicode 92 0 R >>", 92: b"<< /Length 9 >>\nstream\n" + cmap + b"\nendstream"}
    content = b"BT /F2 12 Tf 10 10 Td <0001000200030004000500060007> Tj ET"
    assert pdf.pages(make_pdf([content], fonts=b"/F2 91 0 R", extra=extra)) == ["Aéabcx😀"]


@pytest.mark.parametrize("data", [b"", b"%PDF", b"%PDF-1.4 /Encrypt 5 0 R", make_pdf([b""])])
def test_pdf_errors(data):
    with pytest.raises(ValueError, match="PDF converter"):
        pdf.pages(data)


def test_pdf_files_as_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make_pdf([b"BT /F1 12 Tf 1 1 Td (One) Tj ET", b"BT /F1 12 Tf 1 1 Td (Two) Tj ET"]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF broken")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.pdf"] == ("OneTwo", None) and got["b.pdf"][0] is None and "PDF" in got["b.pdf"][1]


def test_mailbox_quotes_and_line_ends():
    box = b"From a@b Thu\r\nSubject: One\r\n\r\nBody\r\n>From here on\r\n\r\nFrom c@d Fri\r\nSubject: Two\r\n\r\nWithin\r\n"
    assert [(s, t.replace("\r\n", "\n")) for s, t in files.mail(box)] == [("One", "Body\nFrom here on"), ("Two", "Within")]
    assert files.mail(b"") == []


def test_line_edits():
    text = "def f():\n    a = 1\n    b = 2\n    return a\n"
    assert edits.edit(text, "b = 2", "b = 3") == text.replace("b = 2", "b = 3")
    assert edits.edit(text, "a = 1\nb = 2", "a = 5\nb = 6") == "def f():\n    a = 5\nb = 6\n    return a\n"
    assert edits.edit(text, "  a = 1\n  b = 2", "  a = 5\n    b = 6") == "def f():\n    a = 5\n      b = 6\n    return a\n"
    assert edits.edit(text, "none", "x") is None and edits.edit("a\r\nb", "a\nb", "c") == "c" and edits.edit("x x", "x", "y") == "y x"
    assert edits.unified("a\nb\nc", "a\nx\nc", "n").split("\n") == ["--- n\toriginal", "+++ n\tmodified", "@@ -1,3 +1,3 @@", " a", "-b", "+x", " c"]
    assert edits.unified("a", "a") == ""


def test_rules(spark):
    requests = spark.createDataFrame([(1, "About METERING", 5.0), (2, "pls look", 80.0), (3, None, None), (4, "multi\nline", 1.0)], "id int, prompt string, size double")
    properties = {"prompt": F.col("prompt"), "size": F.col("size")}

    def targets(conditions, logic="AND", enabled=True):
        table = spark.createDataFrame([(1, 1, enabled, logic, "hit"), (2, 2, True, "AND", "empty")], "rule_id int, priority int, enabled boolean, logic string, target string")
        rows = spark.createDataFrame([(1, *c) for c in conditions], "rule_id int, property string, comparator string, value string")
        out = requests.select("id", rules.route(requests, table, rows, properties, ("size",)).alias("t")).collect()
        return {r.id for r in out if r.t == "hit"}

    assert targets([("prompt", "contains", " metering ,pls,")]) == {1, 2} and targets([("prompt", "contains", " , ")]) == set()
    assert targets([("prompt", "matches", "/^line/m")]) == {4} and targets([("prompt", "matches", "/ABOUT/g")]) == set() and targets([("prompt", "matches", "ABOUT")]) == {1} and targets([("prompt", "matches", "([")]) == set()
    assert targets([("size", "between", "5,80")]) == {1, 2} and targets([("size", "between", "5")]) == set() and targets([("size", "neq", "5")]) == {2, 4} and targets([("size", "gt", "x")]) == set()
    assert targets([("prompt", "eq", "PLS LOOK"), ("size", "lt", "3")]) == set() and targets([("prompt", "eq", "PLS LOOK"), ("size", "lt", "3")], "or") == {2, 4}
    assert targets([("unknown", "eq", "x")]) == set() and targets([("size", "lt", "3")], enabled=False) == set()
