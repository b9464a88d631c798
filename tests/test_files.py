"""Whole files: traps are flagged, clean files stay clean, unpacking is bounded."""

import json

import pytest
from pyspark.sql import functions as F

from lumen.plans import report
from lumen.plans.scan import scan_files, scan_records
from lumen.sources import unpack
from tests import fixtures

EXPECTED = {
    "trap.docx": {"Hidden text", "Data appended after file end", "Orphaned part", "Document variables", "Unicode smuggling (tag characters)", "Invisible characters", "Tracked deletions retained", "Field code", "Remote template", "Dangerous hyperlink", "Document metadata", "Malicious XML construct", "Possible AI prompt injection"},
    "trap.xlsx": {"Very hidden sheet", "Hidden cell content", "Cells in hidden rows/columns", "Data far outside main area", "Data on hidden sheet", "DDE formula"},
    "trap.pptx": {"Hidden text", "Hidden slide", "Speaker notes"},
    "trap.pdf": {"Hidden text", "Data appended after file end", "JavaScript", "Document metadata", "Orphaned objects"},
    "trap.eml": {"Hidden HTML text", "Deceptive link", "Tracking pixel", "Plain-text part differs from HTML", "Reply-To differs from sender", "Authentication failure", "Attachments", "Message headers"},
    "trap.txt": {"Whitespace steganography pattern", "Content after large blank gap", "Unicode smuggling (tag characters)"},
    "trap.rtf": {"Hidden text", "Data appended after file end"},
    "trap.odt": {"Hidden text", "Macros", "Comments"},
    "page.html": {"Hidden HTML text", "Possible AI prompt injection"},
    "cells.csv": {"CSV formula injection"},
    "wrong.pdf": {"File type mismatch"},
    "image.png": {"Data appended to image"},
}


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, make in fixtures.FILES.items():
        (folder / name).write_bytes(make())
    (folder / "left.out").write_bytes(b"not a supported extension")
    return scan_files(spark, str(folder), include_all=True)


@pytest.fixture(scope="module")
def found(scan):
    out = {}
    roots = {r["artifact_id"]: r["root_id"] for r in scan.artifacts.collect()}
    for r in scan.findings.collect():
        out.setdefault(roots[r["artifact_id"]].rsplit("/", 1)[-1], []).append(r)
    return out


def test_no_errors(scan):
    assert [(r["artifact_id"], r["message"]) for r in scan.errors.collect()] == []


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_traps(found, name):
    assert EXPECTED[name] <= {r["category"] for r in found[name]}
    assert name in ("wrong.pdf", "image.png") or any(r["severity"] == "HIGH" for r in found[name])


@pytest.mark.parametrize("name", ["clean.docx", "clean.xlsx", "clean.pptx", "clean.pdf", "clean.txt"])
def test_clean(found, name):
    assert [(r["category"], r["detail"]) for r in found.get(name, []) if r["severity"] in ("HIGH", "MEDIUM")] == []


def test_details(found):
    said = lambda name, category: " ".join(r["detail"] + r["snippet"] for r in found[name] if r["category"] == category)
    assert "covered by the opaque shape 'lid'" in said("trap.pptx", "Hidden text") and "off the slide" in said("trap.pptx", "Hidden text")
    assert all(x in said("trap.pdf", "Hidden text") for x in ("tiny words", "mode three", "covered words", fixtures.ORDER)) and "Visible" not in said("trap.pdf", "Hidden text")
    assert "AZ9000" in said("trap.xlsx", "Data far outside main area") and "masked away" in said("trap.xlsx", "Hidden cell content")


def test_children_and_verdicts(scan):
    rows = scan.artifacts.collect()
    assert any(r["name"] == "invoice.docx" and r["depth"] == 1 and r["kind"] == "ooxml" for r in rows)
    assert any(r["name"] == "note.txt" and r["depth"] == 2 for r in rows)
    verdict = {r["artifact_id"].rsplit("/", 1)[-1]: r["verdict"] for r in scan.verdicts().collect()}
    assert verdict["trap.docx"] == "Suspicious" and verdict["clean.txt"] == "Clean" and verdict["nested.zip"] == "Suspicious"


def test_exports(scan):
    trees = [json.loads(t) for t in scan.json()]
    mail = next(t for t in trees if t["path"].endswith("trap.eml"))
    assert mail["children"][0]["path"] == "invoice.docx" and mail["children"][0]["counts"]["HIGH"] > 0 and mail["counts"]["HIGH"] > mail["children"][0]["counts"]["HIGH"]
    order = [report.rules.SEVERITIES.index(f["severity"]) for f in mail["findings"]]
    assert order == sorted(order)
    assert json.loads(report.to_json(scan.json()))[0].keys() == mail.keys()
    assert "invoice.docx" in "\n".join(report.console(mail)) and "<section" in report.to_html(trees, "today")


def test_extension_filter(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x")
    (tmp_path / "b.out").write_bytes(b"x")
    assert unpack.list_files(spark, str(tmp_path)).count() == 1 and unpack.list_files(spark, str(tmp_path), True).count() == 2


def test_budget(spark):
    four = fixtures.package({f"p{k}.txt": b"\0" * (8 << 20) for k in range(4)}, types=False)
    big = fixtures.package({"p.txt": b"\0" * (300 << 20)}, types=False)
    for raw, total in ((four, 20 << 20), (big, 1 << 30), (fixtures.trap_docx(), 1000)):
        rows = unpack.Unpacker("x", unpack.Budget(total)).run("x.zip", raw)
        assert any(r.get("context") == "Decompression limit exceeded" for r in rows)


def test_large_files_are_not_opened(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x" * 100)
    rows = unpack.unpack(unpack.list_files(spark, str(tmp_path)), max_file=10)
    scan = scan_records(spark, rows)
    assert scan.findings.count() == 0 and scan.errors.count() == 1 and [r["verdict"] for r in scan.verdicts().collect()] == ["Partial"]


def test_streams_and_slack(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain words")
    path = spark.read.format("binaryFile").load(str(tmp_path)).first()["path"]
    ads = spark.createDataFrame([(path, 1, ":secret:$DATA", 9, bytearray(b"hidden words")), (path, 2, "Zone.Identifier", 9, bytearray(b"[ZoneTransfer]\nZoneId=3"))], "artifact_id string, seq long, stream string, size long, content binary")
    slack = spark.createDataFrame([(path, "ok", None, None, bytearray(b"PK\x03\x04 leftover data")), ("other", "ok", None, None, bytearray(b"x"))], "path string, status string, title string, message string, slack binary")
    got = {(r["category"], r["severity"]) for r in scan_files(spark, str(tmp_path), ads=ads, slack=slack).findings.collect()}
    assert {("Hidden alternate data stream", "HIGH"), ("Mark of the Web", "INFO"), ("Data in file slack", "HIGH")} <= got


@pytest.mark.parametrize(("name", "raw", "kind"), [("a.msg", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "msg"), ("a", b"  {\\rtf1}", "rtf"), ("a", b"x%PDF-1", "pdf"), ("a", b"From: a\r\nSubject: b\r\n\r\nx", "eml"), ("a", b"plain", "text"), ("a", bytes(range(32)) * 9, "binary"), ("a", b"PK\x03\x04broken", "binary"), ("a", b"PK\x03\x04broken" + b" words" * 9, "text"), ("a", b"", "text")])
def test_detect(name, raw, kind):
    assert unpack.detect(name, raw) == kind


def test_decode():
    assert unpack.decode("é".encode("utf-16")) == ("é", "utf-16") and unpack.decode(b"\xe9") == ("é", "cp1252") and unpack.decode("ab".encode("utf-16-le"))[1] == "utf-16-le" and unpack.decode(b"\xef\xbb\xbfa") == ("a", "utf-8-sig")


def test_facts_stay_spread(scan):
    assert scan.findings.where(F.col("severity").isNull()).count() == 0


def test_text_over_a_scan_is_an_ocr_layer(spark, tmp_path):
    words = lambda t: f"BT 3 Tr /F1 12 Tf 72 700 Td ({t}) Tj ET"
    image = lambda w, h: f"q {w} 0 0 {h} 0 0 cm /Im0 Do Q "
    for name, content in {"scan": image(612, 792) + words("words read from a scan"), "small": image(300, 300) + words("words read from a scan"), "order": image(612, -792) + words(fixtures.ORDER)}.items():
        (tmp_path / f"{name}.pdf").write_bytes(fixtures.pdf_file(content))
    got = {}
    for r in scan_files(spark, str(tmp_path)).findings.collect():
        got.setdefault(r["artifact_id"].rsplit("/", 1)[-1], {})[r["category"]] = (r["severity"], r["location"], r["snippet"])
    assert got["scan.pdf"]["OCR text layer"] == ("INFO", "Page 1", "words read from a scan") and "Hidden text" not in got["scan.pdf"]
    assert got["small.pdf"]["Hidden text"][0] == "HIGH" and "OCR text layer" not in got["small.pdf"]
    assert "Hidden text" not in got["order.pdf"] and got["order.pdf"]["Possible AI prompt injection"][1] == "Page 1 (OCR layer)"


def test_long_chains_do_not_stop_other_files(spark, tmp_path):
    from lumen.operators import sequences

    chain = [("a", k, k + 1) for k in range(400)] + [("a", 400, 0), ("a", 900, 901), ("b", 7, 8)]
    edges = spark.createDataFrame(chain, "file string, src int, dst int")
    starts = spark.createDataFrame([("a", 0), ("b", 7), ("c", 1)], "file string, node int")
    got = {tuple(r) for r in sequences.reachable(edges, starts, ["file"]).collect()}
    assert got == {("a", k) for k in range(401)} | {("b", 7), ("b", 8), ("c", 1)}
    outline = "".join(f"{k} 0 obj\n<< /Title (entry {k}) /Next {k + 1} 0 R >>\nendobj\n" for k in range(20, 320))
    pdf = fixtures.pdf_file("BT /F1 12 Tf 72 700 Td (Visible words) Tj ET").replace(b"/Type /Catalog", b"/Type /Catalog /Outlines 20 0 R", 1)
    at = pdf.rfind(b"xref")
    (tmp_path / "long.pdf").write_bytes(pdf[:at] + outline.encode() + b"320 0 obj\n<< /Title (last) >>\nendobj\n" + pdf[at:])
    (tmp_path / "plain.txt").write_bytes(fixtures.trap_txt())
    scan = scan_files(spark, str(tmp_path))
    rows = scan.findings.collect()
    assert any(r["artifact_id"].endswith("plain.txt") for r in rows) and [r["detail"][-3:] for r in rows if r["category"] == "Orphaned objects"] == [": 7"]  # the fixture has one


def test_streams_of_common_programs_are_benign(spark):
    from lumen.operators import documents

    names = ["com.dropbox.attrs", "com.dropbox.attributes", "encryptable", "OECustomProperty", "ms-properties", "{4c8cc155-6c1e-11d1-8e41-00c04fb9386d}", "com.apple.quarantine", "AFP_AfpInfo", "favicon", "encryptable2"]
    ads = spark.createDataFrame([("f", k, n, 4, bytearray(b"abcd")) for k, n in enumerate(names)], "artifact_id string, seq long, stream string, size long, content binary")
    got = {r["location"]: r["severity"] for r in documents.streams(ads).collect()}
    assert got == dict.fromkeys(names[:8], "INFO") | {"favicon": "HIGH", "encryptable2": "HIGH"}


def test_readers_of_structures():
    import io
    import struct
    import zipfile
    import zlib

    from lumen.sources.formats import Directory, Rtf, image_extra, strings

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "hello " * 99)
        z.writestr("ü/b.txt", "x")
        z.comment = b"said"
    for before in (b"", b"bytes in front"):
        d = Directory(before + held.getvalue() + b"behind")
        with zipfile.ZipFile(io.BytesIO(before + held.getvalue())) as z:
            assert [(m.name, m.start) for m in d.members()] == [(i.filename, i.header_offset) for i in z.infolist()]
        assert d.comment == b"said" and [m.stop for m in d.members()][-1] == d.start
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + chunk(b"IDAT", b"IEND inside") + chunk(b"IEND", b"")
    jpeg = b"\xff\xd8\xff\xe0\x00\x06\xff\xd9ab\xff\xda\x00\x04ab" + b"coded\xff\x00\xff\xd3more" + b"\xff\xd9"
    gif = b"GIF89a" + b"\x01\x00\x01\x00\x80\x00\x00" + b"\x00" * 6 + b"\x2c" + b"\x00" * 9 + b"\x02\x02;;\x00" + b"\x3b"
    for image in (png, jpeg, gif):
        assert image_extra(image) is None and image_extra(image + b"\0" * 99) is None
        for extra in (b"appended words, quite long", b"with marks IEND \xff\xd9 ; inside of it"):
            assert image_extra(image + extra)[1] == extra
    rtf = Rtf(r"{\rtf1{\fonttbl Arial;}{\colortbl;\red9\green9\blue9;\red250\green250\blue250;}seen{\v hidden {\b bold} \v0 back}{\*\generator none}\cf2 pale\plain\u233?\'e9\{x\}{\object\objdata 01ff}}")
    assert [(t, s.hidden) for t, s in rtf.runs] == [("seen", False), ("hidden bold ", True), ("back", False), ("pale", False), ("éé{x}", False)]
    assert rtf.pale() == {2} and rtf.runs[3][1].colour == 2 and [x for _, x in rtf.objects] == ["01ff"]
    assert strings(b"\0plain words\xffw\0i\0d\0e\0r\0s\0\xff") == ["plain words", "widers"]
