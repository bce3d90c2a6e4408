"""File sources: binaryFile scan, sniffing, validation, extraction (docx/xlsx written here)."""
import io
import tempfile
import zipfile

from docsift.sources.files import extract_text, scan_files, validate_files

DOCX_XML = ('<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
            '<w:p><w:r><w:t>INVOICE</w:t></w:r></w:p><w:p><w:r><w:t>Invoice Number: INV-1</w:t></w:r></w:p>'
            '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Total</w:t></w:r></w:p></w:tc>'
            '<w:tc><w:p><w:r><w:t>$10.00</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _zip(entries):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return buf.getvalue()


def make_files():
    d = tempfile.mkdtemp(prefix="docsift-files-")
    files = {
        "a.txt": b"INVOICE\nAmount: $5.00\n",
        "b.docx": _zip({"[Content_Types].xml": "x", "word/document.xml": DOCX_XML}),
        "c.xlsx": _zip({"[Content_Types].xml": "x",
                        "xl/workbook.xml": f'<workbook xmlns="{S}"><sheets><sheet name="Q1"/></sheets></workbook>',
                        "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>Total</t></si></sst>',
                        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData><row><c t="s"><v>0</v></c>'
                                                    '<c><v>42</v></c></row></sheetData></worksheet>'}),
        "d.pdf": b"%PDF-1.4 not really",
        "e.exe": b"MZ\x90\x00\xff\xfe\x00binary",
        "f.txt": b"",
        "g.png": b"plain text pretending",
        "h.py": b"print('x')\n",
    }
    for name, data in files.items():
        with open(f"{d}/{name}", "wb") as fh:
            fh.write(data)
    return d


def test_validate_and_extract(spark):
    d = make_files()
    v = validate_files(scan_files(spark, d))
    res = {r.path.rsplit("/", 1)[-1]: (r.mime, r.reject_reason) for r in v.collect()}
    assert res["a.txt"] == ("text/plain", None)
    assert res["b.docx"][1] is None and res["c.xlsx"][1] is None and res["d.pdf"][1] is None
    assert "f.txt" not in res                     # binaryFile lists no zero-byte files
    empty = spark.createDataFrame([("x/f.txt", 0, bytearray(b""), ".txt")],
                                  "path string, length long, content binary, extension string")
    assert validate_files(empty).first().reject_reason == "empty file"
    assert res["e.exe"][1].startswith("unsupported")
    assert res["g.png"][1] == "text file with invalid extension"
    assert res["h.py"][1] == "text file with invalid extension"
    ok = v.filter("reject_reason IS NULL")
    ex = {r.path.rsplit("/", 1)[-1]: (r.text, r.extract_error) for r in extract_text(ok).collect()}
    assert ex["a.txt"][0].startswith("INVOICE")
    assert ex["b.docx"][0] == "INVOICE\nInvoice Number: INV-1\nTotal\n$10.00"
    assert ex["c.xlsx"][0] == "Total 42\n--- End of Sheet: Q1 ---\n"
    assert ex["d.pdf"][0] is None and "NotImplementedError" in ex["d.pdf"][1]
