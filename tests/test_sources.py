"""Files as a table."""

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from docmill.operators import access, layout
from docmill.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_files(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    cell = lambda x: f"<w:tc>{p(x)}</w:tc>"
    data = docx(p("One") + "<w:tbl><w:tr>" + cell("a") + cell("b") + '</w:tr></w:tbl><w:p><w:r><w:br w:type="page"/></w:r></w:p>' + p("Two"))
    hwpx = io.BytesIO()
    with zipfile.ZipFile(hwpx, "w") as z:
        for i in (10, 2):
            z.writestr(f"Contents/section{i}.xml", f'<s xmlns:h="x"><h:p pageBreak="{int(i > 2)}"><h:run><h:t>part {i}</h:t></h:run></h:p></s>')
    for name, content in {"a.docx": data, "b.docx": data, "c.hwpx": hwpx.getvalue(), "d.docx": b"broken", "e.pdf": b"", "f.txt": b"x"}.items():
        (root / name).write_bytes(content)
    found = files.checked(files.read_files(spark, f"{root}"))
    assert {r.filename: r.problem for r in found.collect()} == {
        "a.docx": None, "b.docx": "DUPLICATE", "c.hwpx": None, "d.docx": None, "f.txt": "TYPE",
    }
    texts = {r.filename: (r.text, r.page_count, r.error) for r in files.extract_text(found.where("problem IS NULL")).collect()}
    assert texts["a.docx"] == ("One\na | b\nTwo", 2, None)
    assert texts["c.hwpx"] == ("part 2\npart 10", 2, None)
    assert texts["d.docx"] == (None, None, "BadZipFile")


def test_roles_and_boxes(spark):
    df = spark.createDataFrame([("OWNER",), ("EDITOR",), ("VIEWER",), (None,)], "role string")
    allowed = [[r[0] for r in df.select(access.may(F.col("role"), a)).collect()] for a in ("read", "edit", "invite")]
    assert allowed == [[True, True, True, False], [True, True, False, False], [True, False, False, False]]
    ratio = spark.range(1).select(layout.overlap_ratio(*map(F.lit, (0.0, 0.0, 2.0, 1.0, 1.0, 0.0, 2.0, 1.0)))).first()[0]
    assert abs(ratio - 1 / 3) < 1e-9
