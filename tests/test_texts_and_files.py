"""Nested pages, code and variants in replies, workbooks, encodings."""

import io
import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F


class Outside(HTMLParser):
    """Text outside of nested blocks, by a parser of its own."""

    skip = {"nav", "header", "footer", "aside", "form", "iframe", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines = 0, []

    def handle_starttag(self, tag, attrs):
        self.open += tag in self.skip

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        self.open = max(0, self.open - (tag in self.skip))

    def handle_data(self, data):
        if not self.open and self.lasttag not in ("script", "style") or self.lasttag in ("script", "style") and not self.open and not self.rawdata.startswith(data):
            self.lines += [x.strip(" \t\f") for x in re.split(r"[\r\n]", data)]


def page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.randrange(8)
        word = f"w{rng.randrange(1000)}"
        if kind < 3 and depth < 6:
            tag = rng.choice(["nav", "NAV", "header", "footer", "aside", "form"])
            out.append(f"<{tag}{rng.choice(['', ' class=x', chr(10) + 'id=1'])}>{page(rng, depth + 1)}</{tag}>")
        elif kind == 3 and depth < 6:
            out.append(f"<div>{page(rng, depth + 1)}</div>")
        elif kind == 4:
            out.append(f"<navigation>{word}</navigation> &amp; <p>{word}&lt;b&gt;</p>")
        else:
            out.append(f"<p>{word}\n  {word} </p>")
    return "".join(out)


def test_nested_blocks(spark):
    from tickloom.functions.text import page_text

    rng = random.Random(1)
    pages = [page(rng) for _ in range(150)]
    pages += ["<nav>a<nav>b</nav>c</nav>d", "a</nav>b", "a<nav>b", "<nav/>a", "a<!-- <nav> -->b", "<script>var t='<nav>';</script>x<style>y</style>z", "plain", "", "<nav>" * 300 + "in" + "</nav>" * 300 + "out"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)] + [(-1, None)], "id long, html string").select("id", page_text("html", 0).alias("t"))
    got = {r["id"]: r["t"] for r in rows.collect()}
    for i, p in enumerate(pages):
        parser = Outside()
        parser.feed(re.sub(r"(?s)<(script|style)>.*?</\1>|<!--.*?-->", lambda m: "\n" if m[1] else "", p))
        parser.close()
        assert (got[i] or "").split("\n") == ([x for x in parser.lines if x] or [""]), p
    assert got[-1] in (None, "")
    long = spark.createDataFrame([("<p>" + "x" * 199 + "</p>",), ("<p>" + "x" * 200 + "</p>",)], "html string").select(page_text("html").alias("t"))
    assert sorted((r["t"] is None) for r in long.collect()) == [False, True]


def test_code_in_replies():
    from tickloom.functions.text import code_of, is_code

    assert code_of("Text (see below\n\nimport x\nx.y(\n  1,\n)\nSome words, then.") == "import x\nx.y(\n  1,\n)"
    assert code_of("if a:\n    b()\nelse:\n    c()\n\n\nAll done!") == "if a:\n    b()\nelse:\n    c()"
    assert code_of('t = """\nDear (all\n"""\nprint(t)\nYours, me') == 't = """\nDear (all\n"""\nprint(t)'
    assert code_of("def f():\n    return 1\n    and so on it goes\nmore prose, here") == "def f():\n    return 1"
    assert code_of("no code, none") == "" and code_of("import broken from\nstill") == "import broken from\nstill"
    prose = "\n".join(f"x = y, said he, number {i} (or so" for i in range(40))
    assert code_of(f"{prose}\nimport late\nlate.go()") == "import late\nlate.go()"  # beyond any number of false starts
    for n in (2_000, 20_000):
        began = time.time()
        code = "\n".join(f"x{i} = [\n    {i},\n]" for i in range(n))
        assert code_of("So:\n" + code + "\nThat, then, is it.") == code and is_code(code)
    assert time.time() - began < 20


def test_variants_and_lint():
    from tickloom.functions.text import LINT, variants_of

    part = lambda n, code: f"### VARIANT_{n} ###\n```python\n{code}\n```\n"
    head = "class Variant{}(bt.Strategy):\n    def next(self):\n        "
    checked = "if len(self.data) < 9:\n            return\n        "
    cases = [
        (head + checked + "pass", []), (head + "pass", ["bars"]), (head + checked + "x = self.position.price", ["price"]), (head + checked + "if self.position:\n            x = self.position.price", []),
        (head + checked + "if not self.position:\n            return\n        x = self.position.price", []), (head + checked + "y = bt.ind.OnBalanceVolume()", ["obv"]), (head + "y = OnBalanceVolume() + self.position.price", ["obv", "price", "bars"]),
        (head.replace("next", "step") + "pass", []),
    ]
    text = "Intro\n" + "text between\n".join(part(f"{i:02d}", c.format(i)) for i, (c, _) in enumerate(cases))
    assert [(v["number"], v["ok"], v["warnings"]) for v in variants_of(text)] == [(i, True, w) for i, (_, w) in enumerate(cases)]
    assert set(LINT) == {w for _, ws in cases for w in ws}
    assert variants_of(part("3", "class Other:\n    pass")) == [] == variants_of(None) == variants_of("### VARIANT_1 ### no code")
    assert [(v["number"], v["ok"]) for v in variants_of(part("5", "class Variant5(:\n  x"))] == [(5, False)]


def test_workbooks(spark, tmp_path):
    from tickloom.sources import xlsx

    rng = random.Random(2)
    odd = [None, "", " a ", "<&>\"'", "é漢😀", "line\nbreak", "1", "x\x01y"]
    rows = [(i, rng.choice([None, 1.5, -2e-300, 1e300]), rng.choice(odd), rng.choice([True, False, None])) for i in range(257)]
    df = spark.createDataFrame(rows, "i long, x double, t string, b boolean").repartitionByRange(3, "i").sortWithinPartitions("i")
    path = f"file://{tmp_path}/books"
    written = xlsx.write(df, path, most=60).collect()
    assert sum(r["rows"] for r in written) == 257 and all(r["rows"] < 60 for r in written) and len(written) > 4
    back = {int(r["i"]): (r["x"] and float(r["x"]), r["t"] or None, r["b"]) for r in xlsx.table(xlsx.read_cells(spark, path)).collect()}
    assert back == {i: (x, (t or "").replace("\x01", "") or None, None if b is None else str(b)) for i, x, t, b in rows}
    assert xlsx.read_cells(spark, path).select("path").distinct().count() == len(written)
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    with pytest.raises(Exception, match="is not a workbook"):
        xlsx.read_cells(spark, f"file://{tmp_path}/bad.xlsx").count()


def test_workbooks_of_other_writers():
    import zipfile

    from tickloom.sources.xlsx import column_name, column_number, rows_of

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="B" sheetId="2" r:id="r2"/><sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="t" Target="worksheets/one.xml"/><Relationship Id="r2" Type="t" Target="/xl/worksheets/two.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>")
        z.writestr("xl/worksheets/one.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2"><v>4.5</v></c></row><row><c t="s"><v>0</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/two.xml", f'<worksheet {ns}><sheetData><row r="7"/><row r="9"><c r="A9" t="str"><f>A1</f><v>made</v></c></row></sheetData></worksheet>')
    assert list(rows_of(f.getvalue())) == [("B", 7, []), ("B", 9, ["made"]), ("A", 2, [None, "rich text", *[None] * 24, "4.5"]), ("A", 3, ["plain", "1"])]
    assert [column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(column_number(column_name(i)) == i for i in range(2000))


def test_times_of_cells(spark):
    from tickloom.sources.xlsx import when

    got = [str(r[0]) for r in spark.createDataFrame([("43831",), ("43831.75",), ("2020-01-01 18:00:00",), ("43831.000011574",), ("never",), (None,)], "t string").select(when(F.col("t"))).collect()]
    assert got == ["2020-01-01 00:00:00", "2020-01-01 18:00:00", "2020-01-01 18:00:00", "2020-01-01 00:00:01", "None", "None"]


def test_the_encoding_that_reads_a_file_whole(spark, tmp_path):
    from tickloom.sources.files import read_bars, read_text

    for name, encoding in (("u", "utf-8"), ("l", "latin-1")):
        (tmp_path / f"{name}.csv").write_bytes("Date,Open,High,Low,Close,Note\n2020-01-01,1,2,0.5,1.5,café\n2020-01-02,1,2,0.5,x,né\n".encode(encoding))
        assert [r["Note"] for r in read_text(spark, f"file://{tmp_path}/{name}.csv").collect()] == ["café", "né"]
    assert read_bars(spark, f"file://{tmp_path}/l.csv").count() == 1
