import io
import json
import zipfile

from sparvane.sources import formats, ingest, sinks
from sparvane.streaming import runs


def workbook(sheets):
    """An XML workbook of sheets given as rows of cells."""
    rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
    names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>gene</t></si><si><r><t>p </t></r><r><t>value</t></r></si></sst>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{''.join(rows)}</sheetData></worksheet>")
    return out.getvalue()


def word_file(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


FILES = {
    "Biomni/run_1/report.txt": ("Grüße\r\n".encode(), "Grüße\n"),
    "Biomni/run_1/old.txt": ("caf\xe9".encode("latin-1"), "café"),
    "Biomni/run_1/a.csv": (b"x;y\n1;2\n3;4\n", "x\ty\n1\t2\n3\t4"),
    "Biomni/run_1/chatgpt.json": (b'{"a":"\xc3\xa9"}', '{\n  "a": "é"\n}'),
    "Biomni/run_1/bad.json": (b"{", "{"),
    "k_dense/Run-2/log.jsonl": (b'{"message":{"role":"user","content":[{"type":"text","text":"hi"},"you"]}}\nplain\n{"a":1}\n{"type":"note","text":" t "}\n7', '[JSONL FILE: log.jsonl | lines=5]\n\n[user] hi you\n\nplain\n\n{"a":1}\n\n[note] t\n\n7'),
    "k_dense/Run-2/n.ipynb": (json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"], "outputs": [{"text": "3"}]}, {"cell_type": "raw", "source": "r"}]}).encode(), "[CODE]\na\nb\n\n[OUTPUT]\n3\n\nr"),
    "mine/r3/p.png": (b"\x89PNG", "[IMAGE FILE: p.png]"),
    "mine/r3/v.npy": (b"x" * 2_000_000, "[BINARY DATA FILE: v.npy, 1.9 MB]"),
    "mine/r3/c.toml": (b"[a]\nb=[1,2]\n", "[TOML FILE: c.toml]\na.b[0] = 1\na.b[1] = 2"),
    "mine/r3/bad.toml": (b"[", "["),
    "mine/r3/f.svg": (b'<svg xmlns="http://www.w3.org/2000/svg"><title>T</title><text>x <tspan>y</tspan></text><g aria-label="L"/></svg>', "[SVG FILE: f.svg]\n\nText elements (2):\nx y\ny\n\nLabels / tooltips (2):\nT\nL"),
    "mine/r3/fig2_volcano.svg": (b'<svg xmlns="http://www.w3.org/2000/svg"><metadata>by me</metadata><g id="axes_1"/><path id="DejaVuSans-41"/><path id="DejaVuSans-70"/><g id="zz"/></svg>', "[SVG FILE: fig2_volcano.svg]\n\nCharacters used in figure: A p\n\nFigure structure elements (1):\naxes_1\n\nFilename hint: fig2 volcano\n\nMetadata: by me"),
    "mine/r3/bad.ipynb": (b"{", "{"),
    "mine/r3/x.bin": (bytes(range(1, 32)) * 4 + b"\xff", None),
    "mine/r3/r.bib": (b"@article{k1,\n year = {2020},\n title = {A  B},\n note = \"n\",\n}\n", "[BIBTEX FILE: r.bib | entries=1]\n\n@ARTICLE {k1}\n  title: A  B\n  year: 2020\n  note: n"),
    "mine/r3/m.aux": (b"\\citation{b,a}\\citation{a}\n\\newlabel{s1}{{1}{4}{x}}", "[LATEX AUX: m.aux]\nCitations (2): a, b\n\nCross-reference labels (1):\n  s1 → page 1"),
    "mine/r3/m.toc": (b"\\contentsline {section}{\\numberline {1}Intro}{3}{x}\n\\contentsline {subsection}{More}{4}{x}", "[LATEX TOC: m.toc | entries=2]\n  section: Intro (p.3)\n    subsection: More (p.4)"),
    "mine/r3/m.out": (b"\\BOOKMARK [1][-]{s.1}{\\376\\377\\000A\\000b\\040c}{}% 1", "[LATEX BOOKMARKS: m.out | entries=1]\nDocument outline:\n  Ab c"),
    "mine/r3/w.xlsx": (workbook({"One": ['<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>', "<row/>", '<row><c r="A3"><v>2</v></c><c r="B3"><v>0.5</v></c><c r="C3" t="b"><v>1</v></c></row>'], "Two": []}), "[WORKBOOK: w.xlsx | sheets=2 | names=One, Two]\n\n=== Sheet: One ===\ngene\t\tp value\n2\t0.5\tTrue\n\n=== Sheet: Two ==="),
    "mine/r3/broken.xls": (b"nope", "[EXCEL FILE: broken.xls — file may be corrupt]"),
    "mine/r3/d.docx": (word_file("<w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"), "Hello\na\tb"),
    "mine/r3/q.pdf": (b"%PDF", "[PDF FILE: q.pdf — install PyMuPDF to parse]"),
    "mine/r3/empty.txt": (b"", ""),
}
LEFT_OUT = ["mine/r3/.DS_Store", "mine/r3/~$a.xlsx", "mine/r3/__MACOSX/z.txt", "tables/run_1/t.csv", "$RECYCLE.BIN/run_1/t.csv", "run_1/x.txt", "mine/none/a.txt"]


def test_tree_with_many_formats(spark, tmp_path):
    for name, content in [(n, c) for n, (c, _) in FILES.items()] + [(n, b"1") for n in LEFT_OUT]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    rows = {r.filename: r for r in ingest.read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {n.rpartition("/")[2] for n in FILES}
    for name, (_, text) in FILES.items():
        assert text is None or rows[name.rpartition("/")[2]].text == text, name
    assert (rows["log.jsonl"].agent, rows["log.jsonl"].run, rows["report.txt"].agent, rows["p.png"].run, rows["chatgpt.json"].agent) == ("KDense", 2, "Biomni", 3, "Biomni")
    assert rows["report.txt"].file_id == "Biomni__run1__report.txt" and rows["a.csv"].file_type == "table" and rows["report.txt"].extension == ".txt"


def test_long_tables_are_cut_with_a_mark():
    text = formats.parse(".tsv", "t.tsv", b"a\tb\n" * 10_001)
    assert text.count("\n") == 10_000 and text.endswith("[... truncated after 10000 rows ...]")
    assert formats.parse(".toml", "x.toml", None) == ""


def test_score_and_registry_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("agent,run,R,P,D,notes\n X ,1,10,20.5,x,n\n")
    (tmp_path / "r.csv").write_text("agent,run,interactive_mode,requested_metadata\nX,1, YES ,0\nY,2,,t\n")
    assert [tuple(r) for r in ingest.manual_scores(spark, str(tmp_path / "m.csv")).collect()] == [("X", 1, 10.0, 20.5, None)]
    assert ingest.manual_scores(spark, str(tmp_path / "r.csv")) is None and ingest.manual_scores(spark, str(tmp_path / "none.csv")) is None
    got = sorted(tuple(r) for r in ingest.run_registry(spark, str(tmp_path / "r.csv")).collect())
    assert got == [("X", 1, True, False, False, False, ""), ("Y", 2, False, False, True, False, "")]


def test_intensity_table(spark, tmp_path):
    (tmp_path / "i.csv").write_text("Molecule,Contr-1,Fibr-1,QC 1,other\nx,1,2,3,9\nx,4,nope,,9\nnan,1,1,1,1\ny,NaN,0,5,1\n")
    got = [tuple(r) for r in ingest.intensities(spark, str(tmp_path / "i.csv")).collect()]
    wanted = [("x", "Contr-1", "control", 1, 1.0), ("x", "Fibr-1", "case", 1, 2.0), ("x", "QC 1", "qc", 1, 3.0), ("x#1", "Contr-1", "control", 1, 4.0), ("x#1", "Fibr-1", "case", 1, None), ("x#1", "QC 1", "qc", 1, None), ("y", "Contr-1", "control", 1, None), ("y", "Fibr-1", "case", 1, 0.0), ("y", "QC 1", "qc", 1, 5.0)]
    assert sorted(map(str, got)) == sorted(map(str, wanted))


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(i, [i]) for i in range(40)], "a int, b array<int>")
    assert sinks.write_csv(table, str(tmp_path / "t")) and not sinks.write_csv(table.limit(0), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 40
    text = sinks.markdown(table, ["a"]).split("\n")
    assert len(text) == 32 and text[2] == "| 0 | [0] |" and text[-1] == "| 39 | [39] |"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x 1\ny"), ("a", 1, "FDR"), ("b", 2, None)], "agent string, run int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    query = runs.run_totals(runs.stream_corpus(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, runs.run_totals(rows).collect()))


def test_texts_as_columns(spark):
    from pyspark.sql import functions as F

    from sparvane.sources import texts

    cases = {
        ("plain", "a\r\nb\rc é".encode()): "a\nb\nc é", ("plain", b"caf\xe9\r"): "café\n", ("plain", b""): "",
        ("generic", b"\x00\x01\x02\x03\x04"): "[BINARY FILE: g — no readable text found]", ("generic", b"abc\nabcd  \n\x00\x01ab\nab\x00\xff cdefgh\n   \t  \n"): "abcd\nab\x00\ufffd cdefgh",
        ("anything", b" \n\t"): "[BINARY FILE: g — no readable text found]", ("anything", b"one"): "one",
        ("latex_toc", b"\\contentsline {section}{\\numberline {1}A \\LaTeX b}{3}\n\\contentsline{Chapter}{C}{9}"): "[LATEX TOC: g | entries=2]\n  section: A b (p.3)\n  Chapter: C (p.9)", ("latex_toc", b"none"): "none",
        ("latex_aux", b"\\citation{b, a}\\citation{a}\\newlabel{x}{{1}{7}}"): "[LATEX AUX: g]\nCitations (2): a, b\n\nCross-reference labels (1):\n  x → page 1", ("latex_aux", b"z"): "z",
        ("latex_out", b"\\BOOKMARK [1][-]{s.1}{\\376\\377\\000A\\000\\040\\000b}{}\n\\BOOKMARK [-1][-]{s}{\\bf }{}"): "[LATEX BOOKMARKS: g | entries=2]\nDocument outline:\n  A b",
        ("bibliography", b"@Article{k,\n year = 2001,\n note = {x {y}\nz},\n Title = \"T\",\n title = {U}\n}\n"): "[BIBTEX FILE: g | entries=1]\n\n@ARTICLE {k}\n  title: U\n  year: 2001\n  note: x {y} z", ("bibliography", b"@"): "@",
    }
    frame = spark.createDataFrame([(i, "g", c) for i, (_, c) in enumerate(cases)], "i int, name string, content binary")
    for i, ((reader, _), wanted) in enumerate(cases.items()):
        args = [F.col("content")] if reader == "plain" else [F.col("name"), F.col("content")]
        assert frame.filter(F.col("i") == i).select(getattr(texts, reader)(*args)).first()[0] == wanted, (i, reader)
