"""Text of XML parts, by hand."""

from pyspark.sql import functions as F

from millrace.functions import formats, markup

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def one(spark, xml, f):
    return spark.createDataFrame([(xml,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_word(spark):
    p = '<w:p><w:pPr/><w:r><w:t xml:space="preserve">a &amp; </w:t></w:r><w:r><w:tab/><w:t>b</w:t><w:t>c</w:t></w:r></w:p>'
    xml = f"<w:document {NS}><w:body>{p}<w:p/><w:p><w:r><w:t> </w:t></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>"
    assert one(spark, xml, markup.word_text) == "a & bc\nend"
    assert one(spark, f"<w:document {NS}><w:body/></w:document>", markup.word_text) == ""
    assert one(spark, "<w:document><w:body>", markup.word_text) is None and one(spark, None, markup.word_text) is None


def test_sheet(spark):
    strings = "<sst><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r></si><si/></sst>"
    assert one(spark, strings, markup.shared_strings) == ["one", "two", ""]
    xml = '<worksheet><sheetData><row r="2"><c r="AB2" t="s"><v>1</v></c><c r="A2"><v>7</v></c><c r="C2"/></row><row r="1"><c r="B1" t="b"><v>1</v></c><c r="A1" t="s"><v>9</v></c></row><row r="5"/></sheetData></worksheet>'
    cells = lambda x: markup.sheet_cells(x, F.array(F.lit("one"), F.lit("two")))
    assert sorted(tuple(c) for c in one(spark, xml, cells)) == [(1, 0, None), (1, 1, "TRUE"), (2, 0, "7"), (2, 27, "two")]
    assert one(spark, xml, lambda x: formats.grid(cells(x))) == "TRUE\n7\ttwo"
    assert one(spark, "<worksheet/>", cells) == [] and one(spark, "no xml", cells) is None
