import json

from pyspark.sql import functions as F

from millrace.functions import formats


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def parsed(rows, ddl):
    return F.from_json(F.lit(json.dumps(rows)), ddl)


def test_chat_and_mail(spark):
    m = parsed([{"author": " Ann ", "time": "2024-01-01T09:05:00Z", "text": " hi "}, {"text": "x"}, {"author": "B", "text": " "}], "array<struct<author:string,time:timestamp,text:string>>")
    assert value(spark, formats.chat(m)) == "[Ann 09:05] hi\n[unknown ] x"
    mails = F.expr("array(struct('S' as sender, 'T' as subject, 'U' as snippet, 'D' as date))")
    assert value(spark, formats.mail_list(mails)) == "[S] T - U (D)" and value(spark, formats.mail_list(mails, dated=False)) == "[S] T - U"
    assert value(spark, formats.mail(F.lit("a"), F.lit(""), F.lit("b"))) == "Subject: a\nFrom: unknown\n\nb"


def test_issue(spark):
    comments = ", ".join(f"struct('A{i}' as author, 'd{i}' as created, 'b{i}' as body)" for i in range(4))
    i = F.expr(
        f"struct('K-1' as key, 'Sum' as summary, 'Open' as status, '' as priority, cast(null as string) as type, 'Me' as assignee, cast(null as string) as reporter, 'P' as project, "
        f"'Text' as description, array('x','y') as labels, array({comments}) as comments)"
    )
    assert value(spark, formats.issue(i)) == (
        "# K-1: Sum\n\nStatus: Open | Assignee: Me | Project: P\n\n## Description\nText\n\nLabels: x, y\n\n## Recent Comments\n[A1 - d1]\nb1\n\n[A2 - d2]\nb2\n\n[A3 - d3]\nb3"
    )


def test_grids_slides_searches(spark):
    cells = parsed([{"row": 10, "col": 0, "text": "z"}, {"row": 2, "col": 1, "text": "b"}, {"row": 2, "col": 0, "text": "a"}], "array<struct<row:int,col:int,text:string>>")
    assert value(spark, formats.grid(cells)) == "a\tb\nz"
    assert value(spark, formats.slides(F.expr("array('one', ' ', 'three')"), F.expr("array('n')"))) == "Slide 1: one\nSlide 3: three"
    assert value(spark, formats.slides(F.expr("array(' ')"), F.expr("array('n', '')"))) == "n"
    results = parsed([{"title": "T", "snippet": "S", "link": "L"}, {"title": "", "snippet": "x"}, {"title": "V", "snippet": "W"}], "array<struct<title:string,snippet:string,link:string>>")
    assert value(spark, formats.search_results(F.lit("short"), results)) == "## Search Results\n1. T\n   S\n   L\n\n3. V\n   W\n   "
    assert value(spark, formats.without_visual_breaks(F.lit(" a\r\n\n b \n c "))) == "a b c"


def test_keys_and_hashes(spark):
    assert value(spark, formats.issue_key(F.lit("https://x/browse/ab-12"))) == "ab-12"
    assert value(spark, formats.conversation_id(F.lit("https://g/x?c=Q1"))) == "Q1"
    text, h = "hello wörld", 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    h = abs(h - (1 << 32) if h >= 1 << 31 else h)
    digits = ""
    while h:
        digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits, h // 36
    assert value(spark, formats.fingerprint(F.lit(f"[User]\n {text.upper()}"), F.lit(1))) == digits
    assert value(spark, formats.fingerprint(F.lit("none"), F.lit(36))) == "10"
    assert [value(spark, formats.wanted_tab(F.lit(u))) for u in ("http://a", "https://docs.google.com/document/u/0", "https://docs.google.com/document/d/1", "file:///x")] == [True, False, True, False]
    assert value(spark, formats.file_path(F.lit("file://localhost/a%20b+c/%C3%A9"))) == "/a b+c/é"
    assert [value(spark, formats.natural_number(F.lit(n))) for n in ("slide10.xml", "slide.xml")] == [10, 0]
    rows = [(i * 37) % 11 for i in range(72)]
    want = sum(1 << (r * 8 + c) for r in range(8) for c in range(8) if rows[r * 9 + c] > rows[r * 9 + c + 1])
    assert value(spark, formats.difference_hash(F.array(*map(F.lit, rows)))) % (1 << 64) == want
    assert value(spark, formats.distinct_pieces(F.expr("array('ab', 'a', 'abc', 'x', 'x')"))) == ["ab", "x"]
    assert value(spark, formats.mean_confidence(F.expr("array(struct(0.5 as confidence), struct(1.0 as confidence))"))) == 0.75
