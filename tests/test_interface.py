import pytest

from millrace.functions import chat
from millrace.operators import ui
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "title,expected",
    [
        ("Ann Lee: See you there. 10:59 AM.", ("Ann Lee", "10:59 AM", "See you there")),
        ("Ann: done: all of it. 4:10 PM. 1 link. 2 reactions.", ("Ann", "4:10 PM", "done: all of it")),
        ("Bob: no stop at all 7:28 PM", ("Bob", "7:28 PM", "no stop at all")),
        ("Bob: Image: No alt text. look  at this", ("Bob", "Unknown", "look at this")),
        ("Bob: a long enough message with 9:41 AM. and words", ("Bob", "9:41 AM", "a long enough message with")),
        ("short: x", None),
        ("Home: a message in here", None),
        ("no colon in this title", None),
        (None, None),
    ],
)
def test_messages(spark, title, expected):
    row = spark.createDataFrame([(title,)], "t string").select(chat.message(F.col("t")).alias("m")).first().m
    assert (None if row is None else tuple(row)) == expected


def test_ui_text(spark):
    got = spark.createDataFrame([(x,) for x in ("Home", "9:41", "12", "hello")], "t string").select(chat.is_ui_text(F.col("t")), chat.looks_like_time(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, False), (False, False), (False, False)]


def test_tree_text(spark):
    rows = [
        (1, 1, None, 0, "AXWindow", None, None), (1, 3, 1, 2, "AXStaticText", " second ", None), (1, 2, 1, 1, "AXGroup", None, None), (1, 4, 2, 0, "AXTextArea", "first", "x"),
        (1, 5, 1, 3, "AXToolbar", None, None), (1, 6, 5, 0, "AXStaticText", "hidden", None), (1, 7, 1, 4, "AXCell", "", "label"), (1, 8, 1, 5, "AXCell", "", "no. label"),
        (2, 1, None, 0, "AXButton", "x", None),
    ]
    nodes = spark.createDataFrame(rows, "tree int, node int, parent int, ord int, role string, value string, description string")
    assert {r.tree: r.content for r in ui.tree_text(nodes).collect()} == {1: "first\nsecond\nlabel\n", 2: ""}
    assert ui.find(nodes, "AXCell").count() == 2
