"""Text of interface trees, given as flat rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# ---- fixed values: roles whose subtrees are left out, roles that hold text, and the depth
CHROME_ROLES = [
    "AXMenuBar", "AXMenu", "AXMenuItem", "AXToolbar", "AXTabGroup", "AXTab", "AXButton", "AXPopUpButton", "AXCheckBox", "AXRadioButton", "AXSlider", "AXSplitter",
    "AXStatusBar", "AXOutline", "AXList",
]
TEXT_ROLES = ["AXTextArea", "AXTextField", "AXStaticText", "AXDocument", "AXWebArea", "AXCell", "AXLayoutArea"]
MOST_DEPTH = 100


def visible_lines(nodes: list[dict]) -> list[str]:
    """Lines of a tree in document order; the values of text roles, else short descriptions."""
    below: dict[object, list[dict]] = {}
    for n in sorted(nodes, key=lambda n: n["ord"]):
        below.setdefault(n["parent"], []).append(n)
    out, todo = [], [(n, 0) for n in reversed(below.get(None, []))]
    while todo:
        n, depth = todo.pop()
        if depth > MOST_DEPTH or n["role"] in CHROME_ROLES:
            continue
        if n["role"] in TEXT_ROLES:
            value, described = (n["value"] or "").strip(), (n["description"] or "").strip()
            if value or described and "." not in described:
                out.append(value or described)
        todo += [(c, depth + 1) for c in reversed(below.get(n["node"], []))]
    return out


def tree_text(nodes: DataFrame) -> DataFrame:
    """(tree, content) from (tree, node, parent, ord, role, value, description).

    Rows are dealt by tree and sorted, and a task holds one tree, which is one
    window's and so of bounded size.
    """
    kind = nodes.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = object(), []
        for b in batches:
            keys, texts = [], []
            for row in b.to_pylist():
                if row["tree"] != now:
                    if held:
                        keys.append(now)
                        texts.append("".join(f"{x}\n" for x in visible_lines(held)))
                    now, held = row["tree"], []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("tree").type), pa.array(texts, pa.string())], ["tree", "content"])
            own = b.schema.field("tree").type
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([now], own), pa.array(["".join(f"{x}\n" for x in visible_lines(held))])], ["tree", "content"])

    return nodes.repartition("tree").sortWithinPartitions("tree", "ord").mapInArrow(run, f"tree {kind}, content string")


def find(nodes: DataFrame, role: str) -> DataFrame:
    """Nodes of a role (a filter that reaches the scan)."""
    return nodes.where(F.col("role") == role)


def dump(nodes: DataFrame) -> DataFrame:
    """(tree, node, said): what a node has of value and description, in one line."""
    said = [F.concat(F.lit(f"{c}="), strip(F.col(c))) for c in ("value", "description")]
    return nodes.select("tree", "node", F.concat_ws(" | ", *said).alias("said"))
