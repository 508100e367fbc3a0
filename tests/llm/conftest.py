import random

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["Éa", "ñ", "the", "The"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = prose(60), prose(150)
    rows = [
        (1, base), (2, base), (2, base), (3, base + " tail"), (4, f"{prose(30)}\n{shared}  {prose(20)}"), (5, f"{shared}\t{prose(70)}"), (None, base), (None, None),
        (6, None), (7, ""), (8, " \n "), (9, prose(6000)), (10, "one"), (11, "x " * 300), (12, prose(90)), (13, f"{shared} {shared}"), (14, "Zeile\nZeile\nZeile " + prose(60)),
    ]
    data = [(i, t, "clash", 1, "c", 5) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, shard string, slot int, rejected_by string, __row int").repartition(3)


@pytest.fixture(scope="session")
def odd_rows(odd_docs):
    return [(r.doc_id, r.text) for r in odd_docs.collect()]
