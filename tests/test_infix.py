"""Trigram search against LIKE over all rows."""

import random

from millrace.operators import infix


def test_search_is_like_and_reads_few_postings(spark, tmp_path):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "delta_x", "50%", "tt", "ÉCOLE", "longerword"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(500)]
    rows += [(900, None), (901, ""), (902, "a rare needle, once"), (903, "needles are not rare: needle"), (904, "ab")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    found = infix.build(df, "id", "text", str(tmp_path / "index"))
    for p in ("%needle%", "%NEEDLE,%", "alpha%", "%beta gamma%", "%delta\\_x%", "%50\\%%", "%école%", "%tt%", "%lpha%lphA%", "ab", "%a_pha%", "%nowhere to be found%", "%"):
        want = sorted(r.id for r in df.where(df.text.ilike(p)).collect())
        assert sorted(r.id for r in found.search(p).collect()) == want, p
    grams = found.rarest("%a rare needle%")
    assert len(grams) == infix.RAREST and found.postings.where(found.postings.gram.isin(grams)).count() <= 2 * infix.RAREST
    assert infix.pieces("%A_b\\%c%d") == ["a", "b%c", "d"] and found.rarest("%_a%b_") == []
    none = infix.build(df.limit(0), "id", "text", str(tmp_path / "none"))
    assert none.search("%needle%").count() == 0
