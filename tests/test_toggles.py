"""Windows while applications are blocked and unblocked, against a replay in order."""

import fnmatch
import random

from millrace.operators import toggles


def replay(windows, changes, reads, begin):
    patterns, states, out = set(begin), {}, []
    # at one instant: blocks, unblocks, windows that come, reads
    steps = [(at, kind == "unblock", "change", (kind, p)) for at, kind, p in changes]
    steps += [(at, 2, "seen", (w, b)) for w, b, at in windows] + [(at, 3, "read", (w, i)) for w, at, i in reads]
    for _, _, what, x in sorted(steps, key=lambda s: (s[0], int(s[1]))):
        if what == "change":
            kind, p = x
            patterns.add(p) if kind == "block" else patterns.discard(p)
            for w, (b, _) in states.items():
                if b == p:
                    states[w] = (b, kind == "block")
        elif what == "seen":
            w, b = x
            always = b is not None and "kiro" in b
            states[w] = (b, always or (b is not None and any(fnmatch.fnmatchcase(b, p) for p in patterns)))
        elif x[0] in states:
            out.append((x[1], states[x[0]][1]))
    return sorted(out)


def test_against_a_replay(spark):
    rng = random.Random(12)
    names = ["com.a_b", "com.axb", "a%c", "my.bank", "dev.kiro.app", "é.bank.x", None]
    globs = ["com.a_b", "com.axb", "com.*", "*bank*", "dev.kiro.app", "?%c", "com.a?b", "my.bank", "a%c"]
    windows = [(w, rng.choice(names), float(rng.randrange(50))) for w in range(60)]
    changes = [(float(rng.randrange(100)), rng.choice(["block", "unblock"]), rng.choice(globs)) for _ in range(70)]
    reads = [(rng.randrange(62), float(rng.randrange(120)), i) for i in range(1500)]
    df = toggles.read_blocked(
        spark.createDataFrame(reads, "window long, at double, id long"), spark.createDataFrame(windows, "window long, bundle string, seen_at double"),
        spark.createDataFrame(changes, "at double, kind string, pattern string"), ["*bank*"],
    )
    got = sorted((r.id, r.blocked) for r in df.collect())
    want = replay(windows, changes, reads, ["*bank*"])
    assert got == want and {b for _, b in want} == {True, False}


def test_without_changes(spark):
    windows = spark.createDataFrame([(1, "my.bank", 0.0), (2, "x", 0.0)], "window long, bundle string, seen_at double")
    none = spark.createDataFrame([], "at double, kind string, pattern string")
    reads = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "window long, at double")
    assert sorted((r.window, r.blocked) for r in toggles.read_blocked(reads, windows, none, ["*bank*"]).collect()) == [(1, True), (2, False)]
    assert toggles.read_blocked(reads.limit(0), windows.limit(0), none, []).count() == 0
