"""Reconciliation by range digests against plain set differences."""

import random

from cdcmart.operators import quality


def test_digests_find_every_difference(spark, monkeypatch):
    r = random.Random(2)
    a = [str(r.randrange(4000)) for _ in range(3000)]
    b = [k for k in a if r.random() > 0.01] + ["new", "x:y", ""]
    pairs = [(str(i % 40), r.choice(["limited", None])) for i in range(60)]
    sides = [
        ("one", spark.createDataFrame([(k,) for k in a], "id string"), spark.createDataFrame([(k,) for k in b + b[:50]], "id string"), ["id"]),
        ("same", spark.createDataFrame([(k,) for k in a], "id string"), spark.createDataFrame([(k,) for k in reversed(a)], "id string"), ["id"]),
        ("pairs", spark.createDataFrame(pairs, "p string, t string"), spark.createDataFrame(pairs[:-3] + [("z", None)], "p string, t string"), ["p", "t"]),
        ("empty", spark.createDataFrame([], "id string"), spark.createDataFrame([], "id string"), ["id"]),
    ]
    joined = {(p or "") + ":" + (t or "") for p, t in pairs}, {(p or "") + ":" + (t or "") for p, t in [*pairs[:-3], ("z", None)]}
    sets = {"one": (set(a), set(b)), "same": (set(a), set(a)), "pairs": joined, "empty": (set(), set())}
    want = {(t, k, "missing_in_target") for t, (s, g) in sets.items() for k in s - g} | {(t, k, "extra_in_target") for t, (s, g) in sets.items() for k in g - s}
    for rows, leaves in ((16, 0), (0, quality.MAX_LEAVES), (0, 0)):  # one level, two, and too many leaves
        monkeypatch.setattr(quality, "LEAF_ROWS", rows)
        monkeypatch.setattr(quality, "MAX_LEAVES", leaves)
        got = quality.reconcile_tables(sides).collect()
        assert len(got) == len(want) and {tuple(g) for g in got} == want
    report = {x.table: (x.source_keys, x.missing_in_target, x.extra_in_target, x.status) for x in quality.reconcile_report(sides).collect()}
    assert report == {
        t: (len(s), len(s - g), len(g - s), "SKIP" if not s else "PASS" if s == g else "FAIL") for t, (s, g) in sets.items()
    }
    few = quality.reconcile_tables(sides, sample=2).where("table = 'one' AND side = 'missing_in_target'").collect()
    assert [x.key for x in sorted(few, key=lambda x: x.key)] == sorted(set(a) - set(b))[:2]
    # what agrees is never compared key by key
    keyed = quality.keyed_sides(sides)
    assert {x.table for x in quality.differing_ranges(keyed, 1).select("table").distinct().collect()} == {"one", "pairs"}
