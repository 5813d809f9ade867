"""Roll-ups by several dimensions against a plain one at a time."""

from collections import defaultdict

from textloom.operators import analytics as A


def test_each_dimension_and_the_total(spark):
    rows = [("a", "x", 1, 2), ("a", None, 3, None), (None, "x", 5, 1), (None, None, None, 9), ("b", "y", 0, 4), ("b", "y", 0, 4)]
    found = A.rolled_up(spark.createDataFrame(rows, "pillar string, kind string, seen int, n long"), ["pillar", "kind"], {"each": "seen"}, {"all": "n"}, present="seen")
    wanted = defaultdict(lambda: [0, 0, 0])
    for p, k, seen, n in rows:
        if seen is not None:
            for group in (("pillar", p), ("kind", k), ("total", None)):
                wanted[group][0] += 1
                wanted[group][1] += seen
                wanted[group][2] += n or 0
    assert {(r["dimension"], r["key"]): (r["n"], r["each"], r["all"]) for r in found.collect()} == {g: (n, s / n, t) for g, (n, s, t) in wanted.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_no_rows(spark):
    empty = spark.createDataFrame([], "pillar string, seen int")
    assert A.rolled_up(empty, ["pillar"], {"each": "seen"}, {}).count() == 0
