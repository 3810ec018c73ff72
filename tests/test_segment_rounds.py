import random

from tillwater.operators import segments

SCHEMA = "user_id string, customer_id long, x0 long, x1 long, x2 long, x3 long"


def test_a_round_is_compiled_and_right(spark):
    """Centres are plain columns (no lambda over arrays), ties go to the first centre, and one that nobody is nearest to stays."""
    rng = random.Random(4)
    rows = [("a", i, *[rng.randrange(-3_000_000, 3_000_000) for _ in range(4)]) for i in range(200)]
    rows += [("b", 1, 0, 0, 0, 0), ("b", 2, 10, 0, 0, 0)]
    points = spark.createDataFrame(rows, SCHEMA)
    first = {("a", 0): [rows[3][2:], rows[9][2:], rows[9][2:]], ("b", 0): [(0, 0, 0, 0), (20, 0, 0, 0), (None,) * 4]}
    columns = ", ".join(f"{c} long" for c in segments._columns(3))
    state = spark.createDataFrame([(*k, *sum(map(tuple, v), ())) for k, v in first.items()], f"user_id string, restart int, {columns}")
    step = segments.next_centres(points, state, 3)
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "array_min" not in plan
    got = {(r["user_id"], r["restart"]): r for r in step.collect()}
    for (user, restart), centres in first.items():
        members = {0: [], 1: [], 2: []}
        for row in rows:
            if row[0] == user:
                away = [sum((float(x) - y) ** 2 for x, y in zip(row[2:], c)) for c in centres if c[0] is not None]
                members[away.index(min(away))].append(row[2:])
        for i, c in enumerate(centres):
            want = [(2 * sum(x) + len(x)) // (2 * len(x)) for x in zip(*members[i])] if members[i] else list(c)
            assert [got[user, restart][f"c{i}_{x}"] for x in segments.POINT] == want
    assert got["a", 0]["going"] and not got["b", 0]["going"]


def test_two_customers_make_centres_for_three(spark):
    points = spark.createDataFrame([("a", 1, 0, 0, 0, 0), ("a", 2, 5, 0, 0, 0)], SCHEMA)
    rows = {r["restart"]: r for r in segments.first_centres(points, 3, 2).collect()}
    assert rows[0]["c2_x0"] is None and sorted((rows[0]["c0_x0"], rows[0]["c1_x0"])) == [0, 5]
    assert sorted((rows[1]["c0_x0"], rows[1]["c1_x0"])) == [0, 5] and rows[1]["c2_x0"] is not None
