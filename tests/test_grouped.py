import random

import pyarrow as pa

from loomline.operators.grouped import map_groups, whole_groups


def batches(rows, sizes):
    table = pa.table({"k": pa.array([r[0] for r in rows], pa.string()), "j": pa.array([r[1] for r in rows], pa.int64()), "x": pa.array([r[2] for r in rows], pa.int64())})
    at = 0
    for n in sizes:
        yield from table.slice(at, n).to_batches()
        at += n


def test_no_group_is_cut():
    rng = random.Random(1)
    for _ in range(50):
        rows = sorted(((rng.choice(["a", "b", None]), rng.randrange(3), i) for i in range(rng.randrange(0, 40))), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        sizes, left = [], len(rows)
        while left:
            sizes.append(rng.randrange(0, min(7, left) + 1))
            left -= sizes[-1]
        seen = []

        def check(table):
            groups = list(zip(table.column("k").to_pylist(), table.column("j").to_pylist()))
            seen.append((set(groups), table.num_rows))
            return table

        out = [tuple(r.values()) for b in whole_groups(batches(rows, sizes), ["k", "j"], check) for r in b.to_pylist()]
        assert out == rows
        for i, (groups, _) in enumerate(seen):
            for other, _ in seen[i + 1 :]:
                assert not groups & other


def test_in_spark(spark):
    frame = spark.range(1000).selectExpr("cast(id % 7 as string) as k", "id as x")
    got = map_groups(frame, ["k"], lambda t: t.group_by("k").aggregate([("x", "sum")]).rename_columns(["k", "s"]), "k string, s bigint").collect()
    assert {r["k"]: r["s"] for r in got} == {str(i): sum(range(i, 1000, 7)) for i in range(7)}
