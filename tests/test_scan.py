import random

import pytest
from pyspark.sql import functions as F

from railyard.operators.scan import segmented_scan


@pytest.mark.parametrize("direction,inclusive", [("forward", True), ("forward", False),
                                                 ("backward", True), ("backward", False)])
def test_two_level_equals_one_window(spark, direction, inclusive):
    rnd = random.Random(7)
    data = []
    for i in range(600):
        key = 0 if rnd.random() < 0.5 else rnd.randint(1, 5)  # one hot key
        data.append((key, i, rnd.randint(0, 40), rnd.randint(-5, 5)))
    df = spark.createDataFrame(data, "k INT, pos INT, blk INT, v INT")
    # blocks must be non-decreasing along the order: order by (blk, pos)
    aggs = {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    order = [F.col("blk"), F.col("pos")]
    one = segmented_scan(df, ["k"], order, aggs, block=None, direction=direction,
                         inclusive=inclusive)
    two = segmented_scan(df, ["k"], order, aggs, block=F.col("blk"), direction=direction,
                         inclusive=inclusive)
    a = sorted(tuple(r) for r in one.collect())
    b = sorted(tuple(r) for r in two.collect())
    assert a == b
    # and against a direct computation
    by_key = {}
    for r in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        by_key.setdefault(r[0], []).append(r)
    expect = {}
    for k, rs in by_key.items():
        for i, r in enumerate(rs):
            if direction == "forward":
                win = rs[: i + 1] if inclusive else rs[:i]
            else:
                win = rs[i:] if inclusive else rs[i + 1:]
            vs = [x[3] for x in win]
            expect[r[1]] = (sum(vs) if vs else None, min(vs) if vs else None,
                            max(vs) if vs else None)
    got = {r["pos"]: (r["s"], r["lo"], r["hi"]) for r in two.collect()}
    assert got == expect


def test_struct_min_gives_next_occurrence(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, "b")],
                               "k INT, t INT, kind STRING")
    nxt = F.when(F.col("kind") == "b", F.struct(F.col("t").alias("t")))
    out = segmented_scan(df, ["k"], [F.col("t")], {"n": ("min", nxt)}, block=F.col("t"),
                         direction="backward", inclusive=False)
    got = {r["t"]: (r["n"]["t"] if r["n"] else None) for r in out.collect()}
    assert got == {1: 2, 2: 4, 3: 4, 4: None}


def test_backward_scan_has_frames_that_grow(spark):
    """A frame up to the last row is computed anew for each row."""
    df = spark.createDataFrame([(1, 1, 1)], "k INT, t INT, blk INT")
    for block in (None, "blk"):
        for inclusive in (True, False):
            out = segmented_scan(df, ["k"], ["t"], {"n": ("min", F.col("t"))}, block=block,
                                 direction="backward", inclusive=inclusive)
            plan = out._jdf.queryExecution().analyzed().toString().lower()
            assert "windowspec" in plan and "unboundedfollowing" not in plan


def test_backward_scan_with_nulls_in_the_order(spark):
    df = spark.createDataFrame([(1, None, 7), (1, 1, 5), (1, 2, None), (1, 3, 4), (None, 1, 2), (None, 2, 1)],
                               "k INT, t INT, v INT")
    for block in (None, F.floor(F.col("t") / 2)):
        out = segmented_scan(df, ["k"], ["t"], {"n": ("sum", F.col("v"))}, block=block, direction="backward",
                             inclusive=False)
        assert {(r["k"], r["t"]): r["n"] for r in out.collect()} == {
            (1, None): 9, (1, 1): 4, (1, 2): 4, (1, 3): None, (None, 1): 1, (None, 2): None}
