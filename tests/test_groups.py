"""Appends in groups against a loop over the groups in order, with several proposals on a stream and long chains."""

import random

import pytest
from foldlog.plans import tables
from foldlog.sources import log as S
from foldlog.sources.stored import dealt

COLUMNS = "stream_id string, ord long, expected_version long, group_id long"


def in_order(rows, heads):
    """rows' groups one after the other; group ids rise with ord on every stream."""
    head, out = dict(heads), {}
    for g in sorted({r[3] for r in rows}):
        trial, ok = dict(head), True
        for s, _, expected, _ in sorted((r for r in rows if r[3] == g), key=lambda r: r[:2]):
            at = trial.get(s, -1)
            ok &= expected == at
            trial[s] = max(at, 0) + 1
        out[g] = ok
        head = trial if ok else head
    return out


def decided(spark, rows, heads):
    out = S.admit_groups(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(heads, "stream_id string, version long"))
    return {r.group_id: r.accepted for r in out.collect()}


def test_several_proposals_of_a_group_on_a_stream(spark):
    rng, rows, head = random.Random(5), [], {"s0": 4}
    for g in range(14):
        for s in rng.sample(["s0", "s1", "s2", "s3", "s4", "s5"], 2):
            for i in range(rng.randrange(1, 4)):
                rows.append((s, g * 10 + i, head.get(s, -1) if rng.random() < 0.9 else 99, g))
                head[s] = max(head.get(s, -1), 0) + 1
    want = in_order(rows, [("s0", 4)])
    assert decided(spark, rows, [("s0", 4)]) == want and set(want.values()) == {True, False}


def test_chain_of_over_twenty_groups(spark):
    rows = [("hot", i, -1 if i == 0 else i, i) for i in range(22)]
    assert decided(spark, rows, []) == dict.fromkeys(range(22), True)


def test_a_thousand_groups_on_one_stream_take_one_pass(spark):
    rows = [("hot", i, (-1 if i == 0 else i) if i % 10 else 10**6, i) for i in range(1000)]
    want = in_order(rows, [])
    assert decided(spark, rows, []) == want
    rows = [(f"s{i + j:04}", i, i if j == 0 and i else -1, i) for i in range(300) for j in (0, 1)]
    assert decided(spark, rows, []) == in_order(rows, [])


def test_a_group_waits_for_one_that_comes_later_on_its_other_stream(spark):
    # group 1 is first on a (ord 1) but second on b, where group 2 stands before it
    rows = [("a", 1, -1, 1), ("b", 5, 1, 1), ("b", 3, -1, 2), ("c", 9, -1, 2), ("d", 1, None, 3)]
    assert decided(spark, rows, []) == {1: True, 2: True, 3: False}


def test_components_of_paths_and_stars(spark):
    names = [f"p{(i * 37) % 101:03}" for i in range(101)]
    links = list(zip(names, names[1:])) + [("z0", f"z{i}") for i in range(1, 30)] + [("y", "y")]
    got = {r.node: r.root for r in S.connected(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {**dict.fromkeys(names, "p000"), **{f"z{i}": "z0" for i in range(30)}, "y": "y"}


def test_circle_is_an_error(spark):
    rows = [("a", 1, -1, 1), ("b", 2, 1, 1), ("b", 1, -1, 2), ("a", 2, 1, 2)]
    with pytest.raises(ValueError, match="2 groups"):
        decided(spark, rows, [])


def test_query_decides_every_group(spark):
    d = "/root/testdata/sf0.001"
    out = tables.QUERIES["a9_admit_groups"](spark, d)
    assert out.where("accepted is null").count() == 0
    p = tables.proposals(spark, d).selectExpr("floor(cast(regexp_extract(stream_id, '([0-9]+)', 1) as long) / 3) as block", "ord").distinct()
    assert out.count() == p.count()


def test_a_fold_in_python_is_spread_over_all_partitions(spark):
    """Adaptive execution would give so few bytes to one task."""
    rows = spark.createDataFrame([(i,) for i in range(50)], "k long")
    assert rows.repartition("k").rdd.getNumPartitions() == 1
    assert dealt(rows, "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
