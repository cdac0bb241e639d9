import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import pages
from folio.operators.ordering import first_by, with_rank, with_running


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, and the order column has gaps."""
    rnd = random.Random(7)
    rows = [("hot", i * 3 + rnd.randrange(3), rnd.randrange(100)) for i in range(600)]
    rows += [(f"k{i}", j, rnd.randrange(100)) for i in range(20) for j in range(i)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(8)


@pytest.mark.parametrize("how,fn", [("sum", F.sum), ("max", F.max), ("min", F.min)])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("following", [True, False])
def test_running_equals_plain_window(skewed, how, fn, inclusive, following):
    edge = 0 if inclusive else 1
    frame = (edge, Window.unboundedFollowing) if following else (Window.unboundedPreceding, -edge)
    plain = skewed.withColumn("x", fn("v").over(Window.partitionBy("k").orderBy("o").rowsBetween(*frame)))
    if how == "sum":
        plain = plain.withColumn("x", F.coalesce("x", F.lit(0)))
    got = with_running(skewed, "k", "o", F.col("v"), how, "x", inclusive=inclusive, following=following, width=37)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_rank_and_first(skewed):
    plain = skewed.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1)
    got = with_rank(skewed, "k", "o", "r", width=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    firsts = first_by(skewed, ["k"], ["o"])
    assert sorted(map(tuple, firsts.collect())) == sorted(map(tuple, plain.filter("r = 0").drop("r").collect()))


def test_join_chain_alternates(spark):
    """Pairs along a run of one-snippet pages, against the plain sequential reading."""
    rnd = random.Random(3)
    rows, wanted = [], set()
    for book in range(30):
        taken = False
        for i in range(60):
            if rnd.random() < 0.1:
                taken = False
                continue
            e, single = rnd.random() < 0.8, rnd.random() < 0.7
            rows.append((f"b{book}", i, "join" if e else "split", 1 if single else 2))
            prev = any(r[0] == f"b{book}" and r[1] == i - 1 for r in rows)
            take = e and not (single and taken and prev)
            if take:
                wanted.add((f"b{book}", i))
            taken = take
    df = spark.createDataFrame(rows, "book_id string, page_index bigint, decision string, left_bodies int")
    got = {(r.book_id, r.page_index) for r in pages.joined_pairs(df).collect()}
    assert got == wanted


def test_tree_with_shared_nodes(spark):
    """Depth-first order; an inner node reached twice is walked once; depth is limited."""
    edges = [
        (None, "r", 0, "monograph"), ("r", "p1", 0, "page"), ("r", "u", 1, "unit"), ("r", "w", 2, "unit"), ("r", "p2", 3, None),
        ("u", "p3", 0, "page"), ("u", "x", 1, "part"), ("w", "x", 0, "part"), ("w", "p4", 1, "page"), ("x", "p5", 0, "page"), ("x", "r", 1, "monograph"),
    ]
    objs = spark.createDataFrame(edges, "parent_pid string, pid string, ord bigint, model string")
    got = pages.collect_pages(objs, objs.filter("parent_pid IS NULL").select("pid")).orderBy("page_index").collect()
    assert [(r.pid, r.page_index) for r in got] == [("p1", 0), ("p3", 1), ("p5", 2), ("p4", 3), ("p2", 4)]
    deep = [(None, "n0", 0, "m")] + [(f"n{i}", f"n{i + 1}", 0, "m") for i in range(7)] + [(f"n{i}", f"p{i}", 1, "page") for i in range(7)]
    objs = spark.createDataFrame(deep, "parent_pid string, pid string, ord bigint, model string")
    got = pages.collect_pages(objs, objs.filter("parent_pid IS NULL").select("pid")).orderBy("page_index").collect()
    assert [r.pid for r in got] == ["p4", "p3", "p2", "p1", "p0"]


def walk(rows, root, max_depth=4):
    """Pages in the order of a depth-first walk that enters each inner node once."""
    kids, seen, out = {}, set(), []
    for pid, parent, order, model in sorted((r for r in rows if r[1]), key=lambda r: r[2]):
        kids.setdefault(parent, []).append((pid, model))

    def enter(node, depth):
        if depth > max_depth or node in seen:
            return
        seen.add(node)
        for pid, model in kids.get(node, []):
            if model == "page":
                out.append(pid)
            elif depth + 1 <= max_depth:
                enter(pid, depth + 1)

    enter(root, 0)
    return out


def test_a_node_met_too_deep_is_walked_where_it_is_in_reach(spark):
    chain = [("r", None, 0, "book"), ("a", "r", 0, "unit"), ("b", "a", 0, "unit"), ("c", "b", 0, "unit"), ("d", "c", 0, "unit")]
    deep = chain + [("x", "d", 0, "unit"), ("x", "r", 5, "unit"), ("px", "x", 0, "page"), ("pd", "d", 1, "page"), ("py", "y", 0, "page"), ("y", "r", 9, "unit"), ("y", "n", 3, "unit"), ("pn", "n", 0, "page"), ("n", "c", 4, "unit"), ("n", "r", 2, "unit"), ("a", "b", 9, "unit")]
    objs = spark.createDataFrame(deep, "pid string, parent_pid string, ord bigint, model string")
    got = [r.pid for r in pages.collect_pages(objs, spark.createDataFrame([("r",)], "pid string")).orderBy("page_index").collect()]
    assert got == walk(deep, "r") == ["pd", "pn", "px", "py"]


def test_random_trees_are_walked_like_a_loop(spark):
    import random

    rng = random.Random(11)
    for _ in range(3):
        rows = [("0", None, 0, "book")]
        for i in range(1, 25):
            for _ in range(rng.randint(1, 3)):
                rows.append((str(i), str(rng.randrange(max(0, i - 9), i) if rng.random() < 0.8 else rng.randrange(25)), len(rows), "unit"))
        rows += [(f"p{i}", str(rng.randrange(25)), len(rows) + i, "page") for i in range(40)]
        objs = spark.createDataFrame(rows, "pid string, parent_pid string, ord bigint, model string")
        got = [r.pid for r in pages.collect_pages(objs, spark.createDataFrame([("0",)], "pid string")).orderBy("page_index").collect()]
        assert got == walk(rows, "0")
