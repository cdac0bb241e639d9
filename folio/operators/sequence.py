"""Ordered comparison of two arrays, as column expressions.

The longest run of equal neighbours is matched first, the earliest on the left and then on the right where several are as long;
what lies before it and behind it is compared in the same way.  All of it is a fold over the arrays of one row, so rows are
compared where they lie, without joins or shuffles.

The length of the longest run is searched by halves: two arrays have a run of some length if the hashes of their windows of that
length overlap.  Windows of every power of two are hashed once a row, any other is made of two that cover it.  What is found is
compared element by element; should hashes have misled, the row's gap is folded whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import let

RUNS = "array<struct<i:int,j:int,n:int>>"
GAPS = "array<struct<alo:int,ahi:int,blo:int,bhi:int>>"


def _gap(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    return F.struct(alo.cast("int").alias("alo"), ahi.cast("int").alias("ahi"), blo.cast("int").alias("blo"), bhi.cast("int").alias("bhi"))


def _run(i: Column, j: Column, n: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), n.cast("int").alias("n"))


def longest_run(a: Column, b: Column, gap: Column) -> Column:
    """(i, j, n): the longest run of equal elements of ``a`` and ``b`` within ``gap``; n is 0 if nothing is equal."""
    width = gap["bhi"] - gap["blo"]
    right = F.slice(b, gap["blo"] + 1, width)

    def fold(right: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            # row[j]: how many equal neighbours end at this element and at j
            row = F.zip_with(F.slice(F.concat(F.array(F.lit(0)), s["row"]), F.lit(1), width), right, lambda p, y: F.when(y == x, p + 1).otherwise(0))
            return let(row, lambda row: let(F.array_max(row), lambda top: F.when(
                top > s["n"], F.struct(row.alias("row"), (s["at"] + 1).alias("at"), (s["at"] - top + 1).alias("i"), (F.array_position(row, top).cast("int") - top).alias("j"), top.alias("n"))
            ).otherwise(F.struct(row.alias("row"), (s["at"] + 1).alias("at"), s["i"].alias("i"), s["j"].alias("j"), s["n"].alias("n")))))

        zero = F.struct(F.array_repeat(F.lit(0), width).alias("row"), *[F.lit(0).alias(c) for c in ("at", "i", "j", "n")])
        return F.aggregate(F.slice(a, gap["alo"] + 1, gap["ahi"] - gap["alo"]), zero, step)

    return let(let(right, fold), lambda s: _run(gap["alo"] + s["i"], gap["blo"] + s["j"], s["n"]))


def _both(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _windows_by_size(values: Column, side: str) -> Column:
    """At k the hashes of all windows of 2**k elements; a null is like nothing on the other side."""
    single = F.transform(values, lambda x, i: F.when(x.isNull(), F.xxhash64(F.lit(side), i)).otherwise(F.xxhash64(x)))

    def doubled(sizes: Column, k: Column) -> Column:
        def more(half: Column) -> Column:
            def put(h: Column) -> Column:
                n = F.size(h) - half
                return F.concat(sizes, F.array(F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, half + 1, n), _both)))

            return let(F.element_at(sizes, -1), put)

        return let(F.call_function("shiftleft", F.lit(1), k - 1), more)

    n = F.size(values)
    powers = F.when(n > 1, F.sequence(F.lit(1), F.length(F.bin(n)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(powers, F.array(single), doubled)


def _longest(a: Column, b: Column, sizes_a: Column, sizes_b: Column, gap: Column) -> Column:
    """The same as :func:`longest_run`, by the hashes of windows."""
    def windows(sizes: Column, lo: Column, hi: Column, length: Column) -> Column:
        k = F.length(F.bin(length)) - 1
        n = hi - lo - length + 1
        return let(F.get(sizes, k), lambda h: F.zip_with(
            F.slice(h, lo + 1, n), F.slice(h, lo + length - F.call_function("shiftleft", F.lit(1), k) + 1, n), _both))

    left = lambda n: windows(sizes_a, gap["alo"], gap["ahi"], n)
    right = lambda n: windows(sizes_b, gap["blo"], gap["bhi"], n)
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halved(s: Column, _: Column) -> Column:
        tried = let(F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int"), lambda n: F.when(F.arrays_overlap(left(n), right(n)), span(n, s["hi"])).otherwise(span(s["lo"], n - 1)))
        return F.when(s["lo"] >= s["hi"], s).otherwise(tried)

    most = F.least(gap["ahi"] - gap["alo"], gap["bhi"] - gap["blo"])
    found = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(most))), span(F.lit(0), most), halved)["lo"]

    def placed(n: Column) -> Column:
        def first(both: Column) -> Column:
            key = F.get(F.array_intersect(both["x"], both["y"]), F.lit(0))
            return let(key, lambda key: _run(gap["alo"] + F.array_position(both["x"], key) - 1, gap["blo"] + F.array_position(both["y"], key) - 1, n))

        def checked(run: Column) -> Column:
            same = F.zip_with(F.slice(a, run["i"] + 1, n), F.slice(b, run["j"] + 1, n), lambda x, y: F.coalesce(x == y, F.lit(False)))
            return F.when(F.forall(same, lambda x: x), run).otherwise(longest_run(a, b, gap))

        return F.when(n == 0, _run(gap["alo"], gap["blo"], n)).otherwise(let(let(F.struct(left(n).alias("x"), right(n).alias("y")), first), checked))

    return let(found, placed)


def matching_runs(a: Column, b: Column) -> Column:
    """The runs (i, j, n), from 0 and in order, in which ``a`` and ``b`` match; neighbouring runs are one.  Null elements match nothing."""
    n, m = F.size(a), F.size(b)

    def step(sizes: Column, s: Column) -> Column:
        stack, found = s["stack"], s["found"]
        rest = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))

        def settled(gap: Column) -> Column:
            def put(run: Column) -> Column:
                sides = F.array(_gap(gap["alo"], run["i"], gap["blo"], run["j"]), _gap(run["i"] + run["n"], gap["ahi"], run["j"] + run["n"], gap["bhi"]))
                more = F.filter(sides, lambda g: (g["alo"] < g["ahi"]) & (g["blo"] < g["bhi"]))
                return F.when(run["n"] == 0, F.struct(rest.alias("stack"), found.alias("found"))).otherwise(
                    F.struct(F.concat(rest, more).alias("stack"), F.concat(found, F.array(run)).alias("found")))

            return let(_longest(a, b, sizes["a"], sizes["b"], gap), put)

        return F.when(F.size(stack) == 0, s).otherwise(let(F.element_at(stack, -1), settled))

    whole = F.when((n > 0) & (m > 0), F.array(_gap(F.lit(0), n, F.lit(0), m))).otherwise(F.array().cast(GAPS))
    zero = F.struct(whole.cast(GAPS).alias("stack"), F.array().cast(RUNS).alias("found"))
    sizes = F.struct(_windows_by_size(a, "left").alias("a"), _windows_by_size(b, "right").alias("b"))
    apart = let(sizes, lambda sizes: F.aggregate(F.sequence(F.lit(1), 2 * F.least(n, m) + 1), zero, lambda s, _: step(sizes, s))["found"])

    def joined(out: Column, run: Column) -> Column:
        def onto(last: Column) -> Column:
            meets = (last["i"] + last["n"] == run["i"]) & (last["j"] + last["n"] == run["j"])
            longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(_run(last["i"], last["j"], last["n"] + run["n"])))
            return F.when(meets, longer).otherwise(F.concat(out, F.array(run)))

        return F.when(F.size(out) == 0, F.array(run)).otherwise(let(F.element_at(out, -1), onto))

    different = F.aggregate(F.array_sort(apart), F.array().cast(RUNS), joined)
    return F.when(a == b, F.when(n > 0, F.array(_run(F.lit(0), F.lit(0), n))).otherwise(F.array().cast(RUNS))).otherwise(different)


def gaps(runs: Column, n: Column, m: Column) -> Column:
    """What lies before, between and behind ``runs``: (alo, ahi, blo, bhi, n), each with the length of the run that follows it."""
    def between(runs: Column) -> Column:
        ends = F.concat(runs, F.array(_run(n, m, F.lit(0))))
        behind = F.transform(runs, lambda r: F.struct((r["i"] + r["n"]).alias("i"), (r["j"] + r["n"]).alias("j")))
        starts = F.concat(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))), behind)
        return F.zip_with(starts, ends, lambda s, e: F.struct(s["i"].alias("alo"), e["i"].alias("ahi"), s["j"].alias("blo"), e["j"].alias("bhi"), e["n"].alias("n")))

    return let(runs, between)


def ordered_changes(a: Column, b: Column) -> Column:
    """(left, right, change) for every element, in order: places from 0, change equal, removed or added; removed ones come first."""
    none = F.lit(None).cast("int")
    upto = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    entry = lambda left, right, change: F.struct(left.alias("left"), right.alias("right"), F.lit(change).alias("change"))

    def told(g: Column) -> Column:
        return F.concat(
            F.transform(upto(g["alo"], g["ahi"]), lambda i: entry(i, none, "removed")),
            F.transform(upto(g["blo"], g["bhi"]), lambda j: entry(none, j, "added")),
            F.transform(upto(F.lit(0), g["n"]), lambda k: entry(g["ahi"] + k, g["bhi"] + k, "equal")))

    return F.flatten(F.transform(gaps(matching_runs(a, b), F.size(a), F.size(b)), told))
