"""Near-duplicate detection by SimHash.

Method: meet-in-the-middle ball hashing.  Two fingerprints within a radius meet at a point half-way, so if each emits
every variant within half the radius, they share one; variants are shuffled and those who meet are verified.  For 64
bits and radius 4 the ball has 2,081 points a fingerprint.  By default the bits are therefore first cut into halves:
one half of a linked pair differs in no more than half the bits, so the balls are taken in each half around half of
that, 2 * 33 points, and the verification looks at all bits.  ``parts=1`` takes the whole ball; the links are the same.

A fingerprint is handled once however many documents have it.  Where many meet in one place, their links are not
listed: a shortest spanning forest keeps the same components with fewer edges than members.  That holds for this
relation only, so near copies by shared shingles, at the end of this module, are found by a join of their own, which
starts from the groups that fingerprints make.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import blocks, parted, register, released, row_key, table, texts
from folio.llm.components import components
from folio.session import materialise

BLOCK_BYTES = 2_000_000
SHINGLE = 4
RADIUS = 4
SEED = 42
FEED_ROWS = 200_000
BAND_ROWS, BANDS = 5, 24
STAR_TURNS, PAIRS_A_ROW, IDLE = 6, 1, 0.98
SLACK = 1e-6  # for rounding in bounds; what they let through is verified


def shingles(body: bytes, k: int) -> list[bytes]:
    """``k`` words joined by one space, at every place; of fewer words the whole sequence; of none nothing."""
    words = body.lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [line[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    full = n // 255 * 255
    counts = bits[full:].sum(axis=0, dtype=np.int64)
    if full:  # sums of 255 ones fit a byte, which adds fastest
        counts += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint(body: bytes, k: int, seed: int = SEED, distinct: bool = False) -> int:
    got = shingles(body, k)
    got = set(got) if distinct else got
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, seed) for s in got), np.uint64, len(got)))


def fingerprints(docs: DataFrame, k: int = SHINGLE, seeds: tuple[int, ...] = (SEED,), *, distinct: bool = False) -> DataFrame:
    """doc_id, k1, k2 (key of the row, see ``row_key``) and ``f0``, ``f1`` ...: a 64-bit number for each seed.

    Words are what white space parts, with A-Z lowered; ``distinct`` counts a repeated shingle once.  Texts that are
    null, empty or without words have fingerprint zero.  One row for each row of ``docs``; an empty table gives none.
    """
    names = [f"f{i}" for i in range(len(seeds))]

    def run(batches):
        for b in blocks(batches, "body", BLOCK_BYTES):
            bodies = b.column("body").to_pylist()
            prints = [pa.array([fingerprint(t, k, s, distinct) for t in bodies], pa.int64()) for s in seeds]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "k1", "k2")), *prints], names=["doc_id", "k1", "k2", *names])

    rows = row_key(texts(docs)).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(lambda b: released(run(b)), ", ".join(f"{c} bigint" for c in ("doc_id", "k1", "k2", *names)))


def flips(bits: int, most: int) -> list[int]:
    """All masks of ``bits`` bits with ``most`` or fewer ones."""
    masks = [0]
    for _ in range(most):
        masks += [m | 1 << i for m in masks for i in range(m.bit_length(), bits)]
    return sorted(set(masks))


def variants(prints: DataFrame, names: list[str], node: str, radius: int, parts: int) -> tuple[DataFrame, list]:
    """(place, mask, node, f): a row for each point of the ball round each part of each number ``f``, and the point as columns.

    The point itself is worked out from the row wherever it is needed, so that only ``node`` and ``f`` move.
    """
    width = 64 // parts
    signed = [m - (1 << 64) if m >> 63 else m for m in flips(width, radius // parts // 2)]
    lanes = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.col(n).alias("f")) for i, n in enumerate(names) for p in range(i * parts, (i + 1) * parts)]))
    placed = prints.select(F.col(node).alias("node"), lanes.alias("lane")).select("node", "lane.*")
    rows = placed.select("place", F.explode(F.array(*[F.lit(m).cast("bigint") for m in signed])).alias("mask"), "node", "f")
    low = -1 if width == 64 else (1 << width) - 1
    point = F.expr(f"(shiftrightunsigned(f, (place % {parts}) * {width}) & {low}L) ^ mask") if parts > 1 else F.expr("f ^ mask")
    return rows, ["place", point]


def forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a shortest spanning forest over rows that differ in ``most`` bits or fewer (Prim; space linear in the rows)."""
    left = np.arange(1, len(prints))
    near = np.bitwise_count(prints[1:] ^ prints[0]).sum(axis=1, dtype=np.int64)
    by = np.zeros(len(left), np.int64)
    edges = []
    while len(left):
        i = int(near.argmin())
        node = int(left[i])
        if near[i] <= most:
            edges.append((int(by[i]), node))
        left[i], near[i], by[i] = left[-1], near[-1], by[-1]
        left, near, by = left[:-1], near[:-1], by[:-1]
        far = np.bitwise_count(prints[left] ^ prints[node]).sum(axis=1, dtype=np.int64)
        closer = far < near
        near[closer], by[closer] = far[closer], node
    return edges


def meet(rows: DataFrame, point: list, parts: int, most: int) -> DataFrame:
    """Edges (a, b) between nodes that share a point and differ in ``most`` bits or fewer of that number.

    A task reads its points in order and holds one point at a time.
    """
    width, schema = 64 // parts, pa.schema([("a", pa.int64()), ("b", pa.int64())])
    low = np.uint64(2**width - 1)

    def stacked(batches) -> np.ndarray:
        """place, point, node and number of all rows."""
        col = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches])
        place, f = col("place").astype(np.uint64), col("f").view(np.uint64)
        at = (f >> (place % np.uint64(parts) * np.uint64(width)) & low) ^ col("mask").view(np.uint64)
        return np.stack([place, at, col("node").view(np.uint64), f], axis=1)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        starts = np.nonzero(new)[0]
        sizes = np.diff(np.concatenate([starts, [len(rows)]]))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(rows[two, 3] ^ rows[two + 1, 3]) <= most]
        got = [np.stack([rows[two, 2], rows[two + 1, 2]], axis=1)]
        crowd = sizes > 2
        for a, n in zip(starts[crowd].tolist(), sizes[crowd].tolist(), strict=True):
            edges = np.array(forest(rows[a : a + n, 3:], most), np.int64).reshape(-1, 2)
            got.append(rows[a + edges, 2])
        e = np.concatenate(got).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], schema=schema)

    def run(batches):
        rows, held, count = np.empty((0, 4), np.uint64), [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count < FEED_ROWS:
                continue
            rows = np.concatenate([rows, stacked(held)])
            held, count = [], 0
            upto = len(rows) - int((rows[::-1, :2] == rows[-1, :2]).all(axis=1).cumprod().sum())  # the last point may go on
            if upto:
                yield links(rows[:upto])
                rows = rows[upto:]
        if held:
            rows = np.concatenate([rows, stacked(held)])
        if len(rows):
            yield links(rows)

    return rows.repartition(*point).sortWithinPartitions(*point).mapInArrow(lambda b: released(run(b)), "a bigint, b bigint")


def link(prints: DataFrame, names: list[str], node: str, *, radius: int = RADIUS, parts: int = 2, most: int | None = None) -> DataFrame:
    """Edges (a, b) that connect whatever is linked in one of the numbers ``names``: two that differ there in ``most`` bits or
    fewer (the radius, if not given) and, in some part, ``radius // parts`` or fewer.  Edges within a crowd are a spanning forest."""
    rows, point = variants(prints, names, node, radius, parts)
    return meet(rows, point, parts, radius if most is None else most).distinct()


def reached(distinct: DataFrame, *, radius: int = RADIUS, parts: int = 2) -> DataFrame:
    """``distinct`` (f0, each once, and further columns) with ``root``, the smallest fingerprint reachable."""
    roots = components(link(distinct, ["f0"], "f0", radius=radius, parts=parts))
    return distinct.join(roots.withColumnRenamed("node", "f0"), "f0", "left").withColumn("root", F.coalesce("root", "f0"))


def alike(docs: DataFrame, *, k: int = SHINGLE, radius: int = RADIUS, parts: int = 2) -> DataFrame:
    """(node, root) for the texts of ``docs`` that :func:`groups` puts with other texts; a node stands for a text (``k2`` of its rows)."""
    prints = materialise(fingerprints(docs, k).select(F.col("k2").alias("node"), "f0").distinct())
    distinct = materialise(prints.groupBy("f0").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")))
    rooted = materialise(reached(distinct, radius=radius, parts=parts))
    several = rooted.groupBy("root").agg(F.min("least").alias("least"), F.sum("n").alias("n")).where("n > 1")
    known = rooted.select("f0", "root").join(several, "root").select("f0", F.col("least").alias("root"))
    return materialise(prints.join(known, "f0").select("node", "root"))


def groups(docs: DataFrame, *, k: int = SHINGLE, radius: int = RADIUS, parts: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, for every row of ``docs``.

    Fingerprints that differ in ``radius`` bits or fewer are linked; ``component_id`` is the smallest ``doc_id`` reachable.
    A null ``doc_id`` takes part like any other but names no component (null, if the component has no other).
    """
    prints = materialise(fingerprints(docs, k))
    distinct = materialise(prints.groupBy("f0").agg(F.min("doc_id").alias("first")))
    rooted = materialise(reached(distinct, radius=radius, parts=parts))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("f0", "component_id")
    return prints.join(named, "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def similar(edges: DataFrame, bodies: DataFrame, k: int, least: float) -> DataFrame:
    """Those of ``edges`` (a, b) whose texts ``bodies`` (node, body) share at least ``least`` of their distinct shingles."""

    def run(batches):
        for b in blocks(batches, "x", BLOCK_BYTES):
            same = [_jaccard(x, y, k) >= least for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    both = edges.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(
        bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lambda b: released(run(b)), "a bigint, b bigint")


def _jaccard(x: bytes, y: bytes, k: int) -> float:
    a, b = set(shingles(x, k)), set(shingles(y, k))
    return len(a & b) / len(a | b) if a or b else 1.0


def shingle_hashes(body: bytes, k: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    got, digest = set(shingles(body, k)), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in got), np.uint64, len(got)))


def minima(hashes: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed (rows) the least mixed hash of each text (columns); a text is what follows one of ``starts``."""
    out = np.empty((len(seeds), len(starts)), np.uint64)
    for i, seed in enumerate(seeds):
        x = hashes * seed
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        out[i] = np.minimum.reduceat(x, starts)
    return out


def bands(nodes: DataFrame, k: int, rows: int = BAND_ROWS, count: int = BANDS) -> DataFrame:
    """(key, node, n): ``count`` band keys of each text of ``nodes`` (node, body) and its number of distinct shingles.

    A key stands for ``rows`` least hashes.  Texts that share J of their shingles have a given key in common with probability
    J ** rows, hence none of them with (1 - J ** rows) ** count: 7e-5 at 0.8, 7e-7 at 0.85.  Texts without words share all.
    """
    seeds = np.random.default_rng(SEED).integers(1 << 62, size=rows * count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for b in blocks(batches, "body", BLOCK_BYTES):
            sets = [shingle_hashes(t, k) for t in b.column("body").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            whole = np.concatenate([s if len(s) else np.zeros(1, np.uint64) for s in sets])
            starts = np.cumsum(np.maximum(sizes, 1)) - np.maximum(sizes, 1)
            least = minima(whole, starts, seeds).reshape(count, rows, len(sets))
            keys = np.repeat(np.arange(count, dtype=np.uint64)[:, None], len(sets), axis=1)
            for r in range(rows):
                keys = (keys ^ least[:, r]) * np.uint64(0xBF58476D1CE4E5B9)
                keys ^= keys >> np.uint64(31)
            node = b.column("node").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(node, count)), pa.array(np.tile(sizes, count), pa.int32())], names=["key", "node", "n"])

    return nodes.select("node", "body").mapInArrow(lambda b: released(run(b)), "key bigint, node bigint, n int")


def _may_share(least: float):
    """Whether ``x`` and ``y`` may share ``least`` of their shingles, by their numbers."""
    return F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n") - SLACK


def star(live: DataFrame, least: float, turn: int) -> DataFrame:
    """One candidate (a, b) at most for each text of ``live`` (key, node, n, root): it and a text of another group in one of its keys.

    Of the texts with a key one is taken, and of those taken in its keys a text is paired with the first; the order is alike at
    all keys, so texts of a crowd mostly get the same partner.  In even turns the order is by how many texts a text meets in its
    keys, as that from which many were made meets most; in odd turns it is drawn anew.
    """
    order = F.xxhash64("node", F.lit(turn))
    if turn % 2 == 0:
        sizes = live.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
        live = live.join(live.join(sizes, "key").groupBy("node").agg(F.sum("m").alias("met")), "node")
        order = -F.col("met")
    taken = live.groupBy("key").agg(F.min(F.struct(order.alias("at"), "node", "n", "root")).alias("y"))
    met = live.alias("x").join(taken, "key").where((F.col("x.root") != F.col("y.root")) & _may_share(least))
    hubs = met.groupBy(F.col("x.node").alias("node")).agg(F.min(F.struct("y.at", F.col("y.node").alias("hub"))).alias("c"))
    return hubs.select(F.least("node", "c.hub").alias("a"), F.greatest("node", "c.hub").alias("b")).distinct()


def prefix_pairs(texts_: DataFrame, k: int, least: float) -> DataFrame:
    """Candidates (a, b) among ``texts_`` (node, root, body): all pairs of different roots that may share ``least``.

    Each text gives the first ``n - ceil(least * n) + 1`` of its ``n`` shingles, those of the fewest texts first; two texts that
    share ``least`` have one of these in common.  Shingles of one text only are counted, not sent.
    """

    def run(batches):
        for b in blocks(batches, "body", BLOCK_BYTES):
            sets = [shingle_hashes(t, k) for t in b.column("body").to_pylist()]
            sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
            sizes = np.array([len(s) for s in sets])
            spread = lambda c: pa.array(np.repeat(b.column(c).to_numpy(zero_copy_only=False), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), spread("node"), spread("root"), pa.array(np.repeat(sizes, sizes), pa.int32())], names=["h", "node", "root", "n"])

    rows = materialise(texts_.select("node", "root", "body").mapInArrow(lambda b: released(run(b)), "h bigint, node bigint, root bigint, n int"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ordered = rows.join(shared, "h").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("s"))
    alone = F.col("n") - F.size("s")
    first = F.col("n") - F.ceil(least * F.col("n") - SLACK).cast("int") + 1
    head = F.slice("s", 1, F.greatest(first - alone, F.lit(0)))
    heads = materialise(ordered.select("node", "root", "n", alone.alias("alone"), F.posexplode(head).alias("at", "e")).select("e.h", "node", "root", "n", (F.col("alone") + F.col("at")).alias("pos")))
    behind = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))  # what they may share from the first common shingle on
    enough = behind >= least / (1 + least) * (F.col("x.n") + F.col("y.n")) - SLACK
    met = heads.alias("x").join(heads.alias("y"), "h").where((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _may_share(least) & enough)
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def similar_pairs(nodes: DataFrame, k: int, least: float, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for the texts of ``nodes`` (node, body) that are linked to another: the smallest node reachable.

    Two texts are linked if they share at least ``least`` of their distinct ``k``-word shingles; groups that are ``known``
    (node, root) are linked as they are.  Candidates share one of
    ``BANDS`` keys (see :func:`bands` for what that may miss) and are verified on the whole texts before anything is left
    out.  Where many meet, each is first verified with one of them, one candidate a text and turn, and groups found so
    are one from then on.  Texts that then still share a key with another group go through :func:`prefix_pairs`, which
    misses none of them.
    """
    def placed(rows_: DataFrame, roots_: DataFrame) -> DataFrame:
        return rows_.join(roots_, "node", "left").withColumn("root", F.coalesce("root", "node")).select("key", "node", "n", "root")

    shared = materialise(bands(nodes, k))
    often = shared.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    rooted = shared.withColumn("root", F.col("node")) if known is None else placed(shared, known)
    live = materialise(rooted.join(often, "key", "left_semi"))
    rows = left = live.count()
    tested, roots, idle = None, known, 0

    def bodies_of(chosen: DataFrame) -> DataFrame:
        near, _ = parted(nodes, "node", chosen)
        return near.join(chosen, "node")

    def verified(edges: DataFrame) -> DataFrame:
        ends = materialise(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        return materialise(similar(edges, bodies_of(ends), k, least))

    def grouped(links: DataFrame) -> DataFrame:
        known = links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return components(known)

    for turn in range(STAR_TURNS):
        sizes = live.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("m"))
        open_ = sizes.groupBy("key").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("p")).agg(F.sum("p")).first()[0]
        if (open_ or 0) / 2 <= PAIRS_A_ROW * rows or idle == 2:  # few are open, or neither order settles much
            break
        edges = star(live, least, turn)
        edges = materialise(edges if tested is None else edges.join(tested, ["a", "b"], "left_anti"))
        tested = edges if tested is None else tested.unionByName(edges)
        links = verified(edges)
        roots = grouped(links)
        moved = placed(live.drop("root"), roots)
        split = moved.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        live = materialise(moved.join(split, "key", "left_semi"))
        before, left = left, live.count()
        idle = idle + 1 if left > before * IDLE else 0
    split = live.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_texts = materialise(live.join(split, "key", "left_semi").select("node", "root").distinct())
    bodies = materialise(bodies_of(open_texts))
    edges = prefix_pairs(bodies, k, least)
    edges = materialise(edges if tested is None else edges.join(tested, ["a", "b"], "left_anti"))
    return grouped(materialise(similar(edges, bodies, k, least)))


def without_near_copies(docs: DataFrame, *, k: int = 5, least: float = 0.8, radius: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest ``doc_id`` (nulls last).

    Near copies share at least ``least`` of their distinct ``k``-word shingles (see :func:`similar_pairs`); with a ``radius``
    also texts whose fingerprints differ in so many bits or fewer (see :func:`groups`).  Groups are what all links connect.  Texts that are equal are one node; rows with equal text and ``doc_id`` stay or go
    together.  Other columns are kept as they are.  An empty table gives no rows.
    """
    rows = row_key(texts(docs)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "k1", F.col("k2").alias("node"), "body")
    keys = materialise(rows.select("doc_id", "k1", "node"))
    copied = materialise(keys.groupBy("node").count().where("count > 1").select("node"))
    often, once = parted(rows.select("node", "body"), "node", copied)
    roots = similar_pairs(often.dropDuplicates(["node"]).unionByName(once), k, least, None if radius is None else alike(docs, radius=radius))
    ranked = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("k1").alias("k1"), F.col("node").alias("k2"))
    chosen = ranked.groupBy("root").agg(F.min(best).alias("best"))
    lost = materialise(ranked.join(chosen, "root").where(F.struct("k1", F.col("node").alias("k2")) != F.struct("best.k1", "best.k2")).select("k1", F.col("node").alias("k2")).distinct())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("bigint").alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"))
    near, rest = parted(whole, "k2", lost)
    return near.join(lost, ["k1", "k2"], "left_anti").unionByName(rest).select("row.*")


@register
def op7_simhash(spark, sf):
    return groups(table(spark, sf, "documents"))
