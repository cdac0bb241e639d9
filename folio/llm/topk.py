"""Exact top-k search by inner product.

Method: three-phase uniform threshold.  A vector's score is the sum of its scores in ``LISTS`` slices of the
components, one score list each.  First every block of vectors hands in the head of each of its lists, with whole
scores; the k-th best of a query is a safe cutoff.  The cutoff goes back to the blocks, where a vector whose score in no
list reaches the cutoff's equal share cannot reach the cutoff; the others are the sufficient entries.  Their scores are then
resolved exactly, and the best k of each query are kept.

Lists are scored whole, entries only where a phase asks for them: in the first phase the heads, in the second what passes the
share test.  Queries and vectors meet block by block: each block of one side is sent to every block of the other in an
equality join on the two numbers, so a task holds a few blocks, whatever the tables' sizes.  The join is a merge by name: blocks
are small on disk, and each is repeated for every block of the other side, which the sizes that Spark goes by for a broadcast leave out.

Components are whole numbers held as doubles, so any finite one is exact.  Rows with large ones are blocked apart and scored in
unbounded integers; a score beyond the range of a long is ranked by its digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import register, table, tasks
from folio.session import materialise

LISTS = 4
SCALE = 64.0
VECTOR_BLOCK = 1 << 14
QUERY_BLOCK = 1 << 13
TILE = 1 << 21  # scores of a list held at once
LARGE = 2.0**20
LOWEST = -(1 << 61)


def scaled(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, dim, v): components as floor(scale * x), x as double, as whole numbers in doubles.

    Rows with a null id or vector, or with a null or non-finite component, take no part.
    """
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    # beyond 2**53 / scale a double times a power of two is whole already
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(F.when(F.abs(y) < 2.0**53, y).otherwise(0.0)).cast("double")).otherwise(y)
    x = F.transform("embedding", lambda e: whole(F.lit(scale) * e.cast("double")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.size("embedding").alias("dim"), x.alias("v"))


def blocked(rows: DataFrame, size: int, name: str, extra: tuple[str, ...] = (), tasks_: int = 1) -> tuple[DataFrame, int]:
    """``rows`` (a written table) in blocks of about ``size``: (dim, ``name``, rows), and their number.

    Few rows are cut finer, down to a quarter of ``size``, so that ``tasks_`` have work.  Rows with large components are in blocks
    of their own under the same numbers.
    """
    n = rows.count()
    count = max(1, -(-n // size), min(tasks_, -(-4 * n // size)))
    at = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).cast("int")
    keep = F.struct("vec_id", "v", *extra)
    large = F.coalesce(F.exists("v", lambda c: F.abs(c) >= LARGE), F.lit(False))
    return rows.groupBy("dim", large.alias("_large"), at.alias(name)).agg(F.sort_array(F.collect_list(keep)).alias("rows")).drop("_large"), count  # the hash is even


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in single or double precision where every sum fits, else in unbounded integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2**24:
        return q.astype(np.float32) @ v.astype(np.float32).T
    if most < 2**53:
        return q @ v.T
    whole = lambda x: np.array([int(c) for c in x.ravel().tolist()], dtype=object).reshape(x.shape)
    return whole(q) @ whole(v).T


def unpacked(rows, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and components of an Arrow list of (vec_id, v, ...)."""
    ids = rows.field("vec_id").to_numpy(zero_copy_only=False)
    return ids, rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)


def heads(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of ``k`` best of each row; among equal ones any, as a cutoff is safe with each."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    if scores.dtype == object:
        return np.array([sorted(range(n), key=lambda j, row=row: -row[j])[:k] for row in scores])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def slices(dim: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(LISTS, max(1, dim)) + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("tier", pa.int32()), ("digits", pa.string()), ("text", pa.string())])
HIT_DDL = "query_id bigint, vec_id bigint, score bigint, tier int, digits string, text string"
BEST = ("tier", "score", "digits")  # falling, these sort scores of any size


def told(qid: np.ndarray, vid: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """Rows of hits.  A score beyond a long has no ``score`` but the tier of its length and, within that, sorting digits."""
    if scores.dtype != object:
        n = len(scores)
        return pa.RecordBatch.from_arrays([pa.array(qid), pa.array(vid), pa.array(scores), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], schema=HIT)
    fits, tiers, digits = [], [], []
    for s in map(int, scores.tolist()):
        long = -(2**63) <= s < 2**63
        size = s.bit_length()
        fits.append(s if long else None)
        tiers.append(0 if long else size if s > 0 else -size)
        digits.append(None if long else str(s if s > 0 else (1 << size) + s).zfill(size // 3 + 1))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip((qid, vid, fits, tiers, digits, [str(int(s)) for s in scores.tolist()]), HIT, strict=True)], schema=HIT)


def _best(rows: np.ndarray, flat: np.ndarray, got: np.ndarray, k: int) -> np.ndarray:
    """The k best entries of each row, ties to the smaller place."""
    if got.dtype == object:
        order = np.array(sorted(range(len(got)), key=lambda i: (rows[i], -got[i], flat[i])), np.int64)
    else:
        order = np.lexsort((flat, -got, rows))
    place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order], "left")
    return order[place < k]


def _tile(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, cutoffs: list | None, k: int) -> pa.RecordBatch:
    lists = [products(q[:, lo:hi], v[:, lo:hi]) for lo, hi in slices(q.shape[1])]
    large = any(s.dtype == object for s in lists)
    if large:
        lists = [s if s.dtype == object else s.astype(np.int64).astype(object) for s in lists]
    for r, (lo, hi) in enumerate(zip(np.searchsorted(vid, qid, "left"), np.searchsorted(vid, qid, "right"), strict=True)):
        for s in lists:
            s[r, lo:hi] = LOWEST
    if cutoffs is None:
        at = np.sort(np.concatenate([heads(s, k) for s in lists], axis=1), axis=1)
        rows, flat = np.repeat(np.arange(len(qid)), at.shape[1]), at.ravel()
        new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (rows[1:] != rows[:-1])]) if len(flat) else np.empty(0, bool)
        rows, flat = rows[new], flat[new]
    else:
        enough = np.zeros(lists[0].shape, bool)
        for r, cut in enumerate(cutoffs):  # a sum that reaches the cutoff has a part of at least its ceiling share
            share = None if cut is None else -(-cut // len(lists))
            share = share if large or share is None else min(max(share, -(2**62)), 2**62)
            for s in lists:
                enough[r] |= True if share is None else (s[r] >= share).astype(bool)
        rows, flat = np.nonzero(enough)
    fine = vid[flat] != qid[rows]
    rows, flat = rows[fine], flat[fine]
    got = sum(s[rows, flat] if large else s[rows, flat].astype(np.int64) for s in lists)
    if cutoffs is not None and len(got):
        none = -(10**700) if large else -(2**63)  # below any score there is
        least = np.array([none if c is None else c if large else min(max(c, none), 2**63 - 1) for c in cutoffs], dtype=object if large else np.int64)
        reach = (got >= least[rows]).astype(bool)
        rows, flat, got = rows[reach], flat[reach], got[reach]
    order = _best(rows, flat, got, k)  # of a block's entries only the best k bear on the cutoff or the result
    return told(qid[rows[order]], vid[flat[order]], got[order])


def _pairs(batches, k: int, second: bool):
    for b in batches:
        for i in range(b.num_rows):
            dim = b.column("dim")[i].as_py()
            qid, q = unpacked(b.column("queries")[i].values, dim)
            vid, v = unpacked(b.column("vectors")[i].values, dim)
            cut = [None if c is None else int(c) for c in b.column("queries")[i].values.field("cutoff").to_pylist()] if second else None
            step = max(1, TILE // max(1, len(vid)))
            for lo in range(0, len(qid), step):
                yield _tile(qid[lo : lo + step], q[lo : lo + step], vid, v, cut and cut[lo : lo + step], k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, *, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK, text: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` best rows of ``vectors`` for each of ``queries``.

    Both come from :func:`scaled`.  Ties go to the smaller ``vec_id``; rows with the query's own ``vec_id`` are no
    candidates; vectors of another dimension are none either.  A repeated row counts as often as it occurs on the side
    of the vectors; on the side of the queries an id stands for one query, of several vectors the shortest, then the least.
    Fewer than ``k`` candidates give fewer rows, no vectors none.  A score beyond the range of a long is null, but ranked
    like any other; ``text`` adds ``score_text``, which has the digits of every score.
    """
    asked = materialise(queries.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.*"))
    n_left = max(1, -(-asked.count() // query_block))
    # tasks are pairs of blocks: every further block of vectors is one more copy of the queries
    right, n_right = blocked(materialise(vectors), vector_block, "vector_block", tasks_=-(-tasks(vectors.sparkSession) // n_left))
    right = materialise(right.withColumnRenamed("rows", "vectors"))

    def hits(questions: DataFrame, second: bool, *extra: str) -> DataFrame:
        left, n_left = blocked(questions, query_block, "query_block", extra)
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = left.withColumnRenamed("rows", "queries").withColumn("vector_block", numbers(n_right))
        pairs = left.hint("merge").join(right.withColumn("query_block", numbers(n_left)), ["dim", "query_block", "vector_block"])
        return pairs.select("dim", "queries", "vectors").mapInArrow(lambda b: _pairs(b, k, second), HIT_DDL)

    order = Window.partitionBy("query_id").orderBy(*[F.desc_nulls_last(c) for c in BEST], "vec_id")
    whole = F.coalesce("text", F.col("score").cast("string"))
    best = hits(asked, False).withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    cutoffs = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max_by(whole, "at")).alias("cutoff"))
    again = asked.join(cutoffs.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    found = hits(materialise(again), True, "cutoff").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score", *([whole.alias("score_text")] if text else []))


@register
def op4_topk(spark, sf):
    """The 20 best partners of every twentieth embedding among all."""
    vectors = scaled(table(spark, sf, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0), text=True)
