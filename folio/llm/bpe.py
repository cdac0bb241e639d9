"""Byte-level BPE encoding and decoding.

Method: corpus-level merge replay.  The distinct pieces of a block of documents lie end to end in flat arrays; an
inverted index from merge rank to positions holds every adjacent pair that a merge can join, and the merges are
replayed in rank order over all pieces at once, each touching only the neighbours of the positions it joins.  A block
is what a task reads (bounded in bytes), so nothing is shuffled and no vocabulary of the corpus is ever in one place.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import blocks, register, table, texts

BLOCK_BYTES = 24_000_000
NONE = np.int32(2**31 - 1)


class Ranks:
    """Merge ranks of a tiktoken rank file, with every pair of tokens that joins to a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.by_bytes = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.n = max(self.by_bytes.values()) + 1
        tokens = [b""] * self.n
        for t, r in self.by_bytes.items():
            tokens[r] = t
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.byte = np.array([self.by_bytes.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("the rank file must hold every single byte")
        get, keys, ranks, self.early = self.by_bytes.get, [], [], set()
        for t, r in self.by_bytes.items():
            for cut in range(1, len(t)):
                a, b = get(t[:cut]), get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.n + b)
                    ranks.append(r)
                    self.early.update(x for x in (a, b) if x > r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int32)[order]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair joins to, NONE without one."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def replay(pieces: list[bytes], model: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces end to end, and the number of ids of each."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(raw)
    if not n:
        return np.empty(0, np.uint32), np.zeros(len(pieces), np.int64)
    tok = model.byte[raw]
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    follows, precedes = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    follows[-1] = -1
    edge = np.nonzero(piece[1:] != piece[:-1])[0]
    follows[edge], precedes[edge + 1] = -1, -1
    alive = np.ones(n, bool)
    rank = np.full(n, NONE, np.int32)
    inner = np.nonzero(follows >= 0)[0]
    rank[inner] = model.pair(tok[inner], tok[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(at: np.ndarray) -> None:
        """Put positions under their rank in the inverted index."""
        r = rank[at]
        keep = r != NONE
        at, r = at[keep], r[keep]
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.nonzero(r[1:] != r[:-1])[0] + 1
        for first, part in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            if first not in index:
                index[first] = []
                heapq.heappush(heap, first)
            index[first].append(part)

    note(inner)
    while heap:
        r = heapq.heappop(heap)
        held = index.pop(r)
        at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        at = at[(rank[at] == r) & alive[at]]
        if not len(at):
            continue
        if r in model.early:  # a join may enable an earlier merge: one a piece, and the rest again afterwards
            first = np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])
            later, at = at[~first], at[first]
            if len(later):
                index[r] = [later]
                heapq.heappush(heap, r)
        else:  # of pairs that share a token the left one is joined
            chained = np.concatenate([[False], follows[at[:-1]] == at[1:]])
            if chained.any():
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
        gone = follows[at]
        after = follows[gone]
        tok[at] = r
        alive[gone], rank[gone] = False, NONE
        follows[at] = after
        has = after >= 0
        precedes[after[has]] = at[has]
        rank[at] = NONE
        right = at[has]
        before = precedes[at]
        left = before[before >= 0]
        rank[right] = model.pair(tok[right], tok[follows[right]])
        rank[left] = model.pair(tok[left], tok[follows[left]])
        note(np.concatenate([right, left]))
    return tok[alive].astype(np.uint32), np.bincount(piece[alive], minlength=len(pieces))


def ragged(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``data[starts[i] : starts[i] + sizes[i]]`` of all i, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


class Pieces(dict):
    """Number of each distinct piece, in the order of first sight."""

    def __missing__(self, piece):
        self[piece] = n = len(self)
        return n


def encode_block(bodies: list[bytes], model: Ranks, split) -> list[np.ndarray]:
    seen = Pieces()
    docs = [np.fromiter(map(seen.__getitem__, split(b.decode())), np.int64) for b in bodies]
    pieces = [p.encode() for p in seen]
    ids, counts = replay(pieces, model)
    starts = np.cumsum(counts) - counts
    known = [(i, model.by_bytes[p]) for i, p in enumerate(pieces) if p in model.by_bytes]
    if known:  # a piece that is itself a token stays whole
        at = np.array([i for i, _ in known])
        short = counts[at] != 1
        ids = np.concatenate([ids, np.array([r for _, r in known], np.uint32)[short]])
        starts[at[short]] = len(ids) - int(short.sum()) + np.arange(int(short.sum()))
        counts[at[short]] = 1
    return [ragged(ids, starts[d], counts[d]) for d in docs]


def decode(ids: np.ndarray, model: Ranks) -> bytes:
    """Bytes of the ids; an id outside the vocabulary raises an IndexError."""
    return ragged(model.data, model.starts[ids], model.sizes[ids]).tobytes()


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, path: str, pattern: str, *, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, null without ``keep_ids``), ids_sha256, decoded_sha256.

    One row for each row of ``docs``, repeated ones too; a null or empty text has no ids.  A text of any length is
    encoded whole.  An empty table gives no rows; further columns are ignored.
    """

    def run(batches):
        model, split = ranks(path), splitter(pattern)
        for b in blocks(batches, "body", BLOCK_BYTES):
            got = []
            for ids in encode_block(b.column("body").to_pylist(), model, split):
                data = ids.astype("<u4").tobytes()
                got.append((len(ids), data if keep_ids else None, hashlib.sha256(data).hexdigest(), hashlib.sha256(decode(ids, model)).hexdigest()))
            cols = list(zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(ENCODED)[1:], strict=True))], schema=ENCODED)

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text (bytes) of ``ids``."""

    def run(batches):
        model = ranks(path)
        for b in batches:
            out = [None if x is None else decode(np.frombuffer(x, "<u4"), model) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "body"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, body binary")


@register
def op2_bpe(spark, sf):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(table(spark, sf, "documents"), path, public_tokenizers.PATTERN, keep_ids=False).drop("ids")
