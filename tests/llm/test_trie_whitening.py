"""Prefix trie and whitening against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folio.llm import prefix_trie, whitening

TURNS = "conv_id bigint, turn bigint, role string, text string, length int, node string, tid int, level int"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    seqs = {c: [t[2] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    full = {}
    for c, s in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = seqs.get(c - int(math.fmod(c, 100)), [])[:h] + s[h:]
    nodes = defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in nodes.items():
        cost = (len(m) - 1) * (len(p[-1][1]) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += p not in kids
    out = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(full[c]) == len(p)))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng, rows = random.Random(5), []
    def add(c, texts, turn=lambda i: i):
        rows.extend((c, turn(i), "user" if i % 2 else "assistant", t, i, "n", i, i) for i, t in enumerate(texts))
    for c in range(60):
        add(c, [f"turn {rng.randint(0, 2)}" for _ in range(rng.randint(1, 9))])
    for c in range(200, 230):  # copies, long
        add(c, [f"long {i}" for i in range(23)])
    for c in range(230, 236):  # agree for 19 turns
        add(c, [f"long {i}" for i in range(19)] + [f"own {c % 3}", "end"])
    add(236, [f"long {i}" for i in range(12)])
    add(300, ["only one"])  # short opening for its hundred
    for c in range(301, 312):
        add(c, ["a", "b"])
    for c in range(412, 420):  # the first of the hundred is absent
        add(c, ["a", "b", "c"])
    add(-7, ["minus", "seven", None])
    add(-100, [None, "", "x"], lambda i: None)
    add(500, ["z" * 70_000, "é😀"], lambda i: i // 2)
    rows.append((500, 0, None, None, 0, "n", 0, 0))
    rows += [(501, 3, "user", "again", 0, "n", 0, 0)] * 7
    rows.append((None, 1, "user", "nobody's", 0, "n", 0, 0))
    return rows


@pytest.mark.parametrize("width", [1, 3, 4])
def test_trie_equals_brute_force(spark, width):
    rows = conversations()
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(5), width=width)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows)


def test_long_group_of_ids_is_streamed(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST_IDS", 3)
    rows = [(c, 0, "user", "same", 0, "n", 0, 0) for c in range(0, 20_000, 100)]
    assert sorted((tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()), key=repr) == brute_trie(rows)


def test_trie_of_empty_table(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int, x string, dim string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "d", 1) for i, v in rows], VECTORS).repartition(3)


def whitened(df):
    rows = whitening.whole(df)
    return whitening.whiten(rows, whitening.fit(rows)).collect()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    plain = (rng.standard_normal((300, 7)) * np.array([3, 2, 1.5, 1, 0.5, 0.3, 0.1]) + 2).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(plain)] + [(7, plain[7]), (None, plain[9])] + [(1000 + i, plain[0]) for i in range(500)]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 5), (902, [math.nan] * 7), (903, [math.inf] + [0.0] * 6), (904, [])]
    got = whitened(vectors(spark, rows + odd))
    x = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)).astype(int)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, base = np.linalg.eigh(c.T @ c / n)
    e, base = e[::-1], base[:, ::-1]
    w = (x - s / n) @ base[:, :4] / np.sqrt(e[:4])
    dev = ((n * x - s) ** 2).sum(1)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    key = lambda i, d: (i is None, i or 0, d)
    order = sorted(range(len(rows)), key=lambda j: key(rows[j][0], int(dev[j])))
    for j in range(4):
        mine = sorted((r for r in got if r.component == j + 1), key=lambda r: key(r.vec_id, r.deviation))
        assert [(r.vec_id, r.deviation) for r in mine] == [(rows[i][0], int(dev[i])) for i in order]
        a, b = np.array([r.whitened for r in mine]), w[order, j]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert all(abs(r.explained - e[j] / e.sum()) < 1e-12 for r in mine)
    assert max(r.identity_error for r in got) < 1e-10


def test_lengths_extremes_and_no_variance(spark):
    huge, tiny = [3e38, 1.0], [-3e38, 2.0]
    got = whitened(vectors(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, huge), (4, tiny), (5, [5.0]), (6, [6.0]), (7, [8.0])]))
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    assert [len(by[i]) for i in range(1, 8)] == [3, 3, 2, 2, 1, 1, 1]
    assert all(r.whitened is None and r.explained is None and r.n == 1 and r.deviation == 0 for r in by[1])
    top = (2**63 - 1) + 2**63
    assert [r.deviation for r in by[3]] == [None, None] and by[3][0].deviation_text == str(top**2 + 256**2)
    assert [r.whitened for r in by[3]][1] is None and abs(abs(by[3][0].whitened) - 1) < 1e-12
    mean = np.array([1280, 1536, 2048]).mean()
    assert sorted(abs(by[i][0].whitened) for i in (5, 6, 7)) == pytest.approx(sorted(abs(v - mean) / np.std([1280, 1536, 2048]) for v in (1280, 1536, 2048)))


def test_whitening_of_empty_table(spark):
    assert whitened(vectors(spark, [])) == [] and whitened(vectors(spark, [(1, None)])) == []


@pytest.mark.parametrize("values", [[5.0], [2.0, 2.0], [9, 9, 9, 1, 1, 0, 0, 0], list(range(40)), [1e12, 1.0, 1e-3, 0.0], [4, 4 - 1e-9, 4 - 2e-9, 0]])
def test_components_by_divide_and_conquer(values):
    n = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((n, n)))
    v = (q * np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    e, base = whitening.leading(v, 4)
    scale = max(map(abs, values))
    assert np.allclose(e, np.sort(values)[::-1][:4], rtol=0, atol=1e-13 * n * scale)
    assert np.abs(v @ base - base * e).max() < 1e-12 * n * scale and np.abs(base.T @ base - np.eye(len(e))).max() < 1e-12
