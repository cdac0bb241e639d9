"""Near copies against brute force: whatever shares 0.8 of its five-word shingles is linked, however the texts differ."""

import itertools
import random

import pytest

import corpus_pipeline
from folio.llm import simhash


def kept_by_brute_force(rows, k=5, least=0.8):
    sets = [set(simhash.shingles(t.encode(), k)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best[find(i)] = min(doc_id, best.get(find(i), doc_id))
    return sorted(best.values())


def kept(spark, rows):
    return sorted(r.doc_id for r in simhash.without_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())


def word(rng):
    return "".join(rng.choices("abcdefghijklmnop", k=7))


def test_near_copies_go_beside_the_same_words_in_other_order(spark):
    rng = random.Random(1)
    rows = []
    for g in range(12):
        base = [word(rng) for _ in range(200)]
        near = list(base)
        near[100] = word(rng)
        rows += [(100 * g, " ".join(base)), (100 * g + 1, " ".join(near))]
        rows += [(100 * g + 2 + i, " ".join(rng.sample(base, 200))) for i in range(6)]
    want = kept_by_brute_force(rows)
    assert len(want) == 12 * 7
    assert kept(spark, rows) == want


@pytest.mark.parametrize("kind", ["inserted", "appended", "replaced", "scattered"])
def test_recall_at_the_bound(spark, kind):
    rng = random.Random(kind)
    rows = []
    for g in range(40):
        base = [word(rng) for _ in range(400)]
        share = rng.uniform(0.80, 0.85)
        extra = [word(rng) for _ in range(int(396 / share - 396))]
        lost = int(396 * (1 - share) / (1 + share))
        at = rng.randrange(50, 300)
        if kind == "inserted":
            other = base[:at] + [word(rng) for _ in range(int(392 / share - 400))] + base[at:]
        elif kind == "appended":
            other = base + extra
        elif kind == "replaced":
            other = base[:at] + [word(rng) for _ in range(lost - 4)] + base[at + lost - 4 :]
        else:
            other = list(base)
            for i in range(3, 5 * (lost // 5), 5):
                other[i] = word(rng)
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(other))]
    assert kept_by_brute_force(rows) == [10 * g for g in range(40)]
    assert kept(spark, rows) == [10 * g for g in range(40)]


@pytest.mark.parametrize("a_row", [0, 4, 1e9])
def test_crowds_keep_every_link(spark, monkeypatch, a_row):
    """Chains of drifting texts, a template with long and short fillings, word-free texts: with and without stars."""
    monkeypatch.setattr(simhash, "PAIRS_A_ROW", a_row)
    rng = random.Random(3)
    rows, template = [], [word(rng) for _ in range(150)]
    chain = [word(rng) for _ in range(150)]
    for _ in range(25):
        rows.append(" ".join(chain))
        at = rng.randrange(140)
        chain[at : at + 6] = [word(rng) for _ in range(6)]
    for _ in range(60):
        n = rng.choice([16, 17, 20, 24, 30])
        rows.append(" ".join(template + [word(rng) for _ in range(n)]))
    rows += ["", " ", " \n", "one", "one two", "two one", "one  two"]
    rows = list(enumerate(rows))
    want = kept_by_brute_force(rows)
    assert 10 < len(want) < len(rows) - 10
    assert kept(spark, rows) == want


def test_fingerprints_link_near_copies_too(spark):
    """A group by fingerprints is one group, also where too few shingles are shared; shingles then join it to others."""
    rng = random.Random(11)
    base = [word(rng) for _ in range(30)]
    loop = " ".join(base * 40)
    other = " ".join(base * 40 + [word(rng) for _ in range(12)])  # each shingle of the loop counts forty times in the fingerprint, once here
    bits = [simhash.fingerprint(t.encode(), simhash.SHINGLE) for t in (loop, other)]
    assert bin((bits[0] ^ bits[1]) & (1 << 64) - 1).count("1") <= simhash.RADIUS
    linked = [w for w in base * 40]
    near = " ".join(linked + other.split()[1200:] + ["more"])  # shares enough with the second
    rows = [(1, loop), (2, other), (3, near), (4, " ".join(word(rng) for _ in range(60)))]
    assert kept_by_brute_force(rows) == [1, 2, 4]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert kept(spark, rows) == [1, 2, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 4]
