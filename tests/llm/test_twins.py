"""Plain twins of the models: the classifier's fit and score, and the suffix tree's score, word by word in Python."""

import collections
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import quality, suffix_tree
from folio.llm.common import texts
from folio.session import RUN, materialise, shared_dir

M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mixed(h):
    h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 31)


def counted(text, slots):
    """Count of every slot of a text's words and neighbouring pairs."""
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    hashes = [mixed(sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(w)) & M64) for w in words]
    grams = hashes + [mixed((a * 3 + b) & M64) for a, b in zip(hashes, hashes[1:])]
    return collections.Counter(g >> (64 - (slots - 1).bit_length()) for g in grams)


def features(text, slots):
    c = counted(text, slots)
    norm = math.sqrt(sum(n * n for n in c.values())) if c else 1.0
    return {s: n / norm for s, n in sorted(c.items())} | {slots: 1.0}


def ftrl(rows, slots):
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_quality_fit_and_score_equal_plain_loops(spark):
    rng = random.Random(2)
    good, bad = ["river", "town", "Garden", "letter", "winter"], ["BUY", "click", "now", "free", "river"]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=rng.randint(0, 30)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)] + [(91, None), (92, 7), (None, 1)], "doc_id bigint, quality int")
    slots = 1 << 10
    weights = quality.fit(docs, labels, slots=slots)
    order = [r.doc_id for r in labels.where("quality in (0, 1) and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    sample = [i for i in order if zlib.crc32(str(i).encode()) % 5 != 0]
    texts = dict(rows)
    plain = ftrl([(features(texts[i], slots), i % 2) for i in sample], slots)
    want = np.zeros(slots + 1)
    for i, w in plain.items():
        want[i] = w
    assert np.abs(weights - want).max() < 1e-9 and np.count_nonzero(weights) > 5
    got = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    for i, text in rows:
        x = features(text, slots)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(want[s] * v for s, v in x.items()))), abs=1e-9)
    kept = {r.doc_id for r in quality.accepted(docs, weights, 0.5).collect()}
    assert kept == {i for i, s in got.items() if s >= 0.5} and 20 < len(kept) < 100


class PlainTree:
    """Counts, kept contexts of one and two words, smoothed shares: by dictionaries."""

    def __init__(self, texts):
        seqs = [suffix_tree.words(t) for t in texts]
        self.c = collections.Counter(w for s in seqs for w in s)
        self.total = sum(self.c.values())
        self.kept = {}
        pairs, triples = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
        for s in seqs:
            for a, b in zip(s, s[1:]):
                pairs[(a,)][b] += 1
            for a, b, d in zip(s, s[1:], s[2:]):
                triples[(a, b)][d] += 1
        for w in [w for w in self.c if w != b""]:
            self.consider((w,), self.c[w], pairs[(w,)])
        for w in [k[0] for k in list(self.kept)]:
            for x, n in pairs[(w,)].items():
                if x != b"" and n >= suffix_tree.LEAST_NEXT:
                    self.consider((w, x), n, triples[(w, x)])

    def root(self, w):
        return (self.c[w] + 1) / (self.total + len(self.c) + 1)

    def share(self, context, w):
        """Share of ``w`` behind a context, given the longest part of it that is kept."""
        if not context:
            return self.root(w)
        if context not in self.kept:
            return self.share(context[1:], w)
        entries, back = self.kept[context]
        return entries[w] if w in entries else back * self.share(context[1:], w)

    def consider(self, context, n, nexts):
        seen = {w: c for w, c in nexts.items() if c >= suffix_tree.LEAST_NEXT}
        shorter = {w: self.share(context[1:], w) for w in seen}
        p = {w: (c + suffix_tree.SMOOTHING * shorter[w]) / (n + suffix_tree.SMOOTHING) for w, c in seen.items()}
        left, left_shorter = max(1 - sum(p.values()), 1e-12), max(1 - sum(shorter.values()), 1e-12)
        gain = sum(c * math.log(p[w] / shorter[w]) for w, c in seen.items()) + (n - sum(seen.values())) * math.log(left / left_shorter)
        if gain > suffix_tree.DIVERGENCE:
            self.kept[context] = (p, left / left_shorter)

    def score(self, text):
        s = suffix_tree.words(text)
        total = 0.0
        for i, w in enumerate(s):
            one, two = tuple(s[max(0, i - 1) : i]), tuple(s[max(0, i - 2) : i])
            context = two if len(two) == 2 and two in self.kept and one in self.kept else one
            total += math.log10(self.share(context, w))
        return total


def test_suffix_tree_scores_equal_plain_dictionaries(spark):
    rng = random.Random(8)
    follow = {"a": "bbbc", "b": "aacd", "c": "ddda", "d": "abcd", "e": "aaab"}
    rows = []
    for i in range(500):
        w = [rng.choice("abcde")]
        for _ in range(rng.randint(10, 60)):
            w.append("e" if len(w) > 1 and w[-2:] == ["b", "a"] and rng.random() < 0.9 else rng.choice(follow[w[-1]]))
        if i % 9 == 0:
            w.insert(rng.randrange(len(w)), f"Rare{i % 27}")
        rows.append((i, " ".join(w)))
    rows += [(900, ""), (901, None), (902, "never seen b a e"), (903, "b A e a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    training = suffix_tree.texts(docs.where(~suffix_tree.held_out()))
    counts = suffix_tree.materialise(suffix_tree.word_counts(training))
    tree = suffix_tree.fit(training, counts)
    plain = PlainTree([(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    kept = {tuple(tree.vocab[i] for i in (divmod(int(k), tree.n) if d else (int(k),))) for d in range(2) for k in tree.contexts[d]}
    assert kept == set(plain.kept) and any(len(k) == 2 for k in kept)
    got = {r.doc_id: r.score for r in suffix_tree.score(docs, tree, counts).collect()}
    for i, text in rows:
        assert got[i] == pytest.approx(plain.score((text or "").encode()), abs=1e-6), (i, text)


@pytest.mark.parametrize("most", [0, 3])
def test_suffix_tree_scores_do_not_depend_on_what_is_broadcast(spark, monkeypatch, most):
    """Words, contexts and next words that are not among the broadcast ones count the same."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["x y z", "Lone y w", "the quick fox", "the slow ox", "p q", "y"]) for _ in range(rng.randint(1, 12)))) for i in range(300)]
    rows += [(900, ""), (901, None), (902, "never quick seen fox"), (7, rows[7][1]), (None, "x Y w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    training = suffix_tree.texts(docs.where(~suffix_tree.held_out()))
    counts = suffix_tree.materialise(suffix_tree.word_counts(training))
    plain = PlainTree([(t or "").encode() for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2])
    assert {len(k) for k in plain.kept} == {1, 2}
    for name in ("HEAD_WORDS", "HEAD_CONTEXTS", "HEAD_NEXTS"):
        monkeypatch.setattr(suffix_tree, name, most)
    tree = suffix_tree.fit(training, counts)
    assert len(tree.vocab) <= most and all(len(k) <= most for k in tree.contexts + tree.keys)
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in suffix_tree.score(docs, tree, counts).collect())
    want = sorted((str(i), len(suffix_tree.words((t or "").encode())), plain.score((t or "").encode())) for i, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)


def test_suffix_tree_predicts_what_is_rare_in_a_large_corpus(spark):
    """A pair that occurs a few times is predicted however many other tokens there are."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(9000))) for i in range(60)]
    rows += [(i, "seldom follows") for i in range(100, 112)] + [(200 + i, "follows seldom") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    training = suffix_tree.texts(docs)
    counts = suffix_tree.materialise(suffix_tree.word_counts(training))
    got = {r.doc_id: r.score for r in suffix_tree.score(docs, suffix_tree.fit(training, counts), counts).collect()}
    assert got[100] > got[200] + 2


def test_tree_keeps_no_counts_on_disk(spark):
    """Pairs and triples with their counts go when their terms are known."""
    rows = [(i, " ".join(f"w{(i + j * 7) % 9}" for j in range(40))) for i in range(60)]
    training = texts(spark.createDataFrame(rows, "doc_id bigint, text string"))
    run = Path(shared_dir(spark).removeprefix("file:")) / "folio" / RUN
    before = set(run.rglob("_SUCCESS"))
    counts = materialise(suffix_tree.word_counts(training))
    tree = suffix_tree.fit(training, counts)
    assert len(tree.contexts[0]) and tree.total == 60 * 41
    left = [spark.read.parquet(str(p.parent)).columns for p in set(run.rglob("_SUCCESS")) - before]
    assert left and not [c for c in left if "shorter" in c]
