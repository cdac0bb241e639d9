"""Exact, near and substring duplicates against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import exact_dedup, simhash, substring
from folio.llm.components import components
from tests.llm import helpers


def test_exact_dedup(spark):
    rows, decided = exact_dedup.deduplicate(helpers.odd(spark))
    groups = collections.defaultdict(list)
    for i, t, *_ in helpers.odd_rows():
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = decided.collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    unique = exact_dedup.unique_rows(helpers.odd(spark))
    assert unique.columns == helpers.odd(spark).columns and sorted(r.text or "" for r in unique.collect()) == sorted(groups)
    assert exact_dedup.deduplicate(helpers.empty(spark))[1].count() == 0


def test_equal_digests_are_told_apart_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("ab"))
    _, decided = exact_dedup.deduplicate(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, "z")], "doc_id bigint, text string"))
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in decided.collect())
    assert got == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True)]


def test_state_goes_on_with_later_files(spark, tmp_path):
    first = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id bigint, text string")
    later = spark.createDataFrame([(3, "x")], "doc_id bigint, text string")
    for part in (first, later):
        rows = exact_dedup.tagged(part).select("digest", "doc_id", "locator")
        rows.write.mode("append").parquet(str(tmp_path / "rows"))
        exact_dedup.run_stream(spark, str(tmp_path / "rows"), rows.schema, str(tmp_path / "state"))
    got = exact_dedup.state(spark, str(tmp_path / "state")).collect()
    assert sorted((r.keep.doc_id, r.group_size) for r in got) == [(2, 1), (3, 2)]


def plain_fingerprint(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, prints, radius):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(rows))]
    least = collections.defaultdict(list)
    for r, (i, *_) in zip(roots, rows, strict=True):
        least[r] += [] if i is None else [i]
    return [min(least[r], default=None) for r in roots]


@pytest.mark.parametrize("parts", [1, 2])
def test_simhash_groups(spark, parts):
    if parts == 1:
        rows = [(i, " ".join(random.Random(i % 3).choices("abcdefgh", k=6 + i % 2))) for i in range(12)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    else:
        rows, docs = helpers.odd_rows(), helpers.odd(spark)
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    want = sorted(zip([i for i, *_ in rows], [f"{p:016x}" for p in prints], plain_groups(rows, prints, 4), strict=True), key=repr)
    got = sorted((tuple(r) for r in simhash.groups(docs, parts=parts).collect()), key=repr)
    assert got == want
    assert simhash.groups(helpers.empty(spark)).count() == 0


def test_links_join_what_is_near(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(300):
        p = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.randint(0, 5)):
            p ^= 1 << b
        prints.add(p)
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(100)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "f0 bigint")
    roots = {r.node: r.root for r in components(simhash.link(df, ["f0"], "f0")).collect()}
    want = plain_groups([(s,) for s in signed], prints, 4)
    assert [roots.get(s, s) for s in signed] == want


def test_near_copies_go(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    rows = []
    for g in range(20):
        base = [word() for _ in range(300)]
        rows.append((10 * g, " ".join(base)))
        for c in range(1, 3):
            other = list(base)
            for i in rng.sample(range(300), 3):
                other[i] = word()
            rows.append((10 * g + c, " ".join(other)))
    rows += [(1000 + i, " ".join(word() for _ in range(250))) for i in range(30)]
    kept = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [10 * g for g in range(20)] + list(range(1000, 1030))
    odd = simhash.without_near_copies(helpers.odd(spark))
    assert odd.columns == helpers.odd(spark).columns
    got = {r.text for r in odd.collect()}
    assert helpers.BASE in got and helpers.BASE + " tail words" not in got and helpers.LONG in got
    assert simhash.without_near_copies(helpers.empty(spark)).count() == 0


def plain_cut(texts, window=35):
    split = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def test_repeated_passages(spark):
    rows = helpers.odd_rows()
    want = [(i, *r) for (i, *_), r in zip(rows, plain_cut([t for _, t, *_ in rows]), strict=True)]
    got = [(r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(helpers.odd(spark)).collect()]
    assert sorted(map(repr, want)) == sorted(map(repr, got))
    out = substring.without_repeats(helpers.odd(spark))
    assert out.columns == helpers.odd(spark).columns
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    assert substring.remove_repeats(helpers.empty(spark)).count() == 0


@pytest.mark.parametrize(("window", "phrase"), [(5, 2), (6, 6), (3, 1)])
def test_repeats_in_random_texts(spark, monkeypatch, window, phrase):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 60)))) for i in range(60)]
    monkeypatch.setattr(substring, "SHARD_PHRASES", 3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs, window=window, phrase=phrase).collect())
    assert got == [(i, *r) for (i, _), r in zip(rows, plain_cut([t for _, t in rows], window), strict=True)]


def test_batches_find_the_texts_of_earlier_ones(spark, monkeypatch, tmp_path):
    def run(home, *batches):
        out = []
        for n, rows in enumerate(batches):
            got = exact_dedup.feed(spark.createDataFrame(rows, "doc_id bigint, text string, digest string, batch int").repartition(2), str(home), n).collect()
            out.append(sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.keep_batch, r.group_size, r.kept, r.same_text) for r in got))
        return out

    one = [(1, "a", "d", 7), (2, "b", "d", 7), (3, None, "d", 7), (None, "c", "d", 7)]
    two = [(5, "a", "d", 7), (0, "b", "d", 7), (4, "", "d", 7), (6, "new", "d", 7), (6, "new", "d", 7)]
    first, second, third = run(tmp_path / "x", one, two, [])
    assert first == [(False, 1, 1, 0, 1, True, True), (False, 2, 2, 0, 1, True, True), (False, 3, 3, 0, 1, True, True), (True, 0, None, 0, 1, True, True)]
    assert second == [(False, 0, 2, 0, 2, False, True), (False, 4, 4, 1, 2, True, True), (False, 5, 5, 1, 2, True, True), (False, 6, 6, 1, 2, False, True), (False, 6, 6, 1, 2, True, True)]
    assert third == []
    plain = exact_dedup.tagged
    monkeypatch.setattr(exact_dedup, "tagged", lambda docs, text: plain(docs, text).withColumn("digest", F.lit(b"one")))  # all digests collide
    assert run(tmp_path / "y", [(9, "kept", "d", 7)], [(1, "kept", "d", 7), (2, "other", "d", 7)])[1] == [(False, 1, 9, 0, 3, False, True), (False, 2, 9, 0, 3, False, False)]


def test_windows_come_from_the_hits_of_the_automata(spark, monkeypatch):
    docs = helpers.odd(spark)
    assert substring.remove_repeats(docs).agg({"n_removed": "sum"}).first()[0] > 0
    monkeypatch.setattr(substring, "occurrences", lambda block, chosen, phrase: [False] * len(block.ids))
    assert substring.remove_repeats(docs).agg({"n_removed": "sum"}).first()[0] == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5000), (1000, 1001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(100)} | {5000: 5000}
