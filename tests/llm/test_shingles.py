"""The near-duplicate stage against all pairs by brute force, in both directions, and where spanning links fail."""

import random
from collections import Counter

import pytest
from foldlog.llm import shingles, simhash


def jaccard_sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_force(rows):
    sets, root = [(k, jaccard_sets(t)) for k, t in rows], {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (k, x) in enumerate(sets):
        for m, y in sets[:i]:
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(k), find(m)))
                root[b] = a
    return {k: find(k) for k, _ in rows}


def changed(rng, words, times):
    out = list(words)
    for i in rng.sample(range(len(out)), times):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


def corpus(rng):
    texts = []
    for _ in range(60):  # pairs from about 0.6 to 1
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        texts += [base, changed(rng, base, int(len(base) * rng.choice((0.0, 0.01, 0.02, 0.023, 0.026, 0.04))))]
    hub = [f"h{i}" for i in range(300)]  # copies like the hub, but not like each other: their links must all go through it
    texts += [hub] + [changed(rng, hub, 6) for _ in range(40)]
    common = [f"c{i}" for i in range(100)]  # a passage that many unlike texts share
    texts += [common + [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 120))] for _ in range(60)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(random.Random(seed))
    want = brute_force(rows)
    got = {r.doc_id: r.component for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want
    assert len(set(want.values())) < len(rows) - 60


def test_short_lists_and_long_ones_agree(spark, monkeypatch):
    rows = corpus(random.Random(3))
    monkeypatch.setattr(shingles, "SHORT", 1)
    got = {r.doc_id: r.component for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)


def test_unlike_sets_of_one_hash_stay_apart(spark):
    """Documents 1 and 3 are linked by their nodes; 2 has the hash of 1, but another set, and 4 repeats it."""
    rows = [(1, 7, 5, b"a"), (2, 7, 6, b"b"), (3, 9, 5, b"c"), (4, 7, 6, b"b"), (5, 11, 5, b"a")]
    own = spark.createDataFrame(rows, "id long, node long, n int, parity binary")
    roots = spark.createDataFrame([(7, 7), (9, 7)], "node long, root long")
    assert {r.id: r.component for r in shingles._with_components(own, roots, "id").collect()} == {1: 1, 3: 1, 2: 2, 4: 2, 5: 5}


def passages(rng, docs, own):
    """Texts of so many words of their own that share a passage of 60 words."""
    shared = [f"s{i}" for i in range(60)]
    return [(k, " ".join([f"o{rng.randrange(10**9)}" for _ in range(own)] + shared)) for k in range(docs)]


def test_lists_of_a_common_passage_stay_short_in_a_large_corpus(spark, monkeypatch):
    """The sample grows with the corpus; before, a passage passed for rare once the corpus was large beside SAMPLE_SETS."""
    monkeypatch.setattr(shingles, "SAMPLE_SETS", 1)
    docs = spark.createDataFrame(passages(random.Random(4), 400, 400), "doc_id long, text string")
    assert shingles._shared(shingles._postings(docs, 5)).isEmpty()


def test_long_unlike_sets_are_told_apart_without_their_texts(spark, monkeypatch):
    """Their narrow parities are as good as random; before, each pair of them that shared a rare shingle had its texts compared."""
    rng, given, real = random.Random(5), [], shingles.verified
    monkeypatch.setattr(shingles, "COMMON", 10**6)
    monkeypatch.setattr(shingles, "verified", lambda pairs, *a: given.append(pairs.count()) or real(pairs, *a))
    base = [f"b{i}" for i in range(3000)]
    rows = passages(rng, 12, 3000) + [(100 + k, " ".join(changed(rng, base, n))) for k, n in enumerate((0, 0, 20, 60, 110))]
    got = {r.doc_id: r.component for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows) and max(Counter(got.values()).values()) >= 4
    assert sum(given) <= 6
