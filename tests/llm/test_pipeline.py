"""Each stage of the pipeline against a plain version, and the whole on small and awkward inputs."""

import hashlib
import re
from collections import Counter
from itertools import accumulate

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from foldlog.llm import bpe, simhash, toxicity
from foldlog.llm.common import table, written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    stages = dict(P.STAGES)
    calm = written(stages["toxicity"](spark, docs, DATA))
    scores = toxicity.scored(docs, toxicity.fit(docs, table(spark, DATA, "labels"))).toPandas()
    assert set(calm.toPandas().doc_id) == set(scores[scores.score < toxicity.THRESHOLD].doc_id) and calm.columns == docs.columns
    single = written(stages["simhash_near_dedup"](spark, calm, DATA))
    before, after = calm.toPandas(), single.toPandas()
    shingles = {r.doc_id: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())] for i in range(max(1, len(w) - 4))} for r in before.itertuples()}
    near = lambda a, b: len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))
    for d in set(before.doc_id) - set(after.doc_id):
        assert max(near(d, e) for e in before.doc_id if e < d) > 0.6
    ids = sorted(after.doc_id)
    assert not any(near(a, b) > 0.95 for i, a in enumerate(ids) for b in ids[:i])
    cut = written(stages["suffix_array_dedup"](spark, single, DATA))
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()} == plain_cuts(zip(after.doc_id, after.text, strict=True))
    mix = written(stages["mixing"](spark, cut, DATA))
    rows, taken = Counter(map(tuple, cut.collect())), Counter(map(tuple, mix.collect()))
    assert mix.columns == docs.columns and taken.keys() <= rows.keys() and all(n <= 3 * rows[r] for r, n in taken.items())
    source, text = docs.columns.index("source"), docs.columns.index("text")
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[text] or ""))
    size, got = Counter(), Counter()
    for r, n in rows.items():
        size[r[source]] += n * words(r)
    for r, n in taken.items():
        got[r[source]] += n * words(r)
    largest = max(map(words, rows))
    assert all(abs(got[s] - t) <= largest for s, t in plain_targets(size).items())
    path = public_tokenizers.path(bpe.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    hex_ = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r, n in taken.items():
        ids = enc.encode_ordinary(r[text] or "")
        want[r[docs.columns.index("doc_id")], len(ids), hex_(",".join(map(str, ids)).encode()), hex_((r[text] or "").encode())] += n
    assert Counter(map(tuple, stages["byte_level_bpe"](spark, mix, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def plain_cuts(rows):
    """Each text without the characters all of whose bytes are covered by 100-byte strings that also start earlier."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b, covered = t.encode(), set()
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                covered.update(range(i, i + 100))
            seen.add(b[i : i + 100])
        ends = list(accumulate(len(c.encode()) for c in t))
        out[d] = "".join(c for c, end in zip(t, ends, strict=True) if not covered.issuperset(range(end - len(c.encode()), end)))
    return out


def plain_targets(size):
    """Shares of all words by weights 1, 2, 3 in turn, at most three times a source's own; what is over goes to the others."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    full = {}
    while True:
        rest = [s for s in size if s not in full]
        left = sum(size.values()) - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: 3 * size[s] for s in rest if share[s] > 3 * size[s]}
        if not over:
            return full | share
        full |= over


def test_copies_without_id_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, "quite another text"), (3, None)], "doc_id long, text string")
    got = sorted(map(str, P.drop_near_duplicates(spark, docs, DATA).toPandas().doc_id.tolist()))
    assert got == ["1.0", "3.0", "nan"]
    assert P.drop_near_duplicates(spark, docs.where("false"), DATA).count() == 0


def test_unlike_texts_of_one_id_stay(spark):
    docs = spark.createDataFrame([(4, "a b c d e f g"), (5, "a b c d e f g"), (5, "h i j k l m n"), (5, "o p q r s t u"), (5, "o p q r s t u")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text[0]) for r in P.drop_near_duplicates(spark, docs, DATA).collect())
    assert got == [(4, "a"), (5, "h"), (5, "o")]


def test_near_duplicates_go_by_fingerprints(spark, monkeypatch):
    """Of the copies with a changed word only the first reaches the comparison of sets; an unlike text stays, and so does one whose link fails."""
    words = [f"w{i}" for i in range(400)]
    near = " ".join(words[:200] + ["other"] + words[201:])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, near), (3, "quite another text"), (4, " ".join(reversed(words)))], "doc_id long, text string")
    bits = [int.from_bytes(simhash.majority_bits(simhash.shingle_hashes(t, 4)).to_bytes(8, "big")) for t in (" ".join(words), near)]
    assert 0 < (bits[0] ^ bits[1]).bit_count() <= 4
    met, sets = [], simhash.similar_documents
    monkeypatch.setattr(simhash, "similar_documents", lambda d, k: (met.extend(r.key.id for r in d.collect()), sets(d, k))[1])
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, DATA).collect()) == [1, 3, 4] and sorted(met) == [1, 3, 4]
    links = spark.createDataFrame([(0, 1)], "a long, b long")
    monkeypatch.setattr(simhash, "near_links", lambda reps, most: reps.selectExpr("min(rep) as a", "max(rep) as b").unionByName(links.where("false")))
    unlike = docs.where("doc_id > 2")
    assert sorted(r.doc_id for r in simhash.firsts_by_fingerprint(unlike, "doc_id").collect()) == [3, 4]
