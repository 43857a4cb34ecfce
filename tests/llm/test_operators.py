"""Each corpus operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from foldlog.llm import bpe, embeddings, langid, mixing, quality, sharding, simhash, suffixes, toxicity, warc
from foldlog.llm.common import new_path, table
from foldlog.llm.components import connected_components
from foldlog.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, component string"
LONG = "word " * 3000
AWKWARD = [
    (1, None, "en", "a", 0, "x"), (2, "", None, None, 0, None), (3, "one", "en", "a", 3, "x"), (3, "one", "en", "a", 3, "x"), (None, "no id at all here", "de", "b", None, None),
    (4, LONG, "en", "a", len(LONG), "x"), (5, "été ünï 日本 " * 30, "fr", None, 1, "y"), (6, "été ünï 日本 " * 30, "fr", None, 1, "y"), (7, " \t\n ", "en", "b", 4, "z")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DDL).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents").toPandas()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_shards_are_even_and_gapless(spark, docs):
    got = QUERIES["op1_sharding"](spark, DATA).toPandas()
    want = docs.set_index("doc_id").text.map(lambda t: (len(t.encode()) + 8, zlib.crc32(t.encode())))
    assert [tuple(x) for x in got.sort_values("doc_id")[["size", "text_crc32"]].itertuples(index=False)] == list(want.sort_index())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 24 and abs(by - by.mean()).max() <= got["size"].max()


def test_shards_of_awkward_rows(spark, awkward):
    got = sharding.kd_shards(awkward, 3).toPandas()
    assert len(got) == len(AWKWARD) and got.groupby("shard").slot.max().sum() + got.shard.nunique() == len(AWKWARD)
    assert sharding.kd_shards(awkward.where("false"), 3).count() == 0


def test_shards_of_one_row_repeated(spark):
    rows = [(None, "the same text", "en", "a", 1, None)] * 5000 + [(i, f"text {i}" + " more" * (i % 7), "de", "b", 1, None) for i in range(1000)]
    got = sharding.kd_shards(spark.createDataFrame(rows, DDL).repartition(7)).toPandas()
    want = sorted((d, len(t) + 8, zlib.crc32(t.encode())) for d, t, *_ in ((-1 if r[0] is None else r[0], *r[1:]) for r in rows))
    assert sorted((-1 if d != d else int(d), s, c) for d, s, c in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True)) == want
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 24 and abs(by - by.mean()).max() <= got["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_archives_round_trip(spark):
    long_ = "x" * 300_000
    rows = [(1, "u", "same", 0), (2, "u\r\nEvil: 1", "same", 0), (3, None, None, 1), (4, "v", "", 1), (5, "w", long_, 1), (None, "n", "same", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int").drop("sha1")
    folder = new_path(spark, "wacz")
    got = warc.read_records(warc.list_records(warc.pack_pages(pages, folder), folder), folder).toPandas()
    by = {r.page_id: r for r in got.itertuples() if r.page_id == r.page_id}
    assert len(got) == 6 and (by[1].record_type, by[1].refers_to, by[1].payload_bytes) == ("revisit", 2, 4)
    assert by[2].payload == b"same" and (by[3].record_type, by[3].refers_to) == ("revisit", 4) and by[5].payload == long_.encode()
    assert warc.list_records(warc.pack_pages(pages.where("false"), new_path(spark, "wacz")), folder).count() == 0


def test_zip64_directory(tmp_path):
    import io
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        with z.open("big", "w", force_zip64=True) as m:
            m.write(b"0123456789")
        z.writestr("small", "abc")
    raw = (tmp_path / "a.zip").read_bytes()
    got = warc.zip_members(io.BytesIO(raw), len(raw))
    assert {n: raw[o : o + k] for n, (o, k, _) in got.items()} == {"big": b"0123456789", "small": b"abc"}


def test_warc_query_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{DATA}/pages.parquet')")
    want = con.sql(warc.ORACLE).df().sort_values("page_id").astype(str).values.tolist()
    cols = [c[0] for c in con.sql(warc.ORACLE).description]
    got = QUERIES["op2_warc_zip"](spark, DATA).toPandas()[cols].sort_values("page_id").astype(str).values.tolist()
    strip = lambda rows: [[x.removesuffix(".0").replace("<NA>", "nan").replace("None", "nan") for x in r] for r in rows]
    assert strip(got) == strip(want)


def test_bpe_equals_the_reference_library(spark, docs, awkward):
    import public_tokenizers as P
    import tiktoken

    path = P.path(bpe.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for frame in (table(spark, DATA, "documents"), awkward):
        src = frame.select("doc_id", "text").toPandas()
        got = bpe.bpe_round_trip(frame, path, P.PATTERN).toPandas()
        want = sorted((str(d), len(i := enc.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in src.itertuples(index=False))
        assert sorted((str(r[0]), *r[1:]) for r in got.itertuples(index=False)) == want
    odd = ["a_b __ c", "x² ½ ３４", "a\x1cb\x1f", "'s'll 'D", "\u0085 \xa0 x", "क्षि é", "😀 a\x00"]
    assert bpe.Encoder(path, P.PATTERN).encode(odd) == [enc.encode_ordinary(t) for t in odd]


def test_bpe_offsets_and_split_characters(spark):
    import public_tokenizers as P

    path = P.path(bpe.VOCABULARY)
    text = "héllo 日本 😀 end"
    r = bpe.bpe_decode(bpe.bpe_encode(spark.createDataFrame([(text,), (None,)], "text string"), path, P.PATTERN), path).collect()[0]
    assert bytes(r.decoded) == text.encode() and r.decoded_text == text
    assert r.ids == bpe.tokenizer(path, P.PATTERN).encode(text, add_special_tokens=False).ids
    for i, a, b in zip(r.ids, r.starts, r.ends, strict=True):
        piece = bpe.id_bytes(path)[i]
        assert piece.decode("utf-8", "ignore") in text[a:b]
    cut = [i for i in r.ids if "�" in bpe.decode_text([i], path)]
    assert cut and "�" not in bpe.decode_text(r.ids, path)


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + (i * 37) % 90), "abc"[i % 3] if i % 10 else None) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, again = mixing.mix_sources(d).toPandas(), mixing.mix_sources(d.repartition(3)).toPandas()
    key = lambda x: sorted(zip(x.doc_id, x.copies, strict=True))
    assert key(got) == key(again) and got.copies.between(0, 3).all()
    names, whole = ["a", "b", "c", None], got["size"].sum()
    size = {n: got[got.source.isna() if n is None else got.source == n]["size"].sum() for n in names}
    target, weight = dict.fromkeys(names, 0.0), dict(zip(names, (1, 2, 3, 1), strict=True))
    full = {}
    while True:
        rest = [n for n in names if n not in full]
        for n in rest:
            target[n] = (whole - sum(full.values())) * weight[n] / sum(weight[m] for m in rest)
        over = [n for n in rest if target[n] > 3 * size[n]]
        if not over:
            break
        full |= {n: 3 * size[n] for n in over}
        target |= full
    for n in names:
        g = got[got.source.isna() if n is None else got.source == n]
        assert g.target.iloc[0] == pytest.approx(target[n]) and abs((g.copies * g["size"]).sum() - target[n]) <= 90


def test_mix_of_awkward_rows(spark, awkward):
    got = mixing.mix_sources(awkward).toPandas()
    assert len(got) == len(AWKWARD) and got.copies.between(0, 3).all()
    assert mixing.mixed(awkward).columns == awkward.columns and mixing.mixed(awkward.where("false")).count() == 0


def test_mix_keeps_columns_of_any_name(spark, awkward):
    names = ("row", "picked", "size", "copies", "own", "hash", "bin", "block", "prob", "_c", "_h", "_source", "a.b")
    more = awkward.select("*", *(F.lit(f"my {n}").alias(n) for n in names))
    got = mixing.mixed(more)
    assert got.columns == more.columns and all(r[n] == f"my {n}" for r in got.collect() for n in names)
    kept = mixing.mix_sources(more)
    assert {"row", "picked", "own", "a.b"} < set(kept.columns) and kept.count() == len(AWKWARD) and dict(kept.dtypes)["size"] == "bigint"


def plain_stats(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {g for g in grams if grams.count(g) > 1} if len(grams) < 4000 else {g for g, n in pd.Series(grams).value_counts().items() if n > 1}
    hit = {j for i, g in enumerate(grams) if g in seen for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_word_stats(spark, docs, awkward):
    for frame in (table(spark, DATA, "documents"), awkward):
        got = quality.word_stats(frame).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        for r in got:
            assert tuple(r)[1:] == plain_stats(r.text)


def test_quality_limits(spark, awkward):
    got = quality.judged(quality.word_stats(table(spark, "/root/testdata/sf0.01", "documents")).drop("text")).toPandas()
    assert (got.base_failed == ((got.n_words < 10) | (100 * got.n_repeat_words > 20 * got.n_words))).all() and not (got.kept & got.base_failed).any()
    clean = got.merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    fine = clean[(clean.quality == 1) & ~clean.base_failed]
    assert fine.kept.mean() > 0.97 and clean[clean.quality == 0].kept.mean() < 0.15
    assert quality.quality_rules(awkward).count() == len(AWKWARD) and quality.quality_rules(awkward.where("false")).count() == 0


def plain_limits(stats):
    """Quartiles of each group by lists of buckets with weights: its own documents, and the coarser groups' as 30."""
    values = {m: np.floor(r[2] * stats[r[0]] / stats[r[1]].clip(lower=1)).astype(int) for m, r in quality.METRICS.items()}
    out = {}
    for m, v in values.items():
        rows = [(lg, so, quality_bucket(int(x))) for lg, so, x, n in zip(stats.lang, stats.source, v, stats.n_words, strict=True) if n]

        def blend(own, prior):
            total = sum(prior.values())
            return {b: own.get(b, 0) + 30 * prior.get(b, 0) / total for b in own.keys() | prior.keys()}

        whole = Counter(b for *_, b in rows)
        for lg, so in {r[:2] for r in rows}:
            w = blend(Counter(b for x, y, b in rows if (x, y) == (lg, so)), blend(Counter(b for x, _, b in rows if x == lg), whole))
            q, total = [], sum(w.values())
            for share in (0.25, 0.75):
                upto = 0
                for b in sorted(w):
                    upto += w[b]
                    if upto >= share * total - 1e-9:
                        break
                octave = max(b // 256 - 1, 0)
                q.append(b if b < 512 else (b - 256 * octave) << octave)
            reach = 3 * (q[1] - q[0])
            out[lg, so, m] = (q[0] - reach if quality.METRICS[m][4] == "both" else -1, q[1] + reach)
    return out


def plain_evident(row, m, sign):
    top, under, scale, unit, _ = quality.METRICS[m]
    found = getattr(row, top) / unit
    return scale * unit * max(found + sign * 2 * found**0.5, 0.0) / max(getattr(row, under), 1)


def test_kept_against_plain_quantiles(spark):
    got = quality.judged(quality.word_stats(table(spark, "/root/testdata/sf0.01", "documents")).drop("text")).toPandas()
    got["lang"], got["source"] = got.lang.fillna("-"), got.source.fillna("-")
    limits = plain_limits(got)
    edges = lambda r, m: limits.get((r.lang, r.source, m), (-1, np.inf))
    fits = lambda r: all(plain_evident(r, m, 1) >= edges(r, m)[0] and plain_evident(r, m, -1) <= edges(r, m)[1] for m in quality.METRICS)
    want = [bool(not r.base_failed and fits(r)) for r in got.itertuples()]
    assert got.kept.tolist() == want and 0 < sum(want) < len(want)
    assert len({v for (_, _, m), v in limits.items() if m == "word_length"}) > 40  # limits are the groups' own


def test_quality_limits_adapt(spark):
    """A source whose documents all have symbols keeps them; the same text fails where the others have none. Clashing columns stand."""
    rng = np.random.default_rng(4)
    text = lambda share, n: " ".join(f"w{int(x)}" + "#" * int(rng.random() < share) for x in rng.integers(10, 10**6, n))
    rows = [(source, text(share, int(rng.integers(60, 200))), i) for source, share in (("code", 0.2), ("prose", 0.0)) for i in range(400)]
    frame = spark.createDataFrame([*rows, ("prose", text(0.2, 100), 1000)], "source string, text string, doc_id long").withColumn("lang", F.lit("en"))
    got = quality.quality_rules(frame.select("*", F.lit("mine").alias("_w"), F.lit(7).alias("limits"), F.lit(8).alias("words"), F.lit(-1).alias("n_words"))).toPandas()
    assert (got._w == "mine").all() and (got.limits == 7).all() and (got.words == 8).all() and (got.n_words > 0).all()
    assert got[got.doc_id < 1000].kept.mean() > 0.98 and list(got[got.doc_id == 1000].failed_rules.iloc[0]) == ["symbols"]


def test_sketch_buckets(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 12345, 10**9]
    rows = spark.createDataFrame([(v,) for v in values], "value long").withColumn("bucket", quality.sketch_bucket(F.col("value")))
    one = rows.select(F.lit("m").alias("metric"), "value", "bucket").collect()
    assert all(a.bucket <= b.bucket for a, b in pairwise(one))
    q = quality.quartiles(spark.createDataFrame([("m", quality_bucket(v), 1) for v in range(1001)], "metric string, bucket long, n long"), []).first()
    assert q.q1 == pytest.approx(250, rel=0.04) and q.q3 == pytest.approx(750, rel=0.04)


def quality_bucket(v):
    octave = max(0, v.bit_length() - 9)
    return v if v < 512 else octave * 256 + (v >> octave)


def test_toxicity_held_out(spark):
    d = spark.createDataFrame([(i, ("idiot moron " if i % 5 == 0 else "") + " ".join(f"w{(i * j) % 97}x" for j in range(2, 40))) for i in range(1500)], "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    got = toxicity.scored(d, toxicity.fit(d, labels)).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).where("held").toPandas()
    assert ((got.score >= 0.3) == (got.doc_id % 5 == 0)).mean() > 0.97


def plain_ratios(counts):
    """Kneser-Ney over all beginnings of words, one expression at a time."""
    n = {}
    for word, (toxic, plain) in counts.items():
        for i in range(len(word) + 2):
            x = (word + "$")[:i]
            a = n.setdefault(x, [0, 0, 0])
            for k, v in enumerate((1, toxic, plain)):
                a[k] += v
    after = {}
    for x in n:
        if x:
            after.setdefault(x[:-1], []).append(x)
    off = lambda x, k: 0.75 * (n[x][0] > 0) if k == 0 else min(n[x][k], 3)

    def p(x, k):
        c = x[:-1]
        if k and n[c][k] == 0:
            return p(x, 0)
        backoff = p(x, 0) if k else 1 / 64
        return (n[x][k] - off(x, k)) / n[c][k] + sum(off(y, k) for y in after[c]) / n[c][k] * backoff

    return {w: sum(np.log(p((w + "$")[:i], 1) / p((w + "$")[:i], 2)) for i in range(1, len(w) + 2)) / (len(w) + 1) for w in counts}


def test_toxicity_model_equals_plain_kneser_ney(spark, monkeypatch):
    rng = np.random.default_rng(2)
    counts = {"".join(rng.choice(list("abcé"), rng.integers(1, 7))): (int(rng.integers(0, 6)), int(rng.integers(0, 9))) for _ in range(400)}
    want = {h: r for h, r in zip(toxicity.word_hashes(list(counts)).tolist(), plain_ratios(counts).values(), strict=True)}
    rows = spark.createDataFrame([(w, *n) for w, n in counts.items()], "word string, n_toxic long, n_plain long")
    for part_words in (10**6, 40, 7):
        monkeypatch.setattr(toxicity, "PART_WORDS", part_words)
        got = {r.word: r.ratio for r in toxicity.word_ratios(rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-6 for w in want)


def test_toxicity_scores_do_not_depend_on_partitions_or_the_way_of_joining(spark, monkeypatch):
    labels, docs = table(spark, DATA, "labels"), table(spark, DATA, "documents").select("doc_id", "text")
    one = {r.doc_id: r.score for r in toxicity.scored(docs.coalesce(1), toxicity.fit(docs.coalesce(1), labels)).collect()}
    monkeypatch.setattr(toxicity, "PART_WORDS", 5000)
    many = docs.repartition(16)
    model = toxicity.fit(many, labels)
    assert {r.doc_id: r.score for r in toxicity.scored(many, model).collect()} == one
    joined = toxicity.score_texts(docs.withColumn("row", F.lit(1)), model[0], "mean", "peak", broadcast_words=0)
    plain = {r.doc_id: (r["mean"], r.peak) for r in toxicity.score_texts(docs, model[0], "mean", "peak").collect()}
    assert {r.doc_id: (r["mean"], r.peak) for r in joined.collect()} == plain and joined.columns == ["doc_id", "text", "row", "mean", "peak"]


def test_toxicity_joins_the_rare_words_alone(spark, monkeypatch):
    """Words used often go to every task whatever the size of the table; before, one word too many had all words of all texts joined."""
    labels, docs = table(spark, DATA, "labels"), table(spark, DATA, "documents").select("doc_id", "text")
    ratios, _ = toxicity.fit(docs, labels)
    features = lambda most: {r.doc_id: (r["mean"], r.peak) for r in toxicity.score_texts(docs, ratios, "mean", "peak", most).collect()}
    uses = sorted((r.n for r in ratios.collect()), reverse=True)
    plain, joined, real = features(len(uses)), [], toxicity._rare_words
    monkeypatch.setattr(toxicity, "_rare_words", lambda *a: joined.append(real(*a)) or joined[-1])
    for most in (len(uses) - 1, len(uses) // 8):
        assert features(most) == plain
        least = min(n for n in set(uses) if sum(u >= n for u in uses) <= most)
        assert 0 < joined[-1].count() <= sum(u for u in uses if u < least)
    assert len(joined) == 2 and joined[0].count() < sum(uses) // 4


def test_toxicity_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(3, None), (99, 1)], "doc_id long, toxic int")
    own = awkward.withColumn("mean", F.lit("m")).withColumn("peak", F.lit("p")).withColumn("score", F.lit("s"))
    got = toxicity.scored(own, toxicity.fit(own, labels), "_score").toPandas()
    assert len(got) == len(AWKWARD) and got._score.between(0, 0.3).all() and set(got.score) == {"s"} and set(got["mean"]) == {"m"}
    assert toxicity.scored(awkward.where("false"), toxicity.fit(awkward.where("false"), labels)).count() == 0


def plain_fingerprint(text, size=4):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    sh = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op7_simhash"](spark, DATA).collect()}
    fp = {d: plain_fingerprint(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all((got[d].fingerprint, got[d].component_id) == (f"{fp[d]:016x}", find(d)) for d in ids)


def test_simhash_finds_all_bit_errors(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, 4, replace=False)) for b in base]
    rows = [(i, int(b).to_bytes(8, "big")) for i, b in enumerate(base)] + [(100 + i, n.to_bytes(8, "big")) for i, n in enumerate(near)]
    links = simhash.near_links(spark.createDataFrame(rows, "rep long, fp binary"), 4)
    assert {tuple(sorted((r.a, r.b))) for r in links.collect()} == {(i, 100 + i) for i in range(40)}


def test_byte_triples_lie_within_any_four():
    triples = [set(t) for t in simhash.byte_triples()]
    assert len(triples) == 20 and all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


@pytest.mark.parametrize("long", [1, 8, 2048])
def test_simhash_long_lists_lose_no_link(spark, long):
    """Fingerprints that share their first three bytes, some four: every level of the index has the same components as all pairs."""
    rng = np.random.default_rng(2)
    base = [0x0102030000000000 | int(x) for x in rng.integers(0, 1 << 40, 60)] + [0x0102030400000000 | int(x) for x in rng.integers(0, 1 << 32, 60)]
    fps = sorted({v for b in base for v in (b, *(b ^ sum(1 << int(x) for x in rng.choice(64, n, replace=False)) for n in (1, 3, 4)))})
    frame = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(fps)], "rep long, fp binary")

    def groups(pairs):
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(fps))]

    got = [(r.a, r.b) for r in simhash.near_links(frame, 4, long).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in got)
    assert groups(got) == groups((a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4)


def test_simhash_of_a_crowded_list(spark):
    """20,000 unlike fingerprints that share four bytes: the list is dealt again, not scanned pair by pair."""
    rng = np.random.default_rng(3)
    fps = sorted({0x0A0B0C0D00000000 | int(x) for x in rng.integers(0, 1 << 32, 20_000)})
    frame = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(fps)], "rep long, fp binary")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.near_links(frame).collect()}
    words = np.array(fps, np.uint64)
    near = [(a, a + 1 + int(b)) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(words[a + 1 :] ^ words[a]) <= 4)]
    assert got <= set(near) and {x for p in got for x in p} == {x for p in near for x in p}


def test_simhash_of_awkward_rows(spark, awkward):
    got = simhash.near_duplicates(awkward.select("doc_id", "text"), "doc_id").toPandas()
    assert len(got) == len(AWKWARD)
    zero = got[got.doc_id.isin([1, 2, 7])]
    assert (zero.component == 1).all() and simhash.near_duplicates(awkward.where("false").select("doc_id", "text")).count() == 0
    own = awkward.select("doc_id", "text", F.lit("mine").alias("fp"), F.lit("too").alias("Component"))
    more = simhash.near_duplicates(own).toPandas()
    assert (more.fp == "mine").all() and (more.Component == "too").all() and sorted(more._component.dropna()) == sorted(got.component.dropna())


def plain_repeats(rows):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 99):
            if seen.setdefault(b[i : i + 100], (d, i)) != (d, i):
                cover[i] += 1
                cover[i + 100] -= 1
        c = np.cumsum(cover)[: len(b)] > 0
        spans = int((c & ~np.concatenate([[False], c[:-1]])).sum()) if len(b) else 0
        out[d] = (len(b), int(c.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~c])).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, docs):
    extra = [(900, "ab" * 300), (901, "abcdefghi" * 40), (902, None), (903, ""), (904, "x" * 99), (905, "x" * 100), (906, "y" + "x" * 100), (907, "été" * 60), (908, "z" + "été" * 60)]
    rows = list(zip(docs.doc_id.tolist(), docs.text, strict=True)) + extra
    got = suffixes.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = plain_repeats(rows)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want


def test_repeats_of_awkward_rows(spark, awkward):
    own = awkward
    for c in ("doc", "crc", "spans", "null", "own", "place", "more", "runs"):
        own = own.withColumn(c, F.lit(c))
    got = suffixes.without_repeats(own)
    assert got.columns == own.columns and {tuple(r)[6:] for r in got.collect()} == {("doc", "crc", "spans", "null", "own", "place", "more", "runs")}
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text is None and rows[5].n_chars == len(rows[5].text) and len(rows[6].text) < 40
    assert suffixes.without_repeats(awkward.where("false")).count() == 0


def test_loser_tree_merges_like_a_sort():
    rng = np.random.default_rng(5)
    pool = rng.integers(97, 99, (60, 100)).astype(np.uint8)
    runs, every = [], []
    for _ in range(5):
        pick = pool[rng.choice(60, 30, replace=False)]
        pick = pick[np.argsort(pick.view("S100").ravel())]
        shared, rest = suffixes.front_coded(pick)
        runs.append((shared.tobytes(), rest))
        every.append([bytes(x) for x in pick])
    at, got, agree = [0] * 5, [], []
    for run, n in suffixes.merge_runs(runs, 100):
        got.append(every[run][at[run]])
        agree.append(n)
        at[run] += 1
    assert got == sorted(x for r in every for x in r)
    for (a, b), n in zip(pairwise(got), agree[1:], strict=True):
        assert n == next((i for i in range(100) if a[i] != b[i]), 100)


def test_repeats_of_hot_ngrams_and_small_runs(spark, docs, monkeypatch):
    """Every n-gram that stands three times or more is sorted window by window, over several runs and ranges."""
    for name, value in (("HOT_RUNS", 2), ("HOT_SHARE", 1 << 40), ("RUN_CONTEXTS", 700), ("RANGE_CONTEXTS", 500)):
        monkeypatch.setattr(suffixes, name, value)
    passage = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(160))
    rows = [(i, f"{i * 7919 % 1000:03d}" * (i % 50) + passage + f"{i * 104729 % 1000:03d}" * ((i * 3) % 40)) for i in range(60)] + [(100 + i, "ab" * (40 + i)) for i in range(30)]
    rows += list(zip((docs.doc_id[:60] + 1000).tolist(), docs.text[:60], strict=True))
    got = suffixes.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == plain_repeats(rows)


def test_repeated_rows_are_no_repeats_of_themselves(spark):
    text = "".join(map(chr, np.random.default_rng(6).integers(97, 123, 300)))
    rows = [(1, text), (1, text), (2, "-" + text), (None, text), (None, text), (3, "short")]
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=str) == sorted([(1, 300, 0), (1, 300, 0), (2, 301, 300), (None, 300, 300), (None, 300, 300), (3, 5, 0)], key=str)


def test_language_held_out(spark):
    got = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents"), "doc_id").toPandas()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_popcounts_against_sets():
    """Hits of each word by language against sets of its n-grams' hashes, letter by letter."""
    def grams(word):
        return [int(g) for _, h in langid.ngrams([word]) for g in h.ravel()]

    texts = {"aa": ["haus", "straße", "über"], "bb": ["maison", "été"], "cc": []}
    known = {lang: {g for w in ws for g in grams(w)} for lang, ws in texts.items()}
    filters = langid.Filters({lang: [int(np.uint64(g).view(np.int64)) for g in own] for lang, own in known.items()})
    for word in ("haus", "maison", "hausen", "été", "qqq", "ü"):
        n = len(word) + sum(max(0, len(word) + 2 - k + 1) for k in (2, 3, 4))
        got = filters.hits([word])[0]
        assert len(grams(word)) == n and got[0] == n
        want = [sum(g in known[lang] for g in grams(word)) for lang in filters.langs]
        # three probes of a nearly empty table name no other language here
        assert got[1:].tolist() == want


def test_languages_do_not_depend_on_slices(spark, awkward, monkeypatch):
    filters = langid.train(table(spark, DATA, "documents").select("text", "lang"))
    rows = table(spark, DATA, "documents").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    whole = langid.identify(rows, filters).toPandas().astype(str).values.tolist()
    monkeypatch.setattr(langid, "SLICE_BYTES", 200)
    assert langid.identify(rows, filters).toPandas().astype(str).values.tolist() == whole
    named = langid.identify(rows.withColumn("Score", F.lit("x")).withColumn("lang_pred", F.lit(1)), filters)
    assert named.columns == ["doc_id", "lang_pred", "score"] and named.toPandas().astype(str).values.tolist() == whole


def test_language_of_awkward_rows(spark, awkward):
    filters = langid.train(table(spark, DATA, "documents").select("text", "lang"))
    got = langid.identify(awkward.select("doc_id", "text"), filters).toPandas()
    assert set(got[got.doc_id.isin([1, 2, 7])].lang_pred) == {"und"}
    empty = langid.train(awkward.where("false").select("text", "lang"))
    assert set(langid.identify(awkward.select("doc_id", "text"), empty).toPandas().lang_pred) == {"und"}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 64))
    rows = [(i, (centre[i % 30] + rng.normal(scale=0.12, size=64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, [0.0] * 64), (403, None), (404, [float("nan")] * 64), (405, [1.0, 0.0]), (406, [1.0, 0.001]), (407, [])]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas().set_index("vec_id")
    v = {i: np.array(x, float) for i, x in rows if x and np.isfinite(x).all() and np.linalg.norm(x)}
    links = {i: {j for j in v if j != i and len(v[i]) == len(v[j]) and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= 0.95} for i in v}
    found, want = sum(got.n_links), sum(map(len, links.values()))
    assert found <= want and found >= 0.95 * want
    assert (got.n_links.loc[[402, 403, 404, 407]] == 0).all() and got.n_links.loc[405] == 1 and got.component_id.loc[401] == got.component_id.loc[0]


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(16) + rng.normal(scale=0.02, size=16)).tolist()) for i in range(60)]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert (got.n_links == 59).all() and (got.component_id == 0).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100)}
