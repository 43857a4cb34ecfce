"""Line dedup, periodic runs and whitening against plain versions, and on awkward rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlog.llm import lines, runs, whitening
from foldlog.llm.common import table
from foldlog.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"
sha = lambda text: hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def plain_line_dedup(rows):
    """rows (id, text) to (id, n_lines, n_dropped, text)."""
    low = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = {}
    for id_, text in rows:
        for line in (text or "").split("\n"):
            if len(low(line)) >= 20:
                holders.setdefault(low(line), set()).add(id_)
    last = {k: max((x for x in ids if x is not None), default=None) for k, ids in holders.items() if len(ids) >= 3}
    out = []
    for id_, text in rows:
        split = (text or "").split("\n")
        stay = [x for x in split if low(x) not in last or (id_ is not None and id_ == last[low(x)])]
        out.append((id_, len(split), len(split) - len(stay), "\n".join(stay)))
    return out


def order(rows):
    return sorted(rows, key=str)


def test_line_dedup_is_plain_line_dedup(spark):
    docs = table(spark, DATA, "documents")
    want = plain_line_dedup([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = QUERIES["op12_line_dedup"](spark, DATA).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert order(map(tuple, got)) == order((a, b, c, sha(d)) for a, b, c, d in want) and sum(x[2] for x in want)


def test_line_dedup_of_awkward_rows(spark):
    a, b, c = "A shared line, LONG enough", "été ünï 日本 " * 5, "unique " * 4
    rows = [
        (1, f" {a}\t\nx\n{b}"), (2, f"{a.lower()}\r\n\n{c}\n"), (3, f"{a}\n{a}\n{b}\nx"), (3, f"{a}\n{a}\n{b}\nx"), (3, "another text of id three\n" + b), (4, None), (5, ""), (None, a), (None, f"{b}\n{a}"),
        (6, "\n".join([b] * 3000)), (7, "\n\n"), (8, f"{a} "), (9, f"{a} \u0085"), (10, "ten letters\nten letters"), (11, "ten letters"), (12, "TEN letters")]
    docs = spark.createDataFrame([(i, t, i, "x", t) for i, t in rows], "doc_id long, text string, n_lines long, places string, lines string")
    got = lines.line_dedup(docs)
    assert got.columns == [*docs.columns, "_n_lines", "n_dropped"]
    assert order((r.doc_id, r._n_lines, r.n_dropped, r.text) for r in got.collect()) == order(plain_line_dedup(rows))
    assert lines.line_dedup(docs.where("false")).count() == 0


def plain_runs(words, least_words, least_periods):
    out = []
    for q in range(1, len(words) // least_periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n, own = j + q - i, words[i : j + q]
            if j > i and n >= max(least_words, least_periods * q) and not any(own[r:] == own[: n - r] for r in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_digest(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 24, 3)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_are_plain_runs():
    rng = random.Random(3)
    for _ in range(400):
        n, letters = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 6])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 2)):
            if n > 5:
                a, p = rng.randrange(n), rng.randint(1, 8)
                for i in range(a + p, min(n, a + 50)):
                    words[i] = words[i - p]
        for least in ((2, 2), (6, 3), (24, 3)):
            assert [tuple(map(int, x)) for x in runs.runs_of(np.array(words, np.int64), *least)] == plain_runs(words, *least)
        assert [tuple(map(int, x)) for x in runs.word_runs([str(w).encode() for w in words])] == plain_runs(words, 24, 3)


def test_periodic_stretches_hold_all_runs():
    rng = random.Random(4)
    words = [rng.randrange(1000) for _ in range(600)]
    words[100:112] = words[50:62]  # a copy that is no run
    words[300:360] = words[300:307] * 9
    del words[363:]
    stretches = runs.periodic_stretches(np.array(words))
    assert len(stretches) == 1 and stretches[0][0] <= 300 and stretches[0][1] >= 360


def test_common_extensions():
    rng = np.random.default_rng(5)
    for size, letters in ((40, 2), (3000, 2), (3000, 900)):
        s = rng.integers(0, letters, size)
        s[size // 2 :] = s[: size - size // 2]
        tree = runs.SuffixTree(s.tolist())
        i, j = rng.integers(0, size + 1, 300), rng.integers(0, size + 1, 300)
        i, j = i[i != j], j[i != j]
        want = [next((k for k in range(size) if max(a, b) + k >= size or s[a + k] != s[b + k]), 0) for a, b in zip(i, j, strict=True)]
        assert tree.lce(i, j).tolist() == want


def test_periodic_runs_query_is_plain(spark):
    want = [plain_digest(r.doc_id, (r.text or "").encode().split()) for r in table(spark, DATA, "documents").collect()]
    got = QUERIES["op13_periodic_runs"](spark, DATA).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert order(map(tuple, got.collect())) == order(want) and sum(x[1] for x in want) > 10


def test_runs_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b " * 40), (4, "a b " * 40), (None, "a b " * 40), (5, "ä " * 24), (6, "ä " * 23), (7, "w " * 60_000), (8, " ".join(map(str, range(5000))) + " x" * 30)]
    docs = spark.createDataFrame([(i, t, "r", t) for i, t in rows], "doc_id long, text string, runs string, collapsed string")
    got = runs.periodic_runs(docs)
    assert got.columns == [*docs.columns, "_runs", "_collapsed"]
    by = {(r.doc_id, r.text): ([tuple(x) for x in r._runs], r._collapsed) for r in got.collect()}
    assert by[1, None] == by[2, ""] == by[3, " \n\t "] == ([], "")
    assert by[4, "a b " * 40] == by[None, "a b " * 40] == ([(0, 80, 2)], "a b") and by[5, "ä " * 24] == ([(0, 24, 1)], "ä") and by[6, "ä " * 23][0] == []
    assert by[7, "w " * 60_000] == ([(0, 60_000, 1)], "w") and by[8, rows[-1][1]][0] == [(5000, 30, 1)]
    assert got.count() == len(rows) and runs.periodic_runs(docs.where("false")).count() == 0


def plain_whitening(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return n, s, e[::-1], q[:, ::-1]


def test_whitening_is_plain_whitening(spark):
    rows = [r for r in table(spark, DATA, "embeddings").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in rows])
    n, s, e, q = plain_whitening(x)
    got = QUERIES["op11_whitening"](spark, DATA).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(rows) and set(got.n) == {n} and got.identity_error.iloc[0] < 1e-9 and got.identity_error.nunique() == 1
    assert np.allclose(got.explained.to_numpy()[:16], e[:16] / e.sum(), rtol=1e-9)
    by_id = np.argsort([r.vec_id for r in rows])
    assert (got.deviation.to_numpy()[::16] == (((n * x - s) ** 2).sum(1))[by_id]).all()
    w = got.whitened.to_numpy().reshape(-1, 16)
    p = ((n * x - s) / n @ q[:, :16] / np.sqrt(e[:16]))[by_id]
    assert np.allclose(w, p * np.sign((w * p).sum(0)), atol=1e-8)


def test_components_of_hard_matrices():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.standard_normal((50, 50)))[0]
    square = lambda a: a @ a.T
    cases = {"one": np.array([[3.0]]), "two": square(rng.standard_normal((2, 4))), "dense": square(rng.standard_normal((64, 99))), "equal": np.eye(20), "diagonal": np.diag([5, 5, 5, 1, 1, 0, 0, 3.0]),
             "rank 4": square(rng.standard_normal((30, 4))), "clusters": (turn * np.repeat([7.0, 3, 1], [10, 20, 20])) @ turn.T, "near": np.diag(np.abs(np.arange(-10, 11.0)) + 12) + np.eye(21, k=1) + np.eye(21, k=-1)}
    for name, v in cases.items():
        e, q = whitening.leading_components(v, 16)
        want = np.linalg.eigvalsh(v)[::-1]
        assert len(e) == min(16, (want > 1e-12 * want[0]).sum()), name
        assert np.abs(e - want[: len(e)]).max() < 1e-13 * want[0] and np.abs(v @ q - q * e).max() < 1e-13 * want[0] and np.abs(q.T @ q - np.eye(len(e))).max() < 1e-13, name
    assert whitening.leading_components(np.zeros((3, 3)), 2)[0].size == 0


def test_sturm_counts():
    d, o = np.array([2.0, -1, 3, 0.5]), np.array([1.0, 0, 2])
    e = np.linalg.eigvalsh(np.diag(d) + np.diag(o, 1) + np.diag(o, -1))
    shifts = np.linspace(-5, 6, 40)
    assert (whitening.sturm_counts(d, o, shifts) == [(e < x).sum() for x in shifts]).all()


def test_whitening_of_awkward_rows(spark):
    v = [[1.0, 2.0, 0.5], [0.25, -1.0, 3.0], [4.0, 0.0, 0.0], [1.0, 1.0, 1.0], [-2.0, 5.0, 0.1]]
    bad = [(20, None), (21, []), (22, [1.0, None, 2.0]), (23, [math.nan, 1.0, 1.0]), (24, [math.inf, 1.0, 1.0]), (25, [1.0, 2.0]), (26, [1e300, 0.0, 0.0])]
    rows = [*enumerate(v), (7, v[0]), (7, v[0]), (None, v[1]), *bad]
    got = whitening.whiten(spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, component string, n int")).toPandas()
    assert len(got) == 3 * 8 and set(got.n) == {5} and got.vec_id.isna().sum() == 3 and got.identity_error.max() < 1e-9
    same = got[got.vec_id.isin([0, 7])].groupby("component").whitened.nunique()
    assert (same == 1).all()
    for few in (rows[:1], [(1, v[0]), (2, v[0])], bad[:5], []):
        assert whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>")).count() == 0
    flat = [(i, [float(i), float(i), 7.0]) for i in range(6)]
    assert whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).toPandas().component.max() == 1


def test_whitening_of_large_numbers_is_exact(spark):
    v = [[2.0**40, 1.0], [-(2.0**41), 2.0], [3.0, 2.0**39], [5.0, 5.0]]
    x = [[math.floor(64 * c) + 1_000_000 for c in row] for row in v]
    s = [sum(c) for c in zip(*x, strict=True)]
    far = [sum((4 * c - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).where("component = 1").orderBy("vec_id").collect()
    assert [r.deviation for r in got] == [f if f < 1 << 63 else None for f in far] and all(math.isfinite(r.whitened) for r in got)


def test_partial_matrices_add_up_in_levels(spark):
    rows = [(p, i, [float(p), float(i)]) for p in range(100) for i in range(3)]
    got = whitening._added(spark.createDataFrame(rows, "part long, i long, row array<double>").repartition(5), 100).orderBy("i").collect()
    assert [(r.i, r.row) for r in got] == [(i, [4950.0, 100.0 * i]) for i in range(3)]


@pytest.mark.parametrize("name", ["op11_whitening", "op12_line_dedup", "op13_periodic_runs"])
def test_native_main_paths_and_pruned_scans(spark, name, capsys):
    QUERIES[name](spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "label" not in plan and "n_chars" not in plan
    if name.startswith("op12"):
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_oracle_matches_on_small_table(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = con.execute(lines.ORACLE).fetchall()
    got = QUERIES["op12_line_dedup"](spark, DATA).select(F.col("doc_id"), "n_lines", "n_dropped", "kept_sha256").collect()
    assert order(map(tuple, got)) == order(map(tuple, want))


def plain_repeats(rows, length=100):
    """rows in order of documents, (document, bytes): removed places of each, by the strings that start earlier."""
    seen, out = {}, []
    for doc, text in rows:
        gone = set()
        for i in range(len(text) - length + 1):
            first = seen.setdefault(text[i : i + length], (doc, i))
            if first != (doc, i):
                gone |= set(range(i, i + length))
        out.append((doc, len(gone)))
    return out


def colliding_texts(rng, n, size):
    """n texts without anything in common whose 31-bit checksums are equal."""
    base, rest = zlib.crc32(rng.randbytes(size)) >> 1, []
    while len(rest) < n:
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=size))
        want = base << 1
        # the last four bytes that lead to a checksum, by its linear table
        low = zlib.crc32(text.encode())
        tail = _forge(low, want)
        if all(32 <= b < 127 for b in tail):
            rest.append(text + tail.decode())
    return rest


def _forge(crc, want):
    table_ = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table_.append(c)
    top = {c >> 24: i for i, c in enumerate(table_)}
    state, index = want ^ 0xFFFFFFFF, []
    for _ in range(4):
        i = top[state >> 24]
        index.append(i)
        state = ((state ^ table_[i]) << 8) & 0xFFFFFFFF
    state, out = crc ^ 0xFFFFFFFF, bytearray()
    for i in reversed(index):
        out.append((state & 0xFF) ^ i)
        state = (state >> 8) ^ table_[i]
    return bytes(out)


def test_suffix_dedup_tells_rows_of_one_id_and_checksum_apart(spark):
    from foldlog.llm import suffixes

    rng = random.Random(9)
    short, long_ = colliding_texts(rng, 1, 20)[0], colliding_texts(rng, 1, 412)[0]
    same = colliding_texts(rng, 2, 300)
    a, b = same
    shared = "".join(rng.choices("abcdefgh ", k=150))
    rows = [(None, a), (None, b), (None, a + shared), (None, shared + b), (7, a[:90]), (7, b[:90] + shared), (7, short), (7, long_), (7, long_), (8, long_)]
    assert zlib.crc32(a.encode()) >> 1 == zlib.crc32(b.encode()) >> 1
    got = suffixes.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == len(rows) and got.n_bytes.sum() == sum(len(t) for _, t in rows)
    removed = got.set_index("n_bytes").n_removed.groupby(level=0).apply(sorted).to_dict()
    assert removed[len(short)] == [0] and removed[len(long_)] == [0, 0, len(long_)]
    # rows of id 7 come before those without; of the latter each pair that shares a passage loses it once
    null = got[got.doc_id.isna()].n_removed.sum()
    assert null == len(a) + 2 * 150 + len(b)


def test_many_texts_without_id_are_numbered(spark):
    from foldlog.llm import suffixes

    rows = [(None, f"text {i} " + f"{i * 7919:09d} " * 14) for i in range(3000)] + [(1, "x")] * 3 + [(None, "text 5 " + "000039595 " * 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = suffixes._keyed(docs, "doc_id").toPandas()
    assert keyed[keyed.doc != 1].tie.nunique() == 3000 and keyed[keyed.doc != 1].tie.max() == 2999 and set(keyed[keyed.doc == 1].tie) == {0}
    assert suffixes.repeat_digest(docs.where("doc_id is null")).count() == 3001


def test_compressed_texts_come_in_slices_of_bytes():
    import pyarrow as pa
    import zstandard

    from foldlog.llm.common import inflated

    texts = [b"x" * n for n in (10, 3 << 20, 3 << 20, 9 << 20, 5)] + [None] * 3 + [b"y"] * 600
    batch = pa.RecordBatch.from_pydict({"t": pa.array([t and zstandard.compress(t) for t in texts], pa.binary()), "i": pa.array(range(len(texts)))})
    parts = list(inflated(iter([batch]), "t"))
    assert [t for _, own in parts for t in own] == texts and [i for p, _ in parts for i in p.column("i").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or (p.num_rows <= 512 and sum(len(t or b"") for t in own) <= 1 << 22) for p, own in parts)
