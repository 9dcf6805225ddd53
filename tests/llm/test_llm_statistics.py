"""Whitening, line removal and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from caselake.llm import line_dedup, resampling, whitening

SF = "/root/testdata/sf0.001"


# Whitening

def covariance(x):
    c = x - x.mean(axis=0)
    return c.T @ c / len(x)


@pytest.mark.parametrize("d,rank", [(1, 1), (3, 3), (20, 20), (40, 5), (150, 150)])
def test_eigenpairs_reach_double_precision(d, rank):
    rng = np.random.default_rng(d)
    v = covariance(rng.standard_normal((4 * d + 9, rank)) @ rng.standard_normal((rank, d)))
    values, vectors, residuals = whitening.eigenpairs(lambda b: v @ b, d, 8)
    want = np.linalg.eigvalsh(v)[::-1][:8]
    assert np.abs(values - want).max() <= 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12
    assert residuals.max() <= 1e-13 * want[0]


def test_eigenpairs_of_equal_eigenvalues():
    v = np.diag([5.0] * 6 + [2.0] * 6 + [0.0] * 30)
    values, vectors, _ = whitening.eigenpairs(lambda b: v @ b, 42, 8)
    assert np.allclose(values, [5.0] * 6 + [2.0] * 2, atol=1e-12)


def test_minres_solves_an_indefinite_system():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    b = rng.standard_normal(12)
    solver = whitening.minres(b, 1e-12, 60)
    said = None
    with pytest.raises(StopIteration) as end:
        while True:
            said = a @ solver.send(said)
    assert np.allclose(a @ end.value.value, b, atol=1e-8)


def test_whitening_of_a_table(spark):
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))).astype("float32")
    rows = [(i, [float(v) for v in r], "k") for i, r in enumerate(x)]
    rows += [(1000, None, "k"), (1001, [None] + [0.0] * 11, "k"), (1002, [float("nan")] * 12, "k"), (1003, [float("inf")] * 12, "k"),
             (1004, [1.0] * 5, "k"), (1005, [], "k"), (None, rows[4][1], "k"), (1006, rows[4][1], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string")
    model = whitening.fit(table)
    got = whitening.whitened(model).collect()
    whole = np.floor(1024 * np.concatenate([x, x[4:5], x[4:5]]).astype(float)).astype(int) + 100000
    n, s = len(whole), whole.sum(axis=0)
    v = covariance(whole.astype(float))
    values = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == 302 * 8 and {r.n for r in got} == {302}
    assert max(r.identity_error for r in got) <= 1e-9
    by = defaultdict(dict)
    for r in got:
        if r.vec_id is not None:
            by[r.vec_id][r.component] = r
    assert set(by) == set(range(300)) | {1006}
    ids = sorted(by)
    w = np.array([[by[i][c].whitened for c in range(1, 9)] for i in ids])
    for i in ids[:300]:
        assert int(by[i][1].deviation) == int(((n * whole[i].astype(object) - s.astype(object)) ** 2).sum())
    for c in range(8):
        assert abs(by[0][c + 1].explained - values[c] / np.trace(v)) <= 1e-10
    full = np.concatenate([w, w[[ids.index(4)]]])  # the row without an id is equal to row 4
    assert np.abs(full.T @ full / n - np.eye(8)).max() <= 1e-9
    assert np.allclose(w[ids.index(1006)], w[4])


def test_whitening_of_nothing_and_of_equal_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened(whitening.fit(empty)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whitened(whitening.fit(same)).count() == 0


def test_deviations_of_any_size_are_exact():
    x = np.array([[2 ** 51, -2 ** 51], [5, 7]], np.int64)
    sums = [2 ** 60 + 5, 17]
    want = [sum((3_000_000 * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
    assert whitening.exact_deviations(x, 3_000_000, sums) == want


# Lines

def plain_lines(rows, least=40, copies=5):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(doc)
    last = {k: max(d, key=lambda v: (v is not None, v or 0)) for k, d in holders.items() if len(d) >= copies}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [s for s in lines if last.get(key(s), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def some_lines(seed, n):
    rng = random.Random(seed)
    shared = [f"line {i} é " + "common words of many documents " * rng.randint(1, 3) for i in range(30)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 9)):
            pick = rng.random()
            line = rng.choice(shared) if pick < 0.4 else "short" if pick < 0.5 else f"own line {rng.random()} of this one document only"
            lines.append(rng.choice(["", " ", "\t", "\x0b", " \r"]) + (line.upper() if rng.random() < 0.2 else line) + rng.choice(["", " ", " "]))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("most", [1 << 26, 1 << 14])
def test_lines_against_brute_force(spark, most):
    rows = some_lines(1, 400) + [(900, None), (901, ""), (902, "\n\n"), (3, some_lines(1, 4)[3][1]), (None, some_lines(1, 8)[7][1]), (903, "x" * 500_000)]
    rows += [(1000 + i, "one line that is found in a third of all documents\nZ" + str(i)) for i in range(300)]
    docs = spark.createDataFrame([(d, t, 7, "k") for d, t in rows], "doc_id long, text string, n_lines int, key string").repartition(5)
    got = line_dedup.drop_repeated_lines(docs, most=most)
    assert got.columns == ["doc_id", "key", "kept", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=str) == plain_lines(rows)


def test_no_lines(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_folding_filters_only_lets_more_pass(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SECTION_BITS", (1 << 10, 1 << 12))
    docs = spark.createDataFrame(some_lines(2, 600), "doc_id long, text string").repartition(6)
    keys = line_dedup.document_keys(docs, "doc_id", "text", 40).cache()
    n = sum(len(r.keys) // line_dedup.DIGEST for r in keys.collect())
    seen = Counter(bytes(r.keys[i:i + 16]) for r in keys.collect() for i in range(0, len(r.keys), 16))
    before = set()
    for most in (1 << 26, 1 << 8, 1 << 7):
        shape, filled = line_dedup.twice_seen(keys, n, most)
        assert filled.nbytes <= most and shape[0] > 1
        found = {bytes(r.key) for r in line_dedup.suspects(keys, shape, filled).collect()}
        assert found >= {k for k, c in seen.items() if c > 1} and found >= before
        before = found
        if most == 1 << 26:
            assert len(found) < len(seen) / 2


# Resampling

def plain_scores(docs, target, longest, buckets, percent, least):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    total, wanted = s.total(), t.total()
    out = []
    for doc, text in docs:
        words, fs = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest,head_size", [(1, 1 << 15), (1, 20), (2, 60), (3, 60)])
def test_resampling_against_brute_force(spark, longest, head_size):
    rng = random.Random(longest)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÀÉ", "straße", "北京", "X9", "w" * 200]
    docs = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "\x00", "-A", " b"]) for _ in range(rng.choice([0, 5, 19, 20, 60]))))
            for i in range(300)] + [(500, None), (501, ""), (None, "w1 " * 30), (502, "same " * 25), (502, "same " * 25)]
    target = [" ".join(rng.choice(vocabulary[:20]) for _ in range(50)) for _ in range(20)] + [None]
    got = resampling.resample(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, rank int").repartition(4),
                              spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=100, head_size=head_size)
    rows = sorted(map(tuple, got.collect()), key=str)
    want = plain_scores(docs, target, longest, 100, 10, 20)
    assert [r[:5] for r in rows] == [r[:5] for r in want]
    assert sorted((r[5], r[4]) for r in rows if r[5]) == sorted((r[5], r[4]) for r in want if r[5])
    assert [r for r in rows if r[0] != 502] == [r for r in want if r[0] != 502]


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(empty, empty.select("text")).count() == 0
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert resampling.resample(some, empty.select("text"), percent=100).first().rank == 1


def test_a_tie_in_score_goes_to_the_smaller_id(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(resampling, "noise", lambda doc, seed: F.lit(0).cast("long"))
    docs = spark.createDataFrame([(i, "a b c d " * 5) for i in (7, 3, 9, 1, 5)], "doc_id long, text string")
    got = {r.doc_id: r["rank"] for r in resampling.resample(docs, docs.select("text"), percent=60).collect()}
    assert got == {1: 1, 3: 2, 5: 3, 7: None, 9: None}
