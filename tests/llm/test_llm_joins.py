"""Joins on pairs, repeated strings, vectors and the pipeline, against brute force."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from caselake.llm import arrow, decontam, jaccard, packing, suffixes, vectors
from caselake.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, component_id string, said string"


def smallest_reachable(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)]
    want = smallest_reachable(600, links)
    ends = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want[x] for x in ends}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_sets(texts, words):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def similar(a, b, percent):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= percent * (len(a) + len(b) - both)


def family(rng, n, edits, size=60):
    words = [f"w{rng.randrange(400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(size)] = f"e{rng.randrange(9999)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("words,percent,block", [(4, 85, 1000), (5, 80, 7)])
def test_jaccard_groups_equal_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # at 7, families meet block against block
    monkeypatch.setattr(jaccard, "FREQUENT", 0.02)
    rng = random.Random(words)
    texts = [t for k in range(14) for t in family(rng, rng.randint(1, 25), 3)] + family(rng, 60, 6) + ["A b", "a\tB", "a b c", None, "", " \n", "Éa éa éa éa", "éa éa éa éa"]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts += ["same text here now"] * 30 + ["long " + " ".join(str(i) for i in range(30_000))] * 2
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    sets = plain_sets(texts, words)
    want = smallest_reachable(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if similar(sets[a], sets[b], percent)])
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in jaccard.groups(docs, words, percent).collect()}
    assert len(got) == len(rows)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(rows))] == [(len(s), w) for s, w in zip(sets, want)]
    kept = jaccard.one_of_each(docs, words, percent)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert jaccard.groups(docs.where("false"), words, percent).count() == 0


def test_longer_prefixes_ask_for_more_matches():
    token = np.arange(100, dtype=np.uint64)
    rare = jaccard.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64), 85)
    frequent = jaccard.Order(token, np.full(100, 5000), 85)
    for order in (rare, frequent):
        prefix, matches = order.prefix(token)
        assert len(prefix) == 100 - 85 + matches
    assert frequent.prefix(token)[1] > rare.prefix(token)[1] >= 1
    assert rare.prefix(token[:1]) == (token[:1], 1)


def test_copies_enter_a_family_once(spark, monkeypatch):
    seen, families = [], jaccard._families

    def counted(frame, keys, fn, schema):
        if "prefix" in frame.columns:
            seen.append((frame.count(), frame.select(*keys, "id").distinct().count()))
        return families(frame, keys, fn, schema)

    monkeypatch.setattr(jaccard, "_families", counted)
    texts = family(random.Random(3), 5, 2)
    rows = [(i, t, "x", "y") for i, t in enumerate(texts + texts[:1] * 400)]
    got = jaccard.groups(spark.createDataFrame(rows, DOCS).repartition(6), 4, 85).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id >= 5} == {next(r.component_id for r in got if r.doc_id == 0)}
    assert seen and all(rows == distinct for rows, distinct in seen)


def test_families_count_shared_shingles_alone(spark, monkeypatch):
    """What no other set holds is not sent to a family, and the same members under several leaders are compared once."""
    sent, parts, families = [], [], jaccard._families

    def counted(frame, keys, fn, schema):
        if "prefix" in frame.columns:
            sent.extend(frame.collect())
        elif "text" in frame.columns:
            parts.extend((r[keys[0]], r["id"]) for r in frame.collect())
        return families(frame, keys, fn, schema)

    monkeypatch.setattr(jaccard, "_families", counted)
    rng = random.Random(5)
    texts = [t for _ in range(12) for t in family(rng, 3, 2, 80)]
    got = jaccard.groups(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS).repartition(4), 4, 60).collect()
    sets = plain_sets(texts, 4)
    want = smallest_reachable(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similar(sets[a], sets[b], 60)])
    assert [r.component_id for r in sorted(got)] == want
    held = Counter(m for _, marks in {(r.id, tuple(r.prefix)) for r in sent} for m in set(marks))
    assert sent and min(held.values()) > 1
    members = {}
    for part, i in parts:
        members.setdefault(part, []).append(i)
    assert parts and len({tuple(sorted(m)) for m in members.values()}) == len(members)


def test_shingles_are_counted_over_small_batches(spark, monkeypatch):
    """However few rows a batch has, what a task's documents share is counted over all of them."""
    docs = spark.createDataFrame([(i, f"a common line and w{i} of its own", "x", "y") for i in range(8)], DOCS).coalesce(1)
    with arrow.settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "2"}):
        rows = jaccard._surveyed(docs, 3).collect()
        monkeypatch.setattr(jaccard, "RUN_DOCS", 4)
        runs = jaccard._surveyed(docs, 3).collect()
    assert sorted(r.held for r in rows if r.held) == [8, 8, 8] and sorted(r.held for r in runs if r.held) == [4] * 6
    assert sorted(r.doc_id for r in rows if r.held is None) == list(range(8))


def test_ranges_of_shingles_count_as_the_whole():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(0, 25))) for _ in range(40)] + [np.array([0, (1 << 64) - 1], np.uint64)] * 9
    for least in (3, 8):
        got = [x for t, c in jaccard.frequent(sets, least) for x in zip(t.tolist(), c.tolist())]
        assert got == sorted((t, c) for t, c in Counter(x for s in sets for x in s.tolist()).items() if c >= least)


def test_workers_get_few_bytes_at_a_time(spark, monkeypatch):
    import corpus_pipeline

    def small(batches, rows=1000):
        for batch in batches:
            assert batch.nbytes < 10_000_000
            yield from arrow.slices([batch], rows)

    for module in (jaccard, packing):
        monkeypatch.setattr(module, "slices", small)
    docs = spark.createDataFrame([(i, f"{i} " + "some words " * 50_000, "en", "y") for i in range(30)], DOCS).coalesce(1).drop("said")
    assert len(jaccard.groups(docs).collect()) == 30
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().collect()} == set(range(30))


def test_a_task_gives_back_what_it_freed():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon")) / 1024

    def run(batches):
        blocks = [np.ones(100_000, np.uint8) for _ in range(1200)]
        last = blocks[::60]  # what stands between freed blocks keeps the heap from shrinking by itself
        del blocks
        yield from batches
        kept.extend(last)

    kept = []
    before = held()
    assert list(arrow.released(run)(iter(["batch"]))) == ["batch"] and len(kept) == 20
    assert held() - before < 40


def test_rows_with_odd_ids_in_groups(spark):
    t = "one two three four five six seven"
    docs = spark.createDataFrame([(None, t, "a", None), (3, t, "b", None), (3, t, "b", None), (2, None, "c", None), (2, "", "c", None), (None, "alone in here with nobody", None, None)], DOCS)
    got = sorted(map(tuple, jaccard.groups(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(None, 3, 3), (3, 3, 3), (3, 3, 3), (2, 0, 2), (2, 0, 2), (None, 1, None)], key=str)
    kept = [tuple(r)[:2] for r in jaccard.one_of_each(docs).collect()]
    assert Counter(kept) == Counter([(3, t), (3, t), (2, None), (2, ""), (None, "alone in here with nobody")])


def plain_repeats(rows):
    """rows in order of id: (id, bytes) to removed masks."""
    seen, out = set(), []
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        new = []
        for _, b in group:
            mask = np.zeros(len(b), bool)
            strings = [b[i:i + 50] for i in range(len(b) - 49)]
            for i, s in enumerate(strings):
                if s in seen:
                    mask[i:i + 50] = True
            new += strings
            out.append(mask)
        seen.update(new)
    return out


@pytest.mark.parametrize("batch", [1 << 22, 700])
def test_repeats_equal_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(suffixes, "BATCH", batch)
    monkeypatch.setattr(suffixes, "SLOT", 3000)
    rng = random.Random(8)
    line = "x" * 49, "y" * 50, "éà" * 40, "".join(rng.choices("abcdef ", k=300))
    rows = []
    for i in range(120):
        parts = ["".join(rng.choices("abcdefgh ", k=rng.randint(0, 90))) for _ in range(rng.randint(0, 5))]
        parts.insert(0, rng.choice(line)[rng.randint(0, 20):])
        rng.shuffle(parts)
        rows.append((i - 20, "".join(parts)))
    rows += [(i, rows[i % 7][1]) for i in range(200, 230)] + [(300, "z" * 400), (301, "z" * 400), (301, "z" * 300), (400, None), (401, ""), (402, rows[3][1][:49])]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, data string")
    got = [tuple(r) for r in suffixes.remove_repeats(docs).collect()]
    ordered = sorted(((i, (t or "").encode()) for i, t in rows))
    assert sorted((*k[:4], bytes(k[4])) for k in got) == sorted(_plain_rows(ordered))
    assert suffixes.remove_repeats(docs.where("false")).count() == 0


def _plain_rows(ordered):
    for (i, b), mask in zip(ordered, plain_repeats(ordered)):
        yield i, len(b), int(mask.sum()), int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()), bytes(x for x, m in zip(b, mask) if not m)


def test_rows_without_ids_come_last(spark):
    t = "".join(random.Random(1).choices("abcdefgh", k=200))
    got = suffixes.remove_repeats(spark.createDataFrame([(None, t), (None, t), (5, t), (None, "q" * 60)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (True, 0), (True, 200), (True, 200)]


def test_the_cover_reaches_every_difference():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def vector_rows(seed=0, n=900):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(n)]
    for base in range(0, 60, 3):
        for _ in range(int(rng.integers(1, 12))):
            v = np.array(rows[base][1])
            rows.append((len(rows), (v + rng.normal(size=16) * rng.choice([0.1, 0.3, 0.45]) * np.linalg.norm(v) / 4).tolist()))
    rows += [(5000 + i, rows[1][1]) for i in range(40)] + [(6000, [3 * x for x in rows[2][1]]), (6001, [1e300 * x for x in rows[2][1]])]
    return rows


def plain_links(rows):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= vectors.COSINE
    np.fill_diagonal(near, False)
    label = smallest_reachable(len(ids), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    return {i: (int(near[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("per,shard", [(1000, 2000), (100, 60)])
def test_vector_links_against_brute_force(spark, monkeypatch, per, shard):
    monkeypatch.setattr(vectors, "PER_CLUSTER", per)
    monkeypatch.setattr(vectors, "SHARD", shard)  # at 60, clusters are met block against block
    rows = vector_rows()
    bad = [(7000, None), (7001, []), (7002, [0.0] * 16), (7003, [float("nan")] * 16), (7004, [float("inf")] + [1.0] * 15), (7005, [None] + [1.0] * 15), (7006, [1.0, 2.0]), (None, rows[1][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + bad + rows[5:8]], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
    want = plain_links(rows)
    assert set(got) == {i for i, _ in rows + bad}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in bad)
    found, all_ = sum(got[i].n_links for i in want), sum(n for n, _ in want.values())
    assert 0.98 * all_ <= found <= all_ and all(got[i].n_links <= want[i][0] for i in want)
    assert np.mean([got[i].component_id == want[i][1] for i in want]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in want)
    assert vectors.near_duplicates(frame.where("false")).count() == 0


def tight_groups(groups, size, length=16, first=0):
    rng = np.random.default_rng(9)
    rows = []
    for centre in rng.normal(size=(groups, length)):
        rows += [(first + len(rows) + i, (centre + rng.normal(size=length) * 0.02).tolist()) for i in range(size)]
    return rows


def test_tight_groups_without_background_are_all_reached(spark):
    rows = tight_groups(5, 100)  # one shard; nobody's 64 nearest lie outside its own group
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vectors.near_duplicates(frame)
    want = plain_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == want
    audit = {r.vec_id: (r.n_links, r.n_true) for r in vectors.recall(frame, found).collect()}
    assert audit == {i: (n, n) for i, (n, _) in want.items() if i % 20 == 0}


def test_every_length_is_linked_within_itself(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CLUSTER", 50)  # the first length has several clusters, the others one
    parts = [tight_groups(3, 30), tight_groups(2, 20, 12, 1000), tight_groups(1, 3, 7, 2000)]
    want = {k: v for rows in parts for k, v in plain_links(rows).items()}
    frame = spark.createDataFrame([r for rows in parts for r in rows], "vec_id long, embedding array<double>")
    found = vectors.near_duplicates(frame)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == want
    assert all(r.n_links == r.n_true for r in vectors.recall(frame, found).collect())


def test_the_audit_counts_what_is_missing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 60)  # blocks against blocks
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    none = frame.select("vec_id").selectExpr("vec_id", "0L AS n_links")
    assert {r.vec_id: (r.n_links, r.n_true) for r in vectors.recall(frame, none).collect()} == {
        i: (0, n) for i, (n, _) in plain_links(rows).items() if i % 20 == 0}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = {r.item_id: decontam.folded(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(rows)
    sets = plain_sets([rows[i] for i in ids], jaccard.WORDS)
    groups = smallest_reachable(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if similar(sets[a], sets[b], jaccard.PERCENT)])
    kept = {ids[g] for g in groups}
    clean = {i for i in kept if not any(b in decontam.folded(rows[i]) for b in bench.values())}
    want = [set(ids), kept, clean, clean]
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want):
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in docs.collect()} == expected, name
    texts = {r.doc_id: r.text for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.columns[:4] == packing.COLUMNS[:4] and {r.doc_id for r in packed.collect()} == clean
    run = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r)[:5] for r in run.collect()) == sorted(tuple(r)[:5] for r in packed.collect()) and texts
