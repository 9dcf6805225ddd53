"""Embedding near-duplicates by a robust-pruned flat graph.

1. Equal vectors are one class, known by its smallest id and its size.
2. Vectors of each length are clustered for themselves. Centroids come from some ``SAMPLE`` classes of
   a length; every class joins its two nearest clusters, so shards overlap. A cluster beyond ``SHARD`` members is dealt into several shards.
3. In each shard a class keeps up to ``DEGREE`` neighbours: of its nearest ones, those not nearer to a
   neighbour already taken by the factor ``ALPHA`` (robust pruning), and the way back. The lists of
   all shards are united per class.
4. Every class searches the shards of its three nearest clusters: greedily, by a beam from the medoid of
   each part of the shard's graph that no other start leads to (tight groups have no edges outward), then
   outward from whatever lies in range, until no neighbour of such a node is.
5. Cosines of found pairs are worked out again in double precision from the vectors as given.

Indexing covers every row; ``recall`` holds the links against brute force for a stated set of ids, in a job
of its own: its cost is that set times all rows.
A task sees at most ``SHARD`` members and ``SHARD`` searchers at a time, however large a cluster is:
larger ones are blocks against blocks. Links are pairs of classes; a class's copies are counted.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, nor do rows without vec_id (their component is null); vectors link with those of their own
length; of rows with one vec_id the smallest vector counts, and one row is returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from caselake.llm.arrow import drawn
from caselake.llm.components import components
from caselake.session import materialise

COSINE = 0.9
SAMPLE, PER_CLUSTER, MOST_CLUSTERS, ROUNDS = 32_768, 1000, 4096, 6
SHARD, MEMBER_OF, PROBES = 2000, 2, 3
DEGREE, CANDIDATES, ALPHA, BEAM = 24, 64, 1.2, 24
PAIRS = "a long, b long, link boolean"


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1. A row is scaled first, so that its length neither overflows nor vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def centroids(classes: DataFrame) -> np.ndarray:
    """Spherical k-means over a bounded sample, drawn by hash, of classes of one length; one centre for some PER_CLUSTER."""
    rows = sorted(drawn(classes.select("rep", "vector"), SAMPLE, F.xxhash64("rep")).collect(), key=lambda r: r.rep)
    if not rows:
        return np.zeros((0, 0))
    x = unit(np.array([r.vector for r in rows], float))[np.random.default_rng(1).permutation(len(rows))]
    k = max(1, min(MOST_CLUSTERS, -(-classes.count() // PER_CLUSTER), len(x)))
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), centre)
    return centre


def pruned(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour lists of the rows of ``x`` (unit length) after robust pruning, ways back included."""
    n = len(x)
    similar = x @ x.T
    np.fill_diagonal(similar, -2.0)
    c = min(CANDIDATES, n - 1)
    if c <= 0:
        return [np.zeros(0, np.int64)] * n
    order = np.argpartition(-similar, c - 1, axis=1)[:, :c]
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(similar, order, 1), axis=1), 1)
    kept: list[list[int]] = []
    for i in range(n):
        near = order[i]
        among = similar[np.ix_(near, near)]
        open_, own = np.ones(c, bool), similar[i, near]
        taken: list[int] = []
        while len(taken) < DEGREE and open_.any():
            j = int(open_.argmax())
            taken.append(int(near[j]))
            # squared distances of unit vectors are 2 - 2 cos
            open_ &= ALPHA ** 2 * (1 - among[j]) > 1 - own
            open_[j] = False
        kept.append(taken)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, taken in enumerate(kept):
        for j in taken:
            if len(back[j]) < DEGREE:
                back[j].append(i)
    return [np.array(list(dict.fromkeys(a + b)), np.int64) for a, b in zip(kept, back)]


def parts(x: np.ndarray, links: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """A start for each part of the graph and the part: what can be reached from it and from no start before it.

    Together they hold every member. A start is the medoid of all members not reached so far.
    """
    out, reached = [], np.zeros(len(x), bool)
    while not reached.all():
        rest = np.flatnonzero(~reached)
        start = int(rest[(x[rest] @ x[rest].mean(axis=0)).argmax()])
        own, front = [], np.array([start])
        reached[start] = True
        while len(front):
            own.append(front)
            near = np.unique(links[front])
            front = near[(near >= 0) & ~reached[near]]
            reached[front] = True
        out.append((start, np.concatenate(own)))
    return out


def in_range(x: np.ndarray, links: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(searcher, member) pairs with a cosine of ``least`` or more that the search of every part comes upon."""
    hit_q, hit_m, small = [], [], []
    for start, own in parts(x, links):
        if len(own) <= BEAM:  # a beam would see all of them
            small.append(own)
            continue
        place = np.full(len(x) + 1, -1)  # the last stands for no neighbour
        place[own] = np.arange(len(own))
        r, m = _in_part(x[own], place[links[own]], q, least, int(place[start]))
        hit_q.append(r)
        hit_m.append(own[m])
    if small:
        own = np.concatenate(small)
        r, m = np.nonzero(q @ x[own].T >= least)
        hit_q.append(r)
        hit_m.append(own[m])
    return np.concatenate(hit_q), np.concatenate(hit_m)


def _in_part(x: np.ndarray, links: np.ndarray, q: np.ndarray, least: float, medoid: int) -> tuple[np.ndarray, np.ndarray]:
    """(searcher, member) pairs with a cosine of ``least`` or more that the search from one start comes upon.

    ``links`` has the neighbours of each member, padded with -1. All searchers advance together.
    """
    n, m, width = len(q), len(x), BEAM + links.shape[1]
    seen = np.zeros((n, m), bool)
    seen[:, medoid] = True
    beam = np.full((n, BEAM), -1)
    sim = np.full((n, BEAM), -np.inf, np.float32)
    done = np.zeros((n, BEAM), bool)
    beam[:, 0], sim[:, 0] = medoid, q @ x[medoid]
    hit_q, hit_m = [np.flatnonzero(sim[:, 0] >= least)], [np.full(int((sim[:, 0] >= least).sum()), medoid)]

    def look(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unseen neighbours of one node per row, with their cosines (-inf: none)."""
        near = links[nodes]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], np.where(fresh, near, nodes[:, None])] = True
        cos = np.einsum("qd,qkd->qk", q[rows], x[near])
        cos[~fresh] = -np.inf
        r, c = np.nonzero(cos >= least)
        hit_q.append(rows[r])
        hit_m.append(near[r, c])
        return near, cos

    active = np.arange(n)
    while len(active):
        waiting = np.where(done[active], -np.inf, sim[active])
        best = waiting.argmax(axis=1)
        going = waiting[np.arange(len(active)), best] > -np.inf
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        near, cos = look(active, beam[active, best])
        ids = np.concatenate([beam[active], near], axis=1)
        sims = np.concatenate([sim[active], cos], axis=1)
        was = np.concatenate([done[active], np.zeros_like(near, bool)], axis=1)
        top = np.argpartition(-sims, BEAM - 1, axis=1)[:, :BEAM] if width > BEAM else np.argsort(-sims, axis=1)
        beam[active], sim[active] = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        done[active] = np.take_along_axis(was, top, 1)
    at = 0
    while at < len(hit_q):  # what look() adds is looked from in turn
        rows, nodes = np.concatenate(hit_q[at:]), np.concatenate(hit_m[at:])
        at = len(hit_q)
        order = np.argsort(rows, kind="stable")
        rows, nodes = rows[order], nodes[order]
        first = np.searchsorted(rows, rows)
        turn = np.arange(len(rows)) - first
        for t in range(int(turn.max()) + 1 if len(turn) else 0):  # one node per searcher at a time: look() marks what it saw
            now = turn == t
            look(rows[now], nodes[now])
    return np.concatenate(hit_q), np.concatenate(hit_m)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    x = unit(np.array(pdf["vector"].tolist(), float)).astype(np.float32)
    reps = pdf["rep"].to_numpy()
    return pd.DataFrame({"rep": reps, "near": [reps[a].tolist() for a in pruned(x)]})


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    member = pdf["near"].notna().to_numpy()
    own, ask = pdf[member], pdf[~member]
    if own.empty or ask.empty:
        return pd.DataFrame({"a": [], "b": [], "link": []}).astype({"a": "int64", "b": "int64", "link": bool})
    x, q = unit(np.array(own["vector"].tolist(), float)), unit(np.array(ask["vector"].tolist(), float))
    ids, asks = own["rep"].to_numpy(), ask["rep"].to_numpy()
    place = {r: i for i, r in enumerate(ids)}
    near = [[place[r] for r in row if r in place] for row in own["near"]]
    links = np.full((len(own), max(1, *map(len, near)) if near else 1), -1)
    for i, row in enumerate(near):
        links[i, :len(row)] = row
    r, m = in_range(x.astype(np.float32), links, q.astype(np.float32), COSINE - 1e-4)
    sure = np.concatenate([np.einsum("nd,nd->n", q[r[i:i + 100_000]], x[m[i:i + 100_000]]) for i in range(0, len(r), 100_000)]
                          or [np.zeros(0)])
    r, m = r[sure >= COSINE], m[sure >= COSINE]
    a, b = np.minimum(asks[r], ids[m]), np.maximum(asks[r], ids[m])
    pairs = np.unique(np.stack([a, b], axis=1)[a < b], axis=0)
    nodes, flat = np.unique(pairs, return_inverse=True)
    flat, label = flat.reshape(-1, 2), np.arange(len(nodes))
    while len(flat):  # smallest id of each group of links: a star carries the connections
        new = label.copy()
        np.minimum.at(new, flat[:, 0], label[flat[:, 1]])
        np.minimum.at(new, flat[:, 1], label[flat[:, 0]])
        new = new[new]
        if (new == label).all():
            break
        label = new
    star = label != np.arange(len(nodes))
    return pd.DataFrame({"a": np.concatenate([pairs[:, 0], nodes[label[star]]]), "b": np.concatenate([pairs[:, 1], nodes[star]]),
                         "link": np.repeat([True, False], [len(pairs), int(star.sum())])})


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector can have a cosine."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))


def link_pairs(classes: DataFrame) -> DataFrame:
    """a < b (classes by their smallest ids); link: a found pair, else an edge that carries connections."""
    size = F.size("vector")
    centres: dict[int, tuple[int, np.ndarray | None]] = {}  # by length: the number of the first cluster, and the centres
    clusters = 0
    for r in classes.groupBy(size.alias("n")).agg(F.count("*").alias("c")).orderBy("n").collect():
        # what fits into one cluster needs no centre
        centre = centroids(classes.where(size == r["n"])) if r["c"] > PER_CLUSTER else None
        centres[r["n"]] = clusters, centre
        clusters += 1 if centre is None else len(centre)
    if not centres:
        return classes.sparkSession.createDataFrame([], PAIRS)
    sent = classes.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CLUSTERS rows for a length

    def assign(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            for n, own in pdf.groupby(pdf["vector"].map(len)):
                first, centre = sent.value[n]
                near = np.zeros((len(own), 1), int)
                if centre is not None:
                    x = unit(np.array(own["vector"].tolist(), float))
                    near = np.argsort(-(x @ centre.T), axis=1, kind="stable")[:, :PROBES]
                yield pd.DataFrame({"rep": own["rep"], "vector": own["vector"], "clusters": (near + first).astype("int32").tolist()})

    homes = materialise(classes.select("rep", "vector").mapInPandas(
        assign, "rep long, vector array<double>, clusters array<int>"), "homes")
    draw = F.xxhash64("rep")
    members = homes.select("rep", "vector", F.explode(F.slice("clusters", 1, MEMBER_OF)).alias("cluster"))
    visits = homes.select("rep", "vector", F.explode("clusters").alias("cluster"))
    # One row per cluster: how many blocks its members and its searchers are dealt into.
    blocks = F.broadcast(visits.groupBy("cluster").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("asking")).join(
        members.groupBy("cluster").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("holding")), "cluster"))
    members = members.join(blocks, "cluster").withColumn("block", F.pmod(draw, F.col("holding")))
    near = members.groupBy("cluster", "block").applyInPandas(_build, "rep long, near array<long>") \
        .groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    near = materialise(near, "graph")
    held = members.join(near, "rep").select(
        "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("turn"), "rep", "vector", "near")
    asked = visits.join(blocks, "cluster").select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("holding") - 1)).alias("block"),
        F.pmod(draw, F.col("asking")).alias("turn"), "rep", "vector", F.lit(None).cast("array<long>").alias("near"))
    return held.select("cluster", F.col("block").cast("long"), F.col("turn").cast("long"), "rep", "vector", "near").unionByName(
        asked.select("cluster", F.col("block").cast("long"), F.col("turn").cast("long"), "rep", "vector", "near")) \
        .groupBy("cluster", "block", "turn").applyInPandas(_search, PAIRS)


def near_duplicates(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = rows.select("vec_id", "embedding")
    named = rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    fine = usable(named).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    classes = materialise(fine.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    found = materialise(link_pairs(classes), "pairs")
    pairs = found.where("link").select("a", "b").distinct()
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    linked = ends.join(classes.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("linked"))
    groups = components(found.where("NOT link").select("a", "b"))
    verdict = classes.join(linked, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "vector", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    out = fine.join(verdict, "vector").select("vec_id", "n_links", "component_id")
    none = F.lit(0).cast("long").alias("n_links")
    odd = named.join(fine.select("vec_id"), "vec_id", "left_anti").select("vec_id", none, F.col("vec_id").alias("component_id"))
    nameless = rows.where("vec_id IS NULL").select("vec_id", none, F.col("vec_id").alias("component_id"))
    return out.unionByName(odd).unionByName(nameless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def recall(rows: DataFrame, found: DataFrame, every: int = 20) -> DataFrame:
    """vec_id, n_links (of ``found``) and n_true (by brute force) of the vectors whose id ``every`` divides.

    Found links are all verified, so the sums' ratio is the recall. The ids are held against all rows, blocks
    against blocks; counts are summed in the tasks.
    """
    named = rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    fine = materialise(usable(named).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
                                            F.size("embedding").alias("n")), "audited")
    asked = fine.where(F.col("vec_id") % every == 0)
    sizes = {r["n"]: r for r in fine.groupBy("n").agg(F.count("*").alias("held"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).collect()}
    if not sizes:
        return found.select("vec_id", "n_links", F.lit(0).cast("long").alias("n_true")).where("false")
    counts = fine.sparkSession.createDataFrame([(n, -(-r["held"] // SHARD), max(1, -(-r["asked"] // SHARD))) for n, r in sizes.items()],
                                               "n int, holding int, asking int")
    draw = F.xxhash64("vec_id")
    deal = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    held = fine.join(F.broadcast(counts), "n").select(
        "n", F.pmod(draw, F.col("holding")).cast("int").alias("block"), deal("asking").alias("turn"), "vec_id", "vector", F.lit(True).alias("member"))
    asks = asked.join(F.broadcast(counts), "n").select(
        "n", deal("holding").alias("block"), F.pmod(draw, F.col("asking")).cast("int").alias("turn"), "vec_id", "vector", F.lit(False).alias("member"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        own, ask = pdf[pdf["member"]], pdf[~pdf["member"]]
        if own.empty or ask.empty:
            return pd.DataFrame({"vec_id": [], "n_true": []}).astype("int64")
        x, q = (unit(np.array(part["vector"].tolist(), float)) for part in (own, ask))
        near = (q @ x.T >= COSINE) & (ask["vec_id"].to_numpy()[:, None] != own["vec_id"].to_numpy())
        return pd.DataFrame({"vec_id": ask["vec_id"].to_numpy(), "n_true": near.sum(axis=1)})

    true = held.unionByName(asks).groupBy("n", "block", "turn").applyInPandas(count, "vec_id long, n_true long")
    return true.groupBy("vec_id").agg(F.sum("n_true").alias("n_true")).join(found.select("vec_id", "n_links"), "vec_id") \
        .select("vec_id", "n_links", "n_true")
