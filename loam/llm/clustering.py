"""Similarity clusters by Markov clustering on a sparse, distributed graph.

1. ``links``: vectors of one group are compared in runs. A group of up to ``RUN`` distinct vectors is one run; in a
   larger one, a vector joins the runs named by the largest coordinates under several random rotations (a pair of
   cosine 0.88 shares one with probability 0.9999). Of the links in a run, its task emits the ``DEGREE`` strongest of
   each vector and a spanning forest: in proportion to the run, not to its pairs, and no connection is lost. A run
   that like vectors make far longer than others is cut in blocks, of which every two meet in a task.
2. ``markov``: the strongest links, with loops, make a stochastic matrix. It is squared by a join on the middle node,
   inflated, and small entries are pruned, until the flow is stable. The node that gets most of a node's flow is its
   attractor; an attractor's nodes are a cluster, whose members with the strongest inflow are its most typical ones.
3. ``clusters``: an exact check. Where the cluster asked for is a largest set connected by links, Markov clusters that
   the forest connects are merged; what is left of the graph by then is small.

Exact copies are one node with a weight. Null ids, null groups and unusable vectors belong to no cluster. Vectors
without a link, and without copies, are clusters of one and are left out. Ties go to the smaller node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm import runs, vectors
from loam.scratch import drop, written

COSINE, RUN, DEGREE = 0.88, 2_000, 8
TABLES = {0: 1, 1: 18, 2: 46, 3: 104}
INFLATION, PRUNE, ROUNDS, STABLE = 2.0, 0.02, 12, 1e-3
LAST = 200_000
#: rows that flow to a node, above which it is a hub
HUB = 10_000


def run_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, unit): the runs of each node of (node, grp, unit, depth)."""

    def rows(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            x = vectors.matrix(batch.column("unit"))
            grp = np.array(batch.column("grp").to_pylist(), object)
            depth = batch.column("depth").to_numpy()
            for d in np.unique(depth):
                at = np.flatnonzero(depth == d)
                for t in range(TABLES[int(d)]):
                    if d == 0:
                        key = grp[at]
                    else:
                        if t not in turns:
                            turns[t] = np.linalg.qr(np.random.default_rng(1000 + t).normal(size=(x.shape[1],) * 2))[0].astype(np.float32)
                        y = x[at] @ turns[t]
                        top = np.argpartition(-np.abs(y), d - 1, axis=1)[:, :d]
                        signed = np.sort(top * 2 + (np.take_along_axis(y, top, 1) > 0), 1)
                        key = [f"{g}\x1f{t}\x1f{s}" for g, s in zip(grp[at], signed.tolist())]
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), batch.column("node").take(take), batch.column("unit").take(take)], names=["key", "node", "unit"])

    return nodes.select("node", "grp", "unit", "depth").mapInArrow(rows, "key string, node bigint, unit binary")


def forest_and_nearest(x: np.ndarray, cosine: float = COSINE, degree: int = DEGREE, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine, whether it is of the forest) of a run: a spanning forest of its links and each row's strongest ones."""
    n = len(x)
    label = np.arange(n)
    out: list[list] = [[], [], [], []]

    def emit(i, j, c, tree):
        for column, value in zip(out, (i, j, c, np.full(len(i), tree))):
            column.append(np.asarray(value))

    for s in range(0, n, block):
        score = x[s : s + block].astype(np.float64) @ x.T.astype(np.float64)
        rows = np.arange(len(score))
        score[rows, s + rows] = -2
        score[score < cosine - 1e-9] = -2
        linked = np.flatnonzero((score > -2).any(1))
        for r in linked:
            i = s + r
            js = np.flatnonzero(score[r] > -2)
            roots, first = np.unique(label[js], return_index=True)
            other = roots != label[i]
            if other.any():
                js = js[first[other]]
                emit(np.full(len(js), i), js, score[r, js], True)
                label[np.isin(label, np.append(roots, label[i]))] = min(roots.min(), label[i])
        if len(linked):
            sub = score[linked]
            k = min(degree, n)
            top = np.argpartition(-sub, k - 1, axis=1)[:, :k]
            i, c = np.nonzero(np.take_along_axis(sub, top, 1) > -2)
            j = top[i, c]
            emit(s + linked[i], j, sub[i, j], False)
    if not out[0]:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool)
    return tuple(np.concatenate(c) for c in out)


def links(nodes: DataFrame, cosine: float = COSINE, degree: int = DEGREE) -> DataFrame:
    """(a, b, cosine, tree): a < b; tree marks the links of the runs' spanning forests."""

    def compare(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        i, j, c, tree = forest_and_nearest(vectors.matrix(t.column("unit")), cosine, degree)
        a, b = node[i], node[j]
        return pa.table({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64), "cosine": c.astype(np.float64), "tree": tree.astype(bool)})

    pairs = runs.cut(run_keys(nodes), "node", 8 * RUN).groupBy("key", "pair").applyInArrow(compare, "a bigint, b bigint, cosine double, tree boolean")
    return pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.max("tree").alias("tree"))


def markov(edges: DataFrame, inflation: float = INFLATION, prune: float = PRUNE, rounds: int = ROUNDS, stable: float = STABLE) -> DataFrame:
    """(node, attractor, inflow) by alternate squaring, inflation and pruning of the flow over ``edges`` (a, b, cosine)."""
    row = W.partitionBy("src")

    def stochastic(flow: DataFrame) -> DataFrame:
        flow = flow.withColumn("p", F.col("p") / F.sum("p").over(row)).withColumn("most", F.max("p").over(row))
        flow = flow.where(F.col("p") >= F.least(F.lit(prune), F.col("most")) - 1e-12)
        return flow.select("src", "dst", (F.col("p") / F.sum("p").over(row)).alias("p"))

    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("cosine").alias("p"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p"))
    loops = both.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(1.0).alias("p"))
    flow = first = written(stochastic(both.unionByName(loops)), "flow")
    before = None
    for _ in range(rounds):
        # a row has at most 1 / prune entries, but a hub has no bound on the rows that flow to it: these are salted
        hubs = F.broadcast(flow.groupBy(F.col("dst").alias("mid")).count().where(F.col("count") > HUB).select("mid", F.ceil(F.col("count") / HUB).cast("int").alias("parts")))  # fewer than entries / HUB
        left = flow.select("src", F.col("dst").alias("mid"), F.col("p").alias("p1")).join(hubs, "mid", "left").withColumn("salt", F.expr("cast(pmod(xxhash64(src), coalesce(parts, 1)) as int)")).drop("parts")
        right = flow.select(F.col("src").alias("mid"), "dst", F.col("p").alias("p2")).join(hubs, "mid", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        squared = left.join(right, ["mid", "salt"]).groupBy("src", "dst").agg(F.sum(F.col("p1") * F.col("p2")).alias("p"))
        last, flow = flow, written(stochastic(squared.withColumn("p", F.pow("p", F.lit(inflation)))), "flow")
        if last is not first:
            drop(last)
        # chaos: how far the rows are from one entry each
        now = flow.groupBy("src").agg((F.max("p") - F.sum(F.col("p") * F.col("p"))).alias("c")).agg(F.max("c")).first()[0]
        if now is None or now < stable or (before is not None and abs(before - now) < 1e-9):
            break
        before = now
    attractor = flow.groupBy("src").agg(F.max(F.struct("p", (-F.col("dst")).alias("neg"))).alias("m")).select(F.col("src").alias("node"), (-F.col("m.neg")).alias("attractor"))
    inflow = flow.unionByName(first.withColumn("p", F.col("p") * 1e-3)).groupBy(F.col("dst").alias("node")).agg(F.sum("p").alias("inflow"))
    return attractor.join(inflow, "node", "left").withColumn("inflow", F.coalesce("inflow", F.lit(0.0)))


def _unite(pairs) -> dict[int, int]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def components(pairs: DataFrame, last: int = LAST) -> DataFrame:
    """(node, root): the smallest node of each connected set of ``pairs`` (a, b). More than ``last`` pairs are first
    contracted in rounds: every node points to its smallest neighbour, pointers are doubled, edges are renamed."""
    pairs = written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    names = None
    while pairs.count() > last:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "point")
        for _ in range(2):
            point = written(point.join(point.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.least("to", "far").alias("to")), "point")
        names = point if names is None else written(names.join(point.select(F.col("node").alias("to"), F.col("to").alias("new")), "to", "left").select("node", F.coalesce("new", "to").alias("to")).unionByName(point.join(names.select("node"), "node", "left_anti")), "names")
        pairs = written(pairs.join(point.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(point.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")

    def finish(t: pa.Table) -> pa.Table:
        root = _unite(zip(t.column("a").to_pylist(), t.column("b").to_pylist()))
        return pa.table({"node": pa.array(list(root), pa.int64()), "root": pa.array(list(root.values()), pa.int64())})

    rest = pairs.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(finish, "node bigint, root bigint")
    if names is None:
        return rest
    rest = written(rest, "roots")
    return names.join(rest.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("root", "to").alias("root")).unionByName(rest.join(names.select("node"), "node", "left_anti"))


def clusters(rows: DataFrame, cosine: float = COSINE, run: int = RUN) -> DataFrame:
    """(id, grp, cluster, inflow, markov): for every row of (id, grp, unit) in a cluster of two or more, the smallest id
    of its cluster, its typicality and the Markov cluster that it was found in."""
    rows = written(rows.where("id is not null and grp is not null").select("id", "grp", "unit").dropDuplicates(["id"]).withColumn("u", F.md5("unit")), "cluster-rows")
    nodes = rows.groupBy("grp", "u").agg(F.min("id").alias("rep"), F.first("unit").alias("unit"), F.count("*").alias("copies"))
    sizes = nodes.groupBy("grp").count().where(F.col("count") > run)
    depth = F.when(F.col("count") <= 128 * run, 1).when(F.col("count") <= 8_064 * run, 2).otherwise(3)
    nodes = written(nodes.join(sizes.select("grp", depth.alias("depth")), "grp", "left").withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = written(links(nodes, cosine), "edges")
    flow = written(markov(edges), "markov")
    # the exact check: Markov clusters that a link of the forest connects are one
    own = flow.select("node", "attractor")
    across = edges.where("tree").join(own.withColumnRenamed("node", "a").withColumnRenamed("attractor", "x"), "a").join(own.withColumnRenamed("node", "b").withColumnRenamed("attractor", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    across = written(across, "across")
    if across.take(1):
        merged = components(across).select(F.col("node").alias("attractor"), "root")
        found = flow.join(merged, "attractor", "left").select("node", "attractor", F.coalesce("root", "attractor").alias("root"), "inflow")
    else:  # the Markov clusters are the connected sets
        found = flow.select("node", "attractor", F.col("attractor").alias("root"), "inflow")
    found = nodes.select("node", "grp", "u", "rep", "copies").join(found, "node", "left").where("root is not null or copies > 1").withColumn("root", F.coalesce("root", "node"))
    found = written(found, "found")
    first = found.groupBy("root").agg(F.min("rep").alias("cluster"))
    found = found.join(first, "root").select("grp", "u", "cluster", F.coalesce("inflow", F.lit(1.0)).alias("inflow"), F.coalesce("attractor", "node").alias("markov"))
    return rows.select("id", "grp", "u").join(found, ["grp", "u"]).select("id", "grp", "cluster", "inflow", "markov")


def described(found: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, grp, size, n_markov, typical): each cluster's size and the ids of its most typical members.

    A cluster may hold a third of all rows, so members are ranked in 64 salted parts first."""
    salted = found.withColumn("salt", F.expr("pmod(xxhash64(id), 64)"))
    best = lambda part: F.row_number().over(W.partitionBy("cluster", *part).orderBy(F.desc("inflow"), "id"))
    top = salted.withColumn("r", best(["salt"])).where(F.col("r") <= typical).withColumn("r", best([])).where(F.col("r") <= typical)
    top = top.groupBy("cluster").agg(F.expr("transform(array_sort(collect_list(struct(r, id))), x -> x.id)").alias("typical"))
    size = found.groupBy("cluster", "grp").agg(F.count("*").alias("size"), F.countDistinct("markov").alias("n_markov"))
    return size.join(top, "cluster")
