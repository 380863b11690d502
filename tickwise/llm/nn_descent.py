"""Near-duplicate vectors by NN-descent.

Equal vectors form one node.  A neighbour graph of ``K`` neighbours per node
starts from windows of consecutive nodes in several random orders (by the signs
of random projections) and is refined: each node's neighbours and reverse
neighbours are joined with each other, pairs with at least one new edge are
compared, and every node keeps its nearest.  A node with very many reverse
neighbours is handled in chunks, drawn anew each round; none is left out.

Edges at or above the threshold, verified in double precision on the original
vectors, are the links; their components follow.  A neighbour list of which all
``K`` entries are links is saturated: further links of the node may have found no
room in it.  It is enlarged by the whole component, without a list of pairs, and
by a second list of the ``K`` nearest nodes outside the component, found by
NN-descent over pairs of different components.  Where that list holds a link,
components grow together and the lists are enlarged again, until none holds one.
Components are compared in blocks of at most ``CHUNK`` nodes against each other;
only counts leave a task, so a large group costs no list of pairs.

Recall is audited per node, whatever the size of its group: for ``AUDIT`` nodes
of groups of at most ``K`` nodes, ``AUDIT`` of larger groups and ``ALONE`` nodes
without a known link all links are found by comparison with all nodes.  While less
than ``RECALL`` of a linked node's links are known on average, the links found are
added and the search goes on with lists twice as long and fresh orders; after
``TRIES`` such turns the job fails rather than return less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .graph import connected_components
from .vectors import clean_vectors, stack, unit

THRESHOLD = 0.95
K = 10            # neighbours of a node
ORDERS = 4        # random orders that start the graph
WINDOW = 96       # consecutive nodes compared with each other
BITS = 16         # signs that make an order
CHUNK = 2048      # nodes of a block of a component
AUDIT = 256       # nodes of small and of large groups whose links are checked against all nodes
ALONE = 2048      # nodes without a known link that are checked likewise
TRIES = 5         # turns with longer lists before a recall below the target is an error
RECALL = 0.99     # share of the audited links that must be known
DELTA = 0.02      # share of new edges under which the graph has settled
SEED = 11


def _runs(batches, key: str) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal ``key``, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks().to_pandas()
        k = table[key].to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
            yield table.iloc[a:b]
        last = int(cuts[-1]) if cuts.size else 0
        held = pa.Table.from_pandas(table.iloc[last:], schema=batch.schema, preserve_index=False).to_batches()
    if held:
        yield pa.Table.from_batches(held).to_pandas()


def _vecs(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype="<f4").reshape(len(col), -1)


def _edges(parts: list[tuple]) -> pd.DataFrame:
    cols = [np.concatenate(c) if parts else np.zeros(0) for c in (zip(*parts, strict=True) if parts else ((), (), ()))]
    return pd.DataFrame({"src": cols[0], "nbr": cols[1], "sim": cols[2]})


def _top(ids: np.ndarray, sims: np.ndarray, n: int, floor: np.ndarray) -> tuple | None:
    """Best n columns of each row of ``sims`` above the row's floor, as edges."""
    n = min(n, sims.shape[1] - 1)
    if n < 1:
        return None
    cols = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    best = np.take_along_axis(sims, cols, axis=1)
    i, j = np.nonzero(best > floor[:, None])
    return ids[i], ids[cols[i, j]], best[i, j].astype(np.float64)


def start_graph(nodes: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """(src, nbr, sim): nearest neighbours inside windows of several random orders; nodes of one ``side`` are not compared."""
    def coded(batches):
        planes: dict[int, np.ndarray] = {}
        for pdf in batches:
            out = []
            for dim, part in pdf.groupby("dim"):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).normal(size=(int(dim), ORDERS * BITS)).astype("f4")
                dots = (_vecs(part["vec"]) @ planes[dim]).reshape(len(part), ORDERS, BITS)
                codes = ((dots > 0) * (1 << np.arange(BITS))).sum(axis=2)
                out.extend(part.assign(turn=t, code=codes[:, t], at=dots[:, t, 0]) for t in range(ORDERS))
            if out:
                yield pd.concat(out)[["turn", "dim", "code", "at", "node", "vec", "side"]]

    def windows(batches):
        step = WINDOW // 2

        def compare(pdf: pd.DataFrame):
            ids, vecs, side, parts = pdf["node"].to_numpy(), _vecs(pdf["vec"]), pdf["side"].to_numpy(), []
            for a in range(0, max(len(pdf) - step, 1), step):
                sims = vecs[a:a + WINDOW] @ vecs[a:a + WINDOW].T
                sims[side[a:a + WINDOW, None] == side[None, a:a + WINDOW]] = -2
                if (found := _top(ids[a:a + WINDOW], sims, k, np.full(len(sims), -1.5, "f4"))) is not None:
                    parts.append(found)
            return _edges(parts)

        for pdf in batches:
            for _, part in pdf.groupby(["turn", "dim"]):
                yield compare(part)

    rows = nodes.select("node", "dim", "vec", "side").mapInPandas(
        coded, "turn int, dim int, code long, at float, node long, vec binary, side long")
    order = ["turn", "dim", "code", "at"]
    return (rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(windows, "src long, nbr long, sim double"))


def _keep(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k nearest (ties to the smaller id); an edge is fresh if every report of it is."""
    one = edges.groupBy("src", "nbr").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"))
    near = Window.partitionBy("src").orderBy(F.desc("sim"), "nbr")
    return one.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k).drop("n")


def refine(graph: DataFrame, nodes: DataFrame, k: int, turn: int, inner: DataFrame | None = None) -> DataFrame:
    """One round: neighbours of neighbours, if of another ``side``, compete for every node's list.

    Edges of a settled graph ``inner`` lead to further neighbours of neighbours; only nodes marked ``full`` have lists then.
    """
    floor = graph.groupBy("src").agg(F.min("sim").alias("least"), F.count("*").alias("n")).select(
        F.col("src").alias("node"), F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-1.5)).alias("floor"))
    none = F.lit(-1.5) if inner is None else F.when(F.col("full"), F.lit(-1.5)).otherwise(F.lit(2.0))
    vectors = nodes.join(floor, "node", "left").select(
        F.col("node").alias("member"), "dim", "vec", "side", F.coalesce("floor", none).alias("floor"))
    steps = graph.select("src", "nbr", "fresh")
    if inner is not None:
        steps = steps.unionByName(inner.select("src", "nbr", F.lit(False).alias("fresh")))
    both = (steps.select(F.col("src").alias("center"), F.col("nbr").alias("member"), "fresh")
            .unionByName(steps.select(F.col("nbr").alias("center"), F.col("src").alias("member"), "fresh"))
            .groupBy("center", "member").agg(F.max("fresh").alias("fresh")))

    def local(batches):
        parts: list[tuple] = []
        for run in _runs(batches, "center"):
            if len(run) < 2 or not run["fresh"].any():
                continue
            ids, vecs = run["member"].to_numpy(), _vecs(run["vec"])
            fresh, low, side = run["fresh"].to_numpy(), run["floor"].to_numpy(), run["side"].to_numpy()
            for a in range(0, len(run), WINDOW):
                b = a + WINDOW
                sims = vecs[a:b] @ vecs[a:b].T
                sims[~(fresh[a:b, None] | fresh[None, a:b]) | (side[a:b, None] == side[None, a:b])] = -2
                if (found := _top(ids[a:b], sims, 3, low[a:b])) is not None:
                    parts.append(found)
            if len(parts) > 2000:
                yield _edges(parts)
                parts = []
        yield _edges(parts)

    rows = both.join(vectors, "member").withColumn("draw", F.xxhash64("member", F.lit(turn)))
    found = (rows.repartition("center").sortWithinPartitions("center", "draw").select("center", "member", "fresh", "vec", "floor", "side")
             .mapInArrow(lambda it: (pa.RecordBatch.from_pandas(x, preserve_index=False, schema=pa.schema(
                 [("src", pa.int64()), ("nbr", pa.int64()), ("sim", pa.float64())])) for x in local(it)), "src long, nbr long, sim double"))
    return _keep(graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), k)


def verified(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges whose cosine in double precision reaches the threshold."""
    @F.pandas_udf("double")
    def cos(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float((unit(stack([a])) * unit(stack([b]))).sum()) for a, b in zip(x, y, strict=True)])

    pairs = edges.select(F.greatest("src", "nbr").alias("a"), F.least("src", "nbr").alias("b")).distinct()
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("raw").alias(f"raw_{c}"))
    return pairs.join(end("a"), "a").join(end("b"), "b").where(cos("raw_a", "raw_b") >= threshold).select("a", "b")


def enlarge(graph: DataFrame, links: DataFrame, nodes: DataFrame, k: int, threshold: float, turn: int) -> tuple[DataFrame, DataFrame]:
    """(links, components) after the saturated lists have been enlarged, until that adds no link."""
    full = written(graph.groupBy("src").agg(F.min("sim").alias("least"), F.count("*").alias("n"))
                   .where((F.col("n") >= k) & (F.col("least") >= threshold - 1e-4)).select(F.col("src").alias("node"), F.lit(True).alias("full")), "nn-full")
    n_full, outer = full.count(), None
    while True:
        components = written(connected_components(links), "nn-components")
        if not n_full:
            return links, components
        sided = written(nodes.select("node", "dim", "raw", "vec").join(components, "node", "left").join(full, "node", "left").select(
            "node", "dim", "raw", "vec", F.coalesce("component", "node").alias("side"), F.coalesce("full", F.lit(False)).alias("full")), "nn-sides")
        # the start: windows over all nodes, and over a few nodes of each side, so that no large side fills a window
        few = sided.withColumn("n", F.row_number().over(Window.partitionBy("side", F.pmod(F.xxhash64("node"), F.lit(64))).orderBy(
            F.xxhash64("node", F.lit(turn)), "node"))).where("n = 1").drop("n")
        found = (start_graph(sided, k, SEED + turn).unionByName(start_graph(few, k, SEED + turn))
                 .join(full.select(F.col("node").alias("src")), "src", "left_semi").withColumn("fresh", F.lit(True)))
        if outer is not None:
            end = lambda c: sided.select(F.col("node").alias(c), F.col("side").alias(f"side_{c}"))
            found = found.unionByName(outer.join(end("src"), "src").join(end("nbr"), "nbr").where("side_src != side_nbr").select(
                "src", "nbr", "sim", F.lit(True).alias("fresh")))
        outer, changed = written(_keep(found, k), "nn-outer"), n_full * k
        while changed > DELTA * n_full * k:
            outer = written(refine(outer, sided, k, turn, graph), "nn-outer")
            changed, turn = outer.where("fresh").count(), turn + 1
        more = written(verified(outer.where(F.col("sim") >= threshold - 1e-4), nodes, threshold), "nn-more")
        if more.isEmpty():
            return links, components
        links = written(links.unionByName(more), "nn-links")


def count_links(nodes: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links): vectors linked to each node of a component, other than its own copies."""
    members = written(nodes.select("node", "raw", "n").join(components, "node"), "nn-members")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    part = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rows = (members.join(sizes, "component").withColumn("part", part)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select(F.xxhash64("component", F.least("part", "other"), F.greatest("part", "other")).alias("block"),
                    "component", "part", "other", "node", "raw", "n"))

    def count(batches):
        for run in _runs(batches, "block"):
            for _, group in run.groupby("component"):
                x = unit(stack(group["raw"].tolist()))
                weight, side = group["n"].to_numpy(), group["part"].to_numpy()
                total = np.zeros(len(group), np.int64)
                for a in range(0, len(group), 1024):
                    linked = x[a:a + 1024] @ x.T >= threshold
                    if side.min() != side.max():               # a block of two chunks: across them only
                        linked &= side[a:a + 1024, None] != side[None, :]
                    elif (group["other"] != group["part"]).any():
                        linked[:] = False                      # the other chunk is empty
                    linked[np.arange(len(linked)), np.arange(a, a + len(linked))] = False
                    total[a:a + 1024] = linked @ weight
                yield pa.RecordBatch.from_arrays([pa.array(group["node"].to_numpy()), pa.array(total)], ["node", "n_links"])

    counted = rows.repartition("block").sortWithinPartitions("block").mapInArrow(count, "node long, n_links long")
    return counted.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def audit(nodes: DataFrame, known: DataFrame, components: DataFrame, threshold: float) -> tuple[float, DataFrame]:
    """(mean share of a linked node's links that are known, the links found): samples against all nodes, in blocks.

    The least of three means: of linked nodes in small groups, of those in large
    ones, and of all nodes, where each sample stands for its kind's number of nodes.
    ``known``: (node, n_links), links to other nodes counted with their copies.
    """
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    kind = F.when(F.col("size").isNull(), 0).when(F.col("size") <= K, 1).otherwise(2)
    kinds = written(nodes.select("node", "dim", "raw").join(components.join(sizes, "component"), "node", "left")
                    .join(known, "node", "left").select("node", "dim", "raw", kind.alias("kind"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "nn-kinds")
    picked = pd.concat([kinds.where(F.col("kind") == g).orderBy(F.xxhash64("node"), "node").limit(n).toPandas()
                        for g, n in enumerate((ALONE, AUDIT, AUDIT))], ignore_index=True)
    some = {d: (g["node"].to_numpy(), unit(stack(g["raw"].tolist()))) for d, g in picked.groupby("dim")}
    shipped = nodes.sparkSession.sparkContext.broadcast(some)  # at most ALONE + 2 * AUDIT vectors

    def compare(batches):
        for pdf in batches:
            out = []
            for dim, whole in pdf.groupby("dim"):
                if dim in shipped.value:
                    ids, x = shipped.value[dim]
                    for part in (whole.iloc[a:a + 1024] for a in range(0, len(whole), 1024)):
                        own, n = part["node"].to_numpy(), part["n"].to_numpy()
                        i, j = np.nonzero((unit(stack(part["raw"].tolist())) @ x.T >= threshold) & (own[:, None] != ids[None, :]))
                        out.append(pd.DataFrame({"src": ids[j], "nbr": own[i], "n": n[i]}))
            if out:
                yield pd.concat(out)

    exact = written(nodes.select("node", "dim", "raw", "n").mapInPandas(compare, "src long, nbr long, n long"), "nn-audit")
    true = exact.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("true_links")).toPandas()   # a row per sampled node at most
    linked = picked.merge(true, on="node")
    linked["share"] = linked["n_links"].clip(upper=linked["true_links"]) / linked["true_links"]
    counts = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    stands_for = linked["kind"].map(counts) / linked["kind"].map(picked["kind"].value_counts())
    means = [g["share"].mean() for of, g in linked.groupby("kind") if of]
    if len(linked):
        means.append((linked["share"] * stands_for).sum() / stands_for.sum())
    return min(means, default=1.0), exact.select("src", "nbr")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector.

    Unusable vectors (null, empty, zero, with null or non-finite components)
    link with nothing, and so do vectors of different dimension; rows that
    repeat id and vector count once; rows without vec_id are left out; an empty
    table gives an empty result; further columns are ignored.
    """
    usable = written(clean_vectors(table).distinct(), "nn-vectors")

    def single(batches):
        for pdf in batches:
            yield pdf.assign(vec=[unit(stack([r]))[0].astype("<f4").tobytes() for r in pdf["raw"]])

    classes = usable.groupBy("dim", "raw").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    nodes = written(classes.mapInPandas(single, "dim int, raw binary, node long, n long, vec binary"), "nn-nodes")
    total = nodes.count()
    sided = nodes.withColumn("side", F.col("node"))
    graph = written(_keep(start_graph(sided, k).withColumn("fresh", F.lit(True)), k), "nn-graph")
    extra, turn, tries, changed = None, 0, 0, total * k
    while True:
        while total and changed > DELTA * total * k:
            graph = written(refine(graph, sided, k, turn), "nn-graph")
            changed, turn = graph.where("fresh").count(), turn + 1
        near = graph.where(F.col("sim") >= threshold - 1e-4).select("src", "nbr")
        links = written(verified(near if extra is None else near.unionByName(extra), nodes, threshold), "nn-links")
        links, components = enlarge(graph, links, nodes, k, threshold, turn)
        counts = written(count_links(nodes, components, threshold), "nn-counts")
        recall, found = audit(nodes, counts, components, threshold)
        if recall >= RECALL:
            break
        if tries == TRIES:
            raise RuntimeError(f"{recall:.4f} of the audited links are known, {RECALL} are wanted")
        # what is known stays known: the links found by now, those of the audit, and the graph
        tries, k, extra = tries + 1, 2 * k, found.unionByName(links.select(F.col("a").alias("src"), F.col("b").alias("nbr")))
        fresh = start_graph(sided, k, SEED + 1000 * tries).withColumn("fresh", F.lit(True))
        graph = written(_keep(graph.withColumn("fresh", F.lit(False)).unionByName(fresh), k), "nn-graph")
        changed = total * k
    per_node = nodes.select("node", "dim", "raw", "n").join(components, "node", "left").join(counts, "node", "left").select(
        "dim", "raw", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = usable.join(per_node, ["dim", "raw"]).select("vec_id", "n_links", "component_id")
    ids = table.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    alone = ids.join(usable.select("vec_id"), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
