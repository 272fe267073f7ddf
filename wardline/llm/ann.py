"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all of them, exact reranking.

Inner products are searched as angles: vectors get one more component, which makes all of them equally long. Each tree halves the
space again and again: a node's projection parts two of its random points, moved to the means of their sides, at the median. The
trees are as deep as the number of vectors asks for (about LEAF in a leaf). Their upper levels, down to SAMPLE_LEAF sample points a
node, are fitted to a bounded sample; each level below has one random projection of its own, cut at the sample's median, so that
the forest that is broadcast has a bounded size at any number of vectors.

A query walks all trees through one priority queue. A node's priority is the largest sum of signed margins that any leaf below it
has (margins count for the side that the query is on and against the other), so leaves come out in the order of that sum. How many
leaves a query takes is measured: for some probes the true neighbours among all vectors are found by brute force, and the visits
are those with which the recall wanted is reached over all of them.

Leaves are dealt to parts of about PART_ROWS vectors. A query goes once to each part in which it visits a leaf, whatever their
number, and gets back one row with its best entries there. Leaf candidates are ranked by inner products in double precision on the
vectors as they are stored. Equal vectors are one entry of the index, which stands for its smallest ids: no more than are asked for
can be in a result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from .common import tasks, written

TREES, LEAF = 16, 32
#: The bounded sample to which trees are fitted, and the sample points that a fitted node has at least, about.
SAMPLE, SAMPLE_LEAF = 32_768, 8
#: Recall over the probes that visits are set for; means are taken over at most so many points of a node, so often.
RECALL, PROBES, MEANS_OF, MEANS_ROUNDS = 0.95, 128, 256, 4
#: Index entries (vectors times trees) of a part, about.
PART_ROWS = 40_000
HITS = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("id", "<i8"), ("score", "<f8")])


@dataclass
class Forest:
    """Node i of a tree has the children 2 i + 1 and 2 i + 2. planes: of the fitted levels; below them, one plane a level."""

    depth: int
    normals: np.ndarray  # [trees, 2^fitted - 1, dimensions + 1]
    offsets: np.ndarray
    low_normals: np.ndarray  # [trees, depth - fitted, dimensions + 1]
    low_offsets: np.ndarray
    longest: float
    visits: int = 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes them as long as the longest."""
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(axis=1)))[:, None]]).astype(np.float32)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """int[n, trees]: the leaf of each vector, numbered through all trees; a point on a plane goes left."""
        x, out, fitted = self.lifted(x), np.empty((len(x), len(self.normals)), np.int64), self.depth - self.low_normals.shape[1]
        for t in range(out.shape[1]):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                normal, offset = (self.normals[t][node], self.offsets[t][node]) if level < fitted else (self.low_normals[t, level - fitted], self.low_offsets[t, level - fitted])
                node = 2 * node + 1 + ((x * normal).sum(axis=1) > offset)
            out[:, t] = node - (2**self.depth - 1) + (t << self.depth)
        return out

    def margins(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query: margins at the fitted nodes and at the levels below, and the best sum of margins from each node down."""
        q = np.hstack([q.astype(np.float32), np.zeros((len(q), 1), np.float32)])
        trees, inner, width = self.normals.shape
        top = (q @ self.normals.reshape(-1, width).T).reshape(len(q), trees, inner) - self.offsets
        low = (q @ self.low_normals.reshape(-1, width).T).reshape(len(q), trees, -1) - self.low_offsets
        best = np.zeros((len(q), trees, 2 * inner + 1), np.float32)
        best[:, :, inner:] = np.abs(low).sum(axis=2)[:, :, None]
        for level in range(self.depth - low.shape[2] - 1, -1, -1):
            a, b = 2**level - 1, 2 ** (level + 1) - 1
            m, down = top[:, :, a:b], best[:, :, b : 2 * b + 1]
            best[:, :, a:b] = np.maximum(down[:, :, 0::2] - m, down[:, :, 1::2] + m)
        return top, low, best

    def queue(self, q: np.ndarray) -> Iterator[Iterator[int]]:
        """For each query its leaves, in the order in which the shared priority queue hands them out."""
        for a in range(0, len(q), 32):
            top, low, best = self.margins(q[a : a + 32])
            for k in range(len(top)):
                yield self._pop(top[k], low[k], best[k])

    def _pop(self, top: np.ndarray, low: np.ndarray, best: np.ndarray) -> Iterator[int]:
        inner, last, fitted = top.shape[1], 2**self.depth - 1, self.depth - low.shape[1]
        rest = np.abs(low)[:, ::-1].cumsum(axis=1)[:, ::-1]  # what the levels from this one on can add
        # -priority, tree, node, sum of margins so far
        heap = [(-float(best[t, 0]), t, 0, 0.0) for t in range(len(top))]
        heapq.heapify(heap)
        while heap:
            _, t, node, so_far = heapq.heappop(heap)
            if node >= last:
                yield node - last + (t << self.depth)
                continue
            level = (node + 1).bit_length() - 1
            m = float(top[t, node]) if node < inner else float(low[t, level - fitted])
            for child, own in ((2 * node + 1, so_far - m), (2 * node + 2, so_far + m)):
                ahead = float(best[t, child]) if child < len(best[t]) else float(rest[t, level + 1 - fitted]) if level + 1 < self.depth else 0.0
                heapq.heappush(heap, (-own - ahead, t, child, own))


def fit(sample: np.ndarray, longest: float, rows: int, trees: int = TREES, leaf: int = LEAF, sample_leaf: int = SAMPLE_LEAF) -> Forest:
    """Trees for so many rows, fitted to a sample of them."""
    rng = np.random.default_rng(11)
    depth = max(0, int(np.ceil(np.log2(max(1, rows / leaf)))))
    fitted = min(depth, max(0, int(np.log2(max(1, len(sample) / sample_leaf)))))
    width = sample.shape[1] + 1
    forest = Forest(depth, np.zeros((trees, 2**fitted - 1, width), np.float32), np.zeros((trees, 2**fitted - 1), np.float32), np.zeros((trees, depth - fitted, width), np.float32), np.zeros((trees, depth - fitted), np.float32), longest)
    x = forest.lifted(sample)
    for t in range(trees):
        held = [np.arange(len(x))]
        for n in range(2**fitted - 1):
            own = held[n]
            normal = rng.normal(size=width)
            if len(own) > 1:
                some = x[rng.choice(own, min(len(own), MEANS_OF), replace=False)]
                a, b = some[0], some[1]
                for _ in range(MEANS_ROUNDS):
                    side = some @ (a - b) > (a @ a - b @ b) / 2
                    if side.all() or not side.any():
                        break
                    a, b = some[side].mean(axis=0), some[~side].mean(axis=0)
                normal = a - b if (a != b).any() else normal
            normal = (normal / np.linalg.norm(normal)).astype(np.float32)
            at = x[own] @ normal
            forest.normals[t, n], forest.offsets[t, n] = normal, np.median(at) if len(own) else 0
            right = at > forest.offsets[t, n]
            held += [own[~right], own[right]]
        for level in range(depth - fitted):
            normal = rng.normal(size=width)
            forest.low_normals[t, level] = normal / np.linalg.norm(normal)
            forest.low_offsets[t, level] = np.median(x @ forest.low_normals[t, level])
    return forest


def calibrate(forest: Forest, probes: np.ndarray, near: list[np.ndarray], recall: float = RECALL) -> int:
    """The visits with which the share `recall` of all probes' true neighbours (near: their vectors) stands in a visited leaf."""
    needed = []
    for order, of in zip(forest.queue(probes), near, strict=True):
        waiting = [set(x) for x in forest.leaves(of).tolist()] if len(of) else []
        for visit, leaf in enumerate(order, 1):
            still = [x for x in waiting if leaf not in x]
            needed += [visit] * (len(waiting) - len(still))
            waiting = still
            if not waiting:
                break
    return int(np.quantile(needed, recall)) + 1 if needed else 1


def best_of(hits: np.ndarray, k: int) -> np.ndarray:
    """The k first of distinct entries by falling score, then rising id."""
    hits = hits[np.lexsort((hits["h2"], hits["h1"], hits["id"], -hits["score"]))]
    again = (hits["h1"][1:] == hits["h1"][:-1]) & (hits["h2"][1:] == hits["h2"][:-1]) & (hits["id"][1:] == hits["id"][:-1])
    return hits[np.append(True, ~again)[: len(hits)]][:k]


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order wherever it is computed."""
    return (q.astype(np.float64) * x.astype(np.float64)).sum(axis=1)


def search(rows: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` (a condition on rows), its k nearest other rows by inner product.

    Rows whose id or vector is null, whose vector is zero, holds a null or non-finite component, or has another dimension than most
    take no part. Ties go to the smaller id. An id that stands more than once is one candidate, with its best score. With fewer than
    k other rows, all of them are returned; an empty table gives no rows.
    """
    spark, kind = rows.sparkSession, rows.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    number, stored = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(stored).alias("vec"), queries.alias("asked"))
    fine = own.filter("vec_id is not null and vec is not null").filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    usual = fine.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = usual["d"]
    # an entry's name: 128 bits of its vector's hash; zeros of either sign are equal
    fine = fine.filter(F.size("vec") == dims).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0).cast("float" if single else "double"))).withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    # the smallest ids of each distinct vector: Spark keeps only these before it shuffles
    few = fine.withColumn("n", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    members = written(few.groupBy("h1", "h2", "vec_id", "n").agg(F.first("vec").alias("vec")).withColumn("vec", F.when(F.col("n") == 1, F.col("vec"))), "members")
    entries = members.filter(F.col("n") == 1).select("h1", "h2", F.col("vec_id").alias("id"), "vec")
    stats = entries.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("m")).first()

    def vectors(column) -> np.ndarray:
        return np.array(column.tolist(), np.dtype(number)).reshape(-1, dims)

    def packed(h1, h2, ids, score) -> np.ndarray:
        out = np.empty(len(score), HITS)
        out["h1"], out["h2"], out["id"], out["score"] = h1, h2, ids, score
        return out

    picked = entries.orderBy("h1", "h2").limit(SAMPLE).select("vec").toPandas()["vec"]
    forest = fit(vectors(picked), float(np.sqrt(stats["m"])), stats["n"])
    probes = vectors(picked[:PROBES])

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, vec, size = np.full((len(probes), 0), -np.inf), np.zeros((len(probes), 0, dims), number), k + 1
        for f in frames:
            x = vectors(f["vec"])
            for a in range(0, len(x), 2048):
                s = probes.astype(np.float64) @ x[a : a + 2048].T.astype(np.float64)
                top = np.argpartition(-s, min(size, s.shape[1]) - 1, axis=1)[:, :size]
                best, vec = np.hstack([best, np.take_along_axis(s, top, axis=1)]), np.concatenate([vec, x[a : a + 2048][top]], axis=1)
                top = np.argpartition(-best, min(size, best.shape[1]) - 1, axis=1)[:, :size]
                best, vec = np.take_along_axis(best, top, axis=1), np.take_along_axis(vec, top[:, :, None], axis=1)
        if best.shape[1]:
            yield pd.DataFrame({"probe": np.arange(len(probes)), "scores": [x.astype("<f8").tobytes() for x in best], "vecs": [x.tobytes() for x in vec]})

    def merge_probes(f: pd.DataFrame) -> pd.DataFrame:
        s, x = np.frombuffer(b"".join(f["scores"]), "<f8"), np.frombuffer(b"".join(f["vecs"]), number).reshape(-1, dims)
        return pd.DataFrame({"probe": f["probe"].iloc[:1], "vecs": [x[np.argsort(-s, kind="stable")[: k + 1]].tobytes()]})

    # every vector, against the probes; a task gives one row for each probe
    got = entries.select("vec").mapInPandas(nearest, "probe int, scores binary, vecs binary").groupBy("probe").applyInPandas(merge_probes, "probe int, vecs binary").toPandas().sort_values("probe")
    forest.visits = calibrate(forest, probes, [np.frombuffer(x, number).reshape(-1, dims) for x in got["vecs"]])
    shared = spark.sparkContext.broadcast(forest)  # TREES * SAMPLE / SAMPLE_LEAF planes at most, at any number of rows
    parts = int(max(1, np.ceil(stats["n"] * TREES / PART_ROWS)))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each leaf and batch: its entries' names and ids, and their vectors."""
        for f in frames:
            x, names = vectors(f["vec"]), f[["h1", "h2", "id"]].to_numpy("<i8")
            for leaf in shared.value.leaves(x).T:
                order = np.argsort(leaf, kind="stable")
                cut = np.flatnonzero(np.append(True, leaf[order][1:] != leaf[order][:-1]))
                sets = np.split(order, cut[1:])
                own = leaf[order[cut]]
                yield pd.DataFrame({"part": own % parts, "leaf": own, "n": [len(s) for s in sets], "names": [names[s].tobytes() for s in sets], "vecs": [x[s].tobytes() for s in sets]})

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each query and part with the leaves that the query visits there."""
        for f in frames:
            rows = []
            for h1, h2, vec, order in zip(f["h1"], f["h2"], vectors(f["vec"]), shared.value.queue(vectors(f["vec"])), strict=True):
                leaf = np.fromiter((x for x, _ in zip(order, range(shared.value.visits), strict=False)), np.int64)
                part = leaf % parts
                by = np.argsort(part, kind="stable")
                for own in np.split(by, np.flatnonzero(part[by][1:] != part[by][:-1]) + 1):
                    rows.append((part[own[0]], h1, h2, vec.tobytes(), leaf[own].tobytes()))
            yield pd.DataFrame(rows, columns=["part", "h1", "h2", "vec", "leaves"])

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """A row for each query of the part: its k + 1 best entries among those of the leaves that it visits here."""
        if left.empty or right.empty:
            return pd.DataFrame({"h1": pd.Series(dtype=np.int64), "h2": pd.Series(dtype=np.int64), "hits": pd.Series(dtype=object)})
        x, names = np.frombuffer(b"".join(left["vecs"]), number).reshape(-1, dims), np.frombuffer(b"".join(left["names"]), "<i8").reshape(-1, 3)
        q = np.frombuffer(b"".join(right["vec"]), number).reshape(-1, dims)
        leaf = np.repeat(left["leaf"].to_numpy(), left["n"].to_numpy())
        by = np.argsort(leaf, kind="stable")
        cut = np.flatnonzero(np.append(True, leaf[by][1:] != leaf[by][:-1]))
        of_leaf = dict(zip(leaf[by[cut]].tolist(), np.split(by, cut[1:]), strict=True))
        visits = [np.frombuffer(b, np.int64) for b in right["leaves"]]
        asked, row = np.concatenate(visits), np.repeat(np.arange(len(q)), [len(v) for v in visits])
        by = np.argsort(asked, kind="stable")
        cut = np.flatnonzero(np.append(True, asked[by][1:] != asked[by][:-1]))
        wide, ask_wide, found = x.astype(np.float64), q.astype(np.float64), []
        for a, own in zip(asked[by[cut]].tolist(), np.split(row[by], cut[1:]), strict=True):
            held = of_leaf.get(a)
            if held is not None:
                s = ask_wide[own] @ wide[held].T
                found.append((np.repeat(own, len(held)), np.tile(held, len(own)), s.ravel()))
        if not found:
            return pd.DataFrame({"h1": pd.Series(dtype=np.int64), "h2": pd.Series(dtype=np.int64), "hits": pd.Series(dtype=object)})
        who, what, s = (np.concatenate(z) for z in zip(*found, strict=True))
        by = np.lexsort((what, -s, who))
        who, what, s = who[by], what[by], s[by]
        new = np.append(True, (who[1:] != who[:-1]) | (what[1:] != what[:-1]))  # an entry of several leaves of the part has one score here
        who, what, s = who[new], what[new], s[new]
        cut = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        ends, hits = np.append(cut[1:], len(who)), []
        for a, b in zip(cut, ends, strict=True):
            # all that could be among the first: up to rounding, also those tied with the last of them, each in several trees
            last = s[min(b, a + (k + 1) * TREES) - 1] if b - a > (k + 1) * TREES else -np.inf
            stop = a + int(np.searchsorted(-s[a:b], -(last - 1e-9 * (1 + abs(last))), side="right")) if np.isfinite(last) else b
            w = what[a:stop]
            hits.append(best_of(packed(names[w, 0], names[w, 1], names[w, 2], scores(q[who[a]][None], x[w])), k + 1).tobytes())
        return pd.DataFrame({"h1": right["h1"].to_numpy()[who[cut]], "h2": right["h2"].to_numpy()[who[cut]], "hits": hits})

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        hits = best_of(np.frombuffer(b"".join(f["hits"]), HITS), k + 1)
        return pd.DataFrame({"q1": f["h1"].iloc[0], "q2": f["h2"].iloc[0], "h1": hits["h1"], "h2": hits["h2"], "score": hits["score"]})

    left = written(entries.mapInPandas(index, "part int, leaf long, n int, names binary, vecs binary"), "index")
    wanted = fine.filter("asked").groupBy("h1", "h2").agg(F.first("vec").alias("vec"))
    right = wanted.repartition(tasks(spark)).mapInPandas(ask, "part int, h1 long, h2 long, vec binary, leaves binary")
    # a part in which a leaf is much larger than others is met in several pieces
    pieces = left.groupBy("part").agg(F.ceil(F.sum("n") / (4 * PART_ROWS)).cast("int").alias("pieces"))
    left = left.join(pieces, "part").withColumn("piece", F.pmod(F.xxhash64("names"), "pieces").cast("int")).drop("pieces")
    right = right.join(pieces, "part").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    found = left.groupBy("part", "piece").cogroup(right.groupBy("part", "piece")).applyInPandas(meet, "h1 long, h2 long, hits binary")
    near = written(found.groupBy("h1", "h2").applyInPandas(merge, "q1 long, q2 long, h1 long, h2 long, score double"), "nearest")
    # an entry's ids beyond the k + 1 smallest can't be among the k nearest of any query
    hits = near.join(members.select("h1", "h2", "vec_id"), ["h1", "h2"]).groupBy("q1", "q2", "vec_id").agg(F.max("score").alias("score"))
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    lists = hits.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("hits"))
    # queries by their vectors; a vector that more than a thousandth of all queries share is dealt by salts
    asked = fine.filter("asked").select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    total = asked.count()
    hot = F.broadcast(asked.groupBy("q1", "q2").count().filter(F.col("count") > max(1000, total / 1000)).select("q1", "q2", F.ceil(F.col("count") / 1000).cast("int").alias("salts")))  # 1000 rows at most
    asked = asked.join(hot, ["q1", "q2"], "left").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    lists = lists.join(hot, ["q1", "q2"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    own = asked.join(lists, ["q1", "q2", "salt"]).select("query_id", F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")).alias("hits"))
    # an id with several vectors asks with each; an id that answers with several counts once, with its best score
    best = own.select("query_id", F.explode("hits").alias("h")).groupBy("query_id", F.col("h.vec_id").alias("vec_id")).agg(F.max("h.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
