"""Near duplicates by weighted min-hashes of TF-IDF shingles.

A document is a weighted set: its shingles of five words, the j-th time a shingle stands in it as an element of its own (so the
weight of a shingle is its count times its IDF), each weighted by the damped inverse document frequency of the shingle. Document
frequencies are counted over all documents in 2^20 buckets of the shingle's hash; a bucket holds rare shingles alike, and a
frequent one stands out. Improved consistent weighted sampling draws an element for each of BANDS x ROWS hash functions, equal for
two documents as often as their weighted Jaccard similarity; documents that agree in a band are candidates. A candidate counts when
its exact weighted Jaccard similarity is at least the threshold.

Each text is first paired with the most central member (that in the largest buckets) of each of its buckets, at most BANDS pairs a
text. Then every two members of a bucket that still are in different classes are compared, in the first bucket that they share: the
largest class of a bucket and its other members are cut into chunks of about CHUNK members, and each two chunks meet in a block of
their own, but for two of the largest class, whose members have nothing to be compared for. So no bucket has to fit a task, and a
group of copies costs rows in proportion to its size. A pair goes on to verification unless a byte of each of the BANDS x ROWS draws
says that it lies more than four standard deviations below the threshold; only members of such pairs are fetched with their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hot_join, texts, written

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 6
DF_BITS = 20
LEVELS, LEAST_WEIGHT = 8, 0.75
TABLE_BITS = 16
#: Members of a large bucket that meet as many others in a block.
CHUNK = 512
BLOCK = ["band", "key", "i", "j"]
SEED = 20_240_601
#: Texts are worked on in parts of about this many bytes, which fit a core's cache.
PART_BYTES = 1 << 20

_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles, sorted within each text, how often each stood before, and the bounds of the texts.

    Words are runs of letters, digits and underscores of the lower-cased text. A text of fewer than WORDS words has one shingle of
    all of them, an empty one none.
    """
    parts = [t.lower().encode() for t in texts]
    raw = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    of_text = np.cumsum([1] + [len(p) + 1 for p in parts[:-1]]) if parts else np.zeros(0, np.int64)
    word = _IS_WORD[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    power = np.full(len(raw), _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power)])
    back = np.full(len(raw), _BASE_INVERSE, np.uint64)
    back[0] = 1
    h = _mix((total[end] - total[start]) * np.cumprod(back)[start])
    first = np.searchsorted(start, of_text)  # the first word of each text
    words = np.diff(np.append(first, len(start)))
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(parts) + 1, np.int64)
    rolled = sum(h[k : len(h) - WORDS + 1 + k] * _ODD[k] for k in range(WORDS)) if len(h) >= WORDS else np.zeros(0, np.uint64)
    n = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first - bounds[:-1], n) + np.arange(bounds[-1])
    out = np.zeros(bounds[-1], np.uint64)
    long_ = np.repeat(words >= WORDS, n)
    out[long_] = rolled[at[long_]]
    for k in np.flatnonzero((words > 0) & (words < WORDS)):
        own = h[first[k] : first[k] + words[k]]
        out[bounds[k]] = (own * _ODD[16 : 16 + len(own)]).sum(dtype=np.uint64)
    out = _mix(out)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][n > 0]] = True
    place = np.arange(len(out))
    return out, place - np.maximum.accumulate(np.where(new, place, 0)), bounds


def elements(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """An id for each shingle and number of its occurrence."""
    again = np.flatnonzero(before)
    e = h.copy()
    e[again] = _mix(h[again] + before[again].astype(np.uint64) * _BASE)
    return e


def sampling_table(weights: np.ndarray) -> np.ndarray:
    """uint64[levels << TABLE_BITS]: for each weight and entry, ICWS's ln-free a = c / (y exp(r)), as sortable bits in the upper half."""
    rng = np.random.default_rng(SEED + 1)
    size = 1 << TABLE_BITS
    r, c, beta = rng.gamma(2, 1, size), rng.gamma(2, 1, size), rng.random(size)
    t = np.floor(np.log(weights)[:, None] / r + beta)
    a = c / np.exp(r * (t - beta) + r)
    return (a.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)).ravel()


def signatures(e: np.ndarray, level: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int64[texts, BANDS]: a key of the ROWS elements drawn for each band; uint8[texts, BANDS * ROWS]: a byte of each draw.

    Texts without shingles must not be among them.
    """
    low, shift = e & np.uint64(0xFFFFFFFF), np.uint64(64 - TABLE_BITS)
    base, keys = level.astype(np.int64) << TABLE_BITS, np.zeros((len(bounds) - 1, BANDS), np.uint64)
    draws = np.zeros((len(bounds) - 1, BANDS * ROWS), np.uint8)
    for band in range(BANDS):
        for row in range(ROWS):
            k = band * ROWS + row
            entry = ((e * _ODD[64 + k]) >> shift).astype(np.int64) + base
            drawn = np.minimum.reduceat(table[entry] | low, bounds[:-1])
            draws[:, k] = drawn.view(np.uint8).reshape(-1, 8)[:, 1]
            keys[:, band] = _mix(keys[:, band] + (drawn & np.uint64(0xFFFFFFFF)) * _ODD[200 + row] + np.uint64(row + 1))
    return keys.view(np.int64), draws


def _parts(values: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PART_BYTES together."""
    a = size = 0
    for k, t in enumerate(values):
        size += len(t)
        if size >= PART_BYTES:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(values):
        yield a, len(values)


def document_frequencies(nodes: DataFrame) -> np.ndarray:
    """Over all rows: in how many documents shingles of each bucket stand. 2^DF_BITS numbers on the driver, whatever the input."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << DF_BITS, np.int64)
        for f in frames:
            values = f["text"].tolist()
            for a, b in _parts(values):
                h, before, _ = shingles(values[a:b])
                total += np.bincount((h[before == 0] >> np.uint64(64 - DF_BITS)).astype(np.int64), minlength=len(total))
        for k, part in enumerate(total.reshape(64, -1)):
            yield pd.DataFrame({"slice": [k], "counts": [part.astype("<i8").tobytes()]})

    def add(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for x in f["counts"]:
                own = np.frombuffer(x, "<i8")
                total = own.copy() if total is None else total + own
        yield pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})

    got = nodes.select("text").mapInPandas(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], "<i8") for r in sorted(got, key=lambda r: r["slice"])]) if got else np.zeros(1 << DF_BITS, np.int64)


def idf_levels(df: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's level, and the weight of each level: from 1 (buckets up to the mean) down to LEAST_WEIGHT (in every document)."""
    idf = np.log1p(max(documents, 1) / np.maximum(df, 1))
    usual = np.log1p(max(documents, 1) / max(1.0, df.mean()))
    weight = LEAST_WEIGHT + (1 - LEAST_WEIGHT) * np.clip(idf / usual, 0, 1)
    level = np.rint((1 - weight) / (1 - LEAST_WEIGHT) * (LEVELS - 1)).astype(np.uint8)
    return level, 1 - np.arange(LEVELS) / (LEVELS - 1) * (1 - LEAST_WEIGHT)


def jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of distinct elements: an element weighs the same in both."""
    _, i, _ = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = wa[i].sum()
    union = wa.sum() + wb.sum() - both
    return float(both / union) if union > 0 else 0.0


def similar(values: tuple[np.ndarray, np.ndarray, np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """For pairs (int[n, 2]) of sets, whether their weighted Jaccard similarity is at least the threshold.

    values: all sets' elements one after another, their weights, and the bounds of the sets. Many pairs of the same sets are
    counted by products of matrices, a tile of elements at a time; those next to the threshold once more by themselves.
    """
    e, w, bounds = values
    at = [slice(x, y) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def own(some: np.ndarray) -> np.ndarray:
        return np.array([jaccard(e[at[u]], w[at[u]], e[at[v]], w[at[v]]) for u, v in some])

    u, u_at = np.unique(pairs[:, 0], return_inverse=True)
    v, v_at = np.unique(pairs[:, 1], return_inverse=True)
    if len(pairs) <= 4 * (len(u) + len(v)):
        return own(pairs) >= threshold
    of = np.repeat(np.arange(len(at)), np.diff(bounds))
    _, kind, often = np.unique(e, return_inverse=True, return_counts=True)
    named = np.cumsum(often > 1) - 1  # an element of one set alone is in no intersection
    kept = np.flatnonzero(often[kind] > 1)
    kept = kept[np.argsort(named[kind[kept]], kind="stable")]
    column = named[kind[kept]]
    both, tile = np.zeros((len(u), len(v))), 2048
    for low in range(0, int((often > 1).sum()), tile):
        some = slice(*np.searchsorted(column, [low, low + tile]))
        has, weight = np.zeros((len(at), tile)), np.zeros(tile)
        has[of[kept[some]], column[some] - low] = 1
        weight[column[some] - low] = w[kept[some]]
        both += (has[u] * weight) @ has[v].T
    total, found = np.bincount(of, w, len(at)), both[u_at, v_at]
    sims = found / np.maximum(total[pairs[:, 0]] + total[pairs[:, 1]] - found, 1e-9)
    close = np.flatnonzero(np.abs(sims - threshold) < 1e-9)
    sims[close] = own(pairs[close])
    return sims >= threshold


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one block after another, from frames in the order of BLOCK."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        k = f[BLOCK].to_numpy(np.int64)
        bounds = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(f)]
        for a, b in zip(bounds[:-2], bounds[1:-1], strict=True):
            yield f.iloc[a:b]
        rest = f.iloc[bounds[-2] :]
    if rest is not None and len(rest):
        yield rest


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, comp (its class's smallest node) for every node of edges (u, v), by large-star and small-star steps."""
    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most):
        # large star: a node links its larger neighbours to its smallest one; small star: smaller ones and itself
        near = both(e)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(hot_join(near.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = hot_join(large, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = written(small, "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("classes didn't settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id, text and node: the text's 64-bit hash. Equal texts are one node."""
    return texts(docs).withColumn("node", F.xxhash64("text"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node and comp of all nodes that are in a class with another node."""
    spark, nodes = docs.sparkSession, _nodes(docs)
    df = document_frequencies(nodes)
    level_of, weights = idf_levels(df, nodes.count())
    shared = spark.sparkContext.broadcast((level_of, weights))  # 1 MB

    def levels(h: np.ndarray) -> np.ndarray:
        return shared.value[0][(h >> np.uint64(64 - DF_BITS)).astype(np.int64)]

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = sampling_table(shared.value[1])
        for f in frames:
            f = f.drop_duplicates("node")
            values, ids = f["text"].tolist(), f["node"].to_numpy(np.int64)
            for a, b in _parts(values):
                h, before, bounds = shingles(values[a:b])
                full = np.flatnonzero(np.diff(bounds))
                if len(full):
                    keys, draws = signatures(elements(h, before), levels(h), np.append(bounds[:-1][full], bounds[-1]), table)
                    yield pd.DataFrame({"node": ids[a:b][full], "bands": list(keys), "draws": [d.tobytes() for d in draws]})

    n_draws = BANDS * ROWS
    least = n_draws * (threshold - 4 * np.sqrt(threshold * (1 - threshold) / n_draws))

    def likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            same = [(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).sum() >= least for a, b in zip(f["da"], f["db"], strict=True)]
            yield f.loc[np.array(same, bool), ["u", "v"]]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = shared.value[1]
        for f in frames:
            # parts of whole pairs, in which each text's elements are found once
            part = np.cumsum(f["ta"].str.len().to_numpy() + f["tb"].str.len().to_numpy()) // (4 * PART_BYTES)
            for _, g in f.groupby(part, sort=False):
                of = dict(zip([*g["u"], *g["v"]], [*g["ta"], *g["tb"]], strict=True))
                h, before, bounds = shingles(list(of.values()))
                e, w = elements(h, before), weight[levels(h)]
                at = {node: slice(x, y) for node, x, y in zip(of, bounds[:-1], bounds[1:], strict=True)}
                sims = np.array([jaccard(e[at[u]], w[at[u]], e[at[v]], w[at[v]]) for u, v in zip(g["u"], g["v"], strict=True)])
                yield g.loc[sims >= threshold, ["u", "v"]]

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each member of a block, with which of the others it is to be compared; those without any pair go."""
        for f in _blocks(frames):
            (band, _, i, j), node, comp, chunk = f[BLOCK].iloc[0], f["node"].to_numpy(), f["comp"].to_numpy(), f["chunk"].to_numpy()
            keys, draws = np.stack(f["bands"].to_numpy())[:, : int(band)], np.frombuffer(b"".join(f["draws"]), np.uint8).reshape(len(f), -1)
            right, needed, others = np.flatnonzero(chunk == j), np.zeros(len(f), bool), [b""] * len(f)
            for x in np.flatnonzero(chunk == i):
                y = right[right > x] if i == j else right
                y = y[comp[y] != comp[x]]
                y = y[~(keys[y] == keys[x]).any(axis=1)]  # those met before, in an earlier band
                y = y[(draws[y] == draws[x]).sum(axis=1) >= least]
                if len(y):
                    needed[x] = needed[y] = True
                    others[x] = node[y].astype("<i8").tobytes()
            if needed.any():
                yield f.assign(others=others).loc[needed, [*BLOCK, "node", "comp", "others"]]

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of a block's members that aren't yet in one class, as few as make the classes."""
        weight = shared.value[1]
        for f in _blocks(frames):
            h, before, bounds = shingles(f["text"].tolist())
            place = {node: k for k, node in enumerate(f["node"])}
            pairs = np.array([(k, place[v]) for k, x in enumerate(f["others"]) for v in np.frombuffer(x, "<i8").tolist()]).reshape(-1, 2)
            node, comp, joined = f["node"].to_numpy(), f["comp"].to_numpy(), []
            parent = {c: c for c in comp.tolist()}
            for u, v in pairs[similar((elements(h, before), weight[levels(h)], bounds), pairs, threshold)]:
                a, b = int(comp[u]), int(comp[v])
                while parent[a] != a:
                    a = parent[a] = parent[parent[a]]
                while parent[b] != b:
                    b = parent[b] = parent[parent[b]]
                if a != b:
                    parent[a] = b
                    joined.append((node[u], node[v]))
            if joined:
                yield pd.DataFrame(joined, columns=["u", "v"])

    signed = nodes.select("node", "text").mapInPandas(sign, "node long, bands array<long>, draws binary").groupBy("node").agg(F.first("bands").alias("bands"), F.first("draws").alias("draws"))
    signed = written(signed, "signatures")
    rows = signed.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = hot_join(rows, sizes, ["band", "key"])
    central = rows.groupBy("node").agg(F.sum("n").alias("central"))
    rows = written(rows.join(central, "node").select("band", "key", "node", "central"), "buckets")

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar enough, by their texts."""
        da, db = signed.select(F.col("node").alias("u"), F.col("draws").alias("da")), signed.select(F.col("node").alias("v"), F.col("draws").alias("db"))
        pairs = written(pairs.join(da, "u").join(db, "v").mapInPandas(likely, "u long, v long"), "pairs")
        involved = pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct()
        # both sides grow with the input: the plan is the same at every size
        held = written(nodes.select("node", "text").join(involved.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "texts")
        a, b = held.select(F.col("node").alias("u"), F.col("text").alias("ta")), held.select(F.col("node").alias("v"), F.col("text").alias("tb"))
        return written(pairs.join(b, "v").join(a, "u").mapInPandas(compare, "u long, v long"), "links")

    centres = rows.groupBy("band", "key").agg(F.max_by("node", F.struct("central", "node")).alias("v"))
    links = verify(hot_join(rows, centres, ["band", "key"]).filter("node <> v").select(F.col("node").alias("u"), "v").distinct())
    comp = written(components(links), "classes")
    # the rest: members of buckets that still hold several classes; the largest class of each and its chunks, then those of all others
    named = written(rows.join(comp, "node", "left").select("band", "key", "node", F.coalesce("comp", "node").alias("comp")), "members")
    held = named.groupBy("band", "key", "comp").agg(F.count("*").alias("n")).groupBy("band", "key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("_m"), F.sum("n").alias("_n"))
    mixed = held.filter("_n > _m").select("band", "key", "main", F.ceil(F.col("_m") / CHUNK).cast("int").alias("a"), F.ceil((F.col("_n") - F.col("_m")) / CHUNK).cast("int").alias("b"))
    member = hot_join(named, mixed, ["band", "key"])
    chunk = F.when(F.col("comp") == F.col("main"), F.pmod(F.xxhash64("node", "key"), "a")).otherwise(F.col("a") + F.pmod(F.xxhash64("node", "key"), "b")).cast("int")
    others = F.sequence(F.when(F.col("comp") == F.col("main"), F.col("a")).otherwise(0), F.col("a") + F.col("b") - 1)
    dealt = member.withColumn("chunk", chunk).withColumn("with", F.explode(others)).select("band", "key", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "chunk", "node", "comp")

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartition(*BLOCK).sortWithinPartitions(*BLOCK)

    meeting = by_block(dealt.join(signed, "node")).mapInPandas(meet, "band int, key long, i int, j int, node long, comp long, others binary")
    meeting = written(meeting, "meetings")
    involved = meeting.select("node").distinct()
    held = nodes.select("node", "text").join(involved.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    more = written(by_block(meeting.join(held.hint("merge"), "node")).mapInPandas(settle, "u long, v long"), "links")
    return written(components(links.unionAll(more)), "classes") if more.take(1) else comp


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, node, comp for every row of (doc_id, text); class_id is the smallest doc_id of the class.

    Equal texts are in one class, null and empty ones too. A row without an id belongs to its text's class; a class without any
    id has a null class_id. Repeated rows stay. Texts without words are alike only where they are equal. comp names the class.
    """
    comp = near_classes(docs, threshold)
    rows = written(_nodes(docs).select("doc_id", "node"), "nodes")
    # from rows to texts to classes, and back: each of these may be most of the table
    named = rows.groupBy("node").agg(F.min("doc_id").alias("_least")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = written(named, "named")
    least = named.groupBy("comp").agg(F.min("_least").alias("class_id"))
    classes = written(hot_join(named, least, ["comp"]).select("node", "comp", "class_id"), "named")
    return hot_join(rows, classes, ["node"]).select("doc_id", "class_id", "node", "comp")


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, one of each class: the one with the smallest doc_id."""
    found = written(near_duplicates(docs, threshold), "classes")
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).dropDuplicates(["comp"]).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    out = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (own == F.col("_node"))).select(*[docs[c] for c in docs.columns])
    repeated = found.groupBy("doc_id", "node").count().filter("count > 1").take(1)
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out
