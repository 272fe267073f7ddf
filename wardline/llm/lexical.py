"""Ranked lexical search: a document FP-tree, searched depth first by branch and bound.

Documents are first restricted to the terms of the items. A block of them becomes a tree: vectors of terms in order of falling document
frequency, sorted, so that documents below a node share the path to it and stand side by side. Each node knows, for every term below
it, the largest frequency that a document there has, and the smallest length value m there. Since a term's part in a score rises with
its frequency and falls with m, these bound the scores below the node. Each item goes depth first to the children of the highest
bounds, and leaves out those whose bound is below its k-th best score so far, which tasks carry on from block to block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, pieces, texts, written

K = 10
#: Fixed values of the scores: terms' weights, frequencies and lengths.
W_SCALE, TF_SCALE, TF_PART, M_PART, M_BASE, M_SHARE = 1000, 1_000_000_000, 1000, 8, 100, 75
#: A-Z in lower case, 0-9, a-z and all bytes of other letters as they are; other ASCII is a space.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: UTF-8 bytes of items that are searched for together: their terms are broadcast, 64 MB in Python at most.
ITEM_BYTES = 8 << 20
#: Terms of the documents of a tree, about, and blocks of one task.
BLOCK_TERMS, TASK_BLOCKS = 1 << 19, 2
#: Documents of a leaf.
LEAF = 48


def term_counts(text: str) -> Counter:
    """Maximal matches of [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ as UTF-8, A-Z in lower case."""
    found: Counter = Counter()
    for part in pieces(text.encode().translate(TERMS)):
        found.update(part.split())
    return found


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by."""
    return TF_SCALE * tf // (TF_PART * tf + M_PART * m)


# ---- tree ----


@dataclass
class Rows:
    """Sparse vectors: row k has terms[at[k]:at[k + 1]] and their parts."""

    at: np.ndarray
    terms: np.ndarray
    parts: np.ndarray

    def scores(self, weight: np.ndarray, first: int, last: int) -> np.ndarray:
        """Of rows first to last, for a weight of every term. No row is empty."""
        a, b = self.at[first], self.at[last]
        return np.add.reduceat(weight[self.terms[a:b]] * self.parts[a:b], self.at[first:last] - a)


class Tree:
    """The FP-tree of a block of documents.

    Documents are rows in the order of their vectors, nodes are rows too, children side by side: node k has the children
    first[k] to last[k], documents if leaf[k].
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], leaf: int = LEAF):
        """terms: of each document, ascending by rank (the most frequent first), not empty."""
        keys = [t.astype(">u4").tobytes() for t in terms]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.ids, m = ids[order], m[order]
        terms, tfs = [terms[k] for k in order], [tfs[k] for k in order]
        at = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
        flat, tf = np.concatenate(terms), np.concatenate(tfs).astype(np.int64)
        self.documents = Rows(at, flat, part(tf, np.repeat(m, np.diff(at))))
        shared = np.array([0] + [_shared(a, b) for a, b in zip(terms, terms[1:], strict=False)])
        self.first, self.last, self.leaf, bounds = [0], [0], [False], [(0, len(terms))]
        row_terms, row_parts, todo = [], [], [0]
        while todo:  # breadth first, so that a node's children get numbers in a row
            nodes, todo = todo, []
            for k in nodes:
                low, high = bounds[k]
                if high - low <= leaf:
                    self.first[k], self.last[k], self.leaf[k] = low, high, True
                    continue
                self.first[k] = len(bounds)
                for a, b in _split(shared, low, high, leaf):
                    todo.append(len(bounds))
                    bounds.append((a, b))
                    self.first.append(0)
                    self.last.append(0)
                    self.leaf.append(False)
                self.last[k] = len(bounds)
        for low, high in bounds:
            a, b = at[low], at[high]
            by = np.argsort(flat[a:b], kind="stable")
            t = flat[a:b][by]
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            row_terms.append(t[start])
            row_parts.append(part(np.maximum.reduceat(tf[a:b][by], start), m[low:high].min()))
        self.nodes = Rows(np.concatenate([[0], np.cumsum([len(t) for t in row_terms])]), np.concatenate(row_terms), np.concatenate(row_parts))

    def search(self, weight: np.ndarray, best: Best) -> int:
        """Put what scores above 0 and may be among the best into `best`. Returns the number of documents scored."""
        stack, seen = [(int(self.nodes.scores(weight, 0, 1)[0]), 0)], 0
        while stack:
            bound, k = stack.pop()
            if bound < best.least:
                continue
            first, last = self.first[k], self.last[k]
            if self.leaf[k]:
                seen += last - first
                best.add(self.documents.scores(weight, first, last), self.ids[first:last])
                continue
            bounds = self.nodes.scores(weight, first, last)
            order = np.argsort(bounds, kind="stable")  # the highest is taken next
            order = order[bounds[order] >= best.least]
            stack += zip(bounds[order].tolist(), (first + order).tolist(), strict=True)
        return seen


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the common path."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _split(shared: np.ndarray, low: int, high: int, leaf: int) -> list[tuple[int, int]]:
    """The children of a node, as ranges: parted where the path ends that all share; small neighbours go together up to a leaf."""
    inner = shared[low + 1 : high]
    cuts = [low, *(low + 1 + np.flatnonzero(inner == inner.min())).tolist(), high]
    out, start = [], low
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - start > leaf and a > start:
            out.append((start, a))
            start = a
    return [*out, (start, high)]


class Best:
    """The k best of an item, by falling score, then rising id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        some = score >= self.least
        if some.any():
            score, ids = np.concatenate([self.score, score[some]]), np.concatenate([self.ids, ids[some]])
            order = np.lexsort([ids, -score])[: self.k]
            self.score, self.ids = score[order], ids[order]
            if len(order) == self.k:
                self.least = int(self.score[-1])


# ---- search ----


def restricted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (those of `terms`, by number) of every document with a term."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = known.value
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
                counts = term_counts(text)
                own = [(number[t], c) for t, c in counts.items() if t in number]
                if counts:
                    rows.append((doc_id, counts.total(), [k for k, _ in own], [c for _, c in own]))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tfs"])

    # a null id is the smallest
    named = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    return named.mapInPandas(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def search_group(docs: DataFrame, items: list[tuple[int, Counter]], k: int, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """number, doc_id, score: the k best of each task for every item (a number and its terms)."""
    spark = docs.sparkSession
    terms = {t: j for j, t in enumerate(dict.fromkeys(t for _, own in items for t in own))}
    stored = written(restricted(docs, terms), "lexical-vectors")
    size = stored.agg(F.count("*").alias("N"), F.sum("n").alias("L"), F.sum(F.size("terms")).alias("terms")).first()
    n_docs, n_terms = size["N"], size["L"] or 1
    df = np.zeros(len(terms), np.int64)
    for r in stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many rows as broadcast terms at most
        df[r["term"]] = r["count"]
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    weight = [math.floor(W_SCALE * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df]
    asked = []
    for number, own in items:
        pairs = [(int(rank[terms[t]]), weight[terms[t]] * c) for t, c in own.items()]
        asked.append((number, np.array([r for r, _ in pairs], np.int64), np.array([w for _, w in pairs], np.int64)))
    shared = spark.sparkContext.broadcast((rank.astype(np.int32), asked))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, asked = shared.value
        best, weights = [Best(k) for _ in asked], np.zeros(len(rank), np.int64)
        for ids, m, own_terms, tfs in _blocks(frames, rank, block_terms):
            tree = Tree(ids, m, own_terms, tfs)
            for (_, own, w), b in zip(asked, best, strict=True):
                weights[own] = w
                tree.search(weights, b)
                weights[own] = 0
        rows = [(number, i, s) for (number, _, _), b in zip(asked, best, strict=True) for i, s in zip(b.ids.tolist(), b.score.tolist(), strict=True)]
        if rows:
            yield pd.DataFrame(rows, columns=["number", "doc_id", "score"])

    m = F.lit(M_BASE - M_SHARE) + F.expr(f"({M_SHARE} * n * {n_docs}L) div {n_terms}L")
    dealt = stored.filter(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs").repartition(1 + (size["terms"] or 0) // (block_terms * TASK_BLOCKS))
    return dealt.mapInPandas(search, "number long, doc_id long, score long")


def _blocks(frames: Iterator[pd.DataFrame], rank: np.ndarray, most: int) -> Iterator[tuple]:
    """ids, m, terms by rank (ascending) and their frequencies of about `most` terms at a time."""
    ids, m, terms, tfs, held = [], [], [], [], 0
    for f in frames:
        for i, own_m, t, tf in zip(f["doc_id"], f["m"], f["terms"], f["tfs"], strict=True):
            t = rank[t]
            by = np.argsort(t)
            ids.append(i)
            m.append(own_m)
            terms.append(t[by])
            tfs.append(tf[by])
            held += len(t)
            if held >= most:
                yield np.array(ids, np.int64), np.array(m, np.int64), terms, tfs
                ids, m, terms, tfs, held = [], [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(m, np.int64), terms, tfs


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each item, equal scores by rising doc_id.

    items: item_id and text. Items are searched for in groups of about `item_bytes`, each in two passes over all documents. Null and
    empty texts hold no terms; an item without terms has no rows. Items or documents that share an id are items or documents of their
    own. A null doc_id comes first among equal scores (and is told from others as the smallest long).
    """
    spark = docs.sparkSession
    own = written(items.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("number", F.monotonically_increasing_id()), "lexical-items")
    groups = 1 + (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes
    found = spark.createDataFrame([], "number long, doc_id long, score long")
    for g in range(groups):
        some = [(r["number"], counts) for r in own.filter(F.pmod(F.xxhash64("number"), F.lit(groups)) == g).collect() if (counts := term_counts(r["text"]))]
        if some:
            found = found.unionByName(search_group(docs, some, k))
    by = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
    top = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return top.join(own.select("number", "item_id"), "number").select("item_id", "rank", F.nullif("doc_id", F.lit(-(1 << 63)).cast("long")).alias("doc_id"), "score")


def op11_fp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle_sql() -> str:
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH asked AS (SELECT item_id, unnest({terms}) AS term FROM benchmark),
found AS (SELECT doc_id, {terms} AS terms FROM documents),
totals AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM found WHERE len(terms) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM found) GROUP BY ALL),
weights AS (SELECT term, floor({W_SCALE} * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals WHERE term IN (SELECT term FROM asked) GROUP BY term),
parts AS (
  SELECT doc_id, term, w * (({TF_SCALE} * tf) // ({TF_PART} * tf + {M_PART} * ({M_BASE - M_SHARE} + ({M_SHARE} * n * n_docs) // n_terms))) AS part
  FROM tf JOIN weights USING (term), totals
),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {K}
"""
