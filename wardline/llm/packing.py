"""Sequence packing by patterns: fit repeat counts of few-document length patterns to the histogram of lengths, then pack the rest.

Lengths are at most `capacity`, so their histogram has at most that many entries and everything that the driver works on is
bounded. Lengths fall in bins; a pattern is a multiset of up to `depth` bins that fills a sequence. Non-negative least squares
finds how often each pattern stands so that the bins' counts are met; a share of each count is taken and rounded down, and what
that leaves over is packed best-fit, longest first, into the gaps of the patterns' sequences and into new ones. The share is the one
of SHARES that needs the fewest sequences: rounding nearly all counts leaves best-fit too little to fill the gaps with where lengths
are few. The outcome is a plan: for each length, runs of documents (by their number among those of this length) with the sequence of the first, one sequence on for each
next document, and the place within it.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, tasks, texts, written
from .wordtok import word_ids

CAPACITY = 4096
END_ID = 1
BINS = 128
DEPTH = 3
#: Shares of the fitted counts that are tried, the largest first; 0 is plain best fit.
SHARES = (1.0, 0.95, 0.85, 0.7, 0.5, 0.3, 0.0)


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of 1 to `depth` bins that together fill `bins` exactly; a bin b stands for lengths of up to b shares of the capacity."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if head and left == 0:
            found.append(head)
        if left and len(head) < depth:
            low, slots = 1, depth - len(head)
            top = min(left, head[-1] if head else left)
            for b in range(top, low - 1, -1):
                if b * slots < left:
                    break
                extend((*head, b), left - b)

    extend((), bins)
    return found


def fit_counts(bin_counts: np.ndarray, options: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts x that bring A x near the counts of bins 1, 2, ... (A: how often a pattern holds a bin).

    Projected gradient with momentum on weighted least squares. A bin is weighted by its share of the capacity: long documents are
    hard to place later, short ones fill gaps.
    """
    n = len(bin_counts)
    scale = max(1.0, float(bin_counts.max(initial=0)))
    place = np.array([b - 1 for p in options for b in p])
    owner = np.array([k for k, p in enumerate(options) for _ in p])
    weight = np.sqrt(np.arange(1, n + 1) / n)
    target, x = bin_counts / scale, np.zeros(len(options))

    def residual(v: np.ndarray) -> np.ndarray:
        return np.bincount(place, weights=v[owner], minlength=n) - target

    def gradient(r: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=(weight**2 * r)[place], minlength=len(options))

    probe = np.ones(len(options))
    for _ in range(30):  # the largest eigenvalue gives the step
        probe = gradient(np.bincount(place, weights=probe[owner], minlength=n))
        size = np.linalg.norm(probe)
        probe /= size
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - gradient(residual(y)) / size)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x * scale


class Plan:
    """Runs of sequences: (first sequence, number of sequences, lengths in each). Numbers only grow with the lengths' variety."""

    def __init__(self, histogram: dict[int, int], capacity: int, counts: dict[tuple[int, ...], int], bins: int):
        self.capacity, self.left = capacity, {n: c for n, c in histogram.items() if c}
        self.given: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first document, documents, sequence, offset
        self.next = 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, number)
        self.free: list[int] = []
        full = self.left.get(capacity, 0)
        if full:
            self._give(capacity, full, self._new(full), 0)
        if self.left:
            self._patterns(counts, bins)
        self._best_fit()

    def _new(self, n: int) -> int:
        self.next += n
        return self.next - n

    def _give(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.given[length], n, sequence, offset))
        self.given[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _gap(self, free: int, sequence: int, n: int) -> None:
        if free:
            if not self.gaps[free]:
                bisect.insort(self.free, free)
            self.gaps[free].append((sequence, n))

    def _patterns(self, counts: dict[tuple[int, ...], int], bins: int) -> None:
        of = bins_of(self.left, self.capacity, bins)
        stock: dict[int, list[int]] = defaultdict(list)  # bin -> its lengths, the longest last
        for n in sorted(self.left):
            stock[of[n]].append(n)
        for option, todo in sorted(counts.items(), key=lambda x: -x[1]):
            need = {b: option.count(b) for b in option}
            while todo:
                # a run: as many sequences as the longest lengths in stock of each bin allow
                if any(not stock[b] for b in need):
                    break
                n = min(todo, *(self.left[stock[b][-1]] // m for b, m in need.items()))
                if n == 0:  # fewer of a length are left than the pattern holds of its bin: one sequence of mixed lengths
                    if any(sum(self.left[x] for x in stock[b]) < m for b, m in need.items()):
                        break
                    n = 1
                sequence, at = self._new(n), 0
                for b in option:
                    length = stock[b][-1]
                    self._give(length, n, sequence, at)
                    at += length
                    if length not in self.left:
                        stock[b].pop()
                self._gap(self.capacity - at, sequence, n)
                todo -= n

    def _best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while length in self.left:
                todo = self.left[length]
                k = bisect.bisect_left(self.free, length)
                if k == len(self.free):
                    # new sequences hold the length as often as it fits
                    per = self.capacity // length
                    n, rest = divmod(todo, per)
                    if n:
                        sequence = self._new(n)
                        for j in range(per):
                            self._give(length, n, sequence, j * length)
                        self._gap(self.capacity - per * length, sequence, n)
                    if rest:
                        sequence = self._new(1)
                        for j in range(rest):
                            self._give(length, 1, sequence, j * length)
                        self._gap(self.capacity - rest * length, sequence, 1)
                    continue
                free = self.free[k]
                sequence, n = self.gaps[free].pop()
                if not self.gaps[free]:
                    self.free.pop(k)
                if n > todo:
                    self._gap(free, sequence + todo, n - todo)
                    n = todo
                self._give(length, n, sequence, self.capacity - free)
                self._gap(free - length, sequence, n)


def bins_of(lengths, capacity: int, bins: int) -> dict[int, int]:
    return {n: -(-n * bins // capacity) for n in lengths}


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS, depth: int = DEPTH) -> tuple[pd.DataFrame, int]:
    """The runs (length, first, n, sequence, offset) of the plan that needs the fewest sequences among SHARES, and their number.

    Of plans as good, that with the largest share. A plan that fills all its sequences but the last is taken at once.
    """
    bins, best = min(bins, capacity), None
    options, counts, of = patterns(bins, depth), np.zeros(bins), bins_of(histogram, capacity, bins)
    for n, c in histogram.items():
        if n < capacity:
            counts[of[n] - 1] += c
    fitted = fit_counts(counts, options) if counts.any() else np.zeros(len(options))
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    for share in SHARES:
        repeat = np.floor(fitted * share).astype(np.int64)
        plan = Plan(histogram, capacity, {options[k]: int(repeat[k]) for k in np.flatnonzero(repeat)}, bins)
        if best is None or plan.next < best.next:
            best = plan
        if best.next <= least:
            break
    return pd.DataFrame(best.runs, columns=["length", "first", "n", "sequence", "offset"]), best.next


def pack(pieces: DataFrame, capacity: int = CAPACITY, bins: int = BINS, depth: int = DEPTH) -> DataFrame:
    """Add sequence_id and offset to pieces (rows with a length from 1 to capacity), in as few sequences as the plan finds.

    Pieces must be stored, not computed anew: equal lengths are numbered within salts of the row's own values. Repeated rows are
    rows of their own. No pieces give no sequences. Sequences are gapless from 0.
    """
    spark = pieces.sparkSession
    keys = [c for c in pieces.columns if c != "length"]
    salts = max(32, tasks(spark))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan_sequences(histogram, capacity, bins, depth)
    runs = runs.sort_values(["length", "first"])
    length, first, sequence, offset = (runs[c].to_numpy(np.int64) for c in ("length", "first", "sequence", "offset"))
    begins = {int(n): int(k) for n, k in zip(*np.unique(length, return_index=True), strict=True)} if len(runs) else {}
    ends = {n: int(np.searchsorted(length, n, side="right")) for n in begins}
    held = spark.sparkContext.broadcast((first, sequence, offset, begins, ends))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, sequence, offset, begins, ends = held.value
        for f in frames:
            n, number = f["length"].to_numpy(np.int64), f["_number"].to_numpy(np.int64)
            run = np.empty(len(f), np.int64)
            for x in np.unique(n):
                own = n == x
                run[own] = begins[int(x)] + np.searchsorted(first[begins[int(x)] : ends[int(x)]], number[own], side="right") - 1
            yield f.drop(columns=["_number"]).assign(sequence_id=sequence[run] + number - first[run], offset=offset[run])

    base = parts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_base"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*[F.col(c).asc_nulls_first() for c in keys])) - 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    numbered = salted.withColumn("_local", number).join(base, ["length", "_salt"]).select(*pieces.columns, (F.col("_base") + F.col("_local")).cast("long").alias("_number"))
    return numbered.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text: its ids and end_id, cut after every `capacity` ids.

    A null or empty text is the end id alone. Null and repeated ids stay as they are.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end, step = word_ids(tokenizer), end_id.to_bytes(4, "little"), 4 * capacity
        for f in frames:
            rows = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                ids = words.encode(text) + end
                rows += [(None if pd.isna(doc) else int(doc), k, k * capacity, len(x) // 4, zlib.crc32(x)) for k in range(-(-len(ids) // step)) if (x := ids[k * step : (k + 1) * step])]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return texts(docs).mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
