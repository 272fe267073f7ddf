"""Toxicity by a support vector machine on a subsequence string kernel, approximated by Nyström landmarks.

The kernel compares two words by the triples of characters that stand in both in this order, with gaps: an occurrence that spans
s characters counts DECAY^s, up to SPAN characters. So a word with inserted or doubled characters stays near the word it hides.
Words carry marks for their start and end, single letters in a row are read as one word, and signs within a word are passed over.

Training takes a bounded sample of labelled texts. Labels hold for texts, while insults are single words: words that stand far more
often in toxic texts than in clean ones start as witnesses, and after each fit every toxic text is witnessed by its highest word.
Landmarks are the strongest witnesses and a few usual words. As the kernel is a sum over triples, the fitted machine folds into one
weight for each triple, and scoring adds up table entries over a whole text: nothing is cut off, whatever its length. A text's score
is a probability by logistic regression, fitted to the sample, on the decisions for its TOP highest words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, texts

SPAN, DECAY = 6, 0.6
#: Places of the second and third character after the first.
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: Character codes: 0 separates words, 1 to 26 are letters, 27 starts and 28 ends a word, the rest are shared by all other letters.
START, END, OTHERS, CODES = 27, 28, 29, 48
#: The bounded sample: at most so many texts of each label, of at most so many characters each.
MOST_TEXTS, MOST_CHARS = 1500, 10_000
#: Landmarks: the strongest witnesses, the words that are most usual in clean texts, and the hardest clean words of each fit, at most.
LANDMARKS, USUAL, HARD = 160, 32, 128
#: A witness stands in at least this share of the toxic texts, and in three.
LEAST_SHARE = 0.012
PART_CHARS = 1 << 20
TOP = 3
#: Of the sample's distinct words: other clean words that are instances (every so manieth of them), and clean words that count as
#: hard after each fit.
OTHER_WORDS, HARD_WORDS = 12_000, 2000


def char_codes() -> np.ndarray:
    """uint8[65536]: a code for each letter or digit of the basic plane, 0 for everything else."""
    codes = np.zeros(1 << 16, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        if c.isalnum():
            codes[k] = k - 96 if "a" <= c <= "z" else OTHERS + k % (CODES - OTHERS)
    return codes


CHAR_CODES = char_codes()
WHITE = np.zeros(1 << 16, bool)
WHITE[[k for k in range(1 << 16) if chr(k).isspace()]] = True


def words_of(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes: all words of the texts one after another, each as START, its characters, END and SPAN - 1 zeros; the places where words
    start in it; the text of each word."""
    # letters of other shapes, such as full-width or mathematical ones, are the plain letters
    values = [t if t.isascii() else unicodedata.normalize("NFKC", t) for t in values]
    points = np.frombuffer("\n".join(t.lower() for t in values).encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(points, 0xFFFF).astype(np.int64)
    code = CHAR_CODES[small]
    code[points > 0xFFFF] = 0
    letter = code > 0
    # a single sign between two letters is passed over
    inner = np.zeros(len(code), bool)
    inner[1:-1] = letter[:-2] & letter[2:] & ~letter[1:-1] & ~WHITE[small[1:-1]]
    # so is one white space between two letters that stand alone
    gap = np.ones(len(code) + 4, bool)
    gap[2:-2] = ~letter
    one = letter & gap[1:-3] & gap[3:-1]
    line = np.zeros(len(code), bool)
    ends = np.cumsum([len(t.lower()) + 1 for t in values[:-1]]) - 1 if len(values) > 1 else np.zeros(0, np.int64)
    line[ends] = True
    inner[1:-1] |= one[:-2] & one[2:] & ~letter[1:-1] & WHITE[small[1:-1]]
    inner &= ~line
    of_text = np.zeros(len(code), np.int64)
    of_text[ends + 1] = 1
    keep = ~inner
    code, of_text = code[keep], np.cumsum(of_text)[keep]
    letter = code > 0
    before = np.concatenate([[False], letter[:-1]])
    start = np.flatnonzero(letter & ~before)
    end = np.flatnonzero(~letter & before)
    if len(end) < len(start):
        end = np.append(end, len(code))
    size = end - start
    place = np.concatenate([[0], np.cumsum(size + 1 + SPAN)])  # START, END and zeros
    out = np.zeros(place[-1], np.uint8)
    first = place[:-1]
    out[np.repeat(first + 1 - start, size) + np.flatnonzero(letter)] = code[letter]
    out[first], out[first + 1 + size] = START, END
    return out, first, of_text[start]


def triple_sums(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each place, the sum of table[triple] DECAY^span over the triples that start there. table is 0 wherever a code is 0."""
    wide = codes.astype(np.int32)
    out = np.zeros(len(codes), np.float32)
    for a, b in OFFSETS:
        n = len(codes) - b
        if n > 0:
            out[:n] += table[(wide[:n] * CODES + wide[a : a + n]) * CODES + wide[b : b + n]] * np.float32(DECAY ** (b + 1))
    return out


def norms(sizes: np.ndarray) -> np.ndarray:
    """The length of a word's feature vector were all its triples different: it depends on the number of characters alone."""
    most = int(sizes.max(initial=3)) + 1
    table = np.array([np.sqrt(sum(max(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in OFFSETS)) for n in range(most)])
    return np.maximum(table, table[3])[sizes]


def word_values(codes: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word, the inner product of its normed feature vector with a table over triples."""
    if not len(first):
        return np.zeros(0, np.float32)
    sizes = np.diff(np.append(first, len(codes))) - (SPAN - 1)
    return np.add.reduceat(triple_sums(codes, table), first) / norms(sizes).astype(np.float32)


def feature_table(word: str) -> np.ndarray:
    """A word's normed feature vector over triples."""
    codes, first, _ = words_of([word])
    out, wide = np.zeros(CODES**3, np.float32), codes.astype(np.int64)
    for a, b in OFFSETS:
        n = len(codes) - b
        x, y, z = wide[:n], wide[a : a + n], wide[b : b + n]
        full = (x > 0) & (y > 0) & (z > 0)
        np.add.at(out, ((x * CODES + y) * CODES + z)[full], np.float32(DECAY ** (b + 1)))
    return out / np.float32(norms(np.array([len(codes) - (SPAN - 1)]))[0])


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """float[words, landmarks]; every word must be one word."""
    codes, first, _ = words_of(words)
    return np.stack([word_values(codes, first, feature_table(z)) for z in landmarks], axis=1)


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5, rounds: int = 60) -> np.ndarray:
    """L2-loss support vector machine: primal Newton steps, halved until the loss falls; y in {-1, 1}; the last weight is the intercept."""
    x, weight = np.hstack([x, np.ones((len(x), 1))]), weight / weight.sum()
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-9

    def loss(v: np.ndarray) -> float:
        return float((penalty * v * v).sum() + (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        on = y * (x @ w) < 1
        xs, c = x[on], weight[on]
        step = np.linalg.solve((xs * c[:, None]).T @ xs + np.diag(penalty), xs.T @ (c * y[on])) - w
        size = 1.0
        while size > 1e-4 and (new := loss(w + size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - new < 1e-10:
            break
        w, now = w + size * step, new
    return w


def highest(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """float[n, TOP]: the highest values of each text, falling, within -2 and 2; -2 where it has fewer. of rises."""
    out, values = np.full((n, TOP), -2.0), values.astype(np.float64)
    for k in range(TOP):
        best = np.full(n, -np.inf)
        np.maximum.at(best, of, values)
        out[:, k] = np.clip(best, -2, 2)
        at = np.flatnonzero((values == best[of]) & np.isfinite(values))
        values[at[np.append(True, of[at][1:] != of[at][:-1])[: len(at)]]] = -np.inf
    return out


@dataclass
class Model:
    """table: a weight for each triple; a word's decision is its value plus bias; weights (the last is the shift) make a probability."""

    table: np.ndarray
    bias: float
    weights: np.ndarray
    empty: float
    landmarks: list[str]

    def score(self, values: list[str]) -> np.ndarray:
        """A probability for each text; a text without words has that of the share of toxic ones."""
        out = np.full(len(values), self.empty)
        a = size = 0
        for k, t in enumerate(values):
            size += len(t)
            if size >= PART_CHARS or k + 1 == len(values):
                codes, first, of = words_of(values[a : k + 1])
                if len(first):
                    top = highest(word_values(codes, first, self.table) + self.bias, of, k + 1 - a)
                    found = np.unique(of)
                    out[a + found] = 1 / (1 + np.exp(-np.clip(top[found] @ self.weights[:-1] + self.weights[-1], -60, 60)))
                a, size = k + 1, 0
        return out


def train(values: list[str], toxic: np.ndarray, share: float) -> Model:
    """Fit to labelled texts. share: of toxic ones among all labelled rows, to which probabilities are calibrated.

    Without both labels, the score is the share for every text.
    """
    toxic = np.asarray(toxic, bool)
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    if not n_toxic or not n_clean:
        return Model(np.zeros(CODES**3, np.float32), 0.0, np.append(np.zeros(TOP), np.log((share + 1e-6) / (1 - share + 1e-6))), share, [])
    ids: dict[bytes, int] = {}
    kinds, owners = [], []
    for at in range(0, len(values), 100):  # a part at a time, as the driver is small
        codes, first, of = words_of(values[at : at + 100])
        raw = codes.tobytes()
        kinds.append(np.array([ids.setdefault(raw[a:b], len(ids)) for a, b in zip(first, np.append(first[1:], len(codes)), strict=True)], np.int64))
        owners.append(of + at)
    kind, of = np.concatenate(kinds), np.concatenate(owners)
    # clean texts in which each word stands; toxic ones, or words after which it stands there if these are fewer: an insult is
    # found in ever new places, while the words of one text and its copies always follow the same ones
    seen = np.unique(np.stack([kind, of]), axis=1)
    in_clean = np.bincount(seen[0][~toxic[seen[1]]], minlength=len(ids))
    after = np.where(np.append(True, of[1:] != of[:-1]), len(ids), np.append(0, kind[:-1]))
    places = np.unique(np.stack([kind, after])[:, toxic[of]], axis=1)
    in_toxic = np.minimum(np.bincount(seen[0][toxic[seen[1]]], minlength=len(ids)), np.bincount(places[0], minlength=len(ids)))
    rate = (in_toxic + 0.5) / (n_toxic + 1) / ((in_clean + 0.5) / (n_clean + 1))
    least = max(3, LEAST_SHARE * n_toxic)
    strength = np.where(in_toxic >= least, in_toxic * np.log(rate), 0)
    witness = (in_toxic >= least) & (rate >= 6)
    if not witness.any():
        witness = rate >= np.quantile(rate, 0.999)
    words = list(ids)
    # the words one after another again, each once
    all_first = np.cumsum([0] + [len(w) for w in words[:-1]])
    strong = np.argsort(-strength, kind="stable")[:LANDMARKS]
    strong = strong[witness[strong]]
    usual = np.argsort(-in_clean, kind="stable")[:USUAL]
    chosen = list(dict.fromkeys([*strong.tolist(), *usual.tolist()]))

    def table_of(k: int) -> np.ndarray:
        own = np.frombuffer(words[k], np.uint8).astype(np.int64)
        out = np.zeros(CODES**3, np.float32)
        for a, b in OFFSETS:
            n = len(own) - b
            x, y, z = own[:n], own[a : a + n], own[b : b + n]
            full = (x > 0) & (y > 0) & (z > 0)
            np.add.at(out, ((x * CODES + y) * CODES + z)[full], np.float32(DECAY ** (b + 1)))
        return out / np.float32(norms(np.array([len(own) - (SPAN - 1)]))[0])

    # instances: witnesses, all words that are usual in clean texts, and a spread of the others
    spread = np.arange(len(words)) % max(1, len(words) // OTHER_WORDS) == 0
    use = witness | ((in_clean > 0) & (rate < 2) & spread)
    use[usual] = True
    clean_kinds = np.flatnonzero((in_clean > 0) & ~witness)
    bias, table = 0.0, None
    for turn in range(3):
        rows = np.flatnonzero(use)
        own = np.concatenate([np.frombuffer(words[k], np.uint8) for k in rows])
        own_first = np.cumsum([0] + [len(words[k]) for k in rows[:-1]])
        k_nm = np.stack([word_values(own, own_first, table_of(k)) for k in chosen], axis=1).astype(np.float64)
        k_mm = np.stack([word_values(np.frombuffer(b"".join(words[k] for k in chosen), np.uint8), np.cumsum([0] + [len(words[k]) for k in chosen[:-1]]), table_of(k)) for k in chosen], axis=1).astype(np.float64)
        value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        y = np.where(witness[rows], 1.0, -1.0)
        weight = np.where(y > 0, np.sqrt(1.0 + in_toxic[rows]), np.sqrt(1.0 + in_clean[rows]))
        weight *= np.where(y > 0, 1 / weight[y > 0].sum(), 1 / max(1e-9, weight[y < 0].sum()))
        w = fit_svm(k_nm @ root, y, weight * len(y))
        alpha = root @ w[:-1]
        table, bias = np.zeros(CODES**3, np.float64), float(w[-1])
        for a, k in zip(alpha, chosen, strict=True):
            table += a * table_of(k)
        table = table.astype(np.float32)
        decided = np.concatenate([word_values(np.frombuffer(b"".join(words[a : a + 20_000]), np.uint8), all_first[a : a + 20_000] - all_first[a], table) for a in range(0, len(words), 20_000)]) + bias
        if turn == 2:
            break
        # each toxic text is witnessed by its highest word, unless that word is as usual in clean texts; the highest words of clean texts are counted against
        by_text = decided[kind]
        order = np.lexsort((by_text, of))
        last = np.flatnonzero(np.append(of[order][1:] != of[order][:-1], True))
        top = np.zeros(len(words), bool)
        top[[kind[order[k]] for k in last if toxic[of[order[k]]]]] = True
        witness = (witness & (decided > -0.5)) | (top & (in_toxic >= least / 2) & (rate >= 6) & (decided > 0))
        hard = clean_kinds[np.argsort(-decided[clean_kinds], kind="stable")[:HARD_WORDS]]
        use[hard] = True
        fresh = [k for k in hard[:HARD].tolist() if k not in chosen]
        chosen += fresh
        use[witness] = True
    found = np.unique(of)
    prior = np.where(toxic, share / n_toxic, (1 - share) / n_clean)[found]
    weights = fit_logistic(highest(decided[kind], of, len(values))[found], toxic[found], prior)
    names = ["".join("^" if c == START else "$" if c == END else chr(96 + c) if c <= 26 else "?" for c in words[k] if c) for k in chosen]
    return Model(table, bias, weights, share, names)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weighted logistic regression by Newton steps, without negative weights; the last number is the shift."""
    a, weight = np.hstack([x, np.ones((len(x), 1))]), weight / weight.sum()
    w = np.zeros(a.shape[1])
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (weight * (p - y)) + ridge * w)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    low = np.flatnonzero(w[:-1] < 0)
    if len(low):  # without the feature of the lowest weight, and once more
        rest = np.setdiff1d(np.arange(x.shape[1]), low[np.argmin(w[low])])
        out = np.zeros(len(w))
        out[np.append(rest, len(w) - 1)] = fit_logistic(x[:, rest], y, weight, ridge)
        return out
    return w


def learn(docs: DataFrame, labels: DataFrame, most_texts: int = MOST_TEXTS, most_chars: int = MOST_CHARS) -> Model:
    """Fit to labelled rows whose crc32(doc_id as text) mod 5 isn't 0: of each label up to `most_texts`, by the order of their ids' hash.

    Only texts of at most `most_chars` characters are in the sample. Rows without an id, text or label are left out.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).dropDuplicates(["doc_id"])
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ids alone are ordered; only the sample's texts leave the executors
    sized = marks.join(own.select("doc_id", F.char_length("text").alias("n")), "doc_id").filter(F.col("n") <= most_chars)
    picked = None
    for label in (1, 0):
        part = sized.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_texts).select("doc_id", "toxic")
        picked = part if picked is None else picked.unionAll(part)
    sample = own.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    return train(sample["text"].tolist(), sample["toxic"].to_numpy() == 1, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of (doc_id, text).

    Null and empty texts, and those without letters or digits, have the share of toxic labels as score. Equal texts have equal
    scores. Null and repeated ids and repeated rows stay. A row without an id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of CODES^3 numbers

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = shared.value.score(f["text"].tolist())
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return texts(docs).mapInPandas(rate, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(["" if t is None else t for t in b.column("text").to_pylist()])
            yield b.filter(pa.array(s < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op6_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
