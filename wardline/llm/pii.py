"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card and phone numbers wherever they stand. The field works on a text's candidate
tokens (runs without white space that hold a digit or an at sign, with the parts that belong to one number): each has a label, none
or one of the four kinds. Neighbouring candidates share a chain potential, and candidates whose letters and digits are the same, or
nearly, share a skip potential, however far apart they stand. Loopy sum-product messages run until they settle, and spread what is
certain at one place to the others, so that a number whose repetition has lost its plus sign, its dots or a digit, or has letters
in place of digits, gets the label of the place where it is whole.

The field is trained by pseudo-likelihood on a bounded sample of texts whose tokens the patterns label. For a part of these, a
broken repetition of one of many shapes is added with the same label, and for another part a broken number that stands whole
nowhere, with the label none: a shape alone isn't enough. Spans that the patterns found always stay; the field only adds spans that
overlap none of them.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: The bounded sample: at most so many texts with candidates, of at most so many characters.
MOST_TEXTS, MOST_CHARS = 2000, 20_000
#: Messages keep this share of the last round's at first, and ever more of it after so many rounds; they have settled when none moves
#: by more than SETTLED. A token is labelled when it is surer than SURE.
DAMPING, ROUNDS, SETTLED, SURE = 0.3, 30, 1e-3, 0.9
#: Log odds of a label that a pattern gave: more than any number of messages outweighs.
CERTAIN = 1e6

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
#: The same matches as without the look-behind: a match can only start where a run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HINT = re.compile(r"[0-9@]")
#: A candidate: a phone-like or card-like run with its inner spaces, or else a run without white space that holds a digit or @.
CANDIDATE = re.compile(r"\+?\(?[0-9][0-9().-]*(?:[ ][(]?[0-9][0-9().-]*)+|\S+")
EDGE = "\"'`*#$%&|,;:!?.()[]{}<>="


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, leftmost first and without overlaps in a kind; a failing match isn't tried again."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if HINT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            d = digits_of(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of the candidate tokens, without signs at their edges."""
    out = []
    if HINT.search(text):
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            if not HINT.search(text, a, b):
                continue
            while a < b and text[a] in EDGE and text[a] != "(":
                a += 1
            while a < b and text[b - 1] in EDGE:
                b -= 1
            if a < b:
                out.append((a, b))
    return out


#: Letters that stand for digits.
LIKE_DIGITS = str.maketrans("oliszb", "011528")
SEPARATED = re.compile(r"[0-9]+(?:[ ._/,:()-]+[0-9]+)*[)]?")
#: Shapes of numbers: groups of digits between separators.
PHONE_GROUPS = {(1, 3, 3, 4), (3, 3, 4), (2, 3, 3, 4), (1, 3, 7), (3, 7), (10,), (11,)}
FEATURES = 15 + 7


def key(token: str) -> str:
    """Equal for tokens that show the same personal datum: letters and digits in lower case; in numbers, letters like digits are these."""
    own = "".join(c for c in token.lower() if c.isalnum())
    return own.translate(LIKE_DIGITS) if 2 * len(digits_of(own)) > len(own) and "@" not in token else own


def features(token: str) -> np.ndarray:
    """What a token shows by itself. Fixed length."""
    number = key(token)
    d, letters, dots = digits_of(number), sum(c.isalpha() for c in number), token.count(".")
    n, groups = len(d), tuple(map(len, re.findall("[0-9]+", token)))
    plain = not letters and SEPARATED.fullmatch(token.lstrip("+(")) is not None
    parts = re.findall("[0-9]+", token)
    x = np.zeros(FEATURES)
    x[0] = 1
    x[1] = "@" in token and dots > 0
    x[2] = "@" in token
    x[3] = token.startswith("+")
    x[4] = dots == 3 and len(parts) == 4 and plain and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    x[5] = 14 <= n <= 19 and not letters and luhn(d)
    x[6] = 14 <= n <= 19 and not letters
    x[7] = 10 <= n <= 15 and not letters
    x[8] = letters > 0
    x[9] = dots == 3 and not letters
    x[10] = "(" in token and ")" in token
    x[11] = letters > 0 and n > 0 and "@" not in token
    x[12] = plain and len(parts) == 4 and dots != 3 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    x[13] = plain and groups in PHONE_GROUPS
    x[14] = plain and 14 <= n <= 19 and len(set(groups[:-1])) <= 1
    x[15 + min(n, 20) // 3] = 1
    return x


def skip_edges(tokens: list[str], known: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges between tokens of the same key, of keys that differ in leading signs or in the last one, or of the same name before an at sign.

    Where patterns label a token of the key (known), the first such is the hub of all others, so that what is certain reaches every
    repetition at once; else each token is linked to the next. A token is in at most four groups, so that edges grow with the tokens.
    """
    groups: dict[tuple[str, str], list[int]] = {}
    for k, t in enumerate(tokens):
        own = key(t)
        name = key(t.partition("@")[0]) if "@" in t else ""
        for group, least in ((("all", own), 6), (("end", own[-9:]), 6), (("start", own[:-1]), 6), (("at", name), 3)):
            if len(group[1]) >= least:
                groups.setdefault(group, []).append(k)
    out = set()
    for members in groups.values():
        hub = next((k for k in members if known and known[k]), None)
        if hub is None:
            out.update(zip(members[:-1], members[1:], strict=True))
        else:
            out.update((min(hub, k), max(hub, k)) for k in members if k != hub)
    return sorted(out)


@dataclass
class Field:
    unary: np.ndarray  # [labels, features]
    chain: np.ndarray  # [labels, labels], symmetric
    skip: np.ndarray

    def marginals(self, x: np.ndarray, chain: np.ndarray, skip: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """float[n, labels] by loopy sum-product in log space; messages of all edges move at once. chain, skip: int[edges, 2].

        Rounds go on until no message moves by more than SETTLED. Each round after the first ROUNDS moves them less, so that they
        settle on every graph. known: labels that patterns gave, 0 for none; these are certain, however many repetitions look like none.
        """
        local = x @ self.unary.T
        if known is not None:
            local[known > 0] = CERTAIN * np.eye(len(LABELS))[known[known > 0]]
        edges = np.concatenate([chain, skip]).reshape(-1, 2)
        if not len(edges):
            return _softmax(local)
        table = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), len(LABELS)))
        for k in itertools.count():
            belief = local.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            new = _logsumexp(out[:, :, None] + table)
            new -= _logsumexp(new[:, :, None])
            move = (1 - DAMPING) / (1 + max(0, k - ROUNDS)) * (new - message)
            message = message + move
            if np.abs(move).max() <= SETTLED:
                break
        np.add.at(local, target, message)
        return _softmax(local)


def _logsumexp(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


def _softmax(a: np.ndarray) -> np.ndarray:
    a = np.exp(a - a.max(axis=1, keepdims=True))
    return a / a.sum(axis=1, keepdims=True)


def chain_edges(n: int) -> np.ndarray:
    return np.stack([np.arange(n - 1), np.arange(1, n)], axis=1) if n > 1 else np.zeros((0, 2), np.int64)


def weaken(token: str, shape: int) -> str:
    """The token broken in one of SHAPES ways: a training case for what only its repetition tells. A digit or at sign stays."""
    groups = re.findall("[0-9]+", token)
    if len(groups) == 1 and len(groups[0]) >= 12:  # a card number in fours
        groups = re.findall("[0-9]{1,4}", groups[0])
    if "@" in token:
        name, _, domain = token.partition("@")
        return [f"{name}@{domain.split('.')[0]}", f"{name}@{domain.replace('.', ',')}", f"{name}@", f"{name.upper()}@{domain.replace('.', '_')}"][shape % 4]
    if shape < 5:
        return [" ", "-", "/", ",", ""][shape].join(groups)
    if shape == 5:  # the last digit is another
        return " ".join(groups)[:-1] + str((int(groups[-1][-1]) + 1) % 10)
    return re.sub(r"[+()]", "", token).replace("0" if shape == 6 else "1", "O" if shape == 6 else "l")


SHAPES = 8


def pattern_labels(spans: list[tuple[int, int, int]], places: list[tuple[int, int]]) -> list[int]:
    """For each candidate the label of the first pattern's span that covers most of it, 0 without one."""
    starts, out = [a for a, _, _ in spans], []
    ends = list(itertools.accumulate((b for _, _, b in spans), max))
    for a, b in places:
        label, k = 0, bisect.bisect_left(starts, b) - 1
        while k >= 0 and ends[k] > a:  # spans that could reach into this place, from the last on
            s, kind, e = spans[k]
            if min(b, e) - max(a, s) >= 0.8 * (b - a):
                label = kind + 1
            k -= 1
        out.append(label)
    return out


def broken_copies(text: str, seed: int) -> tuple[list[str], list[int], list[int]]:
    """A text's candidate tokens, their labels and what patterns say of each, with broken ones after them."""
    spans, places = base_spans(text), candidates(text)
    tokens, labels = [text[a:b] for a, b in places], pattern_labels(spans, places)
    known = labels.copy()
    for k, (t, y) in enumerate(list(zip(tokens, labels, strict=True))):
        if y:
            shape, turn = (seed + 3 * k) % SHAPES, (seed + k) % 3
            if turn == 0:  # the same one again, broken
                tokens.append(weaken(t, shape))
            elif turn == 1:  # another one of its shape, broken, that is nowhere whole
                tokens.append(weaken("".join(str((int(c) + 1 + (j + seed) % 9) % 10) if c in "0123456789" else c for j, c in enumerate(t)) if y > 1 else "z" + t[::-1], shape))
            if turn < 2:
                labels.append(y if turn == 0 else 0)
                known.append(0)
    return tokens, labels, known


def train(values: list[str], rounds: int = 300) -> Field:
    """Fit by pseudo-likelihood to the labels of the patterns and of the broken copies."""
    xs, ys, chains, skips, base = [], [], [], [], 0
    for seed, text in enumerate(values):
        tokens, labels, known = broken_copies(text, seed)
        if tokens:
            xs.append(np.stack([features(t) for t in tokens]))
            ys.append(np.array(labels))
            chains.append(chain_edges(len(tokens)) + base)
            skips.append(np.array(skip_edges(tokens, known), np.int64).reshape(-1, 2) + base)
            base += len(tokens)
    n = len(LABELS)
    field = Field(np.zeros((n, FEATURES)), np.zeros((n, n)), np.zeros((n, n)))
    if not xs:
        field.unary[0, 0] = 5.0
        return field
    x, y, chain, skip = np.concatenate(xs), np.concatenate(ys), np.concatenate(chains), np.concatenate(skips)
    hot = np.eye(n)[y]
    near_chain, near_skip = np.zeros((len(y), n)), np.zeros((len(y), n))
    for near, edges in ((near_chain, chain), (near_skip, skip)):
        np.add.at(near, edges[:, 0], hot[edges[:, 1]])
        np.add.at(near, edges[:, 1], hot[edges[:, 0]])
    # the pairs' potentials are symmetric: both ends use the same table
    wide, weight = np.hstack([x, near_chain, near_skip]), np.where(y == 0, 1.0, 2.0) / len(y)
    w, speed, square = np.zeros((n, wide.shape[1])), np.zeros((n, wide.shape[1])), np.zeros((n, wide.shape[1]))
    for k in range(1, rounds + 1):
        g = ((_softmax(wide @ w.T) - hot) * weight[:, None]).T @ wide + 1e-4 * w
        for at in (FEATURES, FEATURES + n):
            own = g[:, at : at + n]
            g[:, at : at + n] = (own + own.T) / 2
        speed, square = 0.9 * speed + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= 0.1 * (speed / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Field(w[:, :FEATURES], w[:, FEATURES : FEATURES + n], w[:, FEATURES + n :])


def find(values: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text the spans of the patterns, and all spans: these and those that the field adds. Each text by itself."""
    out = []
    for text in values:
        spans = base_spans(text)
        places = candidates(text)
        known = pattern_labels(spans, places)
        if all(known):  # nothing is left to be decided
            out.append((spans, spans))
            continue
        tokens = [text[a:b] for a, b in places]
        p = field.marginals(np.stack([features(t) for t in tokens]), chain_edges(len(tokens)), np.array(skip_edges(tokens, known), np.int64).reshape(-1, 2), np.array(known))
        best, sure = p.argmax(axis=1), p.max(axis=1)
        starts, ends = [a for a, _, _ in spans], list(itertools.accumulate((b for _, _, b in spans), max))
        new = []
        for k in np.flatnonzero((best > 0) & (sure >= SURE)).tolist():
            (a, b), last = places[k], bisect.bisect_left(starts, places[k][1]) - 1
            if last < 0 or ends[last] <= a:
                new.append((a, int(best[k]) - 1, b))
        out.append((spans, sorted(spans + new) if new else spans))
    return out


def learn(docs: DataFrame, most_texts: int = MOST_TEXTS, most_chars: int = MOST_CHARS) -> Field:
    """Fit to the first `most_texts` texts by the hash of their words that hold a digit or @ and at most `most_chars` characters."""
    own = texts(docs)
    held = own.filter(F.col("text").rlike("[0-9@]") & (F.char_length("text") <= most_chars)).withColumn("_h", F.xxhash64("text"))
    picked = held.select("_h").distinct().orderBy("_h").limit(most_texts)
    sample = held.join(F.broadcast(picked), "_h").dropDuplicates(["_h"]).select("_h", "text").toPandas().sort_values("_h")
    return train(sample["text"].tolist())


def detect(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the patterns' spans), spans (all) for every row of (doc_id, text).

    Places count code points, ends are exclusive. A null text is empty and has no spans. Null and repeated ids and repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for base, spans in find(f["text"].tolist(), shared.value):
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], index=f.index)
            out.insert(0, "doc_id", f["doc_id"])
            yield out

    return texts(docs).mapInPandas(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans are one, of the first one's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """docs with the found spans masked in text and n_chars, if there, counted anew. Null texts stay null."""
    shared, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(at).to_pylist()
            found = find(["" if t is None else t for t in values], shared.value)
            texts_ = pa.array([None if t is None else masked(t, s) for t, (_, s) in zip(values, found, strict=True)], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts_)

    out = docs.mapInArrow(scan, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def op7_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return detect(docs, learn(docs))
