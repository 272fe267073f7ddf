"""Byte-level BPE as a monoid: encode halves, join neighbours, decode by concatenation.

The encodings of byte strings form a monoid under `join`. A sequence of tokens is the encoding of its bytes exactly if every two
neighbours, taken alone, encode to themselves (each token is the encoding of its own bytes in a vocabulary made by merges). So
when two encodings meet, only a window around the boundary needs encoding again; it grows until both of its outer pairs are
stable in this sense, and then no token outside it can change.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import documents, texts

#: White space that stands beside other white space or at an end: then a text can't be cut before each of its spaces.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Ids that a leaf of the decoding tree holds.
LEAF_IDS = 256
BESIDE = re.compile(rf"[{SPACES}] | [{SPACES}]|\A | \Z")


class TreeBpe:
    """Encodes matches of a split pattern by ranks, as a tree of joins; holds at most `most` pieces and pairs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 700_000):
        import regex

        self.ranks, self.split, self.most = ranks, regex.compile(pattern), most
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        self.parts: dict[bytes, list[int]] = {}  # short strings, most of them halves
        self.windows: dict[bytes, list[int]] = {}
        self.first: dict[str, bytes] = {}  # a text up to its first space -> ids
        self.rest: dict[str, bytes] = {}  # what stands after a space -> ids of the space and it

    def merge(self, raw: bytes) -> list[int]:
        """The encoding of a short string: the pair of lowest rank is merged, leftmost first, until none is left."""
        ranks, none, parts = self.ranks, 1 << 62, [raw[k : k + 1] for k in range(len(raw))]
        pairs = [ranks.get(raw[k : k + 2], none) for k in range(len(raw) - 1)]
        while pairs and (least := min(pairs)) != none:
            k = pairs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], none)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], none)
        return [ranks[p] for p in parts]

    def is_stable(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self.stable:
            if len(self.stable) > self.most:
                self.stable.clear()
            self.stable[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.stable[key]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b or self.is_stable(a[-1], b[0]):
            return a + b
        left, right = 1, 1
        while True:
            raw = b"".join(map(self.bytes_of.__getitem__, a[len(a) - left :] + b[:right]))
            window = self.windows.get(raw)
            if window is None:
                window = self.merge(raw)
                if len(raw) <= 16:
                    if len(self.windows) > self.most:
                        self.windows.clear()
                    self.windows[raw] = window
            grow_left = left < len(a) and not self.is_stable(a[-left - 1], window[0])
            grow_right = right < len(b) and not self.is_stable(window[-1], b[right])
            if not grow_left and not grow_right:
                return a[: len(a) - left] + window + b[right:]
            left, right = left + grow_left, right + grow_right

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one match of the pattern: a leaf is a byte string of the vocabulary, every other string is halved."""
        found = self.ranks.get(raw)
        if found is not None:
            return [found]
        if len(raw) > 16:
            half = len(raw) // 2
            return self.join(self.piece(raw[:half]), self.piece(raw[half:]))
        held = self.parts.get(raw)
        if held is None:
            half = len(raw) // 2
            held = self.join(self.piece(raw[:half]), self.piece(raw[half:]))
            if len(raw) <= 8:
                if len(self.parts) > self.most:
                    self.parts.clear()
                self.parts[raw] = held
        return held

    def text(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(i.to_bytes(4, "little") for m in self.split.findall(text) for i in self.piece(m.encode()))

    def _new(self, part: str, held: dict[str, bytes], lead: str) -> bytes:
        if len(held) > self.most:
            held.clear()
        if part[-1:] in (".", ",") and part[-2:-1].isalpha():
            # a sign after a letter is a match of its own
            ids = (held.get(part[:-1]) or self._new(part[:-1], held, lead)) + self.ranks[part[-1].encode()].to_bytes(4, "little")
        else:
            ids = self.text(lead + part)
        if len(part) < 64:
            held[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """As text(), but what stands between two single spaces is encoded once: every match that holds a space starts with it."""
        if not text or BESIDE.search(text):
            return self.text(text)
        first, *parts = text.split(" ")
        rest = self.rest.get
        found = [rest(p) for p in parts]
        if None in found:
            found = [rest(p) or self._new(p, self.rest, " ") if x is None else x for p, x in zip(parts, found, strict=True)]
        head = self.first.get(first)
        return (self._new(first, self.first, "") if head is None else head) + b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids: leaves of LEAF_IDS ids, neighbours concatenated up the tree."""
        of, held = self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()
        parts = [b"".join(map(of, held[k : k + LEAF_IDS])) for k in range(0, len(held), LEAF_IDS)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""


_held: dict[tuple[str, str], TreeBpe] = {}


def tree_bpe(path: str, pattern: str) -> TreeBpe:
    """One per Python worker, rank file and pattern."""
    if (path, pattern) not in _held:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _held[path, pattern] = TreeBpe(ranks, pattern)
    return _held[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit), decoded binary for every row of (doc_id, text).

    A null text is empty and has no ids. Null and repeated ids, ties and repeated rows stay as they are; other columns go. The path
    of the rank file must exist on every executor.
    """
    return _each(docs, ranks, pattern, "ids binary, decoded binary", lambda ids, raw: (ids, raw))


def _each(docs: DataFrame, ranks: str, pattern: str, what: str, of) -> DataFrame:
    names = [x.split()[0] for x in what.split(", ")]

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tree_bpe(ranks, pattern)
        for f in frames:
            rows = [of(ids := bpe.encode(t), bpe.decode(ids)) for t in f["text"]]
            out = pd.DataFrame(rows, columns=names, index=f.index)
            out.insert(0, "doc_id", f["doc_id"])
            yield out

    return texts(docs).mapInPandas(encode, f"doc_id long, {what}")


def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return _each(
        documents(spark, sf_dir),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, raw: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()),
    )
