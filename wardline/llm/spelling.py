"""Spelling variants: words one edit apart, found with bidirectional FM-index search schemes.

Two words are one edit apart only if one half of the query stands unchanged at its own end of the other word. So each half is
matched exactly from its inner end outwards up to the delimiter, and the match is then extended across the other half, allowing one
error, up to the delimiter at that end. What is matched is an interval of suffix ranks in the text and one in the reversed text, kept
in step by a wavelet matrix over each text's Burrows-Wheeler transform.

The vocabulary is dealt into blocks by what a search must find unchanged: a word stands in the blocks of those of its beginnings and
endings that can be a half of a word one edit away, and is looked for in the blocks of its own two halves. Blocks are hash ranges of
such halves whose number follows the vocabulary, so that an index stays small; all of a block's words are searched at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hot_join, pieces, texts, written

LEAST_LETTERS, LEAST_COUNT, RATIO, DROP = 6, 5, 5, 199
#: Code points of words in a block, about, before copies for halves of other lengths.
BLOCK_CHARS = 1 << 18
#: Distinct words held by a task before it passes their counts on.
MOST_HELD = 200_000
DELIMITER = 0
#: Latin-1 bytes: A-Z in lower case, a-z and 0xC0 to 0xFF as they are, all else a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


# ---- vocabulary ----


def run_counts(text: str) -> Counter:
    """Maximal runs [A-Za-z\\u00C0-\\u00FF]+, A-Z in lower case, as Latin-1."""
    found: Counter = Counter()
    for part in pieces(text.encode("latin-1", "replace").translate(LETTERS)):
        found.update(part.split())
    return found


def dropped(word: bytes, start: int, drop: int) -> bytes:
    """Without one letter if `drop` divides the CRC-32 of "<doc_id>:<word>"; start is the CRC-32 of "<doc_id>:"."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % drop:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, drop: int = DROP) -> DataFrame:
    """word, n: occurrences of words of so many letters in all texts. A null id counts as an empty string."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})

        for f in frames:
            for doc_id, text in zip(f["id"], f["text"], strict=True):
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in run_counts(text).items():
                    if len(word) >= least_letters and len(word := dropped(word, start, drop)) >= least_letters:
                        held[word] += n
                if len(held) >= MOST_HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    named = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return named.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- index ----


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling: ranks by the first 1, 2, 4, ... symbols until all differ."""
    n, width = len(text), 1
    rank = text.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (n + int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        width *= 2
        if rank[order[-1]] == n - 1 or width >= n:
            return order


class Wavelet:
    """Ranks in a sequence of symbols, by a wavelet matrix: for each bit, the zeros before each place."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.zeros, s = [], symbols
        for b in range(self.bits - 1, -1, -1):
            zero = (s >> b & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int32))
            s = np.concatenate([s[zero], s[~zero]])
        # where each symbol stands in the last order, and how many smaller ones there are
        self.first = np.zeros(1 << self.bits, np.int64)
        start, _, _ = self._down(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int64))
        self.first[:] = start
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.bits))])[:-1]

    def _down(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        less = np.zeros(len(low), np.int64)
        for b, z in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            one = (symbol >> b & 1).astype(bool)
            zl, zh = z[low].astype(np.int64), z[high].astype(np.int64)
            less += np.where(one, zh - zl, 0)
            low, high = np.where(one, z[-1] + low - zl, zl), np.where(one, z[-1] + high - zh, zh)
        return low, high, less

    def step(self, symbol: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of suffixes that `symbol` precedes (start and size), and how many symbols of the old interval are smaller."""
        a, b, less = self._down(symbol, low, low + size)
        return self.smaller[symbol] + a - self.first[symbol], b - a, less

    def branches(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each interval's distinct symbols: the interval's number and the symbol."""
        of, symbol, high = np.arange(len(low)), np.zeros(len(low), np.int64), low + size
        for z in self.zeros:
            zl, zh = z[low].astype(np.int64), z[high].astype(np.int64)
            low, high = np.concatenate([zl, z[-1] + low - zl]), np.concatenate([zh, z[-1] + high - zh])
            of, symbol = np.concatenate([of, of]), np.concatenate([2 * symbol, 2 * symbol + 1])
            some = high > low
            of, symbol, low, high = of[some], symbol[some], low[some], high[some]
        return of, symbol


class Bidirectional:
    """FM-indexes of a text of delimited words and of its reverse. An interval is (low in the text, low in the reverse, size)."""

    def __init__(self, words: list[str]):
        """words: distinct, sorted, without NUL; the ranks of suffixes that begin with a delimiter are then the words' numbers."""
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), "<u4")
        self.alphabet, text = np.unique(points, return_inverse=True)
        self.n, k = len(text), len(self.alphabet)
        # one delimiter more than words: the last one's suffix ranks before all others
        self.left, self.right = (Wavelet(t[suffix_ranks(t) - 1], k) for t in (text, text[::-1]))

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """-1: not in the text."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, -1)

    def whole(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.n, np.int64)

    def extend(self, leftward: bool, symbol: np.ndarray, low: np.ndarray, back: np.ndarray, size: np.ndarray):
        """One symbol more on one side; symbols that the text lacks leave an interval of size 0."""
        known = symbol >= 0
        symbol = np.where(known, symbol, 0)
        if leftward:
            low, new, less = self.left.step(symbol, low, size)
            back = back + less
        else:
            back, new, less = self.right.step(symbol, back, size)
            low = low + less
        return low, back, np.where(known, new, 0)


def search(index: Bidirectional, words: list[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
    """query, word (numbers): words of the index one edit from the query whose same half is unchanged. A pair may come twice.

    The first half is matched leftwards to the delimiter and the second rightwards; the other half follows in the other direction.
    """
    length = np.array([len(w) for w in words])
    points = np.zeros((len(words), int(length.max()) + 1), np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    points[np.arange(points.shape[1]) < length[:, None]] = index.symbols(flat)
    half, query = length // 2, np.arange(len(words))
    low, back, size = index.whole(len(words))
    exact = half if first_half else length - half
    for k in range(int(exact.max()) + 1):
        # the symbols from the inner end outwards, then the delimiter
        at = half[query] - 1 - k if first_half else half[query] + k
        symbol = np.where(k < exact[query], points[query, np.clip(at, 0, points.shape[1] - 1)], DELIMITER)
        moving = k <= exact[query]
        a, b, s = index.extend(first_half, symbol, low, back, size)
        low, back, size = np.where(moving, a, low), np.where(moving, b, back), np.where(moving, s, size)
        query, low, back, size = (x[size > 0] for x in (query, low, back, size))
    rest = length - exact
    done, errors = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(query):
        # what the query has next; past its end, the delimiter
        at = np.where(first_half, half[query] + done, half[query] - 1 - done)
        ended = done >= rest[query]
        own = np.where(ended, DELIMITER, points[query, np.clip(at, 0, points.shape[1] - 1)])
        clean = np.flatnonzero(errors == 0)
        wavelet, lows = (index.right, back) if first_half else (index.left, low)
        of, symbol = wavelet.branches(lows[clean], size[clean])
        of = clean[of]
        other = (symbol != DELIMITER) & (symbol != own[of])
        # an inserted symbol (also one equal to the query's next: then the rest must match behind it), a replaced one, a deleted one
        inserted = symbol != DELIMITER
        replaced = other & ~ended[of]
        skipped = clean[~ended[clean]]
        parent = np.concatenate([np.arange(len(query)), of[inserted], of[replaced]])
        by = np.concatenate([own, symbol[inserted], symbol[replaced]])
        a, b, s = index.extend(not first_half, by, low[parent], back[parent], size[parent])
        step = np.concatenate([np.ones(len(query), np.int64), np.zeros(int(inserted.sum()), np.int64), np.ones(int(replaced.sum()), np.int64)])
        wrong = errors[parent] + np.concatenate([np.zeros(len(query), np.int64), np.ones(len(parent) - len(query), np.int64)])
        over = np.concatenate([ended, np.zeros(len(parent) - len(query), bool)])
        hit = over & (s > 0) & (wrong == 1) & (a > 0)  # at rank 0 the text begins again
        found.append((query[parent[hit]], a[hit] - 1))
        go = ~over & (s > 0)
        query, low, back, size, done, errors = (
            np.concatenate([x, y])
            for x, y in (
                (query[parent[go]], query[skipped]), (a[go], low[skipped]), (b[go], back[skipped]), (s[go], size[skipped]), (done[parent[go]] + step[go], done[skipped] + 1), (wrong[go], np.ones(len(skipped), np.int64)),
            )
        )
    return tuple(map(np.concatenate, zip(*found, strict=True)))


# ---- pairs ----


def _halves(word: str, length: int) -> list[str]:
    """The two halves of a query of `length` that `word` may share, each with its side; of the word itself if that is its length."""
    half = length // 2
    return [f"<{word[:half]}", f">{word[len(word) - (length - half) :]}"]


def _places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each half under which a word stands in an index (asks: false) or is looked for (true)."""
    for f in frames:
        rows = []
        for word, n in zip(f["word"], f["n"], strict=True):
            k = len(word)
            rows += [(h, False, word, n) for h in dict.fromkeys(h for m in (k - 1, k, k + 1) for h in _halves(word, m))]
            rows += [(h, True, word, n) for h in _halves(word, k)]
        yield pd.DataFrame(rows, columns=["half", "asks", "word", "n"])


def _search_block(frame: pd.DataFrame) -> pd.DataFrame:
    out = []
    first = frame["half"].str[0] == "<"
    for side in (True, False):
        own = frame[first == side]
        held = own[~own["asks"]].drop_duplicates("word").sort_values("word")
        words, n, asked = held["word"].tolist(), held["n"].to_numpy(), own[own["asks"]]["word"].drop_duplicates().to_numpy()
        if words and len(asked):
            query, near = search(Bidirectional(words), asked.tolist(), side)
            out.append(pd.DataFrame({"word": asked[query], "near": held["word"].to_numpy()[near], "near_n": n[near]}))
    return pd.concat(out).drop_duplicates(["word", "near"]) if out else pd.DataFrame(columns=["word", "near", "near_n"], dtype=object)


def near_pairs(words: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """word, near, near_n: every two distinct words one inserted, deleted or replaced code point apart, both ways.

    words: word (distinct, without NUL) and n. A half that more words share than a block should hold is dealt over several blocks,
    and looked for in each of them; there is one such half for each block at most.
    """
    places = written(words.mapInPandas(_places, "half string, asks boolean, word string, n long"), "spelling-places")
    held = places.filter("NOT asks")
    chars = held.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    blocks = 1 + chars // block_chars
    parts = held.groupBy("half").agg(F.ceil(F.sum(F.length("word") + 1) / block_chars).cast("int").alias("parts")).filter("parts > 1")
    dealt = places.join(F.broadcast(parts), "half", "left")
    own = F.array(F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("word"), "parts")).cast("int"))
    every = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("asks"), every).otherwise(own)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("half", "part"), F.lit(int(blocks))))
    pairs = dealt.select("block", "half", "asks", "word", "n").groupBy("block").applyInPandas(_search_block, "word string, near string, near_n long")
    return pairs.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


# ---- forms ----


def spelling_forms(words: DataFrame, ratio: int = RATIO, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """word, n, n_near, form, form_n, root for a table of distinct words and their n.

    form: of the words one edit away the most frequent (ties: the smallest), if it is at least `ratio` times as frequent, else null.
    root: the last form from form to form, the word itself if it has none. Chains double their length in each round.
    """
    words = written(words.select("word", "n"), "spelling-words")
    best = near_pairs(words, block_chars).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    out = words.join(best, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    form = F.when(-F.col("best.least") >= ratio * F.col("n"), F.col("best.near"))
    out = written(out.select("word", "n", "n_near", form.alias("form"), F.when(form.isNotNull(), -F.col("best.least")).alias("form_n")), "spelling-forms")
    chain = out.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        after = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(hot_join(chain, after, ["root"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "spelling-roots")
        chain = longer.select("word", "root")
        if longer.filter("more").isEmpty():
            break
    return out.join(chain, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, drop: int = DROP) -> DataFrame:
    """spelling_forms of the words that the whole texts have at least `least_count` times. Null and empty texts have no words."""
    return spelling_forms(word_counts(docs, least_letters, drop).filter(F.col("n") >= least_count), ratio)


def op12_fm_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def oracle_sql() -> str:
    """Words one edit apart share what is left when one letter is taken out or masked."""
    crc_bits = "list_reduce(range(9), lambda c, k: if(k = 0, c, if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)), i)"
    return f"""
WITH RECURSIVE steps AS (SELECT list({crc_bits} ORDER BY i) AS step FROM range(256) t(i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]{{{LEAST_LETTERS},}}')) AS run FROM documents
),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT *, list_concat([4294967295], flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: if(unicode(c) < 128, [unicode(c)::BIGINT], [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)])))) AS b FROM counted
),
hashed AS (SELECT run, n, length(run) AS k, xor(list_reduce(b, lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, steps),
changed AS (SELECT if(h % {DROP} = 0, left(run, (h % k)::BIGINT) || substr(run, (h % k)::BIGINT + 2), run) AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, left(word, i - 1) AS a, substr(word, i + 1) AS z FROM words, range(1, length(word) + 1) r(i)),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.a || x.z = y.word
  UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.a || x.z = y.word
),
best AS (SELECT word, count(*) AS n_near, (list({{'near': near, 'near_n': near_n}} ORDER BY near_n DESC, near))[1] AS b FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, if(b.near_n >= {RATIO} * w.n, b.near, NULL) AS form, if(b.near_n >= {RATIO} * w.n, b.near_n, NULL) AS form_n
  FROM words w LEFT JOIN best USING (word)
),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.root AND e.form IS NULL
"""
