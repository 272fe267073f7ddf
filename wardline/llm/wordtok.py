"""Encoding with a tokenizers file whose pre-tokenizer drops white space, one distinct word at a time.

Such a tokenizer encodes the words of a text independently: no match of its split pattern holds white space, and neither NFC nor
lower-casing by character reaches across it. So a text's ids are the ids of its words in turn, and a word is encoded once per
Python worker and then looked up. Words are lower-cased and parted from commas and full stops beforehand only in texts of proven
characters; a letter that becomes a letter and a mark, or a mark that becomes part of a letter, is left to the library's own steps.
A text in which a special token's string stands goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters that stay letters, and one each, under NFC and lower-casing, and signs that stay signs; all others are unproven.
PROVEN = " -įı-ſΑ-ΡΣ-Ωα-ωА-я‐-‧‰-›€ぁ-ゔァ-ヺ一-龥가-힣"
UNPROVEN = re.compile(f"[^\\x00-\\x7F{PROVEN}]")
#: A full stop or comma before white space that doesn't end a word, but a run of signs; then the signs stay together.
RUN = re.compile(r"[.,](?=[ \n])(?<=[^\w \n\t\r].|_.)", re.DOTALL)
#: Words of letters without a mark of their own and signs other than the apostrophe: each run of letters or of signs is one match.
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
SIGNS = r"!-&(-/:-@\[-`{-~"
PLAIN, PARTS = re.compile(f"[{LETTERS}{SIGNS}]+"), re.compile(f"[{LETTERS}]+|[{SIGNS}]+")
#: Longer words are encoded wherever they stand and never held.
MOST_WORD = 64


class WordIds(dict):
    """word (UTF-8) -> its ids as little-endian 32-bit integers. Words of about `most_bytes` in all are held, with what Python needs for them."""

    def __init__(self, path: str, most_bytes: int = 160 << 20):
        from tokenizers import Tokenizer

        super().__init__()
        self.most_bytes, self.bytes, self.tokenizer = most_bytes, 0, Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        steps = (kind["pre_tokenizer"] or {}).get("pretokenizers", [])
        if not steps or steps[0].get("behavior") != "Removed" or kind.get("post_processor") or "Lowercase" not in json.dumps(kind["normalizer"]):
            raise ValueError(f"{path}: not a lower-casing tokenizer of separate words")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in kind["added_tokens"]) or r"(?!)")
        self.size = self.tokenizer.get_vocab_size()
        # what the pre-tokenizer makes of each letter
        self.letters = {k: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(k))[0][0] for k in range(0xC0, 0x100) if PLAIN.fullmatch(chr(k))}

    def ids(self, word: str) -> bytes:
        t = self.tokenizer
        if PLAIN.fullmatch(word):
            pieces = PARTS.findall(word.lower())
            if not word.isascii():
                pieces = [p.translate(self.letters) for p in pieces]
        else:
            pieces = [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word))]
        tokenize = t.model.tokenize
        return b"".join([x.id.to_bytes(4, "little") for p in pieces for x in tokenize(p)])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.ids(word.decode())
        if len(word) <= MOST_WORD:
            self[word] = ids
            self.bytes += len(word) + len(ids) + 160
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.special.search(text):
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        raw = text.encode()
        if text.isascii() or not UNPROVEN.search(text):
            raw = raw.lower()  # only ASCII letters change
            if not RUN.search(text):
                for sign in (b", ", b". ", b",\n", b".\n"):
                    raw = raw.replace(sign, b" %c " % sign[0])
        if self.bytes > self.most_bytes:
            self.clear()
            self.bytes = 0
        return b"".join(map(self.__getitem__, raw.split()))


_held: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker and file."""
    if path not in _held:
        _held[path] = WordIds(path)
    return _held[path]
