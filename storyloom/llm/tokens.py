"""Token ids of whole texts, by the public word-end BPE vocabulary.

A pre-token's ids do not depend on what stands around it, so each distinct one
is encoded once per worker and looked up afterwards. New ones are encoded in one
string, cut at blanks alone; the ids that end a word tell them apart again. Only texts of characters
whose normal form, case and class are plain take this path; every other text is
encoded as a whole. Both give the library's ids.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

#: What the vocabulary puts behind a word's last piece.
WORD_END = "</w>"
# The vocabulary's pre-token pattern over the plain characters, in lower case.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")
_PLAIN = re.compile("[\\t-\\r\\x20-\\x7eÀ-ÿ–—‘-”…€]*")
#: Distinct pre-tokens a worker remembers before it starts anew. One is remembered
#: when it comes a second time, which a table of ``MET`` marks tells.
MEMO, MET = 400_000, 1 << 22


class Tokens:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.codec = Tokenizer.from_file(path)
        self.codec.encode_special_tokens = True  # their strings in a text are ordinary text
        # Plain pre-tokens are in normal form and need no pattern to find them.
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        vocabulary = self.bare.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for piece, k in vocabulary.items() if piece.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.met = bytearray(MET)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        found, sizes = self._encoded(words)
        at, end = len(self.known), self.used + len(found)
        while at + len(words) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used:end] = found
        self.sizes[at:at + len(words)] = sizes
        self.starts[at:at + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.known.update(zip(words, range(at, at + len(words))))
        self.used = end

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        found = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.diff(np.flatnonzero(self.last[found]), prepend=-1)
        if len(sizes) == len(words) and sizes.sum() == len(found):
            return found, sizes
        # Some word has no piece that ends it: one by one.
        each = [got.ids for got in self.codec.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def __call__(self, text: str) -> np.ndarray:
        """uint32 ids of the text."""
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text; what the texts bring anew is encoded together."""
        plain = [_PLAIN.fullmatch(text) is not None for text in texts]
        words = [_PIECE.findall(text.lower()) if ok else [] for text, ok in zip(texts, plain)]
        if len(self.known) > MEMO:
            self._forget()
        fresh = {w: hash(w) % MET for w in set().union(*words).difference(self.known)}
        once = [w for w, at in fresh.items() if not self.met[at]]
        self._learn([w for w, at in fresh.items() if self.met[at]])
        mark = self.used
        self._learn(once)
        result = [
            self._gather(own) if ok else np.array(self.codec.encode(text, add_special_tokens=False).ids, np.uint32)
            for text, ok, own in zip(texts, plain, words)
        ]
        for word in once:
            del self.known[word]
            self.met[fresh[word]] = 1
        self.used = mark
        return result

    def _gather(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint32)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1])]


_OPEN: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One codec per worker process and vocabulary."""
    if path not in _OPEN:
        _OPEN[path] = Tokens(path)
    return _OPEN[path]
