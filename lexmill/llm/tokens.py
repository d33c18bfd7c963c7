"""Whole texts to token ids with the tokenizers library, at the cost of new words only."""

from __future__ import annotations

import gc
import os
import re
from itertools import repeat

import numpy as np

#: Words that a memo keeps; later new words are encoded each time they appear.
MEMO_WORDS = 1_200_000
_UNKNOWN = -2
JOINED = 500  # new pieces that one call encodes
#: Letters that are \p{L} in every Unicode version.
_LETTERS = r"[A-Za-zÀ-ÖØ-öø-ʯ]+"
_WORD = re.compile(rf"({_LETTERS})([.,;:!?|*#$%&()]*)")
#: A space between two characters that are white space in no Unicode version.
_CUT = re.compile("(?<=[^\\s\u180e\u200b\ufeff]) (?=[^\\s\u180e\u200b\ufeff])")
_EDGES = re.compile("[\\s\u180e\u200b\ufeff]")
_BLANKS = frozenset(c for c in map(chr, range(0x10000)) if _EDGES.match(c))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class TextEncoder:
    """``encode(texts)`` gives the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    The byte-level pre-tokenizer never joins characters across a single space
    between two non-blank characters, and the space goes to what follows. So a
    text is cut there, each piece is encoded once by the library and remembered
    with its ids, and a text's ids are gathered by numpy. Pieces at runs of white
    space are not cut. One instance per Python worker; its memory is bounded by
    ``memo_words``.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), memo_words
        self.model, self.bytes = self.tokenizer.model, _byte_letters()
        self.space = self.bytes[32]
        self.letters = Tokenizer(self.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(self.space)]] = True
        self.memo: dict = {}  # a piece after a space is a str, one at the start of a text a 1-tuple
        self.ends: dict[str, list[int]] = {}  # ids of punctuation after letters, and of a line end
        self.flat, self.starts, self.lens = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = self.n = 0
        self.new_ids: list[int] = []
        self.new_lens: list[int] = []

    def _add(self, ids: list[int]) -> int:
        """The index of a new piece, whose ids wait in lists until ``_settle``."""
        self.new_ids += ids
        self.new_lens.append(len(ids))
        return self.n + len(self.new_lens) - 1

    def _settle(self) -> None:
        if self.new_lens:
            ids, lens, self.new_ids, self.new_lens = self.new_ids, self.new_lens, [], []
            self._extend(np.array(ids, np.int32), np.array(lens, np.int64))

    def _extend(self, ids: np.ndarray, lens: np.ndarray) -> None:
        k, n = len(ids), len(lens)
        while self.used + k > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + n > len(self.starts):
            self.starts, self.lens = (np.concatenate([a, np.empty_like(a)]) for a in (self.starts, self.lens))
        self.flat[self.used : self.used + k] = ids
        self.lens[self.n : self.n + n] = lens
        self.starts[self.n : self.n + n] = self.used + np.cumsum(lens) - lens
        self.used, self.n = self.used + k, self.n + n

    def _direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _end(self, text: str) -> list[int]:
        if (ids := self.ends.get(text)) is None:
            ids = self._direct(text)
            if len(self.ends) < 10_000:
                self.ends[text] = ids
        return ids

    def _parts(self, m: re.Match, space: bool) -> list[int]:
        """Letters and the punctuation after them; the letters alone are often known."""
        word, end = m.groups()
        if end and (i := self.memo.get(word if space else (word,))) is not None and i >= 0:
            return self.flat[self.starts[i] : self.starts[i] + self.lens[i]].tolist() + self._end(end)
        letters = word if word.isascii() else word.encode().decode("latin1").translate(self.bytes)
        ids = [t.id for t in self.model.tokenize(self.space + letters if space else letters)]
        return ids + self._end(end) if end else ids

    def _word(self, bare: str, space: bool) -> list[int]:
        """A piece without white space, after a space or not."""
        m = _WORD.fullmatch(bare)
        return self._parts(m, space) if m else self._direct(f" {bare}" if space else bare)

    def _new(self, key) -> int:
        """The index of a new piece; -1 if it touches other white space and can't be cut out."""
        space = key.__class__ is str
        bare = key if space else key[0]
        if m := _WORD.fullmatch(bare):
            return self._add(self._parts(m, space))
        if not bare or _EDGES.match(bare[0]) or _EDGES.match(bare[-1]):
            return -1
        if not _EDGES.search(bare):
            return self._add(self._direct(f" {bare}" if space else bare))
        lines = bare.split("\n")
        if any(not x or _EDGES.search(x) for x in lines):
            return self._add(self._direct(f" {bare}" if space else bare))
        # Single line ends between words stand alone, and what follows has no leading space.
        ids = self._word(lines[0], space)
        for x in lines[1:]:
            ids = [*ids, *self._end("\n"), *self._word(x, False)]
        return self._add(ids)

    def _join(self, extra: dict, keys: list[str], tokenizer, lead: str) -> None:
        if not keys:
            return
        texts = [f" {lead}" + f" {lead}".join(keys[a : a + JOINED]) for a in range(0, len(keys), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        heads = np.flatnonzero(self.opens[ids])
        if len(heads) == len(keys) and heads[0] == 0:
            extra.update(zip(keys, range(self.n, self.n + len(keys)), strict=True))
            self._extend(ids, np.diff(np.append(heads, len(ids))))

    def _fill(self, extra: dict) -> None:
        """Indexes of new pieces. Those after a space are joined by spaces again and encoded by the library in a few calls.

        The token that holds a piece's space opens it, and no other token has one.
        """
        plain = [k for k in extra if k.__class__ is str and k and k[0] not in _BLANKS and k[-1] not in _BLANKS]
        # ASCII letters are one word each in any case, so these need no pattern, only the model.
        self._join(extra, [k for k in plain if k.isascii() and k.isalpha()], self.letters, self.space)
        self._join(extra, [k for k in plain if not (k.isascii() and k.isalpha())], self.tokenizer, "")
        for key, at in extra.items():
            if at is None:
                extra[key] = self._new(key)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has; null is the empty text."""
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the memo is large
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = [], []
        for t in texts:
            if t:
                p = t.split(" ")
                p[0] = (p[0],)
                keys += p
                counts.append(len(p))
            else:
                counts.append(0)
        memo, kept_n, kept_used = self.memo, self.n, self.used
        index = np.fromiter(map(memo.get, keys, repeat(_UNKNOWN)), np.int64, len(keys))
        room = len(memo) < self.limit
        missing = np.flatnonzero(index == _UNKNOWN).tolist()
        extra = dict.fromkeys([keys[i] for i in missing])
        self._fill(extra)
        index[missing] = [extra[keys[i]] for i in missing]
        self._settle()
        if len(index) and index.min() < 0:
            index, counts = self._uncut(texts, index, counts)
        lens = self.lens[index]
        total = int(lens.sum())
        ends = np.cumsum(lens)
        ids = self.flat[np.repeat(self.starts[index] - (ends - lens), lens) + np.arange(total)]
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        upto = np.concatenate([[0], ends])
        if room:
            memo.update(extra)
        else:
            self.n, self.used = kept_n, kept_used
        return ids, upto[edges[1:]] - upto[edges[:-1]]

    def _uncut(self, texts, index, counts):
        """The same with the pieces of texts that hold other white space at a cut found by a pattern."""
        out, sizes, at = [], [], 0
        for t, n in zip(texts, counts, strict=True):
            own = index[at : at + n]
            at += n
            if n and own.min() < 0:
                pieces = _CUT.split(t)
                own = np.array([self._add(self._direct(pieces[0])), *(self._add(self._direct(f" {p}")) for p in pieces[1:])], np.int64)
            out.append(own)
            sizes.append(len(own))
        self._settle()
        return np.concatenate(out) if out else index, sizes


_ENCODERS: dict[tuple[str, int], TextEncoder] = {}


def encoder(path: str, memo_words: int = MEMO_WORDS) -> TextEncoder:
    """This worker process's encoder; Spark reuses Python workers, so the memo outlives a task."""
    key = path, memo_words
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(path, memo_words)
    return _ENCODERS[key]
