"""Token ids of whole texts with the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from tallywarden.llm.shared import ragged, split_words, strings, text_steps

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class WordEncoder:
    """Encodes texts with a tokenizer whose tokens never span ASCII white space.

    For such a tokenizer (word BPE that drops white space) the ids of a text are the ids of its
    words, one after the other, so a word met again needs no second encoding. When more than
    ``memory`` words are remembered, those met in one step only go (all, if too many are left):
    that changes time, not ids.
    """

    def __init__(self, path: str, memory: int = 600_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        for probe in ("ab  cd\n\tef", " x y "):
            if self._whole(probe) != [i for w in probe.split() for i in self._whole(w)]:
                raise ValueError("this tokenizer's tokens depend on white space")
        parts = [("Ab", ("ab",)), ("aB1.", ("ab1", ".")), ("ÉÑ,", ("éñ", ",")), ("x" + BEHIND, ("x", BEHIND))]
        self.plain = all(self._whole(w) == [i for p in ps for i in self._whole(p)] for w, ps in parts)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.last = self._last_tokens()
        self.memory = memory

        self.place: dict[str, int] = {}
        self.starts, self.lengths, self.seen = np.zeros((3, 0), np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _last_tokens(self) -> np.ndarray | None:
        """Which ids end a word, if the vocabulary marks them and letters alone are one word each."""
        last = np.zeros(self.size, bool)
        last[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if token.endswith("</w>")]] = True
        for word in ("a", "zq", "abcdefghij", "qxzvkjwq", "é", "ßñå", "straße" * 3):
            if np.flatnonzero(last[ids := self._whole(word)]).tolist() != [len(ids) - 1]:
                return None
        return last

    def _each(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, their ids, and the number of ids of each.

        Words of letters go to the tokenizer many at a time, as one text: the ids that end a word part them again.
        """
        joined = [w for w in words if w.isalpha() and (w.isascii() or max(w) < "\u0130")] if self.last is not None else []
        texts = [" ".join(joined[i : i + JOINED]) for i in range(0, len(joined), JOINED)]
        ids = self._batch(texts)[0]
        ends = np.flatnonzero(self.last[ids]) if len(ids) else np.zeros(0, np.int64)
        if len(ends) != len(joined):
            joined, ids, ends = [], ids[:0], ends[:0]
        alone = set(joined)
        others = [w for w in words if w not in alone] if joined else words
        more, lengths = self._batch(others)
        return joined + others, np.concatenate([ids, more]), np.concatenate([np.diff(ends, prepend=-1), lengths])

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _forget(self) -> None:
        kept = np.flatnonzero(self.seen > 1)
        if len(kept) > self.memory // 2:
            kept = kept[:0]
        words = list(self.place)
        self.place = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.ids = self.ids[ragged(self.starts[kept], self.lengths[kept])]
        self.lengths = self.lengths[kept]
        self.starts, self.seen = np.cumsum(self.lengths) - self.lengths, np.ones(len(kept), np.int64)

    def _add(self, words: list[str], starts: np.ndarray, lengths: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int64)])

    def _learn(self, words: list[str]) -> None:
        """Encode new words; a capital or punctuation behind a word needs no encoding of its own."""
        by_mark: dict[str, list[tuple[str, str]]] = {}
        bases = dict.fromkeys(words)
        if self.plain:
            bases = {}
            for word in words:
                if word.isascii() and word.isalpha() and word.islower():
                    bases[word] = None
                    continue
                base, mark = _plain(word)
                bases[base] = None
                if mark or base is not word:
                    by_mark.setdefault(mark, []).append((word, base))
            bases.update(dict.fromkeys(filter(None, by_mark)))
        new, ids, lengths = self._each([b for b in bases if b not in self.place])
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, ids])
        self._add(new, starts, lengths)
        for mark, pairs in by_mark.items():
            pairs = [(w, b) for w, b in pairs if w not in self.place]
            if not pairs:
                continue
            at = np.fromiter((self.place[b] for _, b in pairs), np.int64, len(pairs))
            starts, lengths = self.starts[at], self.lengths[at]
            if mark:
                k = self.place[mark]
                tail = self.ids[self.starts[k] : self.starts[k] + self.lengths[k]]
                ids = np.insert(self.ids[ragged(starts, lengths)], np.repeat(np.cumsum(lengths), len(tail)), np.tile(tail, len(at)))
                lengths = lengths + len(tail)
                starts = len(self.ids) + np.cumsum(lengths) - lengths
                self.ids = np.concatenate([self.ids, ids])
            self._add([w for w, _ in pairs], starts, lengths)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), ``end`` after each text, and the offsets at which the texts begin."""
        collects = gc.isenabled()
        gc.disable()  # hundreds of thousands of words and lists without cycles: looking for some takes a tenth of the time
        try:
            return self._encode(texts, end)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > self.memory:
            self._forget()
        words, offsets = split_words(strings(texts))
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.place.get, distinct))
        new = [i for i, place in enumerate(found) if place is None]
        if new:
            self._learn([distinct[i] for i in new])
            for i in new:
                found[i] = self.place[distinct[i]]
        places = np.array(found, np.int64)
        self.seen[places] += 1
        at = places[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        ids = self.ids[ragged(self.starts[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        ids = np.insert(ids, ends[1:], np.uint32(end))
        return ids, ends + np.arange(len(ends))


#: Words of one text for the tokenizer.
JOINED = 200
#: What may stand behind a word without touching its tokens: no apostrophe, which could begin a contraction.
BEHIND = ".,;:!?$%&*#@+=~^/()[]{}"


def _plain(word: str) -> tuple[str, str]:
    """A word without capitals and without the punctuation behind it, and that punctuation.

    Only below U+0130, where lower-casing goes character by character and no marks combine, and
    without the sign that could begin the name of a special token.
    """
    if "<" in word or not word.isascii() and max(word) >= "\u0130":
        return word, ""
    lower = word.lower()
    base = lower.rstrip(BEHIND)
    if base and base[-1].isalnum():
        return base, lower[len(base) :]
    return lower, ""


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary file; a Python worker keeps it for its next tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(batch: pa.RecordBatch, path: str, column: str, end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of a batch with the ids of their texts."""
    for step in text_steps(batch, column):
        yield step, *encoder(path).encode(step.column(column), end)
