"""Token ids of texts with the ``tokenizers`` library.

Where a tokenizer cuts at white space before anything else and drops it, the ids of a text are
those of its words in turn. Words repeat; each is encoded once while it stays in the worker's
cache. Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from struct import pack

import numpy as np

from tidemark.llm.common import Memo

CACHED_WORDS = 250_000
END_ID = 1
#: Words that go into one call of the tokenizer.
LOT = 256
#: Punctuation at the end of a word, up to so many bytes, is looked up apart from the word.
PUNCTUATION = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
TAIL = 3
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Texts whose ids are those of their words only if white space cuts and leaves nothing.
PROBES = ("the cat", "the  cat,\n\tsat ", " 12 cats. Sat", "a\rb\x0b\x0cc", "\n\n", "it 's \u65e5")
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A word in other case can be another word only if it spells a special token.
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        self.special_id = next(iter(added), None)
        # Without special tokens every word is encoded by itself.
        self.odd = re.compile(b"|".join(map(re.escape, self.special))).search
        if any(len(s.split()) != 1 for s in self.special):
            raise ValueError("special tokens with white space are not supported")
        self.apart = all(
            self._ids(t) == [i for w in t.split() for i in self._ids(w)] for t in PROBES
        )
        self.folds = self._ids("A") == self._ids("a")
        self.tails: dict[bytes, bytes | None] = {}
        # Ids that end a word, for tokenizers that mark word ends.
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.final = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        # Whether the model sees a word of a to z as it is.
        steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bare = (steps[0] is None or steps[0].normalize_str(LETTERS) == LETTERS) and (
            steps[1] is not None and steps[1].pre_tokenize_str(LETTERS) == [(LETTERS, (0, 26))]
        )
        self.words = Memo(CACHED_WORDS)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _tail(self, tail: bytes) -> bytes | None:
        """Ids of punctuation after a letter, if it is cut off there before merging."""
        if tail not in self.tails:
            cutter, text = self.tokenizer.pre_tokenizer, tail.decode()
            cut = cutter and [x[0] for x in cutter.pre_tokenize_str("ab" + text)] == ["ab", text]
            self.tails[tail] = np.array(self._ids(text), "<u4").tobytes() if cut else None
        return self.tails[tail]

    def _store(self, lot: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        spans = map(slice, (4 * starts).tolist(), (4 * ends).tolist())
        self.words.update(zip(lot, map(ids.tobytes().__getitem__, spans), strict=True))

    def _calls(self, words: list[bytes], mark: bytes) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """Lots of words with their ids; each lot is one text, ``mark`` between its words."""
        lots = [words[i : i + LOT] for i in range(0, len(words), LOT)]
        for first in range(0, len(lots), 64):
            part = lots[first : first + 64]
            encoded = self.tokenizer.encode_batch_fast(
                [mark.join(lot).decode() for lot in part], add_special_tokens=False
            )
            for lot, e in zip(part, encoded, strict=True):
                yield lot, np.array(e.ids, "<u4")

    def _encode_new(self, words: list[bytes]) -> None:
        """Words of a to z go straight to the model. Others are encoded in few calls: letters with
        blanks between them, told apart by the ids that end a word, and the rest with a special
        token between them."""
        letters, others = [], []
        tokenize, known = self.tokenizer.model.tokenize, self.words
        for w in words:
            if self.bare and w.isalpha() and w.islower():
                ids = [t.id for t in tokenize(w.decode())]
                known[w] = pack(f"<{len(ids)}I", *ids)
            else:
                (letters if w.decode().isalpha() else others).append(w)
        for lot, ids in self._calls(letters, b" "):
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(lot):
                self._store(lot, ids, np.append(0, ends[:-1]), ends)
            else:  # some word is several to the tokenizer, or none ends visibly
                others += lot
        for lot, ids in self._calls(others, self.special[0] if self.special else b""):
            cuts = np.flatnonzero(ids == self.special_id)
            self._store(lot, ids, np.append(0, cuts + 1), np.append(cuts, len(ids)))

    def _learn(self, words: set[bytes]) -> None:
        self.words.retire()
        new = self.words.absent(words)
        together = b" ".join(new)
        if any(s in together for s in self.special) or not self.special:
            odd = {w for w in new if self.odd(w)}
            new = [w for w in new if w not in odd]
            for w in odd:
                self.words[w] = np.array(self._ids(w.decode()), "<u4").tobytes()
        whole, tailed, stems = set(), [], []
        for w in new:
            stem = w.rstrip(PUNCTUATION)
            short = len(w) - TAIL <= len(stem) < len(w) and stem[-1:].isalpha()
            if short and self._tail(w[len(stem) :]):
                tailed.append(w)
                stems.append(stem)
            else:
                whole.add(w)
        whole.update(self.words.absent(set(stems)))
        self._encode_new(list(whole))
        for w, stem in zip(tailed, stems, strict=True):
            self.words[w] = self.words[stem] + self.tails[w[len(stem) :]]

    def encode(self, texts: list[bytes | None], end: bytes = b"") -> list[bytes]:
        """Ids of each text, followed by ``end``; a null text has no ids of its own."""
        if not self.apart:
            whole = (self._ids((text or b"").decode()) for text in texts)
            return [np.array(ids, "<u4").tobytes() + end for ids in whole]
        split = []
        for text in texts:
            text = text or b""
            if self.folds and not any(s[:2] in text for s in self.special):
                text = text.lower()
            split.append(text.split())
        self._learn(set().union(*split))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) + end for words in split]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


END = np.array([END_ID], "<u4").tobytes()
