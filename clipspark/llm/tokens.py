"""Token ids of whole texts for a word-level BPE vocabulary of the tokenizers library.

Encoding a text piece by piece between spaces gives the same ids as encoding it whole,
because the vocabulary's pre-tokenizer never lets a token cross white space, nor a letter
and the punctuation behind it. So a task looks up the distinct pieces of about a megabyte
of text at a time in a table of known pieces, sends only new ones to the library, many
in one call, and gathers the ids of all pieces at once.

The table is held within ``TABLE_BYTES`` a Python worker; a fuller one is begun anew. Pieces
are found by two independent 64-bit numbers of their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import Words, spans, words

TABLE_BYTES = 32_000_000
_ROW_BYTES = 32
_CALL = 4_000
_tail, _letter = np.zeros(256, bool), np.zeros(256, bool)
_tail[list(b".,;:!?%$*&|#)(")] = True
_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def pieces(part: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first piece of each row): punctuation that ends a piece after an ASCII
    letter is a piece of its own."""
    n = len(part.buffer)
    if not len(part.begin):
        return part.begin, part.end, part.first
    solid = np.maximum.accumulate(np.where(_tail[part.buffer], -1, np.arange(n)))
    cut = solid[part.end - 1] + 1
    split = np.flatnonzero((cut > part.begin) & (cut < part.end) & _letter[part.buffer[cut - 1]])
    begin, end = np.insert(part.begin, split + 1, cut[split]), part.end.copy()
    end[split] = cut[split]
    return begin, np.insert(end, split + 1, part.end[split]), part.first + np.searchsorted(split, part.first)


class Encoder:
    """Encodes texts to 32-bit ids, with a bounded table of known pieces."""

    def __init__(self, vocabulary: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self._clear()

    def _clear(self) -> None:
        self.number, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # in order of number
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def ends_sentence(self) -> np.ndarray:
        """For each id, whether it closes a sentence."""
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[i for t, i in vocab.items() if t.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True
        return out

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, ids one after another)."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for i in range(0, len(new), _CALL):
            some = new[i : i + _CALL]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0, *[len(p) + 1 for p in some]])
            place = np.array([a for a, _ in found.offsets], np.int64)
            sizes.append(np.bincount(np.searchsorted(starts, place, "right") - 1, minlength=len(some)))
            ids.append(np.array(found.ids, np.uint32))
        return np.concatenate(sizes), np.concatenate(ids)

    def _find(self, number: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Row of each piece in the table, or -1."""
        if not len(self.number):
            return np.full(len(number), -1)
        at = np.minimum(np.searchsorted(self.number, number), len(self.number) - 1)
        return np.where((self.number[at] == number) & (self.check[at] == check), at, -1)

    def _learn(self, part: Words, begin: np.ndarray, end: np.ndarray, number: np.ndarray, check: np.ndarray) -> None:
        """Add new pieces, in order of number, to the table."""
        raw = part.buffer.tobytes()
        size, ids = self._encoded([raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())])
        at = len(self.ids) + np.cumsum(size) - size
        to = np.searchsorted(self.number, number)
        self.number, self.check = np.insert(self.number, to, number), np.insert(self.check, to, check)
        self.at, self.size = np.insert(self.at, to, at), np.insert(self.size, to, size)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, first id of each text and the end) of consecutive texts, about a megabyte at
        a time; null is empty."""
        for part in words(texts, "pieces"):
            begin, end, first = pieces(part)
            number, some, inverse = np.unique(spans(part.buffer, begin, end), return_index=True, return_inverse=True)
            begin, end = begin[some], end[some]
            check = spans(part.buffer, begin, end, seed=1)
            if len(self.number) * _ROW_BYTES + self.ids.nbytes > TABLE_BYTES:
                self._clear()
            new = np.flatnonzero(self._find(number, check) < 0)
            if len(new):
                self._learn(part, begin[new], end[new], number[new], check[new])
            row = self._find(number, check)
            size = self.size[row][inverse]
            stop = np.cumsum(size)
            source = np.repeat(self.at[row][inverse] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
            yield self.ids[source], np.concatenate([[0], stop])[first]


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder per Python worker, so its table serves the worker's later tasks."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]
