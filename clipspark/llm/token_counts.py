"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token (a word with the piece mark before it) is cut into vocabulary pieces so that
the sum of the pieces' scores is greatest; of equal sums the one with fewer pieces counts.
The forward recurrence at a prefix needs only the prefix, so it is computed once for every
trie node: the distinct new pre-tokens of a batch are taken in sorted order, which walks
the trie depth first, and the stack of forward values is cut back to the shared prefix.
The count at a word's last node is kept for later batches of the worker.

A character that no piece covers counts as its UTF-8 bytes. Nothing is shuffled; a task
holds one batch, the vocabulary, and at most ``KEPT`` counts.

Defined results: null and empty texts have no pre-tokens and no tokens; repeated rows get
equal counts; an empty table gives no rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import map_text
from .words import words

KEPT = 1_500_000
MARK = "▁"


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities by rank, for vocabularies whose order is all that is known."""
    total = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    scores: dict[str, float] = {}
    for r, piece in enumerate(pieces):
        scores.setdefault(piece, -math.log(r + 2) - total)
    return scores


def read_pieces(path: str) -> list[str]:
    """The normal pieces of a sentencepiece file, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Forward:
    """Counts of distinct words, sharing the work of shared prefixes."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0

    def counts(self, sorted_words: list[str]) -> list[int]:
        out, last = [], ""
        best: list[tuple[float, int]] = [(0.0, 0)]  # (score, minus pieces) of each prefix
        get, longest, unknown = self.scores.get, self.longest, self.unknown
        for word in sorted_words:
            word = MARK + word
            shared, top = 0, min(len(word), len(last))
            while shared < top and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode())
                score, pieces = best[end - 1]
                found = (score + unknown * size, pieces - size)
                for start in range(max(0, end - longest), end):
                    value = get(word[start:end])
                    if value is not None:
                        score, pieces = best[start]
                        if (score + value, pieces - 1) > found:
                            found = (score + value, pieces - 1)
                best.append(found)
            out.append(-best[-1][1])
            last = word
        return out


def token_counts(docs: DataFrame, scores: dict[str, float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_pretokens and n_tokens; ``keep`` names the other columns to keep."""
    held = docs.sparkSession.sparkContext.broadcast(scores)

    def work():
        forward, known = Forward(held.value), {}

        def make(texts: pa.Array) -> dict[str, pa.Array]:
            pretokens, tokens = [], []
            for part in words(texts, "spaced"):
                number, first, inverse = np.unique(part.number, return_index=True, return_inverse=True)
                raw, keys = part.buffer.tobytes(), number.tolist()
                if len(known) + len(keys) > KEPT:
                    known.clear()
                new = sorted((raw[part.begin[i] : part.end[i]].decode(), k) for i, k in zip(first.tolist(), keys) if k not in known)
                known.update(zip([k for _, k in new], forward.counts([w for w, _ in new])))
                count = np.array([known[k] for k in keys], np.int64)
                total = np.concatenate([[0], np.cumsum(count[inverse])]) if len(keys) else np.zeros(1, np.int64)
                pretokens.append(part.counts)
                tokens.append(total[part.first[1:]] - total[part.first[:-1]])
            none = np.zeros(0, np.int64)
            return {"n_pretokens": pa.array(np.concatenate([none, *pretokens]), pa.int64()), "n_tokens": pa.array(np.concatenate([none, *tokens]), pa.int64())}

        return make

    return map_text(docs, "n_pretokens bigint, n_tokens bigint", work, text=text, keep=keep)
