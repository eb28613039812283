"""Token counts of texts under a unigram vocabulary, by dynamic programming shared in a trie.

A pre-token is a word with a leading mark; its best segmentation is a Viterbi pass over its characters. The
distinct pre-tokens of a chunk go into a trie, and a node's forward score depends on the path above it only,
so every shared prefix is computed once. A terminal node's token count is the pre-token's. The trie lives
through the chunks of a partition and starts anew when it has ``NODES`` nodes, which changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import BLANKS, Words, chunks, mask_of

INSIDE = ~mask_of(BLANKS)
MARK = "▁"
NODES = 400_000


@lru_cache(maxsize=2)
def unigrams(path: str) -> dict[str, float]:
    """Log-probabilities of the pieces of a sentencepiece file. The file ranks its pieces; the k-th gets a probability in
    proportion to 1 / (k + 1) (Zipf's law). Control, unknown and single-byte pieces have none."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    total = log(sum(1 / (k + 1) for k in range(len(plain))))
    return {model.id_to_piece(k): -log(place + 1) - total for place, k in enumerate(plain)}


class Trie:
    """Prefixes of pre-tokens with their forward score and the tokens of their best segmentation.

    A character that no piece covers costs as much as its UTF-8 bytes as tokens of the least score less 10.
    Of equal scores the segmentation with fewer tokens counts."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.floor = min(scores.values(), default=0.0) - 10
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.forward, self.tokens = [0.0], [0]

    def count(self, pre_token: str) -> int:
        node, path = 0, [0]
        child, forward, tokens, scores, longest = self.child, self.forward, self.tokens, self.scores, self.longest
        for end, letter in enumerate(pre_token, 1):
            known = child.get((node, letter))
            if known is None:
                width = len(letter.encode())
                best, fewest = forward[node] + self.floor * width, tokens[node] + width
                for begin in range(max(0, end - longest), end):
                    score = scores.get(pre_token[begin:end])
                    if score is not None:
                        above = path[begin]
                        total, used = forward[above] + score, tokens[above] + 1
                        if total > best or (total == best and used < fewest):
                            best, fewest = total, used
                known = len(forward)
                child[node, letter] = known
                forward.append(best)
                tokens.append(fewest)
            node = known
            path.append(node)
        return tokens[node]


COUNTS = "doc_id long, n_words long, n_tokens long, longest_word_tokens long"


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, longest_word_tokens (most tokens of one word), one row per input row.
    Null, empty and blank texts have 0 of each; repeated rows give repeated results; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(unigrams(path))
        for rows, data, at in chunks(batches, text):
            words = Words(data, at, INSIDE[data])
            counts = np.empty(len(words.distinct), np.int64)
            for k, word in enumerate(words.distinct.to_pylist()):
                counts[k] = trie.count(MARK + word.decode())
                if len(trie.forward) > NODES:
                    trie.clear()
            own = counts[words.codes] if len(words.codes) else words.codes
            running = np.concatenate([[0], np.cumsum(own)])
            most = np.zeros(rows.num_rows, np.int64)
            full = np.flatnonzero(words.per_text)
            if len(full):
                most[full] = np.maximum.reduceat(own, words.first[:-1][full])
            made = [rows.column(0), pa.array(words.per_text, pa.int64()), pa.array(running[words.first[1:]] - running[words.first[:-1]]), pa.array(most)]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_words", "n_tokens", "longest_word_tokens"])

    return docs.select(key, text).mapInArrow(run, COUNTS)
