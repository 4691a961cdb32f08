"""Token counts under a unigram model, by dynamic programming shared over a trie.

A text is cut at ASCII whitespace; each word, with the word-start mark before it, is
a pre-token.  The best (Viterbi) segmentation score of a prefix depends on the prefix
alone, so the distinct pre-tokens are inserted in a trie and the forward scores are
computed once per node, along shared prefixes; the node that ends a pre-token stores
its token count.  The trie is walked depth first in sorted order, so only the path to
the current node is held.

Pieces and their order come from a public vocabulary file (a parameter); the score of
a piece is the logarithm of its share under Zipf's law of its rank.  A character that
no piece covers costs one byte token per UTF-8 byte.

Scale: a map without a shuffle; every task counts the distinct pre-tokens of one Arrow
batch and keeps counts of frequent ones in a bounded table.

Defined cases: null, empty and blank texts have no pre-tokens and no tokens; a word of
any length is one pre-token; of equally good segmentations the one whose last piece is the
shortest counts; an empty table gives an empty result; repeated rows give repeated results;
extra columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from motifmill.llm import common

MARK = "▁"
BYTE_PENALTY = -20.0


def vocabulary(path: str) -> dict[str, float]:
    """Piece to log share; ranks are the order of the file's ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    total = sum(1 / (r + 3) for r in range(len(pieces)))
    return {p: -math.log((r + 3) * total) for r, p in enumerate(pieces)}


class TrieCounter:
    """Token counts of pre-tokens; ``pieces`` maps a piece to its log score."""

    def __init__(self, pieces: dict[str, float], limit: int = 300_000):
        self.longest = max(map(len, pieces), default=1)
        self.limit, self.known = limit, {}
        self.nodes_scored = 0
        # Pieces as a trie of their reversed characters: one walk back finds all that end here.
        self.back: dict = {}
        for p, score in pieces.items():
            node = self.back
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = score

    def count(self, words: set[bytes]) -> dict[bytes, int]:
        """Counts of distinct words (UTF-8, without the mark)."""
        new = [w for w in words if w not in self.known]
        out = self._walk(new)
        if len(self.known) + len(out) <= self.limit:
            self.known.update(out)
            return self.known
        return {w: self.known.get(w) or out[w] for w in words}

    def _walk(self, words: list[bytes]) -> dict[bytes, int]:
        out, back = {}, self.back
        path = MARK  # the characters from the root to the current node
        score, tokens = [0.0], [0]  # by depth
        for word, raw in sorted((MARK + w.decode("utf-8", "replace"), w) for w in words):
            shared, most = 0, min(len(path), len(word))
            if word[: most] == path[: most]:
                shared = most
            else:
                while word[shared] == path[shared]:
                    shared += 1
            shared = min(shared, len(score) - 1)
            del score[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode())
                best, n = score[end - 1] + BYTE_PENALTY * size, tokens[end - 1] + size
                node, at = back, end
                while at:
                    node = node.get(word[at - 1])
                    if node is None:
                        break
                    at -= 1
                    own = node.get("")
                    if own is not None and score[at] + own > best:
                        best, n = score[at] + own, tokens[at] + 1
                score.append(best)
                tokens.append(n)
            self.nodes_scored += len(word) - shared
            path = word
            out[raw] = tokens[-1]
        return out


def token_counts(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pre-tokens and tokens of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def worker():
        counter = TrieCounter(sent.value)

        def work(texts: list[bytes]) -> list[pa.Array]:
            words = [t.split() for t in texts]
            known = counter.count(set().union(*words))
            return [pa.array(list(map(len, words)), pa.int64()), pa.array([sum(map(known.__getitem__, w)) for w in words], pa.int64())]

        return work

    return common.map_texts(docs, worker, "n_pretokens bigint, n_tokens bigint", id_col, text_col, keep)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
