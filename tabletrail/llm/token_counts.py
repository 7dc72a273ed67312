"""Token counts under a unigram vocabulary, by dynamic programming shared over a trie.

A pre-token is a word (a run without white space) with the vocabulary's word mark before it. A task gathers the distinct
pre-tokens of a batch, and walks them in sorted order, which visits the nodes of their trie depth first: forward scores
stay on a stack and are computed once for a prefix that many words share. A node's score is the best sum of piece scores
up to it; equal sums take fewer tokens. At a word's end the count goes to the store of the task, and the documents' counts
are sums over their words. A character that is no piece falls back to one token per byte.

Scores are minus the logarithm of a piece's rank (as word frequencies fall with rank), whole numbers of `UNIT`, so that sums
are exact. The store is emptied beyond `STORE_WORDS` words, which changes nothing but time. Null texts have no tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabletrail.llm.tasks import dealt
from tabletrail.llm.words import slices, words_of

MARK = "▁"
UNIT = 1e-6
BYTE_PENALTY = 10.0
STORE_WORDS = 1_000_000
_LOST = -(1 << 60)


class Vocabulary:
    """Pieces (UTF-8) with whole-number scores."""

    def __init__(self, scores: dict[bytes, int], byte_score: int):
        self.scores, self.byte_score = scores, byte_score
        self.longest = max(map(len, scores), default=1)

    @classmethod
    def ranked(cls, pieces: list[str]) -> Vocabulary:
        """Pieces from frequent to rare."""
        scores = {p.encode(): -round(math.log(rank + 2) / UNIT) for rank, p in reversed(list(enumerate(pieces)))}
        return cls(scores, -round((math.log(len(pieces) + 2) + BYTE_PENALTY) / UNIT))


def sentencepiece_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model in the order of their stored scores; control, unknown and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary.ranked([model.id_to_piece(i) for i in sorted(known, key=lambda i: (-model.get_score(i), i))])


def count_sorted(words: list[bytes], vocabulary: Vocabulary) -> list[int]:
    """Tokens of each word; the words are sorted and bear the mark."""
    scores, longest, byte_score = vocabulary.scores, vocabulary.longest, vocabulary.byte_score
    best, tokens = [0], [0]  # the stack: forward score and token count of each prefix of the word before
    before, out = b"", []
    for word in words:
        shared, most = 0, min(len(before), len(word))
        if before[:most] == word[:most]:
            shared = most
        else:
            while before[shared] == word[shared]:
                shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, fewest = _LOST, 0
            if end == len(word) or word[end] & 0xC0 != 0x80:  # the end of a character
                for start in range(max(0, end - longest), end):
                    if best[start] == _LOST:
                        continue
                    score = scores.get(word[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and tokens[start] + 1 < fewest:
                            top, fewest = score, tokens[start] + 1
                start = end - 1
                while start and word[start] & 0xC0 == 0x80:
                    start -= 1
                if word[start:end] not in scores and best[start] != _LOST:
                    score = best[start] + (end - start) * byte_score
                    if score > top:
                        top, fewest = score, tokens[start] + end - start
            best.append(top)
            tokens.append(fewest)
        before = word
        out.append(tokens[-1])
    return out


def counted(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    mark = MARK.encode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            parts = [(part, words_of(part, lower=False)) for part in slices(batch.column(1))]
            if not parts:
                continue
            fresh: dict[int, bytes] = {}
            for part, words in parts:
                distinct, at = np.unique(words.hashes, return_index=True)
                place = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
                new = keys[place] != distinct if len(keys) else np.ones(len(distinct), bool)
                data = part.data.tobytes()
                for key, i in zip(distinct[new].tolist(), at[new].tolist(), strict=True):
                    if key not in fresh:
                        fresh[key] = mark + data[words.starts[i] : words.ends[i]]
            order = sorted(fresh, key=fresh.__getitem__)
            found = count_sorted([fresh[k] for k in order], sent.value)
            keys = np.concatenate([keys, np.array(order, np.uint64)])
            counts = np.concatenate([counts, np.array(found, np.int64)])
            by_key = np.argsort(keys)
            keys, counts = keys[by_key], counts[by_key]
            n_words, n_tokens = [], []
            for _, words in parts:
                running = np.concatenate([[0], np.cumsum(counts[np.searchsorted(keys, words.hashes)])])
                n_tokens.append(running[words.first[1:]] - running[words.first[:-1]])
                n_words.append(words.counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_tokens))], names=["doc_id", "n_words", "n_tokens"])
            if len(keys) > STORE_WORDS:
                keys, counts = keys[:0], counts[:0]

    return dealt(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(work, "doc_id long, n_words long, n_tokens long")
