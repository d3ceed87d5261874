"""Token counts by a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton over the vocabulary enumerates every match in a word; a dynamic programme
over match ends carries the best score and its number of pieces.  Ties go as in the ``tokenizers``
library: a later candidate wins only with a strictly better score, and candidates for one end come by
ascending start, the unknown character last.  Unknown characters count one piece a byte (byte fallback).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ._cluster import ship

SPACE = "▁"
#: Fixed value: what an unknown character costs below the lowest score of the vocabulary.
UNKNOWN_PENALTY = 10.0


def rank_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with Zipf log weights by rank (its own scores are ranks, not log probabilities)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), 0.0 if model.is_control(i) or model.is_unknown(i) else -math.log(i + 1)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Piece counts by word, filled when asked; emptied when it holds ``most`` words, so that memory is bounded."""

    def __init__(self, vocabulary: list[tuple[str, float]], most: int = 300_000) -> None:
        import ahocorasick

        super().__init__()
        self.most, self.unknown = most, min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = count = self.viterbi(SPACE + word)
        return count

    def viterbi(self, text: str) -> int:
        best, pieces, single, unknown = [0.0], [0], self.single, self.unknown
        found = self.matches.iter(text)
        end, match = next(found, (-1, None))
        for at, char in enumerate(text):
            score = None
            while end == at:
                start = at + 1 - match[0]
                candidate = best[start] + match[1]
                if score is None or candidate > score:
                    score, count = candidate, pieces[start] + 1
                end, match = next(found, (-1, None))
            if char not in single:
                candidate = best[at] + unknown
                if score is None or candidate > score:
                    score, count = candidate, pieces[at] + len(char.encode("utf-8", "replace"))
            best.append(score)
            pieces.append(count)
        return pieces[-1]

    def count(self, text: str | None) -> int:
        """Pieces of a whole text: spaces become word marks, one mark leads, words are cut before each mark."""
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        return sum(map(self.__getitem__, words[1:] if words[0] == "" else words))


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(rank_vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` without its text, with a long column of token counts.

    Each row is counted on its own, repeated rows too; null and empty texts have 0 tokens.  ``vocabulary``
    is a path on the executors.  An existing column named ``into`` is replaced.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, into)]
    rows = docs.select(*keep, text)
    schema = docs.select(*keep).schema.add(into, "long")

    def run(batches: Iterator) -> Iterator:
        counter = _counter(vocabulary)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(counts, pa.int64())], names=[*keep, into])

    return rows.mapInArrow(run, schema)
