"""Token counts of a unigram tokenizer, by Viterbi without the pieces.

An Aho-Corasick automaton over the vocabulary finds, for every end in a text, the
pieces that end there, longest first.  Dynamic programming carries the best score and
its number of pieces.  A later candidate must be strictly better, so of equal scores
the piece that starts first wins, as in the tokenizers that use such vocabularies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import check_columns
from lamina.llm.segment import Memo, marked_pieces, slices

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: an unknown character scores so much less than the least piece


def read_pieces(path: str) -> tuple[dict[str, float], bool]:
    """The ordinary pieces and their scores, and whether there are byte pieces to fall
    back on, of a sentencepiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    plain = {m.id_to_piece(i): m.get_score(i) for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
    return plain, any(m.is_byte(i) for i in range(n))


class PieceCounter:
    """(pieces, score) of texts: spaces become U+2581, which also goes before a text."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool):
        self.pieces, self.byte_fallback = pieces, byte_fallback
        self._start()

    def _start(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, s in self.pieces.items():
            if p:
                self.automaton.add_word(p, (len(p), s))
        if self.pieces:
            self.automaton.make_automaton()
        self.unknown = min(self.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        inner = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        # Where no piece can cross, the best path of the whole is those of the parts; unknown characters only run
        # together without byte pieces.
        whole = inner or not self.byte_fallback or any("\n" in p for p in self.pieces)
        self.cut = None if whole else re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.memo = Memo(lambda parts: map(self.best, parts), 500_000)

    def __getstate__(self):
        return self.pieces, self.byte_fallback

    def __setstate__(self, state):
        self.pieces, self.byte_fallback = state
        self._start()

    def best(self, text: str) -> tuple[int, float]:
        n = len(text)
        score, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if self.pieces:
            for end, piece in self.automaton.iter(text):
                ending[end + 1].append(piece)
        for e in range(1, n + 1):
            top, start, single = None, e - 1, False
            for length, s in ending[e]:
                single = single or length == 1
                s += score[e - length]
                if top is None or s > top:
                    top, start = s, e - length
            if not single:
                s = score[e - 1] + self.unknown
                if top is None or s > top:
                    score[e], loose[e] = s, True
                    count[e] = count[e - 1] + (len(text[e - 1].encode()) if self.byte_fallback else 0 if loose[e - 1] else 1)
                    continue
            score[e], count[e] = top, count[start] + 1
        return count[n], score[n]

    def count_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each text; of a null or empty one 0 and 0."""
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", SPACE), ""))
        if self.cut is None:
            made = [self.best(t) for t in texts.to_pylist()]
            return np.array([m[0] for m in made], np.int64), np.array([m[1] for m in made], np.float64)

        def regular(t: pa.Array, mark: str) -> pa.Array:
            return pc.replace_substring(pc.replace_substring(t, SPACE, mark + SPACE), "\n", f"{mark}\n{mark}")

        pieces = marked_pieces(texts, regular, pc.match_substring(texts, SPACE * 2), self.cut.findall)
        made = self.memo.all(pieces.distinct())
        return pieces.sums(np.array([m[0] for m in made], np.int64)), pieces.sums(np.array([m[1] for m in made], np.float64))

    def count(self, text: str | None) -> tuple[int, float]:
        n, score = self.count_all(pa.array([text], pa.string()))
        return int(n[0]), float(score[0])


def token_counts(docs: DataFrame, pieces: dict[str, float], byte_fallback: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, score`` for each row: the best segmentation's pieces and score.

    One pass without a shuffle; the vocabulary is of fixed size and broadcast.  Null and
    empty texts have no tokens and score 0.  Repeated rows get equal results.  Other
    columns are not looked at.
    """
    check_columns(docs, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(PieceCounter(pieces, byte_fallback))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 20 << 20):
                n, score = shared.value.count_all(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(score)], ["doc_id", "n_tokens", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())]))
