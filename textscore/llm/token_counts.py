"""Token counts of a unigram vocabulary: an automaton lists the pieces, dynamic programming keeps score and count only."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import slices, whole_text

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 300_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file of the ``sentencepiece`` library, by id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def read_marks(path: str) -> frozenset[str]:
    """Control, unknown and byte pieces of a file, which stand for no text of their own."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return frozenset(model.id_to_piece(i) for i in range(model.get_piece_size())
                     if model.is_control(i) or model.is_unknown(i) or model.is_byte(i))


class Counts:
    """Best score of a text under a unigram vocabulary, and the number of pieces of that segmentation.

    Ties follow the tokenizer: of equal scores the piece that starts first wins; a character that no piece holds on
    its own costs the worst score less ``UNKNOWN_PENALTY``; neighbouring unknown characters are one piece, or as many as they
    have bytes where the vocabulary has all byte pieces. ``marks`` are pieces that are never met in a text.
    """

    def __init__(self, pieces: list[tuple[str, float]], marks: frozenset[str] = frozenset()) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece not in marks:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        # Where no piece goes on over a blank or a line end, the parts between them have best paths of their own.
        self.parts = not any(BLANK in p.lstrip(BLANK) for p in names)
        self.lines = self.bytes and not any("\n" in p for p in names)
        self.memo: dict[str, tuple[float, int]] = {}

    def walk(self, text: str) -> tuple[float, int]:
        """Score and count of one part, over all pieces that end at each character, the longest first."""
        n = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(text):
            ending[end].append(piece)
        score, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            best, pieces, unknown, single = None, 0, False, False
            for length, gain in ending[end]:
                start = end + 1 - length
                total = score[start] + gain
                if best is None or total > best:
                    best, pieces = total, count[start] + 1
                single = single or length == 1
            if not single:
                total = score[end] + self.unknown
                if best is None or total > best:
                    best, unknown = total, True
                    new = len(text[end].encode("utf-8", "surrogatepass")) if self.bytes else not open_[end]
                    pieces = count[end] + new
            score[end + 1], count[end + 1], open_[end + 1] = best, pieces, unknown
        return score[n], count[n]

    def known(self, part: str) -> tuple[float, int]:
        found = self.memo.get(part)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[part] = self.walk(part)
        return found

    def of(self, text: str) -> tuple[float, int]:
        """Score and count of a whole text: a blank is put before it, and blanks become their sign. Empty text has none."""
        if not text:
            return 0.0, 0
        text = BLANK + text.replace(" ", BLANK)
        if not self.parts:
            return self.walk(text)
        words = text.split(BLANK)[1:]
        if "" in words:
            blanks, joined = 0, []
            for word in words:
                blanks += 1
                if word:
                    joined.append(BLANK * (blanks - 1) + word)
                    blanks = 0
            words = joined + [BLANK * (blanks - 1)] * (blanks > 0)
        often = Counter(words)
        score, count = 0.0, 0
        for word, times in often.items():
            part = BLANK + word
            for i, line in enumerate(part.split("\n") if self.lines else [part]):
                if i:
                    score, count = score + times * self.unknown, count + times
                if line:
                    s, c = self.known(line)
                    score, count = score + times * s, count + times * c
        return score, count


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of pieces of every whole text, and the score of its best segmentation.

    Returns ``id_col``, ``n_tokens`` and ``score``. ``path`` names a ``sentencepiece`` file whose pieces and scores are the unigram
    vocabulary. Null and empty texts have no pieces. Equal parts are walked once while a bounded memo holds them; a
    vocabulary whose pieces go on over blanks is walked over whole texts. One pass without a shuffle. Scores that are
    whole numbers add up exactly; others may differ in the last bits from a sum in text order. Repeated rows count alike; other
    columns are left out. No rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((read_pieces(path), read_marks(path)))  # a vocabulary of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(*sent.value)
        for batch in slices(batches):
            found = [counts.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([c for _, c in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())],
                ["id", "n_tokens", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, score double").withColumnRenamed("id", id_col)
