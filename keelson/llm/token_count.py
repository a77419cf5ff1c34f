"""Token counts of a unigram vocabulary by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a pre-token (blanks become the word mark, one mark is
put before the text, and pre-tokens begin at marks); dynamic programming over its characters carries the best score and
how many pieces it takes. Ties and unknown characters go as in the public unigram implementation: a piece wins against
what already ends at its end only by a higher score, pieces are met by ascending start; where no one-character piece
starts, the character is unknown at the lowest score less UNKNOWN_PENALTY; neighbouring unknown characters count as one
piece or, with byte pieces, as their UTF-8 bytes.

Pre-tokens repeat, so each worker keeps a bounded table of their counts. The vocabulary's path is a parameter; workers
get its pieces by broadcast, bounded by VOCABULARY pieces.

Defined cases: null and empty texts have no tokens; repeated rows are counted each; other columns are ignored; an empty
table gives an empty result. Long texts without blanks are one pre-token, whose cost is linear in its length.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed value of the public implementation.
UNKNOWN_PENALTY = 10.0
VOCABULARY = 2_000_000
_CACHE = 200_000
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")


def read_pieces(path: str = MODEL_PATH) -> tuple[list[tuple[str, float]], int, bool]:
    """Pieces with scores, the unknown piece's number, and whether there is a piece for each byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    if len(pieces) > VOCABULARY:
        raise ValueError(f"{len(pieces)} pieces; at most {VOCABULARY} are broadcast")
    return pieces, sp.unk_id(), sum(bool(_BYTE.fullmatch(p)) for p, _ in pieces) == 256


class Counter:
    """Counts the pieces of texts under the unigram model of the given pieces."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int, byte_pieces: bool):
        import ahocorasick

        self.automaton, self.byte_pieces = ahocorasick.Automaton(), byte_pieces
        for i, (piece, score) in enumerate(pieces):
            if piece and i != unknown:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.lowest = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self._seen: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        text = text.replace(" ", MARK)
        if not text.startswith(MARK):
            text = MARK + text
        parts = text.split(MARK)
        return ([parts[0]] if parts[0] else []) + [MARK + p for p in parts[1:]]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, seen = 0, self._seen
        for token in self.pre_tokens(text):
            n = seen.get(token)
            if n is None:
                n = self.viterbi(token)
                if len(token) <= 64:
                    if len(seen) >= _CACHE:
                        seen.clear()
                    seen[token] = n
            total += n
        return total

    def viterbi(self, token: str) -> int:
        """Pieces of the best segmentation of one pre-token.

        The automaton tells matches by ascending end and, of one end, the longest first, so an earlier start stays on a tie
        and a piece of one character comes last: an end is settled as soon as the next one is told.
        """
        size = len(token)
        best, count, unknown = [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)  # unknown: characters of the unknown run that ends here
        at = length = start = 0  # the end whose matches are being met, the last of their lengths, and the start of the best
        top = 0.0
        for last, (length_here, score) in self.automaton.iter(token):
            if last >= at:
                if at:
                    if length == 1:
                        best[at], count[at] = top, count[start] + 1
                    else:
                        self._settle(token, at, top, start, best, count, unknown)
                for gap in range(at + 1, last + 1):
                    self._settle(token, gap, None, 0, best, count, unknown)
                at, start = last + 1, last + 1 - length_here
                top = score + best[start]
            elif (here := score + best[at - length_here]) > top:
                top, start = here, at - length_here
            length = length_here
        if at:
            self._settle(token, at, top, start, best, count, unknown, length == 1)
        for gap in range(at + 1, size + 1):
            self._settle(token, gap, None, 0, best, count, unknown)
        return count[size]

    def _settle(self, token: str, end: int, top: float | None, start: int, best: list, count: list, unknown: list, single: bool = False) -> None:
        """Fixes an end whose best piece starts at start (top None: no piece ends here); single: its last character is a piece."""
        if not single and (top is None or self.lowest + best[end - 1] > top):
            best[end], unknown[end], before = self.lowest + best[end - 1], unknown[end - 1] + 1, count[end - 1]
            count[end] = before + (len(token[end - 1].encode("utf-8", "surrogatepass")) if self.byte_pieces else not unknown[end - 1])
        else:
            best[end], count[end] = top, count[start] + 1


def _count(model):
    def run(batches):
        counter = Counter(*model.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_chars": batch.column("n"), "n_tokens": pa.array([counter.count(t.as_py()) for t in batch.column("text")], pa.int64())})

    return run


def token_counts(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, n_chars and n_tokens for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(read_pieces(path))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("n"), text.alias("text")).mapInArrow(_count(model), "doc_id long, n_chars long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
