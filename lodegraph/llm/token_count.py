"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic
programming carries, for each position, the best score and the number of pieces of
the path that has it. No path is kept. Ties go as in the public unigram
tokenizers: of paths of equal score, the one whose last piece starts first stays.

A text is cut before each space, as a splitting Metaspace pre-tokenizer cuts it: a
space is U+2581, one is put before a text that has none there, and each part is
tokenized by itself, so its count can be kept: real texts repeat their words. Further
spaces are parts of their own; line feeds, tabs and other white space stay in their
part and count like any character. A character that no piece covers alone counts as
its UTF-8 bytes (byte fallback), or as one unknown piece for each run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodegraph.llm.common import bounded_arrow, held

MARK = "▁"
#: Score that an unknown character has below the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Words that a Python worker keeps the counts of; at that number it starts anew. Longer words than LONGEST are counted each time.
KEPT_WORDS, LONGEST = 300_000, 64


def unigram_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """The pieces of a public SentencePiece file as a unigram vocabulary.

    The file holds merge ranks, not probabilities, and tokenizers aren't trained
    here: the score of the piece of rank r is the logarithm of Zipf's 1 / (r + 2),
    a rule and no fit. Control, unknown and byte pieces are left out.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    real = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return [(m.id_to_piece(i), -math.log(r + 2)) for r, i in enumerate(real)]


class WordCounts(dict):
    """Pieces of each word; a word that is not held yet is counted when asked for."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback

    def viterbi(self, s: str) -> int:
        """Number of pieces of the best path through s."""
        n = len(s)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)

        def close(end: int, single: bool, reached: bool) -> None:
            """All pieces that end here have been seen; the unknown one comes last, for it starts last."""
            if not single and (not reached or best[end - 1] + self.unknown > best[end]):
                best[end], unknown[end] = best[end - 1] + self.unknown, True
                if self.byte_fallback:
                    count[end] = count[end - 1] + len(s[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    count[end] = count[end - 1] + (not unknown[end - 1])

        at, single, reached = 1, False, False
        for last, (length, score) in self.automaton.iter(s):
            end = last + 1
            while at < end:
                close(at, single, reached)
                at, single, reached = at + 1, False, False
            start = end - length
            if not reached or best[start] + score > best[end]:
                best[end], count[end], unknown[end], reached = best[start] + score, count[start] + 1, False, True
            single = single or length == 1
        while at <= n:
            close(at, single, reached)
            at, single, reached = at + 1, False, False
        return count[n]

    def __missing__(self, word: str) -> int:
        n = self.viterbi(MARK + word)
        if len(word) <= LONGEST:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n

    def text(self, text: str) -> int:
        """Number of pieces of a whole text, white space included."""
        if not text:
            return 0
        marked = text.replace(MARK, " ")
        return sum(map(self.__getitem__, (marked[1:] if marked[0] == " " else marked).split(" ")))


def word_counts(model_file: str, byte_fallback: bool = True) -> WordCounts:
    return held(("token_count", model_file, byte_fallback), lambda: WordCounts(unigram_vocabulary(model_file), byte_fallback))


def token_counts(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = True, whole: bool = False) -> DataFrame:
    """(id_col, n_words, n_tokens) for every row, in the scan's own tasks: no shuffle.

    model_file is a path that holds on every executor. With whole, n_tokens is what the
    tokenizer gives for the text as it stands; without, what it gives for the words
    alone, joined by single spaces. n_words counts what stands between white space. A null
    or empty text has 0 words and 0 tokens; one of white space has 0 words, and tokens only
    with whole. Repeated rows give repeated results, other columns are not read, an empty
    table gives an empty result, null ids are kept.
    """
    bounded_arrow(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = word_counts(model_file, byte_fallback)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                parts = text.split()
                words.append(len(parts))
                tokens.append(held.text(text) if whole else sum(map(held.__getitem__, parts)))
            yield pa.record_batch([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_words", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_words bigint, n_tokens bigint").withColumnRenamed("id", id_col)
