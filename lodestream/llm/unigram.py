"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming carries
the best score and the number of pieces at each position. No piece has a space mark behind another
character, so a text's best path is the best paths of its words (a run of marks and what follows it)
end to end, and each task works out every distinct word it meets once.

The tie rules are those of the tokenizers library's Unigram model: among paths of equal score the one
whose last piece is longest wins, that is the one that was found first; a position where no piece of
one character begins gets an unknown piece of one character, scored ``UNK_PENALTY`` below the least
score; and with byte fallback an unknown character counts as its UTF-8 bytes.

The vocabulary is a file of fixed size: pieces and scores of a sentencepiece model. Its scores are whole
numbers here, so sums are exact whatever their order. Blanks become the mark, and one is put first,
as the model's own settings say; other white space is ordinary text.

Defined results: a null or empty text has no pieces; repeated rows are counted alike; an empty table
gives an empty table; kept columns pass through, added ones replace columns of the same name.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textvec as tv

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNK_PENALTY = 10.0
MAX_WORDS = 1 << 20
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of the model file, without control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(len(m)) if not odd(i)]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], most: int = MAX_WORDS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNK_PENALTY
        # words are independent only if marks stand nowhere but at a piece's front
        self.split = all(MARK not in p.lstrip(MARK) for p, _ in vocabulary)
        self.most, self.seen = most, {}

    def word(self, w: str) -> int:
        """Pieces on the best path of one word."""
        n = len(w)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * n
        for last, (size, score) in self.automaton.iter(w):
            ends[last + 1].append((size, score))
            if size == 1:
                single[last] = True
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, pieces_ = None, 0
            # the longest piece begins first and keeps its place on a tie; an unknown character begins last
            for size, score in sorted(ends[end], reverse=True):
                s = best[end - size] + score
                if top is None or s > top:
                    top, pieces_ = s, count[end - size] + 1
            if not single[end - 1]:
                s = best[end - 1] + self.unknown
                if top is None or s > top:
                    top, pieces_ = s, count[end - 1] + len(w[end - 1].encode("utf-8", "surrogatepass"))
            best[end], count[end] = top, pieces_
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.split:
            return self.word(marked)
        seen, total = self.seen, 0
        for w in WORD.findall(marked):
            c = seen.get(w)
            if c is None:
                c = self.word(w)
                if len(w) <= 64:
                    if len(seen) >= self.most:
                        seen.clear()
                    seen[w] = c
            total += c
        return total


@functools.cache
def _counter(path: str) -> Counter:
    return Counter(pieces(path))


def count(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, unless named), n_tokens and n_chars_per_token (null without tokens)."""
    path = path or default_path()
    added = ("n_tokens", "chars_per_token")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("chars_per_token", T.DoubleType())])

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _counter(path)
        for rb in tv.slices(batches):
            texts = [t or "" for t in rb.column("text").to_pylist()]
            n = [c.text(t) for t in texts]
            rate = [len(t) / k if k else None for t, k in zip(texts, n)]
            yield pa.RecordBatch.from_arrays([*(rb.column(x) for x in keep), pa.array(n, pa.int64()), pa.array(rate, pa.float64())], names=[*keep, *added])

    return source.mapInArrow(run, schema)
