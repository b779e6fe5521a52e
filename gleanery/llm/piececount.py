"""Token counts by linear longest match: greedy word-piece lengths without building the pieces.

The vocabulary is a trie over the letters of marked words (a word-start mark, then the word). Each node
has a failure link: where matching goes on after the longest pieces of the text read so far are popped,
and the number of those pieces. A word is read once, letter by letter; no piece is ever cut out.

Words end at ASCII white space. The start mark alone is a piece too where the vocabulary has it. A word that the vocabulary cannot cover counts as one unknown token, as
in word-piece tokenizers.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.session import attach, tidy


#: The mark that the vocabulary puts before the first letter of a word.
WORD_START = "▁"
#: Words kept with their counts in one Python worker, in each of two generations.
WORDS_KEPT = 400_000


class LongestMatch:
    """Trie, failure links and popped-token counts of a vocabulary of pieces.

    With `lone_start` the word-start mark alone is a piece where the vocabulary has it, so that a word can
    begin with a piece that has no word-start form; without it such a word is unknown.
    """

    def __init__(self, pieces: Iterable[str], lone_start: bool = False) -> None:
        root: dict = {}
        self.next: list[dict] = [root, {}]  # 0: before a word; 1: inside one, no letter read
        self.final = [False, False]
        pieces = set(pieces)
        for piece in sorted(pieces):
            inside = not piece.startswith(WORD_START)
            if not piece or piece == WORD_START:
                continue
            node = int(inside)
            for c in piece if inside else piece[1:]:
                to = self.next[node].get(c)
                if to is None:
                    to = self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.final.append(False)
                node = to
            self.final[node] = True
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        if lone_start and WORD_START in pieces:
            self.fail[0], self.pops[0] = 1, 1
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if self.final[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, count = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    count += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][c], count
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if the vocabulary cannot cover it."""
        node, total = 0, 0
        follow, fail, pops = self.next, self.fail, self.pops
        for c in word:
            to = follow[node].get(c)
            while to is None:
                if fail[node] < 0:
                    return 0
                total += pops[node]
                node = fail[node]
                to = follow[node].get(c)
            node = to
        while node != 1:
            if fail[node] < 0:
                return 0
            total += pops[node]
            node = fail[node]
        return total

    def known_count(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            got = self.older.get(word)
            if got is None:
                got = self.count(word)
            if len(word) <= 64:
                if len(self.known) >= WORDS_KEPT:
                    self.older, self.known = self.known, {}
                self.known[word] = got
        return got

    def text(self, text: str) -> tuple[int, int, int]:
        """(tokens, words, unknown words); an unknown word is one token."""
        words = _words(text)
        counts = list(map(self.known_count, words))
        unknown = counts.count(0)
        return sum(counts) + unknown, len(words), unknown


def _words(text: str) -> list[str]:
    """Words ending at ASCII white space only (str.split() also takes Unicode's)."""
    if text.isascii() and "\x1c" not in text and "\x1d" not in text and "\x1e" not in text and "\x1f" not in text:
        return text.split()
    return [w.decode() for w in text.encode().split()]


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentence-piece model file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


_built: dict[str, LongestMatch] = {}


def token_counts(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_words, n_unknown) for each row of `docs`, whole texts.

    One output row for each input row, repeated rows and null ids included; null and empty texts have
    no tokens. Other columns are ignored. `pieces` is a published vocabulary (some ten thousand
    strings), sent once to each executor.
    """
    spark = attach(docs.sparkSession)
    sent = spark.sparkContext.broadcast(list(pieces))
    key = hashlib.sha256("\n".join(pieces).encode()).hexdigest()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = LongestMatch(sent.value, lone_start=True)
        match = _built[key]
        for batch in batches:
            rows = [match.text(t.as_py() or "") for t in batch.column("text")]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *cols], names=["doc_id", "n_tokens", "n_words", "n_unknown"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, n_words long, n_unknown long")
    return out.withColumnRenamed("doc_id", id_col)
