"""Word-piece token counts by a linear longest-match automaton.

Greedy longest match takes, at each place of a word, the longest vocabulary
entry that starts there. Done naively it goes back over the characters behind a
failed match. Here the vocabulary is a trie whose nodes carry a failure link
(the node that stands for what is left once the greedy match has taken all the
tokens it is sure of) and the number of tokens taken on that link, as in "Fast
WordPiece Tokenization" (Song et al., 2021). Each character is then read once
and only the count is kept: no piece is ever built.

Vocabulary: the pieces of a sentencepiece model; a word is matched with U+2581
in front, so word-initial and inner pieces are told apart. A character that no
piece starts with counts as one token for each of its UTF-8 bytes.

Defined results: null or empty text, or text of white space alone, has 0 words
and 0 tokens; repeated rows stay; a null id stays null; an empty table gives none;
very long texts and words are read once, from end to end; other columns of the
input are not read and may have any name.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, held, map_texts, words_of

START = "▁"


class LongestMatch:
    """The automaton over a list of pieces."""

    def __init__(self, pieces):
        step: dict[tuple[int, str], int] = {}
        children: list[list[tuple[str, int]]] = [[]]
        final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                after = step.get((node, c))
                if after is None:
                    after = step[node, c] = len(final)
                    final.append(False)
                    children.append([])
                    children[node].append((c, after))
                node = after
            final[node] = node != 0
        fail, popped = [0] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            above = queue.popleft()
            for c, node in children[above]:
                queue.append(node)
                if final[node]:
                    popped[node] = 1
                    continue
                at, count = fail[above], popped[above]
                if above:
                    while (after := step.get((at, c))) is None and at:
                        count += popped[at]
                        at = fail[at]
                    if after is not None:
                        fail[node], popped[node] = after, count
                        continue
                popped[node] = count + fallback(c)
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: str) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        node = count = 0
        for c in word:
            while (after := step.get((node, c))) is None and node:
                count += popped[node]
                node = fail[node]
            if after is None:
                count += fallback(c)
            else:
                node = after
        while node:
            count += popped[node]
            node = fail[node]
        return count


def fallback(c: str) -> int:
    return len(c.encode("utf-8", "surrogatepass"))


def pieces_of(model_file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    return [model.id_to_piece(i) for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]


def _counter(model_file: str) -> Memo:
    """Token counts of words, computed by the automaton; one for each worker."""

    def build() -> Memo:
        automaton = LongestMatch(pieces_of(model_file))
        return Memo(lambda word: automaton.count(START + word.decode("utf-8", "surrogatepass")), 150_000)

    return held(("token counts", model_file), build)


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and n_tokens of each row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counter(model_file)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                found = words_of(text.as_py())
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[id_col, "n_words", "n_tokens"])

    rows = docs.select(id_col, docs[text_col].alias("__text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return map_texts(rows, run, f"`{id_col}` {kind}, n_words long, n_tokens long")
