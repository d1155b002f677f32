"""Token counts under a unigram tokenizer by dynamic programming over a trie of pre-tokens.

A pre-token is a word (what lies between ASCII white space, as in the other operators) with a
word-start mark before it. The distinct new pre-tokens of a
batch are inserted in a trie; walking it, the forward score of a prefix (best sum of log
probabilities of pieces, and how many pieces that takes) is computed once, however many
words share the prefix, and the count at a word's end is stored. A document's count is
the sum over its words. The trie is held as a sorted list of its words, so only the path
from the root to the present node is in memory, and of that no more than KEPT_PATH nodes:
what two longer words share beyond is computed for each, and a node further down needs
only what the one before it has, so a word's length does not matter for memory.

The public vocabulary ranks its pieces and has no probabilities; these follow Zipf's law of
the ranks here (tokenizers are not trained), so counts are those of this unigram model and
not of the file's own merges.

A character that no piece covers costs one byte piece for each of its bytes. Of
segmentations with equal scores the one with fewer pieces counts.

Cases: a null or empty text has no words and no tokens; repeated rows and null ids are
documents of their own; a very long word is walked once; an empty table gives an empty
result. Only id and text are read.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coderake.llm.common import WORD, parts, tidy

#: The mark before a word, and the log probability of a byte that stands for itself.
MARK, BYTE_SCORE = "▁", -18.0
#: Words whose counts a Python worker remembers (about 40 MB), how long they may be, and nodes of a path that are kept.
REMEMBERED, REMEMBERED_LENGTH, KEPT_PATH = 300_000, 64, 256


def unigram_pieces(path: str | None = None) -> dict[str, float]:
    """Log probabilities of a public vocabulary's pieces: those of Zipf's law by rank, as the file itself only ranks."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1 / (r + 2) for r in range(len(usable))))
    return {model.id_to_piece(i): -math.log(r + 2) - norm for r, i in enumerate(usable)}


class SharedForward:
    """Counts of words; forward scores along the path of the last word serve the next one as far as they agree."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.known: dict[str, int] = {}
        self.vocabulary: dict = {}
        for piece, score in pieces.items():
            node = self.vocabulary
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score

    def counts(self, words) -> dict[str, int]:
        """Tokens of each distinct word."""
        new = sorted(w for w in words if w not in self.known)
        out = {w: self.known[w] for w in words if w in self.known}
        # Per node of the path: best (score, -pieces) of the prefix, and the pieces begun but not ended: (vocabulary node, best at their start).
        path, best, begun = "", [(0.0, 0)], [[(self.vocabulary, (0.0, 0))]]
        for word in new:
            text, shared = MARK + word, 0
            top = min(len(path), len(text))
            while shared < top and path[shared] == text[shared]:
                shared += 1
            del best[shared + 1 :], begun[shared + 1 :]
            found, alive = best[-1], begun[-1]
            for depth in range(shared, len(text)):
                c = text[depth]
                size, before = len(c.encode()), alive
                found, alive = (found[0] + size * BYTE_SCORE, found[1] - size), []
                for node, start in before:
                    node = node.get(c)
                    if node is not None:
                        alive.append((node, start))
                        if "" in node:
                            found = max(found, (start[0] + node[""], start[1] - 1))
                alive.append((self.vocabulary, found))
                if depth < KEPT_PATH:
                    best.append(found)
                    begun.append(alive)
            path = text[:KEPT_PATH]
            out[word] = -found[1]
        if len(self.known) < REMEMBERED:
            self.known.update((w, out[w]) for w in new if len(w) <= REMEMBERED_LENGTH)
        return out


_SHARED: dict[int, SharedForward] = {}


def token_counts(docs: DataFrame, vocabulary: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every row of docs. Nothing is shuffled: each task shares prefixes among its own words."""
    vocabulary = vocabulary or unigram_pieces()
    mark = hash(tuple(vocabulary.items())) & 0xFFFFFFFF
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def scan(batches):
        if mark not in _SHARED:
            _SHARED[mark] = SharedForward(shipped.value)
        forward = _SHARED[mark]
        for batch in batches:
            for part in parts(batch, 1):
                words = [re.findall(WORD, t.as_py() or "") for t in part.column(1)]
                found = forward.counts(set().union(*words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(found.__getitem__, w)) for w in words], pa.int64())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(scan), schema)


def op8_token_counts(spark, sf_dir):
    """Counts of all documents under a synthetic unigram model: the public vocabulary's pieces with probabilities by Zipf's
    law of their ranks, not those of a trained tokenizer."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
