"""Best-fit packing of token sequences: bounded-space online best-fit with a bitset of open bins.

Pieces are dealt to shards by hash, and a shard takes them in that order, as a stream: each
goes to the open bin with the least free space that holds it. A fixed number of bins is open;
when a piece fits in none of them and no more may be open, the fullest one closes first.

Cases: a null text is an empty one; an empty document still has its end token, so
it gives one piece; repeated rows and null ids are separate documents; an empty
table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coderake.llm.common import parts, saved, tidy, tidy_groups

#: Chunks whose ids a Python worker remembers, from its first tasks on (about 60 MB), and how long they may be; others
#: are encoded when met.
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64
#: Bins open at once in a shard, what a shard's pieces may cost, and the cost of a piece besides its tokens.
OPEN_BINS, SHARD_COST, PIECE_COST = 16, 1 << 22, 64


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file as text: read once on the driver, it goes to the tasks by broadcast (a few MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordIds:
    """Ids of whole texts by a tokenizer that never joins text across white space: each distinct chunk is encoded once."""

    #: White space to str.split() that the tokenizer takes for symbols.
    ODD = "\x1c\x1d\x1e\x1f"

    def __init__(self, json_text: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_str(json_text), {}
        # How the tokenizer spells the bytes of the letters up to U+00FF.
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {n: spelled.pre_tokenize_str(chr(n))[0][0] for n in range(128, 256) if chr(n).isalpha()}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [self._text(text) for text in texts]

    def _text(self, text: str) -> bytes:
        if any(c in text for c in self.ODD):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        try:
            text.encode("latin-1")
            text, plain = text.lower(), True  # no such character depends on its neighbours
        except UnicodeEncodeError:
            plain = False
        chunks = text.split()
        found = list(map(self.known.get, chunks))
        if None in found:
            missing = dict.fromkeys(c for c, ids in zip(chunks, found) if ids is None)
            new = self._encoded(missing, plain)
            if len(self.known) < REMEMBERED:
                self.known.update((c, ids) for c, ids in new.items() if len(c) <= REMEMBERED_LENGTH)
            found = [new[c] if ids is None else ids for c, ids in zip(chunks, found)]
        return b"".join(found)

    def _encoded(self, chunks, plain: bool) -> dict[str, bytes]:
        """Ids of new chunks. A word and one sign after it are two pre-tokens, so their ids just follow each other."""
        if plain:
            parts = {c: (c[:-1], c[-1]) for c in chunks if c[-1] in ",.;:!?|" and c[:-1].isalpha()}
            bare = dict.fromkeys(x for pair in parts.values() for x in pair if x not in self.known)
            rest = [*bare, *(c for c in chunks if c not in parts and c not in bare)]
            own = self._direct([c for c in rest if not c.isalpha()])
            # A lower-case word of such letters is one pre-token: it can go straight to the merges.
            merge = self.tokenizer.model.tokenize
            own |= {c: array("I", [t.id for t in merge(c if c.isascii() else c.translate(self.spelling))]).tobytes() for c in rest if c.isalpha()}
            for c, pair in parts.items():
                own[c] = b"".join(self.known.get(x) or own[x] for x in pair)
            return own
        return self._direct(list(chunks))

    def _direct(self, chunks: list[str]) -> dict[str, bytes]:
        encoded = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return {c: array("I", e.ids).tobytes() for c, e in zip(chunks, encoded)}


#: One per tokenizer in each Python worker, kept from task to task.
_WORD_IDS: dict[int, WordIds] = {}


def word_ids(json_text: str) -> WordIds:
    mark = zlib.crc32(json_text.encode())
    if mark not in _WORD_IDS:
        _WORD_IDS[mark] = WordIds(json_text)
    return _WORD_IDS[mark]


def pieces(docs: DataFrame, tokenizer_path: str | None = None, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32, and with with_ids the ids themselves."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(tokenizer_json(tokenizer_path))
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end, step = end_id.to_bytes(4, "little"), 4 * max_tokens

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = word_ids(shipped.value)
        for batch in batches:
            for part in parts(batch, 1):
                yield rows_of(part, encode)

    def rows_of(part, encode):
        rows: dict[str, list] = {f.name: [] for f in fields[1:]}
        origin = []
        for n, text in enumerate(part.column(1)):
            ids = encode([text.as_py() or ""])[0] + end
            for piece, at in enumerate(range(0, len(ids), step)):
                own = ids[at : at + step]
                origin.append(n)
                rows["piece"].append(piece)
                rows["start"].append(at // 4)
                rows["length"].append(len(own) // 4)
                rows["ids_crc32"].append(zlib.crc32(own))
                if with_ids:
                    rows["ids"].append(own)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(origin, pa.int64())), *[pa.array(rows[f.name], k) for f, k in zip(fields[1:], kinds)]], names=[f.name for f in fields])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(cut), T.StructType(fields))


def best_fit(lengths: list[int], capacity: int, open_bins: int, closed: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the given order. An item goes to the open bin with the least free space that
    holds it. Bit f of ``free`` says that some open bin has f tokens free; with open_bins open, the fullest closes.
    closed: gets the bins that closed before they were full."""
    free, by_free, n_open, made = 0, {}, 0, 0
    bins, offsets = [], []
    for length in lengths:
        fits = free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            held = by_free[space]
            at = held.pop()
            if not held:
                free ^= 1 << space
            n_open -= 1
        else:
            if n_open == open_bins:
                least = (free & -free).bit_length() - 1
                gone = by_free[least].pop()
                if not by_free[least]:
                    free ^= 1 << least
                n_open -= 1
                if closed is not None:
                    closed.append(gone)
            at, space, made = made, capacity, made + 1
        bins.append(at)
        offsets.append(capacity - space)
        if left := space - length:
            by_free.setdefault(left, []).append(at)
            free |= 1 << left
            n_open += 1
    return bins, offsets


def pack(cut: DataFrame, max_tokens: int = 4096, open_bins: int = OPEN_BINS, shard_cost: int = SHARD_COST) -> DataFrame:
    """Adds sequence_id and offset to pieces. A shard's pieces cost about shard_cost tokens, a few in each piece counted
    for the piece itself, so that a shard of very short pieces is bounded too."""
    total = cut.agg(F.coalesce(F.sum(F.col("length") + PIECE_COST), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_cost))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("turn")
        bins, offsets = best_fit(rows.column("length").to_pylist(), max_tokens, open_bins)
        shard = rows.column("shard")[0].as_py()
        rows = rows.append_column("sequence_id", pa.array([(shard << 32) + b for b in bins], pa.int64()))
        return rows.append_column("offset", pa.array(offsets, pa.int64())).select(schema.names)

    # cut is a written table, so a task that runs again sees the same rows in the same places.
    turn = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = cut.select("*", turn.alias("turn")).select("*", F.pmod("turn", F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(tidy_groups(packed), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, max_tokens: int = 4096, with_ids: bool = False, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, with with_ids the ids, sequence_id, offset of every piece of docs."""
    return pack(saved(pieces(docs, tokenizer_path, max_tokens, with_ids=with_ids), "pieces"), max_tokens, **options)


def op3_best_fit_packing(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
