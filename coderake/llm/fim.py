"""Fill-in-middle: each text cut in three at two places, and its parts put in another order behind control strings.

Cuts are counted in units (code points, or what a pattern matches), but texts are bytes. Where units end is kept as a
set of byte offsets in containers of 2^16 places each: a run container holds spans of neighbouring offsets (any text in
one-byte characters is one span), an array container few offsets, a bitmap container many. Cumulative cardinalities
lead from a unit's number to its container, and a select inside that container to the offset; so a text's offsets are
never listed one by one where they are regular, and two lookups give both cuts.

Cases: a null or empty text is plain and empty; a text that holds a control string is plain, so that what was moved can
always be told; a null id is hashed like an empty one; repeated rows are cut alike; very long texts are read 2^16
bytes at a time; an empty table gives an empty result; other columns are not read. Texts need not be valid UTF-8: a
code point is a byte that continues none, with those that continue it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coderake.llm.common import parts, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 16


@dataclass
class Runs:
    """Spans of neighbouring places: where each begins, and how many places there are up to its end."""

    starts: np.ndarray
    upto: np.ndarray

    def select(self, k: int) -> int:
        span = int(np.searchsorted(self.upto, k, side="right"))
        return int(self.starts[span]) + k - (int(self.upto[span - 1]) if span else 0)


@dataclass
class Places:
    """Few places, listed."""

    found: np.ndarray

    def select(self, k: int) -> int:
        return int(self.found[k])


@dataclass
class Bits:
    """Many places, as bits of 64-bit words with the number of bits up to each word's end."""

    words: np.ndarray
    upto: np.ndarray

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.upto, k, side="right"))
        k -= int(self.upto[word - 1]) if word else 0
        on = np.flatnonzero(np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little"))
        return 64 * word + int(on[k])


def container(on: np.ndarray) -> Runs | Places | Bits:
    """The smallest of the three for a chunk's places (booleans)."""
    edges = np.flatnonzero(np.diff(on, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    count, width = int((ends - starts).sum()), -(-len(on) // 64) * 8
    if 4 * len(starts) <= min(2 * count, width):
        return Runs(starts.astype(np.uint16), np.cumsum(ends - starts).astype(np.int32))
    if 2 * count <= width:
        return Places(np.flatnonzero(on).astype(np.uint16))
    bits = np.zeros(width * 8, bool)
    bits[: len(on)] = on
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    return Bits(words, np.cumsum(np.bitwise_count(words)).astype(np.int32))


class Boundaries:
    """The byte offsets at which units begin or the last one ends; 0 is the first of them."""

    def __init__(self, chunks) -> None:
        """chunks: for each 2^16 offsets that hold any, their number from the front and booleans of its offsets."""
        self.keys, self.inside, sizes = [], [], []
        for key, on in chunks:
            count = int(np.count_nonzero(on))
            if count:
                self.keys.append(key)
                self.inside.append(container(on))
                sizes.append(count)
        self.upto = np.cumsum(sizes, dtype=np.int64)

    @classmethod
    def of_code_points(cls, text: bytes) -> Boundaries:
        raw = np.frombuffer(text, np.uint8)

        def chunks():
            for at in range(0, len(raw) + 1, CHUNK):
                on = (raw[at : at + CHUNK] & 0xC0) != 0x80
                if at == 0 and len(on):
                    on[0] = True  # bytes that continue nothing belong to the first unit
                yield at // CHUNK, np.append(on, True) if len(raw) < at + CHUNK else on

        return cls(chunks())

    @classmethod
    def of_matches(cls, text: bytes, unit: re.Pattern[bytes]) -> Boundaries:
        """Units are what a pattern matches one after the other; what lies between matches belongs to the next one, and
        what follows the last one to it."""
        ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
        ends = np.array([0, *ends[:-1], len(text)] if ends else sorted({0, len(text)}), np.int64)

        def chunks():
            cuts = np.flatnonzero(np.diff(ends // CHUNK)) + 1
            for own in np.split(ends, cuts):
                on = np.zeros(CHUNK, bool)
                on[own % CHUNK] = True
                yield int(own[0]) // CHUNK, on

        return cls(chunks())

    @property
    def units(self) -> int:
        return int(self.upto[-1]) - 1

    def select(self, k: int) -> int:
        """The offset at which k units have ended."""
        at = int(np.searchsorted(self.upto, k, side="right"))
        return self.keys[at] * CHUNK + self.inside[at].select(k - (int(self.upto[at - 1]) if at else 0))


def _code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers that a seed and an id give."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, moved: int = 90, suffix_first: int = 20, unit: str | None = None) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output. About
    ``moved`` of a hundred texts are cut, of which ``suffix_first`` of a hundred begin with their suffix. unit: a pattern
    over UTF-8 bytes; code points if none."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    pattern = re.compile(unit.encode()) if unit else None

    def cut(text: bytes, h1: int, h2: int, h3: int, h4: int):
        found = Boundaries.of_matches(text, pattern) if pattern else Boundaries.of_code_points(text)
        n = found.units
        if not text or any(m in text for m in marks) or h3 % 100 >= moved:
            return n, "plain", None, None, text
        a, b = (found.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        p, s, m = marks
        front, middle, back = text[:a], text[a:b], text[b:]
        spm = h4 % 100 < suffix_first
        output = b"".join((s, back, p, front, m, middle) if spm else (p, front, s, back, m, middle))
        return n, "spm" if spm else "psm", _code_points(front), _code_points(middle), output

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def scan(batches):
        for batch in batches:
            for part in parts(batch, 1):
                rows = [cut(t or b"", *hs) for t, *hs in zip(*(part.column(i).to_pylist() for i in range(1, 6)))]
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(seed, F.col(id_col)))])
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(tidy(scan), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary").withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    pieces = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(pieces, F.lit(i))
    return F.when(form == "plain", output).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.concat(part(1), part(3), part(2)))


def op12_fill_in_middle(spark, sf_dir):
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""
