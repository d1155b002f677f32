"""Ranked lexical search by the Best Position Algorithm over impact lists, a shard of documents at a time.

Queries come in blocks whose texts are bounded, so that a block's terms fit every task. For a block:

1. One pass over all documents makes shards: the postings (term, document, occurrences) of the block's terms, as arrays
   of one row, and for each task how many documents hold each term. Adding these up gives N, L and df of the whole table.
2. In each shard a term's postings are ordered by impact, what they add to a score. A query reads its terms' lists from
   the top, each a few places further in each round. What is new is looked up in all lists directly, which gives its
   whole score and its place in each of them, and these places are seen from then on. A list's best position is the last
   one up to which every place is seen, however it was; that is never before the last one read, and often far beyond it.
   What nobody has seen lies behind all best positions, so the impacts that follow these bound its score. A query stops
   when this bound is strictly below its k-th score: equal scores may still come, from smaller ids.
3. The k best of all shards are ranked.

Documents of a shard are in the order of their ids, so ties are settled inside a shard as they are at the end.

Cases: a null text has no terms; null ids come last among equal scores; each row is a document of its own, also where it
repeats an id or another row, and each row of items is a query of its own; an item without terms, or of terms that no
document holds, gives no rows; empty tables give an empty result; very long texts are read whole, one at a time; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coderake.llm.common import parts, saved, tidy

#: Bytes that belong to terms stay (A-Z as a-z), all others become blanks.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a block's item texts, about; postings and documents of a shard, at most (but for one document's own).
BLOCK_BYTES, POSTINGS, DOCUMENTS = 16 << 20, 1 << 20, 1 << 14
#: Places that a query reads of each list in its first round; each round doubles them.
FIRST_READ = 32


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Lists:
    """Impact lists of a shard: postings by term and document, and each term's own order by impact."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, documents: int) -> None:
        """Postings sorted by term and document (a number below ``documents``)."""
        self.doc, self.impact, self.documents = doc, impact, documents
        self.terms, self.starts = np.unique(term, return_index=True)
        self.ends = np.append(self.starts[1:], len(term))
        order = np.lexsort((-impact, term))
        self.by_impact = doc[order], impact[order]
        self.place = np.empty(len(term), np.int64)  # of a posting in its term's order by impact
        self.place[order] = np.arange(len(term))
        self.place -= np.repeat(self.starts, self.ends - self.starts)

    def search(self, query: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) of the k best for a query (term: times), best first, and how many places were read."""
        at = [(i, query[t]) for t in query if (i := int(np.searchsorted(self.terms, t))) < len(self.terms) and self.terms[i] == t]
        spans = [(int(self.starts[i]), int(self.ends[i]), times) for i, times in at]
        seen = [np.zeros(b - a, bool) for a, b, _ in spans]
        best, read, step = [0] * len(spans), 0, FIRST_READ
        known = np.zeros(self.documents, bool)
        top, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        longest = max((b - a for a, b, _ in spans), default=0)
        while read < longest:
            met = [self.by_impact[0][min(a + read, b) : min(a + read + step, b)] for a, b, _ in spans]
            for own in seen:
                own[read : read + step] = True
            read, step = read + step, 2 * step
            new = np.unique(np.concatenate(met))
            new = new[~known[new]]
            known[new] = True
            found = np.zeros(len(new), np.int64)
            for (a, b, times), own in zip(spans, seen):
                place = np.minimum(a + np.searchsorted(self.doc[a:b], new), b - 1)
                hit = self.doc[place] == new
                found[hit] += times * self.impact[place[hit]]
                own[self.place[place[hit]]] = True
            top, scores = np.concatenate([top, new]), np.concatenate([scores, found])
            order = np.lexsort((top, -scores))[:k]
            order = order[scores[order] > 0]
            top, scores = top[order], scores[order]
            bound = 0
            for i, ((a, b, times), own) in enumerate(zip(spans, seen)):
                unseen = ~own[best[i] :]
                best[i] = best[i] + int(unseen.argmax()) if unseen.any() else len(own)
                bound += times * int(self.by_impact[1][a + best[i]]) if best[i] < len(own) else 0
            if len(top) == k and bound < scores[-1] or not bound:
                break
        return top, scores, read


def _shards(docs: DataFrame, terms_of_block: dict[bytes, int]) -> DataFrame:
    """Rows of shards (ids, sizes, starts by term number, doc, tf, term) and, with the rest null, of each task's sums (n, l,
    df of each term it saw)."""
    from pyspark.sql.pandas.types import to_arrow_type

    number = docs.sparkSession.sparkContext.broadcast(terms_of_block)
    id_type = docs.schema["doc_id"].dataType
    schema = f"ids array<{id_type.simpleString()}>, sizes array<long>, term array<int>, doc array<int>, tf array<int>, n long, l long, seen array<int>, df array<long>"
    lists = lambda kind: pa.list_(kind)
    types = pa.schema([("ids", lists(to_arrow_type(id_type))), ("sizes", lists(pa.int64())), ("term", lists(pa.int32())), ("doc", lists(pa.int32())), ("tf", lists(pa.int32())), ("n", pa.int64()), ("l", pa.int64()), ("seen", lists(pa.int32())), ("df", lists(pa.int64()))])

    def row(**values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in types], schema=types)

    def shard(ids: list, sizes: list, doc: list, term: list, tf: list) -> pa.RecordBatch:
        order = pa.compute.sort_indices(pa.chunked_array(ids), null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        doc = place[np.repeat(np.arange(len(doc)), doc)]
        term, tf = np.concatenate(term), np.concatenate(tf)
        by = np.lexsort((doc, term))
        found = pa.chunked_array(ids).combine_chunks().take(pa.array(order))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))
        made = [one(found, None), one(np.array(sizes, np.int64)[order], pa.int64()), one(term[by], pa.int32()), one(doc[by], pa.int32()), one(tf[by], pa.int32())]
        return pa.RecordBatch.from_arrays([*made, *[pa.nulls(1, f.type) for f in list(types)[5:]]], schema=types)

    def scan(batches):
        known, n, total, df = number.value, 0, 0, np.zeros(len(number.value), np.int64)
        ids, sizes, doc, term, tf, held = [], [], [], [], [], 0
        for batch in batches:
            for part in parts(batch, 1):
                for i, text in enumerate(part.column(1)):
                    words = terms(text.as_py() or b"")
                    if not words:
                        continue
                    n, total = n + 1, total + len(words)
                    own, times = np.unique(np.array([t for w in words if (t := known.get(w)) is not None], np.int32), return_counts=True)
                    if not len(own):
                        continue
                    df[own] += 1
                    ids.append(part.column(0).slice(i, 1))
                    sizes.append(len(words))
                    doc.append(len(own))
                    term.append(own)
                    tf.append(times.astype(np.int32))
                    held += len(own)
                    if held >= POSTINGS or len(ids) >= DOCUMENTS:
                        yield shard(ids, sizes, doc, term, tf)
                        ids, sizes, doc, term, tf, held = [], [], [], [], [], 0
        if ids:
            yield shard(ids, sizes, doc, term, tf)
        seen = np.flatnonzero(df)
        yield row(n=n, l=total, seen=seen.tolist(), df=df[seen].tolist())

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(scan), schema)


def _blocks(items: DataFrame) -> list[DataFrame]:
    """Items in blocks of about BLOCK_BYTES of text."""
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def ranked(items: DataFrame, docs: DataFrame, k: int = 20, item_id: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0. A document's score is the sum,
    over the item's terms with repeats, of w * ((10**9 * tf) div (1000 * tf + 12 * m)), where w is the term's weight and m
    grows with the document's length."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col("text"))
    out = None
    for block in _blocks(items):
        found = _ranked(block, docs, k)
        out = found if out is None else out.unionByName(found)
    return out


def _ranked(block: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    spark, known, queries, ids = docs.sparkSession, {}, [], []
    for row in block.where("text IS NOT NULL").toLocalIterator():  # BLOCK_BYTES, about
        query: dict[int, int] = {}
        for w in terms(row["text"].encode()):
            t = known.setdefault(w, len(known))
            query[t] = query.get(t, 0) + 1
        queries.append(query)
        ids.append(row["item_id"])
    made = saved(_shards(docs, known), "impact-shards")
    sums = made.where("n IS NOT NULL")
    n, total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    counts = sums.select(F.explode(F.arrays_zip("seen", "df")).alias("x")).groupBy("x.seen").agg(F.sum("x.df").alias("df"))
    weights = np.zeros(len(known), np.int64)
    for row in counts.toLocalIterator():  # a row for each term of the block
        weights[row["seen"]] = weight(n, row["df"])
    shipped = spark.sparkContext.broadcast((weights, queries, ids))
    id_type, item_type = docs.schema["doc_id"].dataType, block.schema["item_id"].dataType
    item_kind = to_arrow_type(item_type)

    def search(batches):
        weights, queries, item_ids = shipped.value
        for batch in batches:
            for i in range(batch.num_rows):
                own, sizes, term, doc, tf = (batch.column(c).slice(i, 1).flatten() for c in range(5))
                sizes, term, doc, tf = sizes.to_numpy(), term.to_numpy(), doc.to_numpy(), tf.to_numpy().astype(np.int64)
                m = 75 + (25 * sizes * n) // total
                lists = Lists(term, doc, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])), len(sizes))
                for q, query in enumerate(queries):
                    top, scores, _ = lists.search(query, k)
                    if len(top):
                        yield pa.RecordBatch.from_arrays([pa.array([q] * len(top), pa.int64()), pa.array([item_ids[q]] * len(top), item_kind), own.take(pa.array(top)), pa.array(scores)], names=["item", "item_id", "doc_id", "score"])

    rows = made.where("n IS NULL").select("ids", "sizes", "term", "doc", "tf").mapInArrow(tidy(search), f"item long, item_id {item_type.simpleString()}, doc_id {id_type.simpleString()}, score long")
    rows = saved(rows, "best-of-shards")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_best_position(spark, sf_dir):
    return ranked(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
q AS MATERIALIZED (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY 1, 2),
p AS MATERIALIZED (SELECT doc_id, size, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS size, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
w AS MATERIALIZED (SELECT t, CAST(floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY t, s.n),
x AS (SELECT q.item_id, p.doc_id, CAST(sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + ((25 * p.size * s.n) // s.l))))) AS BIGINT) AS score FROM q JOIN p ON p.t = q.t JOIN w ON w.t = q.t, s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
