"""Extents of code nested in one another: a file's elements in pre-order, and what lies in which extents.

What lies in an extent is a range of a file's sorted points, found in Arrow batches of whole files; elements come together once, in
the order in which they begin, and pass a stack of those still open. So the work grows with what extents hold, however long a file, a
function or a statement is. A file's extents are bounded by its size. Extents may cross each other, as in
code whose brackets do not match: nothing depends on their being nested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Kinds of elements; of those with the same first and last token, the earlier one holds the later one.
KINDS = ("assignment", "value", "argument", "function", "call", "name")
#: Pairs of an extent and a point that are taken at once, or those of one extent, if these are more.
ROWS = 1 << 16


def _item(first: str, last: str, rank: Column, *more: Column) -> Column:
    """What sorts as it begins, larger ones first."""
    return F.struct(F.col(first).cast("int").alias("first_tok"), (-F.col(last)).cast("int").alias("back"), rank.alias("rank"), *more)


def _spread(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """What the lists of files hold, and the number of each one's file."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return column.flatten(), np.repeat(np.arange(len(sizes)), sizes)


def _at(file: np.ndarray, tok: pa.Array) -> np.ndarray:
    """Tokens of files as numbers that sort by file and token."""
    return (file << 33) + tok.to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(batch: pa.RecordBatch, which: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(extent, point) of a batch of files, as places in all their lists, ROWS pairs or more at once but for the last ones, with
    all points of an extent together and in order; which: places of the points that count, or all. The points of an extent are a
    range of the sorted ones, and so are those of a barrier: what barriers wholly in an extent keep from it are parts of its range."""
    (extents, of), (points, file), (barriers, barred) = (_spread(batch.column(c)) for c in ("extents", "points", "barriers"))
    begin, end = _at(of, extents.field("first_tok")), _at(of, extents.field("last_tok"))
    t = _at(file, points.field("t"))
    order = np.argsort(t, kind="stable")
    if which is not None:
        counts = np.zeros(len(t), bool)
        counts[which] = True
        order = order[counts[order]]
    t = t[order]
    b_begin, b_end = _at(barred, barriers.field("first_tok")), _at(barred, barriers.field("last_tok"))
    own = np.argsort(b_begin, kind="stable")
    b_begin, b_end = b_begin[own], b_end[own]
    low, high = np.searchsorted(t, begin), np.searchsorted(t, end, "right")
    b_low, b_high = np.searchsorted(t, b_begin), np.searchsorted(t, b_end, "right")
    bars = np.searchsorted(b_begin, begin), np.searchsorted(b_begin, end, "right")
    n, m = high - low, bars[1] - bars[0]
    total, at = np.cumsum(n + m), 0
    while at < len(total):
        until = min(int(np.searchsorted(total, (total[at - 1] if at else 0) + ROWS)) + 1, len(total))
        some = np.arange(at, until)
        starts = np.cumsum(n[some]) - n[some]
        e = np.repeat(some, n[some])
        p = np.arange(len(e)) - starts[e - at] + low[e]
        if m[some].any():
            x = np.repeat(some, m[some])
            y = np.arange(len(x)) - (np.cumsum(m[some]) - m[some])[x - at] + bars[0][x]
            inside = b_end[y] <= end[x]
            x, y = x[inside], y[inside]
            from_here = starts[x - at] - low[x]
            change = np.bincount(from_here + b_low[y], minlength=len(e) + 1) - np.bincount(from_here + b_high[y], minlength=len(e) + 1)
            kept = np.cumsum(change)[: len(e)] == 0
            e, p = e[kept], p[kept]
        if len(e):
            yield e, order[p]
        at = until


def _met(extents: DataFrame, points: DataFrame, barriers: DataFrame | None) -> tuple[DataFrame, StructField, StructType]:
    """(path, extents, points, barriers) of files that have extents and points, with the types of a key and of a point. They are
    listed each, and the lists joined: rows of tables that are dealt out by path stay where they are."""
    key, point = extents.schema["key"].dataType, StructType([StructField(f.name, f.dataType) for f in points.schema if f.name != "path"])
    listed = lambda rows, name, *item: rows.groupBy("path").agg(F.collect_list(F.struct(*item)).alias(name))
    bounds = [F.col(c).cast("int").alias(c) for c in ("first_tok", "last_tok")]
    rows = listed(points.where("t IS NOT NULL"), "points", *[c for c in points.columns if c != "path"])
    rows = rows.join(listed(extents.where("first_tok <= last_tok"), "extents", *bounds, "key"), "path")
    none = F.array().cast("array<struct<first_tok:int,last_tok:int>>")
    if barriers is None:
        rows = rows.withColumn("barriers", none)
    else:
        rows = rows.join(listed(barriers.where("first_tok <= last_tok"), "barriers", *bounds), "path", "left").withColumn("barriers", F.coalesce("barriers", none))
    return rows.select("path", "extents", "points", "barriers"), StructField("key", key), point


def enclosing(extents: DataFrame, points: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """path, key, t and the other columns of points: a row for each point (path, t) and each extent (path, key, first_tok,
    last_tok) that it lies in, ends included. A barrier (path, first_tok, last_tok) keeps the points in it from the extents
    that it wholly lies in. Equal rows each count; extents that end before they begin hold nothing; a null bound leaves its
    row out."""
    rows, key, point = _met(extents, points, barriers)

    def met(batches):
        for batch in batches:
            (own, of), given = _spread(batch.column("extents")), batch.column("points").flatten()
            for e, p in _pairs(batch):
                yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(of[e])), own.field("key").take(pa.array(e)), given.take(pa.array(p))], names=["path", "key", "point"])

    return rows.mapInArrow(met, StructType([extents.schema["path"], key, StructField("point", point)])).select("path", "key", "point.*")


def holding(extents: DataFrame, points: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """path, key, points: what ``enclosing`` gives as one row for each extent that holds any point, with these in order, as
    structs of the columns of points; so nothing needs to be dealt out again to bring them together."""
    rows, key, point = _met(extents, points, barriers)

    def met(batches):
        for batch in batches:
            (own, of), given = _spread(batch.column("extents")), batch.column("points").flatten()
            for e, p in _pairs(batch):
                begins = np.flatnonzero(np.diff(e, prepend=-1))
                held = pa.ListArray.from_arrays(pa.array(np.append(begins, len(e)), pa.int32()), given.take(pa.array(p)))
                yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(of[e[begins]])), own.field("key").take(pa.array(e[begins])), held], names=["path", "key", "points"])

    return rows.mapInArrow(met, StructType([extents.schema["path"], key, StructField("points", ArrayType(point))]))


def holding_any(extents: DataFrame, points: DataFrame, barriers: DataFrame | None, words: DataFrame, parts: int | None = None) -> DataFrame:
    """(path, key) of extents that hold, as in ``enclosing``, a point of which is_source is true, or of whose parts one is among
    words (path, names) of its file. What points count is told first, so no pair of an extent and another point is made, and
    no row for any point."""
    rows, key, _ = _met(extents, points, barriers)
    # What a task holds of the names of its files is a part of what the pass over their points holds.
    rows = rows.join(words.select("path", "names").hint("shuffle_hash"), "path", "left")

    def met(batches):
        for batch in batches:
            (own, of), (given, file), (names, named) = (_spread(batch.column(c)) for c in ("extents", "points", "names"))
            which = np.flatnonzero(np.asarray(pc.fill_null(given.field("is_source"), False)) | _among(given.field("parts"), file, names, named))
            hit = np.unique(np.concatenate([np.zeros(0, np.int64), *[e for e, _ in _pairs(batch, which)]]))
            yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(of[hit])), own.field("key").take(pa.array(hit))], names=["path", "key"])

    found = rows.mapInArrow(met, StructType([extents.schema["path"], key]))
    return (found if parts is None else found.repartition(parts, "path")).distinct()


def _among(lists: pa.ListArray, file: np.ndarray, words: pa.Array, of: np.ndarray) -> np.ndarray:
    """Whether a list of words holds one of those of its file."""
    items, at = _spread(lists)
    told = pa.concat_arrays([items, words]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.isin((file[at] << 33) + told[: len(items)], (of << 33) + told[len(items) :])
    return np.bincount(at[found], minlength=len(lists)) > 0


def _nested(first: list[int], back: list[int]) -> tuple[list[int], list[int]]:
    """Parent (-1 for none) and depth of sorted extents, those of one file after those of another, each with larger numbers."""
    parents, depths, still = [], [], []
    for i, (begin, end) in enumerate(zip(first, back)):
        while still and -back[still[-1]] < begin:
            still.pop()
        parent = -1
        for j in reversed(still):
            if back[j] <= end:
                parent = j
                break
        parents.append(parent)
        depths.append(depths[parent] + 1 if parent >= 0 else 0)
        still.append(i)
    return parents, depths


def elements(code_names: DataFrame, calls: DataFrame, arguments: DataFrame, assignments: DataFrame, functions: DataFrame, parts: int | None = None) -> DataFrame:
    """path, place (from 0, in pre-order), kind, tok_no, arg_no (of arguments, else 0), first_tok, last_tok, parent (the place
    of the latest element before it that holds it whole, null for none), depth (how many parents up), last_place (of the last
    element that begins in it): a file's elements as nested sets, where the places after an element's up to last_place are
    those of what lies in it. In code whose extents cross, some of these end after it. Calls begin with what their name
    hangs on; tok_no is that of an assignment's sign, of a call's name, of the word or name a function begins with. parts: in
    how many parts elements are dealt out by path, or as other shuffles do."""
    def of(rows: DataFrame, kind: str, tok: str, first: str, last: str, arg: Column = F.lit(0)) -> DataFrame:
        more = F.col(tok).cast("int").alias("tok_no"), arg.cast("int").alias("arg_no")
        return rows.where(f"{first} <= {last}").select("path", _item(first, last, F.lit(KINDS.index(kind)), *more).alias("item"))

    rows = of(assignments, "assignment", "tok_no", "start_tok", "value_end").unionByName(of(assignments, "value", "tok_no", "value_start", "value_end"))
    rows = rows.unionByName(of(arguments, "argument", "call_tok", "first_tok", "last_tok", F.col("arg_no")))
    rows = rows.unionByName(of(functions, "function", "start_tok", "start_tok", "end_tok")).unionByName(of(calls, "call", "tok_no", "start_tok", "close_tok"))
    rows = rows.unionByName(of(code_names, "name", "tok_no", "tok_no", "tok_no"))

    def placed(batches):
        for batch in batches:
            items, of = _spread(batch.column("items"))
            columns = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in items.flatten()]
            order = np.lexsort((*reversed(columns), of))
            (first, back, rank, tok, arg), of = (c[order] for c in columns), of[order]
            # Those of all files of a batch in one go: a file's tokens are greater than those of the files before it.
            begin, end = (of << 33) + first, (of << 33) - back
            start = np.searchsorted(of, of)
            parents, depths = (np.array(x, np.int64) for x in _nested(begin.tolist(), (-end).tolist()))
            last = np.searchsorted(begin, end, "right") - 1
            own = [np.arange(len(of)) - start, np.where(parents >= 0, parents - start, -1), depths, last - start, rank, tok, arg, first, back]
            own = [pa.array(x.astype(np.int32), pa.int32(), mask=parents < 0 if n == 1 else None) for n, x in enumerate(own)]
            yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(of)), *own], names=["path", "place", "parent", "depth", "last_place", "rank", "tok_no", "arg_no", "first_tok", "back"])

    found = (rows if parts is None else rows.repartition(parts, "path")).groupBy("path").agg(F.collect_list("item").alias("items")).mapInArrow(placed, "path string, place int, parent int, depth int, last_place int, rank int, tok_no int, arg_no int, first_tok int, back int")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    return found.select("path", "place", kind.alias("kind"), "tok_no", "arg_no", "first_tok", (-F.col("back")).alias("last_tok"), "parent", "depth", "last_place")
