"""Taint: which names of a file hold what a user controls, and which expressions use them.

Names are global to a file; one forward pass over assignments and sources decides, in
the order of the text. An expression is tainted if a live name of it is, or if it holds a
source; what stands inside a call of a sanitizer within the expression is not live.
"""

from __future__ import annotations

from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coderake.functions.vocabulary import TAINT_TERMS
from coderake.operators.elements import enclosing, holding, holding_any
from coderake.operators.facts import called_names, names


def _words(role: str, more: dict[str, list[str]] | None = None) -> Column:
    return F.array(*[F.lit(t) for t in TAINT_TERMS[role] + (more or {}).get(role, [])])


def sources(code: DataFrame) -> DataFrame:
    """path, language, tok_no, parts, close_tok (of calls), source: names that are sources."""
    return called_names(code).where("source IS NOT NULL AND source <> 'open'").select("path", "language", "tok_no", "parts", "close_tok", "source")


def sanitizer_calls(calls: DataFrame, more: dict[str, list[str]] | None = None) -> DataFrame:
    """path, first_tok, last_tok: extents of calls whose whole dotted name is a sanitizer's."""
    return calls.where(F.array_contains(_words("sanitizer", more), F.col("callee"))).where("close_tok IS NOT NULL").select("path", F.col("tok_no").alias("first_tok"), F.col("close_tok").alias("last_tok"))


def _inner_names(code: DataFrame) -> DataFrame:
    """path, t, parts, is_source: all names."""
    return names(code).select("path", F.col("tok_no").alias("t"), "parts", F.col("source").isNotNull().alias("is_source"))


def live_names(code: DataFrame, calls: DataFrame, extents: DataFrame, more: dict[str, list[str]] | None = None) -> DataFrame:
    """path, key, t, parts, is_source: names in extents (path, key, first_tok, last_tok) that no sanitizer cuts off. A name
    is cut off by the largest sanitizer call around it that lies in the extent."""
    return enclosing(extents, _inner_names(code), sanitizer_calls(calls, more))


def _value_extents(assigned: DataFrame) -> DataFrame:
    return assigned.select("path", F.col("tok_no").alias("key"), F.col("value_start").alias("first_tok"), F.col("value_end").alias("last_tok"))


def events(code: DataFrame, calls: DataFrame, assigned: DataFrame, more: dict[str, list[str]] | None = None) -> DataFrame:
    """path, ord, targets, idents, seeds: assignments with their live names, and sources, in the order of the text. An
    assignment whose value holds a live source, and every source, seeds its names unconditionally."""
    # An assignment without a live name taints nothing: one event without names stands for all of those of a file.
    values = assigned.select("path", F.struct("start_tok", "targets").alias("key"), F.col("value_start").alias("first_tok"), F.col("value_end").alias("last_tok"))
    none = F.array().cast("array<string>")
    live = holding(values, _inner_names(code), sanitizer_calls(calls, more)).withColumn("is_source", F.exists("points.is_source", lambda x: x))
    made = live.select("path", F.col("key.start_tok").alias("ord"), F.when(F.col("is_source"), none).otherwise(F.col("key.targets")).alias("targets"), F.array_distinct(F.flatten("points.parts")).alias("idents"), F.when(F.col("is_source"), F.col("key.targets")).otherwise(none).alias("seeds"))
    found = sources(code)
    inner = names(code).select("path", F.col("tok_no").alias("t"), F.col("parts").alias("inner"))
    called = found.where("source = 'call'").select("path", F.col("tok_no").alias("key"), F.col("tok_no").alias("first_tok"), F.col("close_tok").alias("last_tok"))
    whole = holding(called, inner).select("path", F.col("key").alias("tok_no"), F.array_distinct(F.flatten("points.inner")).alias("seeds"))
    own = found.where("source <> 'call'").select("path", "tok_no", F.when(F.col("source") == "member", F.col("parts")).otherwise(F.array_intersect("parts", _words("source_identifier"))).alias("seeds"))
    seen = whole.unionByName(own).select("path", F.col("tok_no").alias("ord"), none.alias("targets"), none.alias("idents"), "seeds")
    no_more = assigned.select("path").distinct().select("path", F.lit(-1).alias("ord"), none.alias("targets"), none.alias("idents"), none.alias("seeds"))
    return made.unionByName(seen).unionByName(no_more)


def tainted_names(found: DataFrame, parts: int | None = None) -> DataFrame:
    """(path, names): the names that are tainted once a file's events have passed in the order of the text. Whether an event
    taints depends on all before it, so a file's events are passed in turn; a set of names is asked and added to, which
    takes the same time however many names there are (an expression over arrays would copy them at each event). A file's
    events are bounded by its size. parts: as for ``arguments``."""
    listed = (found if parts is None else found.repartition(parts, "path")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "targets", "idents", "seeds"))).alias("events"))
    known = set(TAINT_TERMS["source_identifier"])

    def scan(batches):
        for batch in batches:
            events = batch.column("events").flatten()
            lists = [events.field(c) for c in ("idents", "targets", "seeds")]
            # A number for each word of a batch.
            words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            told, codes, at, own = words.dictionary.to_pylist(), words.indices.to_pylist(), 0, []
            for x in lists:
                ends = np.cumsum([0, *x.value_lengths().to_pylist()]) + at
                own.append([codes[i:j] for i, j in pairwise(ends.tolist())])
                at = int(ends[-1])
            first = {n for n, word in enumerate(told) if word in known}
            names, rows = [], zip(*own)
            for size in batch.column("events").value_lengths().to_pylist():
                live: set[int] = set()
                for idents, targets, seeds in islice(rows, size):
                    if targets and not (first.isdisjoint(idents) and live.isdisjoint(idents)):
                        live.update(targets)
                    live.update(seeds)
                names.append(sorted((told[n] for n in live), key=str.encode))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(names, pa.list_(pa.string()))], names=["path", "names"])

    return listed.mapInArrow(scan, "path string, names array<string>")


def tainted_extents(code: DataFrame, calls: DataFrame, extents: DataFrame, tainted: DataFrame, more: dict[str, list[str]] | None = None, parts: int | None = None) -> DataFrame:
    """(path, key) of extents that are tainted, given all tainted names of the file. parts: as for ``arguments``."""
    return holding_any(extents, _inner_names(code), sanitizer_calls(calls, more), tainted, parts)  # a source also where a part is an identifier of one
