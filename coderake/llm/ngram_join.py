"""N-gram Jaccard self join of documents through a token-group matrix.

A document's set is its distinct word shingles (hashed to 64 bits). Equal sets are
one set from the start. Two sets link when 100 * intersection >= 80 * union; what is
asked for is each document's component under links.

1. Order. Shingles are ordered by how often they occur (a fixed-size sketch of
   counts over all documents; any order is right, this one makes prefixes rare). Two
   sets that link share one of their first n - ceil(0.8 n) + 1 shingles. The first one they
   share leaves room for their overlap in both: a set keeps a shingle only if what comes from
   there on reaches what a link with the smallest set of the shingle needs. So a passage that
   very many documents begin to share late in their order brings no two of them together.
2. Groups. Under each shared prefix shingle every set is compared with two leaders: the
   most central set, which shares most of its own prefix with others, and one by hash. A
   component of 64 sets or more that these links make is a group whose members need no
   further comparison; all other sets are grouped by the leader with which they share
   most shingles, and by size. Groups are dealt into cells of about 2^15 shingles.
3. Matrix. (shingle, group) says that sets of a group have the shingle in a prefix, of which
   sizes, and how much of a set may follow. A set looks up the groups that share a shingle
   with it and leave room for a link, the smaller group asking the larger (sets
   grouped by leader also ask their own group). Sets travel to the cells of that group as
   bitmaps. In a task the cell's token union, the bitmaps' sum, bounds the overlap of each
   asking set with all members; only where that reaches 80 % of the set's size is the cell
   opened, and the members' own bitmaps tell which sets can link at all. These come again
   as whole sets, and an inverted index counts exact overlaps. A cell gives a spanning
   forest of the links found, never its pairs.

A pair that links keeps the first shingle it shares, and under that shingle it is two sets (then one
is the other's leader), two members of one component, or a set that asks the other's
group: so the components are exact, and a group of thousands of near copies costs a
comparison with its leaders each and, for those that do not link with these, with cells.
Pairs of a set and its leader are bounded by bitmaps before whole sets meet. Whole sets
are made again from the text, only for documents of such pairs and cells; a fixed-size
filter of their ids spares making the others.

Cases: a null or empty text, or one without words, has an empty set and is linked with
nothing (its component is its own id); with fewer words than n the whole sequence is the
one shingle; repeated rows and equal texts are linked (one vertex, named by 64 bits of its
set's mark); a row with a null id takes part like any other and gets the smallest id of
its component, null if there is none; an empty table gives an empty result; very long
texts are read in blocks. Only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coderake.llm.common import parts, saved, tidy, tidy_groups
from coderake.llm.components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RANDOM = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Counters of the sketch of shingle counts, and how many of them a row holds.
BUCKET_BITS, CHUNK = 20, 1 << 16
#: Words of a text that are hashed at once, and bytes of a word beyond which its digest stands for it.
BLOCK_WORDS, LONG_WORD = 1 << 14, 256
#: Members from which a component is a group of its own, and shingles of a cell, about.
CORE, CELL_SHINGLES = 64, 1 << 15


class Shingler:
    """Hashes of a text's distinct word n-grams: differences of a running polynomial hash of its bytes, then mixed."""

    def __init__(self, n: int) -> None:
        self.n, self.size = n, 0
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        self.size = size
        powers = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))
        with np.errstate(over="ignore"):
            self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted unsigned 64-bit hashes; none for a text without words."""
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        n = min(self.n, len(words))
        return np.unique(np.concatenate([self._block(words[at : at + BLOCK_WORDS + n - 1], n) for at in range(0, len(words) - n + 1, BLOCK_WORDS)]))

    def _block(self, words: list[bytes], n: int) -> np.ndarray:
        raw = np.frombuffer(b" ".join(w if len(w) <= LONG_WORD else _shortened(w) for w in words), np.uint8)
        if len(raw) > self.size:
            self._grow(2 * len(raw))
        gaps = np.flatnonzero(raw == 32)
        starts = np.concatenate([[0], gaps + 1])[: len(words) - n + 1]
        ends = np.concatenate([gaps, [len(raw)]])[n - 1 :]
        with np.errstate(over="ignore"):
            run = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_RANDOM[raw] * self.up[: len(raw)], out=run[1:])
            h = (run[ends] - run[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return h


def _shortened(word: bytes) -> bytes:
    """Stands for a very long word: a NUL and 32 digits."""
    return b"\0" + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _mark(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set; the first half is its vertex."""
    with np.errstate(over="ignore"):
        one = (found * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (found >> np.uint64(31))
        two = (found ^ (found >> np.uint64(29))) * np.uint64(_BASE)
        return int(one.sum(dtype=np.uint64).view(np.int64)), int(two.sum(dtype=np.uint64).view(np.int64))


def bitmap(found: np.ndarray) -> bytes:
    """Bits of a set's tokens, 4 to 8 for each token."""
    width = max(64, 1 << (4 * len(found) - 1).bit_length())
    on = np.zeros(width, bool)
    on[(found & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def _folded(bits: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(bits, np.uint8)
    return raw if len(raw) == width else np.bitwise_or.reduce(raw.reshape(-1, width), 0)


def outside(bits: bytes, other: bytes) -> int:
    """At least so many tokens of the first set are not in the other one."""
    width = min(len(bits), len(other))
    return int(np.bitwise_count(_folded(bits, width) & ~_folded(other, width)).sum())


def set_marks(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, sig1, sig2) with a 128-bit mark of each set, and the sketch of shingle counts."""
    def scan(batches):
        hashes, counts = Shingler(n), np.zeros(1 << BUCKET_BITS, np.int32)
        for batch in batches:
            for part in parts(batch, 1):
                sets = [hashes(t.as_py()) for t in part.column(1)]
                if sets:
                    counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int32)
                sig1, sig2 = zip(*map(_mark, sets)) if sets else ((), ())
                none = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig1, pa.int64()), pa.array(sig2, pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        task = TaskContext.get().partitionId()
        chunks = [c for c in range(len(counts) // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
        empty = [pa.nulls(len(chunks)).cast(k) for k in (id_kind, pa.int64(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array([task % 1000] * len(chunks), pa.int32()), pa.array(chunks, pa.int32()), pa.array([counts[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in chunks], pa.binary())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType
    id_kind, names = to_arrow_type(id_type), ["doc_id", "n_shingles", "sig1", "sig2", "part", "chunk", "counts"]
    out = saved(docs.mapInArrow(tidy(scan), f"doc_id {id_type.simpleString()}, n_shingles long, sig1 long, sig2 long, part int, chunk int, counts binary"), "set-marks")

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in rows.column("counts"):
            total += np.frombuffer(x.as_py(), np.int32)
        total = np.minimum(total, 2**31 - 1).astype(np.int32)
        return pa.table({"chunk": rows.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    tasks = out.where("counts IS NOT NULL").select("part", "chunk", "counts")
    added_up = tasks.groupBy("part", "chunk").applyInArrow(added, "chunk int, counts binary").groupBy("chunk").applyInArrow(added, "chunk int, counts binary")
    sketch = np.zeros(1 << BUCKET_BITS, np.int32)
    for row in added_up.collect():  # CHUNK counters a row, 4 MB in all, however many documents there are
        sketch[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.int32)
    return out.where("counts IS NULL").select("doc_id", "n_shingles", "sig1", "sig2"), sketch


def prefixes(docs: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(node, n, prefix, bits) of each document with words: its rarest n - ceil(share * n) + 1 shingles and its bitmap."""
    shipped = docs.sparkSession.sparkContext.broadcast(sketch)

    def scan(batches):
        hashes, order = Shingler(n), shipped.value
        for batch in batches:
            for part in parts(batch, 0):
                nodes, sizes, kept, bits = [], [], [], []
                for text in part.column(0):
                    found = hashes(text.as_py())
                    if not len(found):
                        continue
                    size = len(found) - (percent * len(found) + 99) // 100 + 1
                    counts = order[(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    nodes.append(_mark(found)[0])
                    sizes.append(len(found))
                    kept.append(found[np.argsort(counts, kind="stable")[:size]])
                    bits.append(bitmap(found))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _lists(kept), pa.array(bits, pa.binary())], names=["node", "n", "prefix", "bits"])

    return docs.select("text").mapInArrow(tidy(scan), "node long, n long, prefix array<long>, bits binary")


#: Words of 64 bits in the filter of ids, whatever their number (1 MB).
FILTER_WORDS = 1 << 17


def whole_sets(docs: DataFrame, distinct: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, tokens) of each given vertex: whole sets, made from the text of its first document, or of those without an
    id. A few others may be among them; joins leave them out."""
    reps = distinct.join(nodes, distinct.sig1 == nodes.node, "left_semi").select(F.col("rep").alias("doc_id"))
    place = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(64 * FILTER_WORDS))
    words = reps.select(place().alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("bits"))
    table = np.zeros(FILTER_WORDS, np.int64)
    got = words.toArrow()
    table[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    def scan(batches):
        hashes, on = Shingler(n), shipped.value.view(np.uint64)
        for batch in batches:
            at = batch.column(0).to_numpy()
            chosen = np.flatnonzero(on[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            for part in parts(batch.select(["text"]).take(pa.array(chosen)), 0):
                found = [f for f in (hashes(t.as_py()) for t in part.column(0)) if len(f)]
                yield pa.RecordBatch.from_arrays([pa.array([_mark(f)[0] for f in found], pa.int64()), _lists(found)], names=["node", "tokens"])

    found = docs.select(place().alias("place"), "text").mapInArrow(tidy(scan), "node long, tokens array<long>")
    return found.dropDuplicates(["node"])


def bounded(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of vertices that their bitmaps do not rule out. sketches: (node, n, bits)."""
    def scan(batches):
        for batch in batches:
            keep = []
            for na, x, nb, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                common = min(na - outside(x, y), nb - outside(y, x))
                keep.append(100 * common >= percent * (na + nb - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "bits_a", "nb", "bits_b").mapInArrow(tidy(scan), "a long, b long")


def linked(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of vertices whose whole sets reach the threshold."""
    nodes = saved(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    whole = saved(whole_sets(docs, distinct, nodes, n), "whole-sets")
    left = whole.select(F.col("node").alias("a"), F.col("tokens").alias("s"))
    right = whole.select(F.col("node").alias("b"), F.col("tokens").alias("t"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("s") + F.size("t")).alias("sizes"), F.size(F.array_intersect("s", "t")).alias("common"))
    return saved(both.where(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select("a", "b"), "links")


def _can_meet(percent: int) -> Column:
    """Whether a set of n shingles may link with some of the sets that have a shingle, were it the first in their order that
    the two have in common: what comes from there on, here (rest) and there (most of it in any), bounds their overlap, and
    so much is needed with the smallest of them (low; high is the largest) that fits."""
    smallest = F.greatest("low", F.ceil(percent * F.col("n") / 100))
    fits = (100 * F.col("n") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("n"))
    return fits & ((100 + percent) * F.least("rest", "most") >= percent * (F.col("n") + smallest))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs. The id may be of any type that has an order."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks, sketch = set_marks(docs, n)
    distinct = saved(marks.where("n_shingles > 0").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("rep")), "distinct-sets")

    prefix = saved(prefixes(docs, n, percent, sketch), "prefixes")
    # A prefix is in the order of shingles, the same for all sets: so many shingles of its set come from here on.
    tokens = prefix.select("node", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("rest", F.col("n") - F.col("pos")).drop("pos")
    ends = tokens.groupBy("token").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("most"))
    several = saved(ends.where("first <> last").drop("first", "last"), "tokens-of-several")
    # A document's own prefix, however long, is what a window here holds.
    held = F.count("*").over(Window.partitionBy("node"))
    shared = tokens.join(several, "token").where(_can_meet(percent)).select("token", "node", "n", "rest").distinct()
    least = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    shared = saved(shared.select("token", "node", "n", "rest", (-F.floor(1000 * held / least)).alias("rank")), "shared-tokens")
    sketches = saved(prefix.select("node", "n", "bits").dropDuplicates(["node"]).join(shared.select("node").distinct(), "node", "left_semi"), "bitmaps")

    met, several = _leaders(shared, percent)
    pairs = saved(bounded(met.where("fits").select(F.greatest("a", "l").alias("a"), F.least("a", "l").alias("b")).distinct(), sketches, percent), "candidates")
    links = linked(pairs, docs, distinct, n, percent)
    placed = _placed(sketches, met, components(links))
    links = links.unionByName(_cell_links(shared, several, placed, sketches, docs, distinct, n, percent))
    roots = components(links).select(F.col("id").alias("sig1"), "root")

    # A component is named by the smallest document of its vertices.
    rooted = saved(distinct.join(roots, "sig1", "left").select("sig1", "sig2", "rep", F.coalesce("root", "sig1").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    out = marks.join(saved(rooted.join(named, "root").select("sig1", "sig2", "component"), "components"), ["sig1", "sig2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _leaders(shared: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, l, times, fits): each set with the leaders of its shared shingles, how many of them the most central leader
    leads, and whether their sizes allow a link; and the shingles of three sets or more."""
    central = F.struct("rank", F.xxhash64("node", F.lit(1)).alias("h"), "node", "n")
    drawn = F.struct(F.xxhash64("node", F.lit(2)).alias("h"), "node", "n")
    leaders = saved(shared.groupBy("token").agg(F.min(central).alias("c"), F.min(drawn).alias("d"), F.count("*").alias("sets")), "leaders")
    both = F.array(F.struct(F.col("c.node").alias("l"), F.col("c.n").alias("ln"), F.lit(1).alias("one")), F.struct(F.col("d.node").alias("l"), F.col("d.n").alias("ln"), F.lit(0).alias("one")))
    rows = shared.join(leaders, "token").select(F.col("node").alias("a"), "n", F.explode(both).alias("x")).where("a <> x.l")
    fits = (100 * F.col("n") >= percent * F.col("x.ln")) & (100 * F.col("x.ln") >= percent * F.col("n"))
    met = rows.groupBy("a", F.col("x.l").alias("l"), fits.alias("fits")).agg(F.sum("x.one").alias("times"))
    return saved(met, "met"), leaders.where("sets > 2").select("token")


def _placed(sketches: DataFrame, met: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, n, g, members, cells): the group of each set, its members and cells. g is STRUCT<loose, root, size>: a large
    component, or (loose) what shares most shingles with one leader, or with the component that leader is in, and is of
    about one size."""
    large = groups.groupBy("root").agg(F.count("*").alias("m")).where(f"m >= {CORE}")
    core = saved(groups.join(large, "root").select(F.col("id").alias("node"), "root"), "cores")
    home = met.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("times", "l"))["l"].alias("l"))
    led = core.select(F.col("node").alias("l"), F.col("root").alias("led"))
    home = home.join(led, "l", "left").select("node", F.coalesce("led", "l").alias("home"))
    rows = sketches.select("node", "n").join(core, "node", "left").join(home, "node", "left")
    size = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    loose = F.col("root").isNull()
    g = F.struct(loose.alias("loose"), F.coalesce("root", "home", "node").alias("root"), F.when(loose, size).otherwise(0).alias("size")).alias("g")
    rows = saved(rows.select("node", "n", g), "in-groups")
    sizes = rows.groupBy("g").agg(F.count("*").alias("members"), F.ceil(F.sum("n") / CELL_SHINGLES).cast("int").alias("cells"))
    return saved(rows.join(sizes, "g").select("node", "n", "g", "members", "cells"), "placed")


def _cell_links(shared: DataFrame, several: DataFrame, placed: DataFrame, sketches: DataFrame, docs: DataFrame, distinct: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that join what is left apart: between groups, and inside those that are no components."""
    rows = saved(shared.select("token", "node", "rest").join(several, "token").join(placed, "node"), "grouped-tokens")
    apart = rows.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high OR low.loose").select("token")
    rows = saved(rows.join(apart, "token"), "tokens-of-groups")
    matrix = saved(rows.groupBy("token", F.col("g").alias("b"), F.col("members").alias("mb"), "cells").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("most")), "matrix")
    asks = (F.struct("members", "g") < F.struct("mb", "b")) | ((F.col("g") == F.col("b")) & F.col("g.loose"))
    # A group is asked only if a set with the greatest overlap that its members with this shingle leave room for would link.
    asked = rows.drop("cells").join(matrix, "token").where(asks & _can_meet(percent)).select("node", "n", F.col("b").alias("g"), "cells").distinct()
    asked = saved(asked, "asked")
    # A cell that very many ask is asked in several parts.
    parts = saved(asked.groupBy("g").agg(F.ceil(F.sum("n") / CELL_SHINGLES).cast("int").alias("parts")), "asked-groups")
    part = F.pmod(F.xxhash64("node", F.lit(4)), "parts").cast("int").alias("part")
    cell = F.pmod(F.xxhash64("node", F.lit(3)), "cells").cast("int").alias("cell")
    asking = asked.join(parts, "g").select("node", "g", part, F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    inside = placed.join(parts, "g").select("node", "g", cell, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    key = [F.xxhash64("g", "cell", "part").alias("key"), F.col("g.loose").alias("loose")]
    everyone = saved(asking.select("node", *key, F.lit(True).alias("asks")).unionByName(inside.select("node", *key, F.lit(False).alias("asks"))), "in-cells")

    def bounds(asking: pa.Table, inside: pa.Table) -> pa.Table:
        sides = [(t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("bits").to_pylist()) for t in (asking, inside)]
        kept = cell_bounds(*sides[0], *sides[1], percent)
        both = pa.concat_tables([asking.take(pa.array(kept[0], pa.int64())), inside.take(pa.array(kept[1], pa.int64()))])
        return both.select(["node", "key", "loose", "asks"])

    may = saved(_in_cells(everyone, sketches.select("node", "n", "bits"), bounds, "node long, key long, loose boolean, asks boolean"), "opened")
    whole = saved(whole_sets(docs, distinct, saved(may.select("node").distinct(), "nodes"), n), "whole-sets")

    def compared(asking: pa.Table, inside: pa.Table) -> pa.Table:
        sets = lambda t: (t.column("node").to_numpy(), [x.values.to_numpy().view(np.uint64) for x in t.column("tokens")])
        found = cell_links(*sets(asking), *sets(inside), percent, inside.column("loose")[0].as_py())
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return saved(_in_cells(may, whole, compared, "a long, b long"), "links")


#: Rows of cells, about, that are handed to Python together: most cells are small.
BIN_ROWS = 512


def _in_cells(everyone: DataFrame, sets: DataFrame, work, schema: str) -> DataFrame:
    """work(asking, inside) for each cell's part, where the rows of everyone (node, key, loose, asks) carry what sets has of
    their nodes. A part has about twice CELL_SHINGLES shingles, or two sets if these are larger."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bins, out = max(1, -(-everyone.count() // BIN_ROWS)), to_arrow_schema(StructType.fromDDL(schema))
    names = ["node", *(c for c in sets.columns if c != "node"), "key", "loose", "asks"]
    rows = lambda side: everyone.where(side).join(sets, "node").select(*[F.col(c).alias(c) for c in names], F.pmod("key", F.lit(bins)).alias("bin"))

    def each(asking: pa.Table, inside: pa.Table) -> pa.Table:
        sides = [t.sort_by("key").combine_chunks() for t in (asking, inside)]
        keys = [t.column("key").to_numpy() for t in sides]
        found = []
        for key in np.intersect1d(*keys):
            parts = [t.slice(a := int(np.searchsorted(k, key)), int(np.searchsorted(k, key, "right")) - a) for t, k in zip(sides, keys)]
            found.append(work(*parts).cast(out))
        return pa.concat_tables(found) if found else out.empty_table()

    return rows("asks").groupBy("bin").cogroup(rows("NOT asks").groupBy("bin")).applyInArrow(tidy_groups(each), schema)


def cell_bounds(asking: np.ndarray, sizes: np.ndarray, bits: list[bytes], inside: np.ndarray, member_sizes: np.ndarray, member_bits: list[bytes], percent: int) -> tuple[list[int], list[int]]:
    """Places of the asking sets, and of the members, that some set of the other side may link with, as far as bitmaps tell."""
    width = min(map(len, [*bits, *member_bits]))
    members = np.array([_folded(x, width) for x in member_bits])
    union, apart, kept, met = np.bitwise_or.reduce(members), ~members, [], np.zeros(len(inside), bool)
    for i, (node, n, own) in enumerate(zip(asking, sizes, bits)):
        own = _folded(own, width)
        if 100 * (n - np.bitwise_count(own & ~union).sum(dtype=np.int64)) < percent * n:
            continue
        common = np.minimum(n - np.bitwise_count(own & apart).sum(1, dtype=np.int64), member_sizes - np.bitwise_count(members & ~own).sum(1, dtype=np.int64))
        near = (100 * common >= percent * (n + member_sizes - common)) & (inside != node)
        if near.any():
            kept.append(i)
            met |= near
    return kept, np.flatnonzero(met).tolist()


def cell_links(asking: np.ndarray, sets: list[np.ndarray], inside: np.ndarray, members: list[np.ndarray], percent: int, loose: bool) -> np.ndarray:
    """Links between asking sets and a cell's members: a spanning forest of them, or one for each asking set if the
    members are of one component (not loose)."""
    tokens, owner = np.concatenate(members), np.repeat(np.arange(len(members)), [len(m) for m in members])
    order = np.argsort(tokens, kind="stable")
    union, at, times = np.unique(tokens[order], return_index=True, return_counts=True)
    owner, sizes = owner[order], np.array([len(m) for m in members])
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x] = root.get(root[x], root[x])
        return x

    out = []
    for node, own in zip(asking.tolist(), sets):
        place = np.minimum(np.searchsorted(union, own), len(union) - 1)
        place = place[union[place] == own]
        # The union holds at most so many of the set's shingles: below the threshold no member can link.
        if 100 * len(place) < percent * len(own):
            continue
        n = times[place]
        common = np.bincount(owner[np.repeat(at[place] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(members))
        near = np.flatnonzero((100 * common >= percent * (len(own) + sizes - common)) & (inside != node))
        for b in inside[near[:1] if not loose else near].tolist():
            x, y = top(node), top(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((node, b))
    return np.array(out, np.int64).reshape(-1, 2)


def op5_ngram_jaccard(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS sh FROM w
), t AS MATERIALIZED (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(sh) AS x FROM s)),
n AS MATERIALIZED (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
c AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""
