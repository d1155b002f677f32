"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source is dealt into shards of a few dozen documents by a seeded hash. A
shard claims its part of the source's target. Seats (blocks of ``block_words``
words) go to the claims with the highest quotients claim / (2k + 1), which is the
same as rounding claim / d for one common divisor d; d is found by counting seats
for many divisors in one aggregate. A claim's quota then selects blocks of the
shard's word stream: whole passes first, the rest by a seeded systematic draw, so
a document's share follows from its place in the stream without listing blocks. As a
stream's last block may be short, blocks are drawn for the quota's words, not its number
of seats. A source whose target is its cap has no seats to win: it is taken cap times.

Cases: a null text has no words; a null source is a source of its own; repeated
rows are separate documents, and may differ in what is taken of them; a source without
words has target 0; an empty table gives an empty result. Rows that share an id are dealt
out by their texts. Only the named columns are read, so other columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coderake.llm.common import WORD, numbered, saved, word_count


def _key(source: str):
    """A key that is never null: null sources share one that no text can give."""
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source)))


def targets(sources: DataFrame, total_share: float, cap: float) -> DataFrame:
    """Adds ``target`` to rows of (skey, words, weight): shares of total_share * all words by weight, at most
    cap * words each; what a capped source can't take goes to the others by weight."""
    all_words = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    total, level = total_share * all_words, 0.0
    while True:
        capped = F.col("words") * F.lit(cap) < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(capped, F.col("words") * F.lit(cap))).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        after = (total - (row["full"] or 0.0)) / row["open"]
        if after <= level * (1 + 1e-15):
            break
        level = after
    level = level if row["open"] else float("inf")
    limit = F.col("words") * F.lit(float(cap))
    share = F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when((F.col("weight") > 0) & (share < limit), share).when(F.col("weight") > 0, limit).otherwise(F.lit(0.0)).cast("double"))


def divisor(claims: DataFrame, seats: int) -> float:
    """The divisor d for which the claims' votes / d, rounded, add up to the seats: the highest quotients win."""
    row = claims.agg(F.sum("vote"), F.count("*"), F.max("vote")).first()
    if not row[0] or seats < 1:
        return float("inf")
    votes, n, most = row
    low, high = votes / (seats + n + 1), min(2 * most + 1, votes / (seats - n) if seats > 2 * n else float("inf"))
    for _ in range(12):
        tried = [low * (high / low) ** (i / 33) for i in range(1, 33)]
        counts = list(claims.agg(*[F.sum(F.floor(F.col("vote") / F.lit(d) + 0.5)) for d in tried]).first())
        if seats in counts:
            return tried[counts.index(seats)]
        low = max([low, *(d for d, c in zip(tried, counts) if c > seats)])
        high = min([high, *(d for d, c in zip(tried, counts) if c < seats)])
        if high <= low * (1 + 1e-14):
            break
    return high


def mix(docs: DataFrame, weights: DataFrame, total_share: float = 1.5, cap: float = 2.0, block_words: int = 32, rows_per_shard: int = 64, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted), passes (whole copies),
    and start, claim_blocks, drawn_blocks, turn, which say which blocks of its shard's stream are drawn once more.

    weights: (source, weight), one row per source. keep: columns of docs to carry along (default: none).
    """
    own = [F.col(id_col).alias("doc_id"), _key(source_col).alias("skey"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("draw")]
    sized = saved(docs.select(*own), "mix-sizes")
    rated = weights.select(_key("source").alias("skey"), F.col("weight").cast("double").alias("weight"))
    sources = sized.groupBy("skey").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).join(rated, "skey", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sources = targets(saved(sources, "mix-sources"), total_share, cap)
    full = F.col("target") >= F.lit(float(cap)) * F.col("words")
    sources = sources.select("skey", F.col("words").alias("source_size"), "target", full.alias("full"), F.ceil(F.col("rows") / rows_per_shard).alias("shards"))

    shard = F.pmod("draw", F.col("shards")).alias("shard")
    claims = sized.join(sources, "skey").select("skey", shard, "size", "source_size", "target", "full").groupBy("skey", "shard", "source_size", "target", "full").agg(F.sum("size").alias("claim_words"))
    # Equal claims differ by a seeded trifle, so that no two quotients tie.
    trifle = 1 + F.pmod(F.xxhash64("skey", "shard", F.lit(seed)), F.lit(1 << 20)) * 2.0**-58
    claims = saved(claims.where("claim_words > 0").select("skey", "shard", "claim_words", "full", (F.col("target") * F.col("claim_words") / F.col("source_size") * trifle).alias("vote")), "mix-claims")
    total = sources.where("NOT full").agg(F.sum("target")).first()[0] or 0.0
    found = divisor(claims.where("NOT full"), int(total / block_words + 0.5))

    blocks = F.ceil(F.col("claim_words") / block_words)
    seats = F.floor(F.col("vote") / F.lit(found) + 0.5)
    most = F.lit(float(cap)) * F.col("claim_words")
    quota = F.when(F.col("full"), most).otherwise(F.least(seats * block_words, most))
    quotas = claims.select("skey", "shard", "claim_words", blocks.alias("claim_blocks"), quota.alias("quota"))
    quotas = quotas.withColumn("passes", F.floor(F.col("quota") / F.col("claim_words"))).withColumn("drawn_blocks", F.floor((F.col("quota") / F.col("claim_words") - F.col("passes")) * F.col("claim_blocks") + 0.5))
    whole = F.col("drawn_blocks") >= F.col("claim_blocks")
    quotas = quotas.select("skey", "shard", "claim_blocks", (F.col("passes") + whole.cast("long")).alias("passes"), F.when(whole, 0).otherwise(F.col("drawn_blocks")).alias("drawn_blocks"), F.pmod(F.xxhash64(F.lit(seed), "skey", "shard"), "claim_blocks").alias("turn"))

    if keep:
        sized = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"))
    stream = Window.partitionBy("skey", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sized.join(sources, "skey").select("*", shard).withColumn("end", F.sum("size").over(stream)).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.join(quotas, ["skey", "shard"], "left").fillna(0, ["passes", "drawn_blocks", "turn"]).fillna(1, ["claim_blocks"])
    taken = F.col("passes") * F.col("size") + _drawn_before("end", block_words) - _drawn_before("start", block_words)
    out = ["doc_id", "size", "source_size", "target", taken.alias("taken"), "passes", "start", "claim_blocks", "drawn_blocks", "turn"]
    return rows.select(*out, *(["kept"] if keep else []))


def _drawn(block: str) -> str:
    """Drawn blocks among the first ``block`` ones: a systematic draw from a seeded turn."""
    return f"((({block}) + turn) * drawn_blocks) div claim_blocks"


def _drawn_before(at: str, block_words: int):
    """Words of drawn blocks among the first ``at`` words of the shard's stream."""
    block = f"{at} div {block_words}"
    whole = f"({_drawn(block)} - (turn * drawn_blocks) div claim_blocks) * {block_words}"
    return F.expr(f"{whole} + ({_drawn(f'{block} + 1')} - {_drawn(block)}) * ({at} % {block_words})")


def mixed_documents(docs: DataFrame, weights: DataFrame, block_words: int = 32, text_col: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole pass over a document, and one with the words of
    its blocks that are drawn once more; n_chars, where there is one, follows the text."""
    columns = docs.columns
    plan = mix(docs, weights, block_words=block_words, text_col=text_col, keep=columns, **options)
    text = F.col(f"kept.`{text_col}`")
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    extra = F.col("taken") - F.col("passes") * F.col("size")

    def picked(word, i):
        block = F.expr(f"start div {block_words}") * 0 + F.floor((F.col("start") + i) / block_words).cast("long")
        before = F.floor(((block + F.col("turn")) * F.col("drawn_blocks")) / F.col("claim_blocks"))
        after = F.floor(((block + 1 + F.col("turn")) * F.col("drawn_blocks")) / F.col("claim_blocks"))
        return after > before

    partial = F.when(extra == F.col("size"), text).otherwise(F.array_join(F.filter(pieces, picked), ""))
    copies = F.concat(F.array_repeat(text, F.col("passes").cast("int")), F.when(extra > 0, F.array(partial)).otherwise(F.array().cast("array<string>")))
    rows = plan.where("taken > 0").select("kept", F.explode(copies).alias("mixed_text"))
    new = {text_col: F.col("mixed_text"), "n_chars": F.length("mixed_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None}
    return rows.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"kept.`{c}`").alias(c) for c in columns])


def cyclic_weights(docs: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), source_col: str = "source") -> DataFrame:
    """(source, weight): sources by code point, null last, take the weights in turn."""
    listed = numbered(docs.select(F.col(source_col).alias("source")).distinct(), "place", F.col("source").isNull(), F.col("source"))
    return listed.select("source", F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int")).alias("weight"))


def op1_source_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, cyclic_weights(docs)).select("doc_id", "size", "source_size", "target", "taken")
