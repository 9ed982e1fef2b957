"""Mixing sources to target weights in equal-token blocks.

Sources weigh ``weights`` in turn (by code point of their name, null last) and share ``share`` times all words; a
target stops at ``most`` times its source and what is left goes to the others by weight. Sainte-Laguë's highest
quotients turn targets into whole blocks of ``block`` words, first for sources, then for the shards of each source.
A shard strings its documents in a seeded order and cuts the string into blocks; all of them are taken as often as the
quota has all of them, and of the rest a seeded permutation of the shard's blocks says which. So no block is taken more
than once oftener than another, and what a document gives follows from its offset alone.

Defined results: null or wordless texts have size 0 and are never taken; a null source is a source of its own; rows that
repeat are separate rows (of rows with equal identifier and size the one with the lesser text hash comes first); an empty
table gives an empty result; a very long text has a number for each of its blocks in the row that is counted; other columns do not
matter, whatever their names (``materialise`` keeps them).
"""

from __future__ import annotations

import hashlib
import heapq
from fractions import Fraction
from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, free, local_table, settled, word_count

#: Sources that the driver apportions at most (a row each); plans of up to BROADCAST_ROWS rows are broadcast.
MAX_SOURCES = 200_000
BROADCAST_ROWS = 50_000
#: Shards over all sources at most, besides one for each source; beyond, shards get larger.
MAX_SHARDS = 500_000


def targets(sizes: list[int], weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2) -> list[Fraction]:
    """Each source's target; sources are in order, the weights go round."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, total = share * sum(sizes), sum(weight)
    out = [Fraction(0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (Fraction(most * sizes[i], weight[i]), i)):  # those that fill first
        out[i] = min(Fraction(most * sizes[i]), left * weight[i] / total)
        left -= out[i]
        total -= weight[i]
    return out


def sainte_lague(votes: list[Fraction] | list[int], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2k + 1); of equal quotients the earlier entry's comes first."""
    total = sum(votes)
    if not total:
        return [0] * len(votes)
    got = [int((2 * v * seats / total + 1) // 2) if v else 0 for v in map(Fraction, votes)]  # right for about as many seats
    extra = sum(got) - seats
    if extra < 0:
        heap = [(-Fraction(v) / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got)) if v]
        heapq.heapify(heap)
        for _ in range(-extra):
            _, i = heap[0]
            got[i] += 1
            heapq.heapreplace(heap, (-Fraction(votes[i]) / (2 * got[i] + 1), i))
    elif extra > 0:
        heap = [(Fraction(v) / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, got)) if g]
        heapq.heapify(heap)
        for _ in range(extra):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (Fraction(votes[-i]) / (2 * got[-i] - 1), i))
    return got


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def seeded(text: str) -> int:
    """A number of 32 bits from a text; ``_seeded`` is the same for columns."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def _seeded(seed: int, value: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(value.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long")


def permutation(name: str, blocks: int) -> tuple[int, int]:
    """(stride, start) of the order start + stride * block (mod blocks) of a shard's blocks."""
    stride = 1 + seeded(f"{name}/stride") % blocks
    while gcd(stride, blocks) > 1:
        stride += 1
    return stride, seeded(f"{name}/start") % blocks


def mixed(
    docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2,
    block: int = 64, shard: int = 1 << 20, seed: int = 17,
) -> DataFrame:
    """Per row: ident, size, source_size, target, taken. ``block`` and ``shard`` are in words."""
    rows = _placed(docs.select(F.col(ident).alias("_mix_id"), F.col(source).cast("string").alias("_mix_source"), word_count(text).alias("_mix_size")), weights, share, most, block, shard, seed, [])
    size = F.col("_mix_size")
    extra = F.aggregate("_mix_blocks", F.lit(0).cast("long"), lambda n, b: n + b["high"] - b["low"])
    return rows.select(
        F.col("_mix_id").alias(ident), size.alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_whole") * size + extra).alias("taken")
    )


def _placed(own: DataFrame, weights: tuple[int, ...], share: Fraction, most: int, block: int, shard: int, seed: int, last: list[str]) -> DataFrame:
    """``own`` (_mix_id, _mix_source, _mix_size and others) with its target, how often it is taken whole, and the blocks taken besides as (low, high) of its words.

    ``last`` are columns that order rows of equal identifier and size.
    """
    spark = own.sparkSession
    narrow = settled(own.select("_mix_id", "_mix_source", "_mix_size"), "mix-sizes")
    found = narrow.groupBy("_mix_source").agg(F.sum("_mix_size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in found]
    goal = targets(sizes, weights, share, most)
    quota = sainte_lague(goal, int(sum(goal) / block + Fraction(1, 2)))
    shard = max(shard, sum(sizes) // MAX_SHARDS)
    plan = local_table(
        spark,
        [(i, r[0], r[1], float(g), max(1, -(-r[1] // shard))) for i, (r, g) in enumerate(zip(found, goal))],
        "_mix_no int, _mix_name string, _mix_source_size long, _mix_target double, _mix_shards int",
    )

    def dealt(df: DataFrame) -> DataFrame:
        df = df.join(_small(plan, len(found)), F.col("_mix_source").eqNullSafe(F.col("_mix_name")))
        return df.withColumn("_mix_shard", F.pmod(_seeded(seed, F.col("_mix_id")), F.col("_mix_shards")).cast("int"))

    by_source: dict[int, list] = {}
    for no, k, n in dealt(narrow).groupBy("_mix_no", "_mix_shard").agg(F.sum("_mix_size").alias("n")).toLocalIterator():
        by_source.setdefault(no, []).append((k, n))
    runs = []
    for no, shards in sorted(by_source.items()):
        shards.sort()
        for (k, n), q in zip(shards, sainte_lague([n for _, n in shards], quota[no])):
            blocks = max(1, -(-n // block))
            whole, rest = divmod(min(q, most * blocks), blocks)
            runs.append((no, k, whole, rest, blocks, *permutation(f"{seed}/{found[no][0] or ''}/{k}", blocks)))
    runs_df = local_table(spark, runs, "_r_no int, _r_shard int, _mix_whole long, _mix_rest long, _mix_all long, _mix_stride long, _mix_start long")

    rows = dealt(own if last else narrow).join(_small(runs_df, len(runs)), (F.col("_mix_no") == F.col("_r_no")) & (F.col("_mix_shard") == F.col("_r_shard")))
    order = Window.partitionBy("_mix_no", "_mix_shard").orderBy(_seeded(seed + 1, F.col("_mix_id")), "_mix_id", "_mix_size", *last)
    rows = rows.withColumn("_mix_at", F.sum("_mix_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_mix_size"))
    at, end = F.col("_mix_at"), F.col("_mix_at") + F.col("_mix_size")
    every = F.sequence(F.floor(at / block), F.floor((end - 1) / block))
    chosen = F.filter(every, lambda b: F.pmod(F.col("_mix_start") + F.col("_mix_stride") * b, F.col("_mix_all")) < F.col("_mix_rest"))
    cuts = F.transform(chosen, lambda b: F.struct((F.greatest(b * block, at) - at).alias("low"), (F.least((b + 1) * block, end) - at).alias("high")))
    return rows.withColumn("_mix_blocks", F.when((F.col("_mix_size") > 0) & (F.col("_mix_rest") > 0), cuts).otherwise(F.array().cast("array<struct<low:bigint,high:bigint>>")))


def materialise(
    docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", n_chars: str = "n_chars", weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2),
    most: int = 2, block: int = 64, shard: int = 1 << 20, seed: int = 17,
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that a document is taken whole, and one for the blocks taken besides.

    Those blocks' words are joined by one space, and ``n_chars`` is counted anew; where they are all of a document's, the text is as it was.
    """
    columns = docs.columns
    (row,) = free(docs, "row")
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias(row), F.col(ident).alias("_mix_id"), F.col(source).cast("string").alias("_mix_source"), word_count(text).alias("_mix_size"),
        F.xxhash64(text).alias("_mix_hash"),
    )
    rows = _placed(own, weights, share, most, block, shard, seed, ["_mix_hash"])
    body, none = F.col(row).getField(text), F.array().cast("array<string>")
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("_mix_blocks", lambda b: F.slice(F.col("_mix_words"), (b["low"] + 1).cast("int"), (b["high"] - b["low"]).cast("int")))), " ")
    part = F.aggregate("_mix_blocks", F.lit(0).cast("long"), lambda n, b: n + b["high"] - b["low"])
    whole = F.when((F.col("_mix_whole") > 0) & (F.col("_mix_size") > 0), F.transform(F.sequence(F.lit(1), F.col("_mix_whole").cast("int")), lambda _: body)).otherwise(none)
    rows = rows.withColumn("_mix_part", part).withColumn("_mix_words", F.when((F.col("_mix_part") > 0) & (F.col("_mix_part") < F.col("_mix_size")), words))
    last = F.when(F.col("_mix_part") == 0, none).when(F.col("_mix_part") >= F.col("_mix_size"), F.array(body)).otherwise(F.array(cut))
    out = rows.withColumn("_mix_text", F.explode(F.concat(whole, last)))
    put = {text: F.col("_mix_text")} | ({n_chars: F.length("_mix_text").cast(docs.schema[n_chars].dataType)} if n_chars in columns else {})
    return out.select(*(put[c].alias(c) if c in put else F.col(row).getField(c).alias(c) for c in columns))
