"""Mixing sources to target weights, with DataFrame functions only.

Each source is cut into blocks of documents, about as many blocks as a block
has documents. A source's target says how many whole passes over it the mix
makes and how many words remain; for the remainder blocks are drawn in a
permuted order, the last few in part. The drawn blocks are dealt to the output
shards by a splitting tree over the table of sources: a node draws, by the
multivariate hypergeometric law, how many blocks of each source one half of its
shards gets. Within a source the blocks go by these quotas in a permuted order,
so they stay disjoint, and each shard is shuffled on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.common import carried, staged

WORD = r"[^\x20\x09-\x0D]+"
MOST_PASSES = 3
# Parts of an output shard, each sorted by one task.
PIECES = 256
# Blocks that the last, incomplete draw from a source chooses documents from.
PARTIAL_BLOCKS = 4


def words(text: str) -> Column:
    """The words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Sources by code point, NULL last, take the weights in turn. They share the
    sum of all sizes by weight, but none gets more than ``most`` times its own
    size; the excess goes to the others by weight until none is above. That
    amounts to one common level per unit of weight, the highest reached as
    sources are capped in order of their limit per weight. The table of sources
    is ordered in one task; it has one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(place, F.lit(len(weights))))
    totals = totals.withColumn("weight", weight).withColumn("limit", (most * F.col("source_size")).cast("double"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.max(F.col("level")).over(everything)
    return totals.withColumn("level", left / left_weight).select(
        "source", "source_size", "n_docs", F.least("limit", F.col("weight") * level).alias("target")
    )


def _drawn(held: Column, total: Column, draws: Column, key: Column) -> Column:
    """Of ``held``, an array of (source, n), how many units each source gives to ``draws`` of all ``total`` units.

    Selection sampling: unit after unit is drawn with the chance of draws still
    to be made among units still to come. The numbers per source then follow
    the multivariate hypergeometric law exactly. The draws of a unit go by a
    hash of ``key``, source and the unit's number.
    """
    kind = "struct<total: bigint, draws: bigint, taken: bigint>"

    def of_unit(state: Column, source: Column, number: Column) -> Column:
        chance = F.pmod(F.xxhash64(key, source, number), F.lit(1 << 52)) / float(1 << 52)
        hit = (chance * state["total"] < state["draws"]).cast("bigint")
        return F.struct((state["total"] - 1).alias("total"), (state["draws"] - hit).alias("draws"), (state["taken"] + hit).alias("taken")).cast(kind)

    def of_source(state: Column, own: Column) -> Column:
        start = F.struct(state["total"].alias("total"), state["draws"].alias("draws"), F.lit(0).cast("bigint").alias("taken")).cast(kind)
        units = F.when(own["n"] > 0, F.sequence(F.lit(1).cast("bigint"), own["n"])).otherwise(F.array().cast("array<bigint>"))
        # What is left after the source's units, and what it gave.
        end = F.aggregate(units, start, lambda s, i: of_unit(s, own["source"], i))
        return F.struct(
            (state["total"] - own["n"]).alias("total"), end["draws"].alias("draws"), F.concat(state["taken"], F.array(end["taken"])).alias("taken")
        ).cast("struct<total: bigint, draws: bigint, taken: array<bigint>>")

    start = F.struct(total.alias("total"), draws.alias("draws"), F.array().cast("array<bigint>").alias("taken"))
    return F.aggregate(held, start.cast("struct<total: bigint, draws: bigint, taken: array<bigint>>"), of_source)["taken"]


def quotas(counts: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """(source, shard, n): how many units of each source every shard gets, from rows (source, n).

    A node of the splitting tree covers the shards from ``low`` to ``high``
    and holds a number of units per source. Its left half of the shards gets its share of the
    units, drawn over all sources, and the right half the rest. The tree has a row per node,
    with one entry per source.
    """
    held = F.sort_array(F.collect_list(F.struct("source", F.col("n").cast("bigint").alias("n"))))
    nodes = counts.agg(held.alias("held"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"))
    nodes = nodes.select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "total", "held")
    for _ in range(max(0, (shards - 1).bit_length())):
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        share = F.floor(F.col("total") * (middle - F.col("low")) / (F.col("high") - F.col("low"))).cast("bigint")
        nodes = nodes.withColumns({"middle": middle, "share": share})
        key = F.xxhash64(F.lit(seed), F.lit("tree"), "low", "high")
        nodes = nodes.withColumn("taken", _drawn(F.col("held"), F.col("total"), F.col("share"), key))

        def part(low: str, high: str, total: Column, own: Column) -> Column:
            return F.struct(F.col(low).alias("low"), F.col(high).alias("high"), total.alias("total"), own.alias("held"))

        left = F.zip_with("held", "taken", lambda h, t: F.struct(h["source"].alias("source"), t.alias("n")))
        right = F.zip_with("held", "taken", lambda h, t: F.struct(h["source"].alias("source"), (h["n"] - t).alias("n")))
        halves = F.array(part("low", "middle", F.col("share"), left), part("middle", "high", F.col("total") - F.col("share"), right))
        leaf = F.array(part("low", "high", F.col("total"), F.col("held")))
        nodes = nodes.select(F.explode(F.when(F.col("high") - F.col("low") > 1, halves).otherwise(leaf)).alias("node")).select("node.*")
    return nodes.select(F.col("low").alias("shard"), F.inline("held")).select("source", "shard", "n")


def _split(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """``units`` (source, block, copy) with the ``shard`` each goes to.

    The units of a source in permuted order go to the shards by its quotas, so
    each unit is in one shard, and which of them a shard gets is left to chance.
    """
    counts = staged(units.groupBy("source").agg(F.count("*").alias("n")), "units")
    shares = quotas(counts, shards, seed).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("shares"))
    before = F.aggregate(
        "shares",
        F.array(F.lit(0).cast("bigint")),
        lambda sums, share: F.concat(sums, F.array(F.element_at(sums, -1) + share["n"])),
    )
    ends = staged(shares.select(F.col("source").alias("of"), F.slice(before, F.lit(2), F.lit(shards)).alias("ends")), "quotas")
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", "copy", F.lit(seed), F.lit("permuted")), "block", "copy")
    placed = units.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint"))
    placed = placed.join(ends, F.col("source").eqNullSafe(F.col("of")))
    return placed.select(*units.columns, F.size(F.filter("ends", lambda end: end <= F.col("rank"))).alias("shard"))


def plan(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), shards: int = 8, seed: int = 1) -> DataFrame:
    """What is drawn of each block, from rows (source, size, draw), ``draw`` being a hash of the document.

    Returns (source, block, source_size, target, n_blocks, passes, extra, need, shards):
    ``passes`` whole copies, and one more of the whole block (``extra`` 'all'),
    of some documents of it ('part') or of none ('none'). ``need`` is the number of words
    that a source's partly drawn blocks give together; ``shards`` names the shard of each copy.
    """
    goals = targets(sizes, weights).withColumns(
        {
            "n_blocks": F.ceil(F.sqrt("n_docs")).cast("long"),
            "passes": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"),
        }
    )
    goals = goals.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    goals = staged(goals, "goals")
    block = F.pmod("draw", F.col("n_blocks"))
    blocks = (
        sizes.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("block", block)
        .groupBy("source", "block", "source_size", "target", "n_blocks", "passes", "rest")
        .agg(F.sum("size").alias("words"))
    )
    permuted = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(seed)))
    before = F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"before": before, "at": F.row_number().over(permuted), "need": F.col("rest") - F.col("before")})
    # The first block that is not needed whole; it and a few after it are drawn in part.
    of_source = Window.partitionBy("source")
    blocks = blocks.withColumn("edge", F.min(F.when(F.col("need") < F.col("words"), F.col("at"))).over(of_source))
    edge_need = F.max(F.when(F.col("at") == F.col("edge"), F.col("need"))).over(of_source)
    near_edge = F.col("at").between(F.col("edge"), F.col("edge") + PARTIAL_BLOCKS - 1) & (edge_need > 0)
    extra = F.when(F.coalesce(F.col("at") < F.col("edge"), F.lit(True)), "all").when(near_edge, "part").otherwise("none")
    blocks = staged(blocks.withColumns({"extra": extra, "need": edge_need}), "blocks")

    copies = F.col("passes") + F.when(F.col("extra") == "none", 0).otherwise(1)
    units = blocks.where(copies > 0).select("source", "block", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    dealt = _split(units, shards, seed)
    dealt = dealt.groupBy("source", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda c: c["shard"]).alias("shards")
    )
    dealt = dealt.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "shards")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    of_block = blocks.join(dealt, same, "left").withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
    return staged(
        of_block.select("source", "block", "source_size", "target", "n_blocks", "passes", "extra", "need", "shards"), "plan"
    )


def _with_remainder(part: DataFrame, tries: int = 3) -> DataFrame:
    """For documents of partly drawn blocks, whether each is drawn once more: ``more``.

    In permuted order documents are taken while they fit; later ones that fit
    what is then left are tried again, and at last one that halves the rest at least.
    """
    block = Window.partitionBy("source")
    part = part.withColumns({"more": F.lit(False), "left": F.col("need")})
    for _ in range(tries):
        fits = ~F.col("more") & (F.col("size") > 0) & (F.col("size") <= F.col("left"))
        order = block.orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        part = part.withColumn("sum", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(order))
        part = part.withColumn("more", F.col("more") | (fits & (F.col("sum") <= F.col("left"))))
        taken = F.sum(F.when(F.col("more"), F.col("size")).otherwise(0)).over(block)
        part = part.withColumn("left", F.col("need") - taken)
    open_size = F.when(~F.col("more") & (F.col("size") > 0), F.col("size"))
    first = F.row_number().over(block.orderBy(open_size.asc_nulls_last(), "draw")) == 1
    closer = first & open_size.isNotNull() & (F.col("size") < 2 * F.col("left"))
    return part.withColumn("last", closer).withColumn("more", F.col("more") | F.col("last")).drop("sum", "left", "last")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    shards: int = 8,
    seed: int = 1,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """The columns of ``docs`` with size, source_size, target, taken and shards.

    ``taken`` is the document's size times the number of copies the mix takes
    of it, never more than ``MOST_PASSES``; ``shards`` has the output shard of each copy. A document
    without words is never taken. A NULL text has no words, a NULL source is a
    source of its own. The draw goes by a hash of doc_id, or of the text where
    the id is NULL, so reruns agree. Columns of the names added are replaced.
    """
    draw = F.when(F.col(doc_id).isNull(), F.xxhash64(text, F.lit(seed))).otherwise(F.xxhash64(doc_id, F.lit(seed)))
    added = ("size", "source_size", "target", "taken", "shards")
    columns = [c for c in docs.columns if c not in added]
    given = docs.select(carried(columns).alias("own"), words(text).alias("size"), draw.alias("draw"), F.col(source).alias("source"))
    sizes = staged(given.select("source", "size", "draw"), "sizes")
    drawn = plan(sizes, weights, shards, seed)

    counts = drawn.select(F.col("source").alias("of"), "n_blocks").distinct()
    blocked = given.join(counts, F.col("source").eqNullSafe(F.col("of")))
    blocked = blocked.withColumn("block", F.pmod("draw", F.col("n_blocks"))).drop("of", "n_blocks")
    of_block = drawn.select(
        F.col("source").alias("of"), F.col("block").alias("at"), "source_size", "target", "passes", "extra", "need", "shards"
    )
    joined = blocked.join(of_block, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at")
    whole = joined.where("extra <> 'part'").withColumn("more", F.col("extra") == "all")
    result = whole.unionByName(_with_remainder(joined.where("extra = 'part'")).select(whole.columns))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("more").cast("int")).otherwise(0)
    return result.select(
        *(F.col("own")[c].alias(c) for c in columns),
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        (F.col("size") * copies).alias("taken"),
        F.slice("shards", F.lit(1), copies).alias("shards"),
    )


def deal(mixed: DataFrame, doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """The mix itself: one row per copy with its ``shard``, shuffled within the shard.

    A shard is cut into ``PIECES`` by the leading bits of a hash and sorted by
    it within each, so its pieces in order are one shuffled run and no task
    holds a whole shard. For larger inputs choose more shards.
    """
    columns = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken", "shards", "shard")]
    given = mixed.select(carried(columns).alias("own"), F.col(doc_id).alias("id"), F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64("id", "copy", "shard", F.lit(seed))
    piece = F.pmod(F.shiftright(order, 48), F.lit(PIECES))
    copies = given.repartition("shard", piece).sortWithinPartitions("shard", piece, order)
    return copies.select(*(F.col("own")[c].alias(c) for c in columns), "shard")
