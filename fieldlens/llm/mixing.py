"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

The documents of a source, in the order of a hash of their ids, are one stream of
words, cut into blocks of equal length.  Slots of the schedule take van der
Corput points; a point falls into a source's part of the summed-up targets, and
the slot's rank among the source's slots names the block that it takes, going
round the stream again when it ends.  A source whose points come a few short gets
its last slots at the end of the schedule, and the last block is taken as far as
the target goes, so each source gives its target to the word.

Positions within a source and ranks of slots are sums over buckets plus sums
within a bucket, and sources are numbered and summed up by ranges of them, so no
task holds a whole source, nor all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, free_name, stored, text_or_empty

#: Bits of a van der Corput point, least bits of the cells by which points look up their source, and sources of a range.
POINT_BITS, CELL_BITS, RANGE = 40, 10, 10_000
#: Documents, and slots, of a bucket; there are at most MAX_BUCKETS buckets.
BUCKET, MAX_BUCKETS = 200, 65_536
SOURCE = ["no_source", "source"]


def van_der_corput(n: Column) -> Column:
    """The binary digits of ``n`` mirrored, as an integer below 2 ** POINT_BITS."""
    return F.conv(F.reverse(F.lpad(F.bin(n), POINT_BITS, "0")), 2, 10).cast("long")


def running(df: DataFrame, order: list[str], ranges: int, **sums: str) -> DataFrame:
    """``df`` with ``number``, its rows' places from 0 in ``order``, and the sum of a column over the rows before, for each of ``sums``.

    Rows are dealt into ranges; a row a range is all that is summed up in one task.
    """
    ranged = stored(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c)
    offsets = totals.select("_part", offset("_n"), *(offset(f"_{name}") for name in sums))
    own = Window.partitionBy("_part").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.withColumn("number", F.row_number().over(own) - 1).withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()})
    out = numbered.join(F.broadcast(offsets), "_part")
    return out.withColumns({"number": F.col("number") + F.col("_n")} | {name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_part", "_n", *(f"_{name}" for name in sums))


class Mix:
    """A mix of ``df`` of ``epochs`` times its words.

    Sources, by code point, null last, weigh ``weights``, repeating.  A source's
    target stops at ``repeats`` times its size; the excess goes to the others by
    weight, until none is above.  Null texts have size 0.  Repeated rows are
    documents of their own, null ids are hashed as empty text; documents that
    share id and size are in no certain order.  Other columns are left out, but
    for ``repeated``, which needs ``carry``, whatever their names.  An empty
    table, or one without words, gives targets of 0.
    """

    def __init__(
        self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), epochs: float = 1.5, repeats: int = 2, block: int = 4096, carry: bool = False,
    ):
        self.spark, self.block, self.columns = df.sparkSession, block, df.columns
        self.row = free_name(df, "_mix_row")
        df = df.withColumn(self.row, F.monotonically_increasing_id())
        self.docs = df = stored(df, "mix-docs") if carry else df
        source = F.col(f"`{source_col}`").cast("string")
        size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
        sized = df.select(
            F.col(f"`{self.row}`").alias("row"), F.col(f"`{id_col}`").alias("doc_id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"), size.alias("size")
        )
        self.sized = stored(sized, "mix-sizes")
        per = self.sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        per = stored(per, "mix-sources")
        words, docs, sources = (x or 0 for x in per.agg(F.sum("source_size"), F.sum("n"), F.count("*")).first())
        self.ranges = -(-sources // RANGE) or 1
        self.cell_bits = max(CELL_BITS, sources.bit_length() + 1)
        self.sources = stored(self._targets(per, words * float(epochs), weights, repeats), "mix-targets")
        self.buckets = min(MAX_BUCKETS, -(-docs // BUCKET) or 1)

    def _targets(self, per: DataFrame, goal: float, weights: tuple[int, ...], repeats: int) -> DataFrame:
        """Water-filling in closed form: by rising cap per weight, a source is capped while the level reaches its cap."""
        numbered = running(per, SOURCE, self.ranges).withColumnRenamed("number", "place")
        weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
        cap = F.col("source_size") * repeats
        weighed = weighed.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
        filled = stored(running(weighed, ["ratio", "place"], self.ranges, before="cap", lighter="weight").drop("number"), "mix-levels")
        weight = filled.agg(F.sum("weight")).first()[0] or 0
        levels = filled.withColumn("level", (F.lit(goal) - F.col("before")) / (F.lit(weight) - F.col("lighter")))
        least = levels.where("ratio > level").agg(F.min(F.struct("ratio", "place", "level")).alias("x")).select("x.level").first()[0]
        capped = F.col("cap").cast("double")
        target = capped if least is None else F.least(capped, F.lit(least) * F.col("weight"))
        out = filled.withColumn("target", target).withColumn("quota", F.floor(F.col("target") + 0.5))
        b = F.lit(self.block)
        blocks = F.ceil(F.col("source_size") / b)
        # whole rounds of the source's blocks, then as many as the rest needs
        rounds = F.floor(F.col("quota") / F.greatest("source_size", F.lit(1)))
        slots = rounds * blocks + F.ceil((F.col("quota") - rounds * F.col("source_size")) / b)
        out = running(out, ["place"], self.ranges, low="quota").drop("number").withColumnRenamed("place", "number")
        return out.select(*SOURCE, "number", "source_size", "target", "quota", blocks.alias("blocks"), slots.alias("slots"), "low", (F.col("low") + F.col("quota")).alias("high"))

    def schedule(self) -> DataFrame:
        """A row a slot: slot, source, rank, and the words that it takes: block, first word there, number."""
        s = self.sources
        count, words = (x or 0 for x in s.agg(F.sum("slots"), F.sum("quota")).first())
        cells = 1 << self.cell_bits
        cell = lambda at: F.floor(F.col(at) / F.lit(max(words, 1)) * cells)
        table = s.where("quota > 0").select(
            "number", "low", "high", F.explode(F.sequence(F.greatest(cell("low") - 1, F.lit(0)), F.least(cell("high") + 1, F.lit(cells - 1)))).alias("cell")
        )
        point = van_der_corput(F.col("id"))
        points = self.spark.range(count).select(F.col("id").alias("slot"), point.alias("point")).select(
            "slot", F.shiftright("point", POINT_BITS - self.cell_bits).cast("long").alias("cell"),
            F.floor(F.col("point") / F.lit(float(1 << POINT_BITS)) * words).alias("at"),
        )
        mapped = points.join(table, "cell").where("at >= low and at < high").select("slot", "number")
        span = max(64, -(-count // MAX_BUCKETS))
        mapped = mapped.withColumn("chunk", F.floor(F.col("slot") / span))
        per = mapped.groupBy("number", "chunk").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select("number", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), "n")
        own = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot")) - 1
        ranked = mapped.select("slot", "number", "chunk", own.alias("own")).join(per.drop("n"), ["number", "chunk"]).select("slot", "number", (F.col("before") + F.col("own")).alias("rank"))
        got = per.groupBy("number").agg(F.sum("n").alias("got"))
        short = s.join(got, "number", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
        late = short.select(F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"), "number").select(
            (F.lit(count) + F.col("rank")).alias("slot"), "number", "rank"
        )
        all_slots = ranked.union(late).join(s.select("number", *SOURCE, "source_size", "quota", "blocks", "slots"), "number").where("rank < slots")
        rounds, block = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
        first = block * self.block
        start = rounds * F.col("source_size") + first
        take = F.least(F.lit(self.block), F.col("source_size") - first, F.col("quota") - start)
        return all_slots.select("slot", *SOURCE, "rank", block.alias("block"), first.alias("first"), take.alias("take"))

    def placed(self) -> DataFrame:
        """A row a document, with the place of its words in its source's stream."""
        digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size"))
        at = F.conv(F.substring("digest", 1, 4), 16, 10).cast("long")
        docs = self.sized.withColumn("digest", digest).withColumn("bucket", F.floor(at * self.buckets / 65_536))
        key = [*SOURCE, "bucket"]
        before = Window.partitionBy(*SOURCE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = docs.groupBy(*key).agg(F.sum("size").alias("words")).withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
        sums = stored(sums.join(self.sources, SOURCE).select(*key, "offset", "source_size", "target"), "mix-buckets")
        order = Window.partitionBy(*key).orderBy("digest", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
        own = docs.withColumn("within", F.sum("size").over(order))
        # buckets grow with the documents: a merge join at every size, never a broadcast
        return own.join(sums.hint("merge"), key).withColumn("start", F.col("offset") + F.col("within") - F.col("size"))

    def _rows(self) -> DataFrame:
        """A row a document: row, doc_id, size, source_size, target, start, taken."""
        used = self.schedule().groupBy(*SOURCE, "block").agg(F.collect_list("take").alias("takes"))
        first = F.floor(F.col("start") / self.block)
        last = F.floor((F.col("start") + F.col("size") - 1) / self.block)
        docs = self.placed().withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
        at = F.col("block") * self.block
        lower, upper = F.greatest(F.col("start"), at), F.least(F.col("start") + F.col("size"), at + self.block)
        overlap = F.aggregate(
            F.coalesce("takes", F.array().cast("array<long>")), F.lit(0).cast("long"),
            lambda sum_, take: sum_ + F.greatest(F.least(upper, at + take) - lower, F.lit(0).cast("long")),
        )
        hit = docs.join(used.hint("merge"), [*SOURCE, "block"], "left").withColumn("taken", F.when(F.col("size") > 0, overlap).otherwise(F.lit(0)))
        return hit.groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "start")), F.sum("taken").alias("taken"))

    def taken(self) -> DataFrame:
        """A row a document: doc_id, size, source_size, target, taken."""
        return self._rows().select("doc_id", "size", "source_size", "target", "taken")

    def repeated(self) -> DataFrame:
        """The rows of the table, each as often as the mix takes most of it: taken words over size, to the nearest whole number.

        Only the last document that a source's target reaches isn't taken whole.
        A source that the mix takes anything of keeps at least its first document.
        Rows without words, of which a mix of words takes nothing, are left out.
        """
        times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
        times = F.greatest(times, ((F.col("start") == 0) & (F.col("taken") > 0)).cast("int"))
        whole = self._rows().where("size > 0").select(F.col("row").alias(self.row), times.alias("times")).where("times > 0")
        # a row for each document that is taken: a merge join at every size, never a broadcast
        joined = self.docs.select(F.struct(*(f"`{c}`" for c in self.columns)).alias("doc"), self.row).join(whole.hint("merge"), self.row)
        return joined.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select(*(F.col(f"doc.`{c}`") for c in self.columns))
