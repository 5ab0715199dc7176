"""Texts whose shingle sets are similar, by fingerprints of samples of their shingles.

Fingerprints of whole texts can't tell texts of similarity 0.8 from others on a
grid: they lie ten to fifteen of 64 bits apart.  So a text's shingle set is
sampled ``BANDS`` times, each time the ``SAMPLE`` shingles that come first in an
order of that band's own, and each sample has its own SimHash fingerprint.  Equal
samples have equal fingerprints; two sets of Jaccard similarity s share a band's
sample with a probability of about s ** SAMPLE, so at 0.8 one pair in 600 shares
none of sixteen.

The fingerprints are embedded as segment counts, and the grid join under
Manhattan distance finds all that are within ``RADIUS``; those that link,
transitively, are one class.  Other samples are some twelve bits apart, so a
wider radius would add nothing but chance.

Texts that share a band's class, a bucket, are compared by their whole
shingle sets, 32 bits of each shingle's hash.  In every bucket each text first
meets the bucket's first one, in a bucket of more than ``BUCKET`` texts
``CENTRES`` others too; what that links needs no further comparison.  Then, in
a bucket of up to ``BUCKET`` texts, all that aren't in one group yet meet each
other.  In a larger one, those that aren't in its largest group are dealt into
buckets that share a further band as well, and so on.  So a text has a bounded
number of partners in a bucket, and buckets shrink with each band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored
from .components import connected_components

BANDS, SAMPLE, BUCKET, CENTRES = 16, 5, 64, 4
#: Bits that two fingerprints of a class may differ in.
RADIUS = 1


def shingle_set(hashes):
    """The different hashes, their first 32 bits, as signed numbers."""
    import numpy as np

    return np.unique((hashes >> np.uint64(32)).astype(np.uint32)).view(np.int32)


_orders: list = []


def samples(hashes) -> list[int]:
    """The fingerprints of the samples of a set of shingles."""
    import numpy as np

    from .simhash import majority

    h = np.unique(hashes)
    if len(h) <= SAMPLE:
        return [majority(h)] * BANDS
    if not _orders:  # two odd factors for each band's order
        _orders.append(np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    one, two = _orders[0]
    mixed, out = h ^ (h >> np.uint64(32)), []
    at_once = max(1, 400_000 // len(h))
    for k in range(0, BANDS, at_once):
        order = mixed * one[k : k + at_once]
        order ^= order >> np.uint64(29)
        order *= two[k : k + at_once]
        first = np.argpartition(order, SAMPLE - 1, axis=1)[:, :SAMPLE]
        bits = np.unpackbits(h[first].view(np.uint8), axis=1, bitorder="little").reshape(-1, SAMPLE, 64)
        out.append(np.packbits(2 * bits.sum(axis=1, dtype=np.int64) > SAMPLE, axis=1, bitorder="little").view(np.int64).ravel())
    return np.concatenate(out).tolist()


def jaccard(a, b):
    """Similarity of two arrays of different values; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def classed(keys: DataFrame) -> DataFrame:
    """``keys`` with each ``print`` replaced by the smallest one of its class: those that the grid join links, transitively."""
    from .simhash import links

    near = stored(links(keys.select(F.col("print").alias("fp")).distinct(), RADIUS), "similar-near-prints")
    if near.isEmpty():
        return keys
    same = connected_components(near).withColumnRenamed("node", "print")
    return keys.join(same, "print", "left").withColumn("print", F.coalesce("root", "print")).drop("root")


def components(points: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the rows of ``points`` (row, shingles, samples) that link; root is the smallest row of a group."""
    size, text = F.size("shingles").alias("size"), F.struct("row", "size")
    keys = classed(points.select("row", size, F.posexplode("samples").alias("band", "print")))
    shared = keys.groupBy("band", "print").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    prints = stored(keys.join(shared, ["band", "print"]).select("row", "size", "band", "print"), "similar-prints")
    sets = stored(points.select("row", "shingles").join(prints.select("row").distinct(), "row", "left_semi"), "similar-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, size_a, size_b), those that are similar; sizes tell most others."""
        likely = F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b")
        pairs = pairs.where(likely).select("a", "b").distinct()
        one = sets.select(F.col("row").alias("b"), F.col("shingles").alias("y"))
        two = sets.select(F.col("row").alias("a"), F.col("shingles").alias("x"))
        near = pairs.join(one, "b").join(two, "a").where(jaccard(F.col("x"), F.col("y")) >= similarity)
        return stored(near.select("a", "b"), "similar-links")

    def to(first: str, df: DataFrame) -> DataFrame:
        other = F.col(first)
        return df.where(F.col("row") != other.row).select(F.col("row").alias("a"), other.row.alias("b"), F.col("size").alias("size_a"), other.size.alias("size_b"))

    linked = verified(to("t", prints.where("false").withColumn("t", text)))
    roots = connected_components(linked)
    centres = F.array(*(F.min_by(text, F.xxhash64("row", F.lit(i))) for i in range(CENTRES)))
    active = prints.select(F.xxhash64("band", "print").alias("key"), "band", "row", "size")
    while True:
        per = active.groupBy("key").agg(F.count("*").alias("n"), F.min(text).alias("first"), centres.alias("centres")).where("n > 1")
        active = stored(active.join(per, "key"), "similar-buckets")
        if active.isEmpty():
            return roots
        large = active.where(F.col("n") > BUCKET)
        linked = linked.union(verified(to("first", active).union(to("centre", large.withColumn("centre", F.explode("centres"))))))
        roots = connected_components(linked)
        own = roots.select(F.col("node").alias("row"), "root")
        rooted = active.drop("first", "centres").join(own, "row", "left").withColumn("root", F.coalesce("root", "row"))
        rooted = stored(rooted, "similar-rooted")
        a, b = (rooted.where(F.col("n") <= BUCKET).select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("row", "size", "root"))) for s in "ab")
        pairs = a.join(b, [a.key == b.key, F.col("row_a") < F.col("row_b"), F.col("root_a") != F.col("root_b")])
        more = verified(pairs.select(F.col("row_a").alias("a"), F.col("row_b").alias("b"), "size_a", "size_b"))
        if not more.isEmpty():
            linked = linked.union(more)
            roots = connected_components(linked)
        large = rooted.where(F.col("n") > BUCKET)
        groups = large.groupBy("key", "root").agg(F.count("*").alias("of"))
        largest = groups.groupBy("key").agg(F.max_by("root", F.struct("of", "root")).alias("largest"))
        rest = large.join(largest, "key").where("root <> largest").select("key", "band", "row", "size")
        further = prints.select("row", F.col("band").alias("next"), "print")
        active = rest.join(further, "row").where("next > band").select(F.xxhash64("key", "next", "print").alias("key"), F.col("next").alias("band"), "row", "size")
