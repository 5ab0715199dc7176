"""SimHash near-dedup over a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the bit counts of its 32 two-bit segments.
One differing bit changes one count by one, so the Manhattan distance of two
embeddings is a lower bound of the Hamming distance.  The range join under that
distance runs on a grid: the 32 axes are cut into ``radius + 3`` groups, a
distance of at most ``radius`` leaves at least three groups untouched, so two
near points share a unit cell in one of the projections onto three groups.  The
points of a cell are paired, the lower bound filters the pairs, and the exact
distance verifies them.

A cell of more than ``CELL`` points is divided further: its points are dealt into
finer cells, over segments of one bit, of which a pair within the radius leaves
all but two groups untouched; first ten groups, then, where even those cells are
full, one for each axis, whose cells hold at most sixteen points.  So a point has
a bounded number of partners, however many near copies there are.

With ``similarity``, documents link if their sets of word shingles have at least
that Jaccard similarity.  Then a document has fingerprints of samples of its
shingles; the same embedding and grid join find those that are near each other,
and whole shingle sets verify (see ``similar``).
"""

from __future__ import annotations

from itertools import combinations, repeat

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similar
from ._common import binary_list, free_name, lean, slices, small_batches, stored
from .components import connected_components, salted_join

SEGMENTS = 32
#: The low bit of each two-bit segment.
LOW = 0x5555555555555555
#: Largest Hamming distance of a link, and points of a cell that are paired.
RADIUS = 2
CELL = 64
#: Groups of axes of the finer grids; a pair within the radius differs in two groups at most.  Points of a cell that leaves two axes open.
FINER, LAST = [10, SEGMENTS], 16


def shingle_hashes(text: bytes, words: int):
    """XXH64, seed 42, of the word shingles of a text, repeats included; a text of fewer words is one shingle, one without words has none."""
    import numpy as np
    import xxhash

    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)


def majority(h) -> int:
    """The bits that are set in over half of the hashes; none without hashes."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        part = h[k : k + 4096]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of word shingles: a bit is set if it is in over half of the hashes."""
    return majority(shingle_hashes(text, words))


def _fingerprints(text_at: int, keep: list[int], words: int, names: list[str], similarity: float | None):
    def run(batches):
        import pyarrow as pa

        task = TaskContext.get()
        serial = (task.partitionId() if task else 0) << 40
        for b in (part for batch in batches for part in slices(batch)):
            hashes = [shingle_hashes(t, words) for t in binary_list(b.column(text_at))]
            rows = range(serial, serial + len(hashes))
            serial += len(hashes)
            parts = {"row": pa.array(rows, pa.int64()), "fp": pa.array([majority(h) for h in hashes], pa.int64())}
            if similarity is not None:
                parts["shingles"] = pa.array([similar.shingle_set(h) for h in hashes], pa.list_(pa.int32()))
                parts["samples"] = pa.array([similar.samples(h) for h in hashes], pa.list_(pa.int64()))
            meta = pa.StructArray.from_arrays(list(parts.values()), names=list(parts))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), meta], names=names)

    return run


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 segments, each in the two bits of its segment."""
    hi, lo = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW)), fp.bitwiseAND(F.lit(LOW))
    return hi.bitwiseXOR(lo).bitwiseOR(F.shiftleft(hi.bitwiseAND(lo), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two embeddings: counts that differ by one have an odd difference pattern."""
    x = a.bitwiseXOR(b)
    odd = x.bitwiseAND(F.lit(LOW))
    two = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW)).bitwiseAND(F.bitwise_not(odd))
    return F.bit_count(odd) + 2 * F.bit_count(two)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bits(groups: int) -> list[int]:
    """The bits of each of so many groups of axes."""
    bits = [0] * groups
    for segment in range(SEGMENTS):
        bits[segment * groups // SEGMENTS] |= 3 << (2 * segment)
    return bits


def cell_masks(radius: int = RADIUS) -> list[int]:
    """For each projection onto three of ``radius + 3`` groups of axes, the bits of the embedding that it keeps."""
    return [_signed(a | b | c) for a, b, c in combinations(_bits(radius + 3), 3)]


def finer_masks(n: int, radius: int = RADIUS) -> list[int]:
    """For each ``radius`` of ``n`` groups of axes, the bits of the fingerprint outside them."""
    return [_signed(~sum(left) & (1 << 64) - 1) for left in combinations(_bits(n), radius)]


def _cell_pairs(cells: DataFrame, most: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b of the cells of up to ``most`` points that pass both distances, cells that are fuller) of ``cells`` (fp, projection, cell).

    Most cells that aren't alone hold two points, which the count finds beside it; only fuller ones are gathered.
    """
    key = ["projection", "cell"]
    counted = cells.groupBy(*key).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    counted = stored(counted.where("n > 1"), "simhash-cells")
    pairs, few = counted.where("n = 2").select("a", "b"), counted.where((F.col("n") > 2) & (F.col("n") <= most)).select(*key)
    if not few.isEmpty():
        small = cells.join(few, key, "left_semi").groupBy(*key).agg(F.collect_list("fp").alias("fps"))
        pairs = pairs.union(small.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where("a < b"))
    a, b = F.col("a"), F.col("b")
    near = pairs.where(manhattan(embedding(a), embedding(b)) <= radius).where(F.bit_count(a.bitwiseXOR(b)) <= radius)
    return near, counted.where(F.col("n") > most).select(*key)


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between all different fingerprints ``points`` (fp: long) that are at most ``radius`` (1 or 2) bits apart."""
    dealt = lambda df, of, masks: df.select("fp", F.posexplode(F.array(*(of.bitwiseAND(F.lit(m)) for m in masks))).alias("projection", "cell"))
    cells = dealt(points, embedding(F.col("fp")), cell_masks(radius))
    found, full = _cell_pairs(cells, CELL, radius)
    for n in FINER:
        if full.isEmpty():
            break
        dense = stored(cells.join(full, ["projection", "cell"], "left_semi").select("fp").distinct(), "simhash-dense")
        cells = dealt(dense, F.col("fp"), finer_masks(n, radius))
        more, full = _cell_pairs(cells, CELL if n < SEGMENTS else LAST, radius)
        found = found.union(more)
    return found.distinct()


class SimHashDedup:
    """Near-duplicate groups of ``df``: documents that link, transitively.

    Without ``similarity``, documents link if their fingerprints of ``words``-word
    shingles, repeats included, differ in two bits at most; null and empty texts
    have fingerprint zero, which links like any other.  With it, they link if
    their shingle sets are that similar; texts without words link with each
    other.  Texts of fewer words than a shingle count as one shingle.  Repeated
    rows are rows of their own in one group.  Null ids are greater than any other
    here: a component's id is null only if all its ids are.  Other columns are
    carried along if ``carry`` is set, whatever their names.  An empty table gives
    an empty result.
    """

    def __init__(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, carry: bool = False, similarity: float | None = None):
        small_batches(df.sparkSession)
        self.id_col = id_col
        self.columns = df.columns if carry else [id_col]
        self.meta = free_name(df, "_simhash")
        keep = [df.columns.index(c) for c in self.columns]
        fields = [T.StructField(c, df.schema[c].dataType) for c in self.columns]
        more = "" if similarity is None else ", shingles array<int>, samples array<long>"
        schema = T.StructType([*fields, T.StructField(self.meta, T.StructType.fromDDL("row long, fp long" + more))])
        run = _fingerprints(df.columns.index(text_col), keep, words, schema.names, similarity)
        self.docs = stored(df.mapInArrow(lean(run), schema), "simhash-docs")
        m = lambda f: F.col(f"`{self.meta}`.{f}").alias(f)
        id_ = F.col(f"`{id_col}`").alias("id")
        #: What a group is found by: the fingerprint, or the row where texts link by themselves.
        self.key = "fp" if similarity is None else "row"
        if similarity is None:
            points = stored(self.docs.select(m("fp"), id_).groupBy("fp").agg(F.min("id").alias("id")), "simhash-points")
            roots = connected_components(stored(links(points.select("fp")), "simhash-links"))
        else:
            points = self.docs.select(m("row"), id_)
            roots = similar.components(self.docs.select(m("row"), m("shingles"), m("samples")), similarity)
        named = points.withColumnRenamed(self.key, "node").join(roots, "node").select("node", "root", "id")
        #: Nodes that link: node, root.
        self.roots = roots
        self.least = stored(named.groupBy("root").agg(F.min("id").alias("component_id")), "simhash-least")

    def _rooted(self) -> DataFrame:
        """A row for each input row: id, row, fp, root (null where nothing links)."""
        m = lambda f: F.col(f"`{self.meta}`.{f}").alias(f)
        rows = self.docs.select(F.col(f"`{self.id_col}`").alias("id"), m("row"), m("fp"))
        return salted_join(rows, self.roots.withColumnRenamed("node", self.key), self.key, "row", "left")

    def members(self) -> DataFrame:
        """A row for each input row: id, fingerprint (16 hex digits), component_id."""
        rows = self._rooted()
        hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
        # rows that link to nothing else: all of one fingerprint, or one row
        alone = rows.where("root is null")
        own = alone.groupBy(self.key).agg(F.min("id").alias("component_id"))
        alone = salted_join(alone, own, self.key, "row").select("id", hexed, "component_id")
        linked = salted_join(rows.where("root is not null"), self.least, "root", "row").select("id", hexed, "component_id")
        return alone.union(linked).withColumnRenamed("id", self.id_col)

    def kept(self) -> DataFrame:
        """One row of each group, that of the smallest id, with the columns of the input."""
        group = F.struct("root", F.when(F.col("root").isNull(), F.col(self.key)).alias("own"))
        first = self._rooted().groupBy(group.alias("group")).agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
        # a row for each document that stays: a merge join at every size, never a broadcast
        first = first.select(F.col("first.row").alias(f"{self.meta}_row")).hint("merge")
        out = self.docs.join(first, F.col(f"`{self.meta}`.row") == F.col(f"`{self.meta}_row`"), "left_semi")
        return out.select(*(f"`{c}`" for c in self.columns))
