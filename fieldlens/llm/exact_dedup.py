"""Exact dedup by Grace hash partitioning.

Two levels, both on complete contents:

1. Each task groups the rows of its own split (bounded chunks), so however often
   a text occurs, a task sends it on once a chunk.
2. The representatives are dealt out by digest.  A task puts its bucket into an
   open-addressing table that compares whole texts.  When the table's texts pass
   the memory bound, the contents it doesn't hold are dealt to spill files by the
   next digest bits, and each file is handled the same way, recursively.

The decisions go back to the members by a join on a key that is unique on both
sides, so a text that makes up a third of all rows stays spread.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import binary_list, free_name, lean, small_batches, stored

#: Bytes of distinct text that one table holds.
TABLE_BYTES = 48 << 20
#: Spill files at each level: one for each value of four digest bits.
FANOUT_BITS = 4


class OpenTable:
    """Open addressing with linear probing; entries are equal only if the complete texts are."""

    def __init__(self, capacity: int = 1024):
        self.slots = [-1] * capacity
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, text: bytes) -> tuple[int, int]:
        """(entry, slot): entry is -1 where the text isn't held."""
        slots, hashes, texts, mask = self.slots, self.hashes, self.texts, len(self.slots) - 1
        at = h & mask
        while (entry := slots[at]) >= 0:
            if hashes[entry] == h and texts[entry] == text:
                return entry, at
            at = (at + 1) & mask
        return -1, at

    def add(self, h: int, text: bytes, slot: int) -> int:
        entry = len(self.texts)
        self.slots[slot] = entry
        self.hashes.append(h)
        self.texts.append(text)
        self.bytes += len(text) + 64
        if 2 * entry >= len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        size = 2 * len(self.slots)
        self.slots, mask = [-1] * size, size - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def local_dir() -> str | None:
    """The folder that Spark gives a task for its own files, if it says so."""
    first = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return first if os.path.isdir(first) else None


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


def grace_groups(records, table_bytes: int = TABLE_BYTES, level: int = 0):
    """Groups of records with equal texts, from an iterator of (digest, text, value).

    Yields lists of values.  Memory holds at most ``table_bytes`` of distinct
    texts (one text at least); the rest goes through spill files, which are
    removed when they have been read, also after an error.
    """
    table, groups, folder, files = OpenTable(), [], None, {}
    try:
        for digest, text, value in records:
            h = _hash(digest)
            entry, slot = table.find(h, text)
            if entry >= 0:
                groups[entry].append(value)
            elif table.bytes < table_bytes or level * FANOUT_BITS >= 8 * len(digest) - 64:
                table.add(h, text, slot)
                groups.append([value])
            else:
                if folder is None:
                    folder = tempfile.mkdtemp(prefix="grace-", dir=local_dir())
                nibble = (int.from_bytes(digest[8:], "little") >> (level * FANOUT_BITS)) & ((1 << FANOUT_BITS) - 1)
                if nibble not in files:
                    files[nibble] = open(os.path.join(folder, str(nibble)), "wb")
                pickle.dump((digest, text, value), files[nibble], protocol=5)
        for f in files.values():
            f.close()
        yield from groups
        table = groups = None
        for nibble in sorted(files):
            path = os.path.join(folder, str(nibble))
            yield from grace_groups(_reread(path), table_bytes, level + 1)
            os.remove(path)
    finally:
        for f in files.values():
            f.close()
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _reread(path: str):
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _local_groups(text_at: int, id_at: int, schema, chunk_bytes: int):
    """mapInArrow function: one row a distinct text of a chunk, with the chunk's member ids."""

    def run(batches):
        import pyarrow as pa

        task = TaskContext.get()
        serial = (task.partitionId() if task else 0) << 40
        held, size = [], 0

        def flush():
            nonlocal held, size, serial
            table = pa.Table.from_batches(held)
            texts = binary_list(table.column(text_at).combine_chunks())
            ids = table.column(id_at).to_pylist()
            groups, members, digests = OpenTable(), [], []
            for row, text in enumerate(texts):
                digest = hashlib.sha256(text).digest()
                h = _hash(digest)
                entry, slot = groups.find(h, text)
                if entry < 0:
                    groups.add(h, text, slot)
                    members.append([row])
                    digests.append(digest.hex())
                else:
                    members[entry].append(row)
            best = [max(range(len(m)), key=lambda k: (ids[m[k]] is not None, ids[m[k]] or 0, -k)) for m in members]
            kept = table.take(pa.array([m[k] for m, k in zip(members, best, strict=True)], pa.int64()))
            n = len(members)
            meta = pa.StructArray.from_arrays(
                [
                    pa.array(range(serial, serial + n), pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array([ids[m[k]] for m, k in zip(members, best, strict=True)], pa.int64()),
                    pa.array(best, pa.int32()),
                    pa.array([[ids[r] for r in m] for m in members], pa.list_(pa.int64())),
                ],
                names=["rep", "digest", "max_id", "best", "ids"],
            )
            serial += n
            held, size = [], 0
            out = pa.Table.from_arrays([*(kept.column(i) for i in range(kept.num_columns)), pa.chunked_array([meta])], names=schema)
            yield from out.combine_chunks().to_batches(max_chunksize=2000)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= chunk_bytes:
                yield from flush()
        if held and sum(b.num_rows for b in held):
            yield from flush()

    return run


def _decide(table_bytes: int):
    """mapInArrow function over one digest bucket: the row that stays, for each representative."""

    def run(batches):
        import pyarrow as pa

        def records():
            for b in batches:
                for digest, text, *value in zip(
                    b.column(0).to_pylist(), binary_list(b.column(1)), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True
                ):
                    yield bytes.fromhex(digest), text, tuple(value)

        names = ["rep", "winner", "keep_id", "group_size"]
        out: list[tuple] = []

        def batch():
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for group in grace_groups(records(), table_bytes):
            winner, keep_id, _ = max(group, key=lambda g: (g[1] is not None, g[1] or 0, -g[0]))
            total = sum(g[2] for g in group)
            out += [(rep, winner, keep_id, total) for rep, _, _ in group]
            if len(out) >= 20_000:
                yield batch()
        if out:
            yield batch()

    return run


class ExactDedup:
    """Exact dedup of ``df`` on ``text_col``; of equal texts, the row with the largest id stays.

    Nulls in the text count as empty.  A null id is lower than any other; where
    all ids of a group are null, ``keep_id`` is null.  Of rows that share text
    and id, exactly one stays.  Other columns are carried along as they are,
    whatever their names.  An empty table gives an empty result.
    """

    def __init__(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", table_bytes: int = TABLE_BYTES):
        if df.schema[id_col].dataType != T.LongType():
            df = df.withColumn(id_col, F.col(id_col).cast("long"))
        small_batches(df.sparkSession)
        self.columns = df.columns
        self.meta = meta = free_name(df, "_dedup")
        kind = T.StructType.fromDDL("rep long, digest string, max_id long, best int, ids array<long>")
        schema = T.StructType([*df.schema.fields, T.StructField(meta, kind)])
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        run = _local_groups(df.columns.index(text_col), df.columns.index(id_col), schema.names, table_bytes // 2)
        self.local = stored(df.mapInArrow(lean(run), schema), "dedup-local")
        m = lambda f: F.col(f"`{meta}`.{f}")
        reps = self.local.select(
            m("digest").alias("digest"), F.col(f"`{text_col}`").cast("binary").alias("text"),
            m("rep").alias("rep"), m("max_id").alias("max_id"), F.size(m("ids")).cast("long").alias("n"),
        )
        buckets = reps.repartition(_partitions(df), "digest")
        self.decided = stored(buckets.mapInArrow(lean(_decide(table_bytes)), "rep long, winner long, keep_id long, group_size long"), "dedup-decided")

    def members(self) -> DataFrame:
        """A row for each input row: doc_id, keep_id, group_size, kept, text_sha256."""
        m = lambda f: F.col(f"`{self.meta}`.{f}")
        local = self.local.select(*(m(f).alias(f) for f in ("rep", "digest", "best", "ids")))
        out = local.join(self.decided, "rep").select("*", F.posexplode("ids").alias("pos", "doc_id"))
        kept = (F.col("rep") == F.col("winner")) & (F.col("pos") == F.col("best"))
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))

    def kept(self) -> DataFrame:
        """The rows that stay, with the columns of the input."""
        # a row for each text that stays: a merge join at every size, never a broadcast
        winners = self.decided.where("rep = winner").select(F.col("rep").alias(f"{self.meta}_rep")).hint("merge")
        out = self.local.join(winners, F.col(f"`{self.meta}`.rep") == F.col(f"`{self.meta}_rep`"), "left_semi")
        return out.select(*(f"`{c}`" for c in self.columns))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
