"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Patterns give the candidate spans of every whole text.  The values behind them
are hashed and counted over the corpus: in how many documents (a document stands
for a repository) and by how many owners (the ``owner_col``).  A value that many
owners hold, or that stands in many repositories, is a copied example; one that
is in few of either and looks random is taken for live.  Base kinds are reported
whatever the count says; the further kinds are reported only where they look
live.  Only hashes of values are ever stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored, text_or_empty

#: Fixed patterns: kind, pattern, group of the value in it, shortest value.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
FURTHER = [
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}", 0, 16),
    ("forge", r"(?:gh[pousr]_|github_pat_|glpat-)[A-Za-z0-9_-]{20,}", 0, 20),
    ("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 10),
    ("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 20),
]
KINDS = [k for k, *_ in BASE + FURTHER]
#: A value of this many owners, or in this many repositories, is an example; a live one has at least so many different characters.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LIVE_CHARACTERS = 3, 10, 8


def _found(text: Column, number: int, pattern: str, group: int) -> Column:
    """The matches of a pattern: kind's number, place in order, characters before since the last match, own length, and of the value length, hash and looks.

    The text up to a match is taken along with it, lazily, so that the lengths
    add up to the positions.  It begins where the match before ended; without
    that anchor, each place behind the last match would be tried as a beginning.
    """
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    one = lambda g: F.regexp_extract_all(text, whole, F.lit(g))
    rows = F.transform(
        F.arrays_zip(one(1).alias("gap"), one(2).alias("all"), one(2 + group).alias("value")),
        lambda x, i: F.struct(
            F.lit(number).alias("kind"), i.alias("place"), F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("length"),
            F.length(x["value"]).alias("size"), F.sha2(x["value"].cast("binary"), 256).alias("value"), live_looking(x["value"]).alias("random"),
        ),
    )
    nothing = F.array().cast("array<struct<kind:int,place:int,gap:int,length:int,size:int,value:string,random:boolean>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), rows).otherwise(nothing)


def live_looking(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)


class SecretScan:
    """Spans of secrets in ``df``.

    Null texts count as empty; a null owner is an owner.  Repeated rows are
    documents of their own, so a repeated row counts as a further copy.  Other
    columns are left out.  An empty table gives an empty result.
    """

    def __init__(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source"):
        text = text_or_empty(text_col)
        hits = reduce(F.concat, (_found(F.col("text"), i, p, g) for i, (_, p, g, _) in enumerate(BASE + FURTHER)))
        docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{owner_col}`").cast("string").alias("owner"), text.alias("text"))
        self.docs = stored(docs.select("doc_id", "owner", F.monotonically_increasing_id().alias("row"), hits.alias("hits")), "secret-hits")

        rows = self.docs.where(F.size("hits") > 0).select("row", "owner", F.explode("hits").alias("h")).select("row", "owner", "h.*")
        upto = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        end = F.sum(F.col("gap") + F.col("length")).over(upto)
        least = F.element_at(F.array(*(F.lit(n) for *_, n in BASE + FURTHER)), F.col("kind") + 1)
        spans = rows.select("row", "owner", "kind", (end - F.col("length")).alias("start"), end.alias("end"), "size", "value", "random", least.alias("least"))
        spans = spans.where(F.col("size") >= F.col("least")).drop("size", "least")
        self.spans = stored(spans, "secret-spans")

        # a document counts a value once: its spans of a value meet in a partial aggregate by row
        per_doc = self.spans.groupBy("row", "value", "owner").agg(F.lit(1).alias("one"))
        per_owner = per_doc.groupBy("value", "owner").agg(F.count("*").alias("documents"))
        counts = per_owner.groupBy("value").agg(F.sum("documents").alias("documents"), F.count("*").alias("owners"))
        self.ownership = stored(counts, "secret-ownership")

    def judged(self) -> DataFrame:
        """A row a span: row, kind, start, end, value (its hash), documents, owners, live."""
        live = F.col("random") & (F.col("owners") < EXAMPLE_OWNERS) & (F.col("documents") < EXAMPLE_REPOSITORIES)
        kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
        return self.spans.drop("owner").join(self.ownership, "value").select(
            "row", F.col("kind").alias("number"), kind.alias("kind"), "start", "end", "value", "documents", "owners", live.alias("live")
        )

    def documents(self) -> DataFrame:
        """A row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live."""
        base = F.col("number") < len(BASE)
        told = F.concat_ws(":", "kind", "start", "end").alias("told")
        reported = self.judged().where(base | F.col("live"))
        per = reported.groupBy("row").agg(
            F.sort_array(F.collect_list(F.struct("start", "number", "end", told, base.alias("base")))).alias("s"),
            *(F.count_if(F.col("number") == i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)),
            F.count_if("live").alias("n_live"),
        )
        out = self.docs.select("doc_id", "row").join(per, "row", "left")
        joined = lambda s: F.array_join(F.transform(s, lambda x: x.told), ",")
        every = F.coalesce("s", F.array().cast(per.schema["s"].dataType))
        n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return out.select(
            "doc_id", *(n(f"n_{k}") for k, *_ in BASE),
            F.sha2(joined(F.filter(every, lambda x: x.base)), 256).alias("base_sha256"), joined(every).alias("spans"), n("n_live"),
        )
