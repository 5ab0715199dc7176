"""Queries of this subpackage over the tables of a data directory, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, secrets
from .exact_dedup import ExactDedup
from .language_model import LanguageModel
from .licenses import LicenceModel
from .mixing import Mix
from .packing import pack
from .quality import QualityModel, remainder
from .secrets import SecretScan
from .simhash import SimHashDedup
from .topk import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ExactDedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).members()


OP1_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SimHashDedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=3).members()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LanguageModel(_table(spark, sf_dir, "documents")).score()


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(
        "select cast(-1 as bigint) as conv_id, cast(turn as bigint) as turn, role, '</s>[INST] ok [/INST]' as text "
        "from values (0, 'user'), (1, 'assistant') as t(turn, role)"
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.examples(rows.union(own)))


def _escaped(column: str) -> str:
    for i, x in enumerate(chat.CONTROL):
        column = f"replace({column}, '{x}', '{chat.MARK}{i}')"
    return column


_MARKS = len(chat.OPEN + chat.ROLE + chat.TEXT + chat.CLOSE)
OP2_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as n,
    sum(length({_escaped("role")}) + length({_escaped("text")}) + {_MARKS}) over w as upto
  from t window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' or i = n then upto else 0 end) as bigint) as formatted_chars
from o group by conv_id
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(_table(spark, sf_dir, "documents")).taken()


#: A source's stream is its documents by md5 of id and size; the mix takes it from the start, up to the target.
OP5_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, row_number() over () as row
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
w as (select *, case k % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as cap from s),
r as (
  select *, cap / weight as ratio, cast((select sum(source_size) from s) as double) * 1.5 as goal,
    coalesce(sum(cap) over (order by cap / weight, k rows between unbounded preceding and 1 preceding), 0) as before,
    sum(weight) over (order by cap / weight, k rows between current row and unbounded following) as others
  from w),
l as (select *, (goal - cast(before as double)) / cast(others as double) as level from r),
g as (select source, source_size, least(cast(cap as double),
    coalesce((select arg_min(level, (ratio, k)) from l where ratio > level) * weight, cast(cap as double))) as target from l),
p as (
  select d.*, g.source_size, g.target, cast(floor(g.target + 0.5) as bigint) as quota,
    cast(sum(size) over (partition by d.source order by md5(coalesce(cast(doc_id as varchar), '') || ':' || size), size, row rows unbounded preceding) as bigint) - size as start
  from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
  greatest(least(start + size, quota) - start, 0) + greatest(least(start + size, quota - source_size) - start, 0) as taken
from p
"""

#: A document passes at this score.
PASSES = 0.7


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> QualityModel:
    """The model of the labels, without those that are held out."""
    labels = _table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    return QualityModel(docs, labels)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_model(spark, sf_dir, docs).score(docs)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= PASSES).cast("int").alias("predicted"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.v, b.v) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 5
"""

def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SecretScan(_table(spark, sf_dir, "documents")).documents()


def _op9_sql() -> str:
    """The scan in SQL: pieces up to each match, in order, give the positions."""
    hits = []
    for i, (kind, pattern, group, least) in enumerate(secrets.BASE + secrets.FURTHER):
        quoted = f"(?s)(.*?)({pattern})".replace("'", "''")
        one = [f"unnest(regexp_extract_all(text, '{quoted}', {g}))" for g in (1, 2, 2 + group)]
        hits.append(
            f"select row, owner, {i} as number, '{kind}' as kind, {least} as least, {one[0]} as gap, {one[1]} as whole, {one[2]} as value, "
            f"generate_subscripts(regexp_extract_all(text, '{quoted}', 1), 1) as place from d"
        )
    live = "regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and len(list_distinct(string_split(value, ''))) >= "
    n = len(secrets.BASE)
    counts = ", ".join(f"count(*) filter (number = {i}) as n_{k}" for i, (k, *_) in enumerate(secrets.BASE))
    told = ", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k, *_ in secrets.BASE)
    return f"""
with d as (select doc_id, source as owner, coalesce(text, '') as text, row_number() over () as row from documents),
h as ({" union all ".join(hits)}),
p as (
  select *, cast(sum(length(gap) + length(whole)) over (partition by row, number order by place rows unbounded preceding) as bigint) as stop
  from h),
s as (
  select row, owner, number, kind, stop - length(whole) as start, stop, value, {live}{secrets.LIVE_CHARACTERS} as random from p where length(value) >= least),
o as (select value, count(distinct owner) + max(case when owner is null then 1 else 0 end) as owners, count(distinct row) as documents from s group by value),
r as (
  select row, number, start, stop, kind || ':' || start || ':' || stop as told, random and owners < {secrets.EXAMPLE_OWNERS} and documents < {secrets.EXAMPLE_REPOSITORIES} as live
  from s join o using (value)),
a as (
  select row, {counts}, count(*) filter (live) as n_live,
    coalesce(string_agg(told, ',' order by start, number) filter (number < {n}), '') as base,
    string_agg(told, ',' order by start, number, stop) as spans
  from r where number < {n} or live group by row)
select doc_id, {told}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live
from d left join a using (row)
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return LicenceModel(docs).scan(docs)


QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op4_simhash": op4_simhash, "op6_packing": op6_packing, "op10_lm_scoring": op10_lm_scoring,
    "op2_chat": op2_chat, "op5_mixing": op5_mixing,
    "op3_quality": op3_quality, "op7_topk": op7_topk, "op9_secrets": op9_secrets,
    "op8_licenses": op8_licenses,
}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op2_chat": OP2_SQL, "op5_mixing": OP5_SQL, "op7_topk": OP7_SQL, "op9_secrets": _op9_sql()}
