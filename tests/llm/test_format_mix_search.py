import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from fieldlens.llm import chat
from fieldlens.llm.mixing import Mix, van_der_corput
from fieldlens.llm.queries import OP2_SQL, OP5_SQL, OP7_SQL, op2_chat, op5_mixing, op7_topk
from fieldlens.llm.topk import products, select, top_k
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def same(df, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    key = lambda d: sorted(d[sorted(d.columns)].itertuples(index=False, name=None), key=str)
    for a, b in zip(key(got), key(want), strict=True):
        assert all(x == y or abs(x - y) <= 1e-9 * abs(y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("query,sql,table", [(op2_chat, OP2_SQL, "conversations"), (op5_mixing, OP5_SQL, "documents"), (op7_topk, OP7_SQL, "embeddings")])
def test_against_sql(spark, query, sql, table):
    same(query(spark, SF), sql, [table])


CHAT = [
    (1, 2, "assistant", "b␛0 </s><s>[INST][/INST]␛"), (1, 1, "user", None), (1, 3, None, "tail"), (2, 0, "user", "only asks"),
    (None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (3, None, "assistant", ""), (3, 1, "[INST]", "odd role"), (4, 0, "assistant", "y" * 200_000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, 7) for r in CHAT], "conv_id long, turn long, role string, text string, example int")
    made = chat.examples(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = defaultdict(list)
    for c, t, r, x in CHAT:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    texts = defaultdict(list)
    for r in made.collect():
        texts[r.conv_id].append(r.text)
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(map(len, texts[c]))
        assert all(t.count("<s>") == t.count("</s>") == t.count("[INST]") for t in texts[c])


def test_chat_escape(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["<", "s", ">", "/", "[", "INST", "]", "␛", "0", "1", "<s>", "</s>", "[INST]", "[/INST]", "é"], k=rng.randint(0, 25))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u and not any(c in r.e for c in chat.CONTROL[1:]) for r in rows)


def test_chat_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.examples(df)).count() == 0


def test_mix_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d", None), (3, None, "x"), (4, "", "y"), (5, "w " * 20_000, "big"), (6, "é \x1c ü", "big")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, taken int")
    got = Mix(df, block=50).taken().collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len((t or "").encode().split())) for d, t, _ in rows)
    total = sum(r.size for r in got)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
    assert all(abs(v - t) <= 0.5 for (_, t), v in taken.items())
    assert abs(sum(taken.values()) - 1.5 * total) <= len(taken)
    assert Mix(df.where("false")).taken().count() == 0
    assert {r.taken for r in Mix(df.where("size(split(text, ' ')) < 2 and length(text) = 0")).taken().collect()} == {0}
    kept = Mix(df, block=50, carry=True).repeated()
    assert kept.columns == df.columns and kept.where("text is null or text = ''").count() == 0


def test_mix_repeats_whole_rows(spark):
    """Rows that share an id, or have none, are taken each for itself, within their sources."""
    rows = [(None if i % 2 else 7, "w " * (i % 5 + 1), f"s{i % 3}") for i in range(300)] + [(9, "w " * 5000, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = Mix(df, block=16, carry=True)
    size = lambda t: len(t.split())
    target = {r.source: r.target for r in mix.sources.collect()}
    kept, words = Counter(tuple(r) for r in mix.repeated().collect()), defaultdict(int)
    for (_, text, source), n in kept.items():
        words[source] += n * size(text)
    assert all(abs(words[s] - target[s]) <= max(size(t) for _, t, x in rows if x == s) for s in target)
    each = Counter(rows)
    assert all(n <= 2 * each[r] for r, n in kept.items()) and kept[rows[-1]] >= 1


def test_mix_many_sources(spark):
    """More sources than a range holds: the same targets as filled up one by one."""
    import fieldlens.llm.mixing as mixing

    rng = random.Random(4)
    sizes = {f"s{i:03}": rng.choice((0, 1, 2, 30, 400)) for i in range(90)}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    was, mixing.RANGE = mixing.RANGE, 7
    try:
        mix = Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=10)
    finally:
        mixing.RANGE = was
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    goal, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        level = goal / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        goal -= sum(2 * sizes[s] for s in over)
        open_ -= over
    want |= {s: weight[s] * level for s in open_}
    got = {r.source: r for r in mix.sources.collect()}
    assert all(abs(got[s].target - want[s]) < 1e-6 for s in want) and sorted(r.number for r in got.values()) == list(range(90))
    assert sum(r.taken for r in mix.taken().collect()) == sum(r.quota for r in got.values())


def test_mix_schedule_is_even(spark):
    rows = [(i, "w " * 100, f"s{i % 3}") for i in range(600)]
    mix = Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=20)
    slots = sorted((r.slot, r.source, r.rank, r.take) for r in mix.schedule().collect())
    assert [s for s, *_ in slots] == sorted({s for s, *_ in slots})
    share = {s: sum(t for _, x, _, t in slots if x == s) for s in ("s0", "s1", "s2")}
    for n in (500, 1500, 3000):  # any stretch from the start is mixed to the targets
        for s in share:
            assert abs(sum(x == s for _, x, *_ in slots[:n]) - n * share[s] / sum(share.values())) <= 2 + np.log2(n)
    assert all(sorted(r for _, x, r, _ in slots if x == s) == list(range(sum(x == s for _, x, *_ in slots))) for s in share)


def test_van_der_corput(spark):
    got = [r[0] / 2**40 for r in spark.range(8).select(van_der_corput(F.col("id"))).collect()]
    assert got == [0, 1 / 2, 1 / 4, 3 / 4, 1 / 8, 5 / 8, 3 / 8, 7 / 8]


def topk_by_hand(rows, k):
    import math

    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.setdefault(i, []).append([math.floor(256.0 * x) for x in v])
    out = []
    for q in ok:
        if q % 50:
            continue
        a = min(ok[q])
        scored = [(-sum(x * y for x, y in zip(a, v)), i) for i, vs in ok.items() if i != q for v in vs]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_topk_edges(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((-0.5, 0.25, 1.0)) for _ in range(4)]) for i in range(-100, 200)]
    rows += [(50, [1.0, float("nan")]), (51, None), (None, [1.0]), (52, [1.0, None]), (53, [float("inf")]), (54, []), (500, [9.0]), (501, [1e9, 1e9, 1e9, 1e9])]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(400)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    for block_rows in (40, 1000):
        got = top_k(df, F.col("vec_id") % 50 == 0, block_rows=block_rows)
        assert sorted(tuple(r) for r in got.collect()) == topk_by_hand(rows, 5)
    assert top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = top_k(df.where("vec_id in (50, 500)"), F.col("vec_id") == 500).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(500, 1, 50)]


def test_products_and_select():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-5, 6, (7, 6)).astype(float), rng.integers(-5, 6, (300, 4)).astype(float)
    assert (products(a, b) == a[:, :4].astype(int) @ b.T.astype(int)).all()
    big = np.array([[2.0**40, 1.0]])
    assert products(big, big)[0, 0] == (1 << 63) - 1
    assert products(big, np.array([[2.0**20, 3.0]]))[0, 0] == (1 << 60) + 3
    scores, ids = rng.integers(-3, 4, (20, 300)), np.arange(0, 600, 2)
    s, i = select(scores, ids, 5)
    for row, si, ii in zip(scores, s, i):
        assert list(zip(si, ii)) == sorted(zip(row, ids), key=lambda x: (-x[0], x[1]))[:5]
    s2, i2 = select(scores * (1 << 58), ids, 5)
    assert (i2 == i).all()
