import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from fieldlens.llm.components import connected_components
from fieldlens.llm.exact_dedup import ExactDedup, grace_groups
from fieldlens.llm.simhash import SimHashDedup, cell_masks, fingerprint

SF = "/root/testdata/sf0.01"


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = max(real) if real else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        done = False
        for i in ids:
            stays = not done and i == keep
            done |= stays
            out.append((i, keep, len(ids), stays, digest))
    return sorted(out, key=str)


EDGE = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "a"), (None, "b"), (None, "b"), (7, "b "), (8, "x " * 400_000), (9, "x " * 400_000), (10, "ü")]


def test_exact_edge_cases(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    assert rows_of(ExactDedup(df).members()) == exact_by_hand(EDGE)


def test_exact_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "k"), (2, "a", None, None), (2, "a", None, None)], "doc_id long, text string, keep_id int, _dedup string")
    dedup = ExactDedup(df)
    assert [tuple(r) for r in dedup.kept().collect()] == [(2, "a", None, None)]
    assert dedup.members().count() == 3
    none = ExactDedup(df.where("false"))
    assert none.members().count() == 0 and none.kept().columns == df.columns


def test_exact_spills_whole(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 6)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(ExactDedup(df, table_bytes=2000).members()) == exact_by_hand(rows)


def test_grace_recursion_compares_contents():
    """Many contents, one digest prefix: only the complete text tells them apart."""
    rows = [(b"\0" * 32, str(i % 50).encode(), i) for i in range(500)]
    groups = list(grace_groups(iter(rows), table_bytes=500))
    assert sorted(sorted(g) for g in groups) == sorted(sorted(range(k, 500, 50)) for k in range(50))


@pytest.mark.parametrize("part", [100, 500_000])
def test_components(spark, monkeypatch, part):
    from fieldlens.llm import components

    monkeypatch.setattr(components, "PART_EDGES", part)
    rng = random.Random(2)
    edges = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000 + i) for i in range(1, 300)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    found = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    alone = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert found == {x: find(x) for x in up if x not in alone}


def simhash_by_hand(rows, words):
    import xxhash

    def fp(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        if not w:
            return 0
        s = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
        h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    return sorted(((d, f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def test_simhash_against_all_pairs(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rows += [(None, None), (100_001, ""), (100_002, " \n"), (100_003, "ONE two"), (100_004, "one TWO"), (1, rows[0][1]), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(SimHashDedup(df, words=3).members()) == simhash_by_hand(rows, 3)


def parts_by_hand(points, near):
    """Groups of more than one of ``points`` that link by ``near(point, array of points)``."""
    import numpy as np

    every, left, parts = np.array(points), np.ones(len(points), bool), []
    for i in range(len(points)):
        if not left[i]:
            continue
        left[i], part, todo = False, [], [i]
        while todo:
            k = todo.pop()
            part.append(k)
            more = np.flatnonzero(left & near(every[k], every))
            left[more] = False
            todo += more.tolist()
        if len(part) > 1:
            parts.append(sorted(points[k] for k in part))
    return sorted(parts)


def groups_of(roots):
    found = defaultdict(list)
    for node, root in roots.collect():
        found[root].append(node)
    return sorted(map(sorted, found.values()))


@pytest.mark.parametrize("cell", [2, 5, 64])
def test_simhash_full_cells(spark, monkeypatch, cell):
    """Fingerprints packed closely, thousands in a cell, so that finer grids are needed: every link within two bits is found."""
    import numpy as np

    import fieldlens.llm.simhash as simhash

    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(3)
    near = [0]
    for _ in range(300):
        x = rng.choice(near)
        for _ in range(rng.choice((1, 2, 2, 3))):
            x ^= 1 << rng.randrange(64)
        near.append(x)
    centre = rng.getrandbits(64)
    for _ in range(2500 if cell == 64 else 300):  # about one centre, up to five bits away
        x = centre
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        near.append(x)
    points = [simhash._signed(x) for x in sorted(set(near) | {rng.getrandbits(64) for _ in range(200)})]
    roots = connected_components(simhash.links(spark.createDataFrame([(x,) for x in points], "fp long")))
    want = parts_by_hand(points, lambda x, every: np.bitwise_count((x ^ every).view(np.uint64)) <= 2)
    assert groups_of(roots) == want and max(map(len, want)) > (1000 if cell == 64 else 100)


def jaccard_by_hand(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("bucket", [3, 64])
def test_similar_against_all_pairs(spark, monkeypatch, bucket):
    """Groups of all pairs that share 0.8 of their five-word shingles; large buckets too."""
    from fieldlens.llm import similar

    monkeypatch.setattr(similar, "BUCKET", bucket)
    rng = random.Random(bucket)
    texts = [t for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet' limit 250").fetchall()]
    for n, copies in ((60, 30), (300, 60), (12, 10), (6, 6)):
        words = [f"v{rng.randrange(3000)}" for _ in range(n)]
        texts += [edited(rng, words, rng.randint(0, max(1, n // 40))) for _ in range(copies)]
    texts += [None, "", " \n", "One two", "one TWO", "one two three four five", "one two three four five six"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in SimHashDedup(df, words=5, similarity=0.8).members().collect()}
    split = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in split]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard_by_hand(sets[i], sets[j]) >= 0.8]
    want = dict(tuple(r) for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert all(want.get(i, i) == want.get(c, c) for i, c in found.items())  # nothing that doesn't link
    caught = sum(found[i] == found[j] for i, j in pairs) / len(pairs)
    assert len(pairs) > 500 and caught > (0.99 if bucket == 64 else 0.95)


def test_similar_by_the_grid(spark):
    """Samples whose fingerprints are one bit apart, none of them equal, meet by the embedding's grid; other ones don't."""
    import fieldlens.llm.simhash as simhash
    from fieldlens.llm import similar

    rng = random.Random(9)
    rows = []
    for i in range(0, 100, 2):
        prints = [rng.getrandbits(64) for _ in range(similar.BANDS)]
        for k, bits in ((0, 0), (1, 1 if i < 60 else 7)):
            rows.append((i + k, list(range(i, i + 20)), [simhash._signed(p ^ bits << rng.randrange(60) * k) for p in prints]))
    points = spark.createDataFrame(rows, "row long, shingles array<int>, samples array<long>").repartition(3)
    found = groups_of(similar.components(points, 0.8))
    assert found == [[i, i + 1] for i in range(0, 60, 2)]


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("cell", [2, 64])
def test_links_of_either_radius(spark, monkeypatch, radius, cell):
    import fieldlens.llm.simhash as simhash

    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(radius)
    points = {0} | {1 << rng.randrange(64) for _ in range(30)} | {rng.getrandbits(64) for _ in range(50)}
    points |= {x ^ 1 << rng.randrange(64) for x in list(points) for _ in range(3)}
    points = sorted(map(simhash._signed, points))
    found = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(x,) for x in points], "fp long"), radius).collect()}
    assert found == {(a, b) for a in points for b in points if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}


def test_similar_edges(spark):
    rows = [(None, None, 1), (3, "", 2), (3, "", 2), (5, "a b c d e f g", 3), (None, "A B C D E F G", 4), (6, "long " * 200_000, 5), (7, "long " * 200_001, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _simhash int")
    dedup = SimHashDedup(df, carry=True, similarity=0.8)
    assert sorted(tuple(r) for r in dedup.kept().collect()) == [(3, "", 2), rows[3], rows[5]]
    assert Counter((r.doc_id, r.component_id) for r in dedup.members().collect()) == Counter({(3, 3): 2, (None, 3): 1, (5, 5): 1, (None, 5): 1, (6, 6): 1, (7, 6): 1})
    none = SimHashDedup(df.where("false"), carry=True, similarity=0.8)
    assert none.kept().count() == 0 and none.members().count() == 0 and none.kept().columns == df.columns


def test_embedding_is_a_lower_bound(spark):
    import fieldlens.llm.simhash as simhash
    from pyspark.sql import functions as F

    rng = random.Random(4)
    pairs = [(x, x ^ rng.getrandbits(64) & rng.getrandbits(64)) for x in (rng.getrandbits(64) for _ in range(500))]
    df = spark.createDataFrame([(simhash._signed(a), simhash._signed(b)) for a, b in pairs], "a long, b long")
    got = df.select(simhash.manhattan(simhash.embedding(F.col("a")), simhash.embedding(F.col("b")))).collect()
    counts = lambda x: [(x >> 2 * i & 3).bit_count() for i in range(32)]
    want = [sum(abs(p - q) for p, q in zip(counts(a), counts(b))) for a, b in pairs]
    assert [r[0] for r in got] == want
    assert all(w <= (a ^ b).bit_count() for w, (a, b) in zip(want, pairs))
    assert len(cell_masks()) == 10


def test_simhash_keeps_one_of_each_group(spark):
    text = "The quick brown fox jumps over the lazy dog near the old mill"
    rows = [(5, text, "x"), (3, text, "y"), (3, text, "y"), (8, "something else entirely is written here", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = SimHashDedup(df, carry=True).kept()
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted([rows[1], rows[3]])
    none = SimHashDedup(df.where("false"), carry=True)
    assert none.kept().count() == 0 and none.members().count() == 0


def test_simhash_long_text(spark):
    rows = [(1, "x y " * 100_000), (2, "x y " * 100_000 + "z"), (3, "x y")]
    got = rows_of(SimHashDedup(spark.createDataFrame(rows, "doc_id long, text string"), words=3).members())
    assert got == simhash_by_hand(rows, 3)


@pytest.mark.parametrize("text,words,want", [(b"", 3, 0), (b" \t\n", 3, 0)])
def test_fingerprint_of_nothing(text, words, want):
    assert fingerprint(text, words) == want
