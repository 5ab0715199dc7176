import math
import zlib
from collections import Counter

import duckdb
import numpy as np

import fieldlens.llm.language_model as lm
from fieldlens.llm.language_model import BloomFilter, LanguageModel, level_mean, level_of

SF = "/root/testdata/sf0.01"


def by_hand(rows):
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in rows]
    words = [[x.decode() for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()] + [""] for _, t in rows]
    c = Counter(w for h, ws in zip(held, words) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    score = lambda ws: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, score(ws)) for (d, _), h, ws in zip(rows, held, words)]


def compare(df, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in df.collect()), key=lambda r: (str(r[:5]), r[5]))
    want = sorted(by_hand(rows), key=lambda r: (str(r[:5]), r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-11, atol=1e-9)


def test_base_and_model_scores(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rows += [(None, None), (None, "x"), (10**9, ""), (10**9 + 1, "A a \x0b\x1c ü Ü"), (5, "word " * 50_000), (5, "word " * 50_000)]
    df = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double").repartition(4)
    out = LanguageModel(df).score()
    compare(out, rows)
    held = [r for r in out.collect() if r.held_out and r.n_tokens > 20]
    # on texts it hasn't seen, the pairs must tell more than the words alone
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out.collect())


def test_scores_by_hand(spark):
    """The model's scores against a plain model with exact counts, each taken as the mean of its level."""
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' where length(text) < 4000 limit 300").fetchall()
    texts = [["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [b""], zlib.crc32(str(d).encode()) % 5 == 1] for d, t in rows]
    single, pair = Counter(), Counter()
    for words, held in texts:
        if not held:
            single.update(words)
            pair.update(zip([b""] + words[:-1], words))
    mean = lambda n: level_mean(int(level_of(np.array([n]))[0])) if n else 0.0
    total, distinct = sum(single.values()), len(single)
    want = []
    for words, _ in texts:
        score = 0.0
        for a, b in zip([b""] + words[:-1], words):
            context, alone = mean(single[a]), mean(single[b])
            both = min(mean(pair[a, b]), alone, context)
            score += math.log10((both + lm.WEIGHT * (alone + 0.5) / (total + 0.5 * (distinct + 1))) / (context + lm.WEIGHT))
        want.append(score)
    got = {r.doc_id: r.score for r in LanguageModel(spark.createDataFrame(rows, "doc_id long, text string")).score().collect()}
    off = np.array([abs(got[d] - w) / len(words) for (d, _), (words, _), w in zip(rows, texts, want)])
    # what differs is read too high by the filter: rare, and little for each token
    known = np.array([not held for _, held in texts])
    assert len(got) == len(rows) and np.median(off[known]) < 0.01 and off.max() < 0.3 and off.mean() < 0.05


def test_small_blocks(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' limit 60").fetchall()
    compare(LanguageModel(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), block_tokens=500).score(), rows)


def test_a_filter_too_large_to_broadcast(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' limit 200").fetchall()
    rows += [(None, None), (10**9, ""), (10**9 + 1, "never seen before")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole, joined = LanguageModel(df), LanguageModel(df, filter_bytes=64, block_tokens=5000)
    # the size follows from the levels, and how the filter is probed doesn't change a score
    assert joined.filter_size == whole.filter_size > 64 and whole.bloom and joined.bloom is None
    key = lambda r: (str(r.doc_id), r.n_tokens)
    a, b = (sorted(m.score().collect(), key=key) for m in (whole, joined))
    assert [key(r) for r in a] == [key(r) for r in b] and len(a) == len(rows)
    assert np.allclose([r.score for r in a], [r.score for r in b], rtol=1e-12, atol=1e-12)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert LanguageModel(df).score().count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(alone, "only held out")]
    compare(LanguageModel(spark.createDataFrame(rows, "doc_id long, text string")).score(), rows)


def test_levels():
    counts = np.arange(1, 5000)
    levels = level_of(counts)
    assert levels[0] == 1 and (np.diff(levels) >= 0).all()
    assert all(lm.BASE ** (q - 1) <= c < lm.BASE**q for c, q in zip(counts.tolist(), levels.tolist()))
    assert level_mean(1) == 1


def test_filter_never_reads_too_low(spark):
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) << np.uint64(1)
    keys[:10_000] ^= np.uint64(1 << 63)
    counts = rng.zipf(1.5, len(keys)).clip(1, 10**6)
    import pyarrow as pa

    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    seg, low = lm.split_key(keys, 4)
    rows = [(s, low[seg == s].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), counts[seg == s].astype("<u4").tobytes(), None) for s in range(16)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["seg", "keys", "counts", "sizes"])
    offsets, sizes, buffer, top = [], [], b"", 0
    for b in lm._segment(1 << 20)([batch]):
        r = b.to_pylist()[0]
        offsets.append(len(buffer))
        sizes.append(r["size"])
        buffer += r["bits"]
        top = max(top, r["top"])
    bloom = BloomFilter(4, offsets, sizes, buffer, top)
    found, true = bloom.levels(keys), level_of(counts)
    assert (found >= true).all() and (found > true).mean() < 0.06
    other = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert (bloom.levels(other) > 0).mean() < 0.06


def test_words_by_arrow():
    """Words and ends as by plain splitting, of nulls, blank ends and columns that are slices, text or binary."""
    import numpy as np
    import pyarrow as pa

    from fieldlens.llm.language_model import _words

    texts = ["Ab\tcd", None, " \n", "", "x\x0b\x0cY\r\nz ", "É ÀB c D", " a  a A", "tail"]
    for kind in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        column = pa.array(texts).cast(kind)
        shifted = pa.RecordBatch.from_arrays([column], names=["t"]).slice(4).column(0)
        for part, own in ((column, texts), (column.slice(3), texts[3:]), (shifted, texts[4:]), (column.slice(0, 0), [])):
            words, ends = _words(part)
            plain = [(x or "").encode().lower().split() for x in own]
            assert words.cast(pa.large_binary()).to_pylist() == [w for ws in plain for w in ws]
            assert ends.tolist() == np.cumsum([len(ws) for ws in plain]).tolist()


def test_levels_up_to_a_bound():
    """Probing up to a bound gives the lesser of the bound and the level, across parts that are probed at once."""
    import numpy as np

    from fieldlens.llm.language_model import AT_ONCE, PROBES, BloomFilter, bit_position, probe_hashes, split_key

    keys = np.random.default_rng(5).integers(0, 1 << 63, AT_ONCE + 999, dtype=np.uint64)
    level = np.arange(len(keys)) % 9
    _, key40 = split_key(keys, 0)
    h1, h2 = probe_hashes(key40)
    size = int(level.sum() * PROBES * 2)
    bits = np.zeros(size, np.uint8)
    for q in range(1, 9):
        for probe in range(PROBES):
            bits[bit_position(h1[level >= q], h2[level >= q], q, probe, np.uint64(size))] = 1
    model = BloomFilter(0, [0], [size], np.packbits(bits, bitorder="little").tobytes(), 8)
    every, most = model.levels(keys), np.arange(len(keys)) % 5
    assert (every >= level).all() and (every == level).mean() > 0.9
    assert (model.levels(keys, most) == np.minimum(every, most)).all()
