import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldlens.llm.packing import Packer, WordTokenizer, class_lengths, class_of, cut, pack
from fieldlens.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(tokenizer_path())


def same(words, text):
    found = np.frombuffer(words.ids(text.encode()), "<u4").tolist()
    assert found == words.tokenizer.encode(text, add_special_tokens=False).ids


ODD = st.sampled_from(list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\xad'sStTreRElLdD<|>éſİıΣß²½123_ǅŉÅe\u0301\u0130"))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), ODD, ODD)))
def test_words_give_the_ids_of_the_text(words, text):
    same(words, text)


def test_words_of_the_corpus(words):
    for (text,) in duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null").fetchall():
        same(words, text)


def test_words_of_plain_characters(words):
    plain = [chr(c) for c in range(0x250) if not 0xD800 <= c < 0xE000]
    same(words, "".join(plain) + " " + " ".join(plain))
    for a in plain:
        same(words, f"x{a}y 'S{a}'")


@pytest.mark.parametrize("text", ["a<|endoftext|> b <|startoftext|>", "x" * 5000 + " y", "don't we'll  I'D", ""])
def test_words_special(words, text):
    same(words, text)


def test_few_words_kept(words):
    own = WordTokenizer(tokenizer_path())
    own.pieces.limit = 4
    for _ in range(2):
        text = "one two three four five one six " + "z" * 100 + " two"
        same(own, text)
        assert len(own.pieces) <= 2


@given(st.integers(1, 50_000))
def test_cut_is_whole(n):
    pieces = cut(n, 4096)
    assert sum(pieces) == n and min(pieces) > 0 and max(pieces) <= 4096


def test_packer_pads_little():
    rng = random.Random(5)
    rows = []
    packer = Packer(4096, 0, lambda doc, start, ids, seq, off: rows.append((doc, start, len(ids), seq, off)))
    sizes = [rng.choice((1, rng.randint(1, 300), rng.randint(1, 9000))) for _ in range(3000)]
    for d, n in enumerate(sizes):
        start = 0
        for k in cut(n, 4096):
            packer.add(d, start, np.arange(start, start + k))
            start += k
    packer.finish()
    check_layout(rows, dict(enumerate(sizes)), 0.01)


def test_classes_close():
    """Of a worker's documents, nearly all pieces end in sequences that their class has filled."""
    rng = random.Random(6)
    rows = []
    packer = Packer(4096, 0, lambda *row: rows.append(row))
    sizes = [int(min(20_000, rng.lognormvariate(6, 1.2))) + 1 for _ in range(8000)]
    for d, n in enumerate(sizes):
        for k in cut(n, 4096):
            packer.add(d, 0, np.zeros(k, np.int32))
    before = len(rows)
    packer.finish()
    rest = sum(len(ids) for _, _, ids, _, _ in rows[before:])
    print(rest / sum(sizes), (len(rows) - before) / len(rows))
    assert rest < 0.015 * sum(sizes) and len(rows) - before < 0.04 * len(rows)


def test_classes():
    lengths = class_lengths(4096)
    assert lengths[0] == 4096 and lengths[-1] == 1 and len(lengths) < 30
    for n in range(1, 4097):
        k = class_of(n, 4096)
        assert n * k <= 4096 and all(4096 // k <= x or x < n for x in lengths)
    for n in range(1, 20_000):
        pieces = cut(n, 4096)
        # a piece that was cut is as long as its class, but for the last one, which is close to it
        assert all(p in lengths for p in pieces[:-1]) and (n < 13 or pieces[-1] >= 13)
        assert 4096 // class_of(pieces[-1], 4096) - pieces[-1] <= 4
    assert sum(cut(n, 64) == [n] or sum(cut(n, 64)) == n for n in range(1, 500)) == 499


def check_layout(rows, sizes, padding):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc, start, n, seq, off in rows:
        by_doc[doc].append((start, n))
        by_seq[seq].append((off, n))
    for doc, size in sizes.items():
        at = 0
        for start, n in sorted(by_doc[doc]):
            assert start == at and n > 0
            at += n
        assert at == size
    pad = 0
    for pieces in by_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= 4096
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    assert pad <= padding * sum(sizes.values())


def test_pack_table(spark, words):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rows += [(None, None), (10**9, ""), (10**9 + 1, "word " * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sequence_id int").repartition(3)
    got = pack(df, tokenizer_path(), with_ids=True).collect()
    ids = {d: [*words.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == part and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    check_layout([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got], {d: len(x) for d, x in ids.items()}, 0.01)


def test_pack_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df, tokenizer_path()).count() == 0
