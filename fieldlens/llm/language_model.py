"""Scores of texts by an n-gram language model in a log-frequency Bloom filter.

Training counts the words and word pairs of the training rows.  A count is
quantised on a logarithmic scale to a level, and an n-gram of level q is put into
a Bloom filter q times, as (n-gram, 1) ... (n-gram, q).  A probe asks for level 1,
2, ... until one is missing, so a count is never read too low and seldom too high.
The filter has room for all levels at a fixed error rate, so it grows with the
corpus.  Up to ``filter_bytes`` it is broadcast; a larger one stays in segments,
and each block of texts sends the segments its n-grams and gets their levels
back.  Workers score whole texts and interpolate the word pairs' relative
frequencies with the words' add-half probabilities.

Exact counts of words are kept beside it for the base score: the words that make
up a fixed share of the corpus, of which there can't be more than
``HOT_WORDS``, are broadcast, and all others are joined, a text's counts with the
corpus's, so no join key is frequent.

Texts are tokenised twice: once to count, words and n-grams by the same segments
of their hashes, and once to score.
"""

from __future__ import annotations

import math
import zlib
from itertools import repeat

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, small_batches, stored

#: A word with at least 1 / HOT_WORDS of all tokens is hot; there are no more such words than that.
HOT_WORDS = 65_536
#: A longer word is joined even if it is hot.
HOT_LENGTH = 64
#: Tokens of a text block that is counted at once.
BLOCK_TOKENS = 1_200_000
#: Tokens for each segment of the counts, about, and bytes of a token, by which the number of segments is set.
SEGMENT_TOKENS, TOKEN_BYTES = 2_000_000, 6
#: Keys that are probed at once: their hashes stay in a core's cache.
AT_ONCE = 1 << 15
#: Base of the levels, bits set for each (n-gram, level), and weight of the words' probabilities.
BASE, PROBES, WEIGHT = 1.5, 5, 4.0


def crc(doc_id) -> int:
    """CRC-32 of the id as text; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def _blocks(batches, held_out_mod: int, held_out_rest: int, block_tokens: int):
    """(vocabulary, ids, ends, held out, document ids, first row) of bounded blocks of documents; ``ends`` are the ends in ``ids``.

    Arrow cuts the words and numbers them as they come; the vocabulary lists them in that order.
    """
    import numpy as np
    import pyarrow as pa

    task = TaskContext.get()
    row = (task.partitionId() if task else 0) << 40
    words, sizes, doc_ids, n = [], [], [], 0

    def block():
        coded = pa.chunked_array(words, pa.large_string()).dictionary_encode()
        vocabulary = coded.chunk(0).dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist() if coded.num_chunks else []
        ids = np.concatenate([np.zeros(0, np.int64), *(c.indices.to_numpy() for c in coded.chunks)])
        held = np.array([crc(doc_id) % held_out_mod == held_out_rest for doc_id in doc_ids], bool)
        return vocabulary, ids, np.cumsum(np.concatenate(sizes)), held, doc_ids, row

    for b in batches:
        cut, ends = _words(b.column(0))
        of_batch, first = b.column(1).to_pylist(), 0
        while first < len(of_batch):
            # up to the document that fills the block
            start = ends[first - 1] if first else 0
            took = ends[first:] - start + np.arange(1, len(ends) - first + 1)
            stop = min(first + int(np.searchsorted(took, block_tokens - n)) + 1, len(ends))
            words.append(cut.slice(start, ends[stop - 1] - start))
            sizes.append(np.diff(ends[first:stop], prepend=start))
            doc_ids += of_batch[first:stop]
            n += int(took[stop - first - 1])
            first = stop
            if n >= block_tokens:
                yield block()
                row += len(doc_ids)
                words, sizes, doc_ids, n = [], [], [], 0
    if doc_ids:
        yield block()


def _words(texts):
    """The lower-case words of an Arrow column of texts, one after another, and each text's end among them; a null text has none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type):
        texts = texts.view(pa.string() if pa.types.is_binary(texts.type) else pa.large_string())
    # a copy of its own begins at byte 0, which ascii_lower takes for granted
    texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, ends = cut.flatten(), cut.offsets.to_numpy()[1:]
    some = pc.greater(pc.binary_length(words), 0)  # blanks at a text's ends give empty words
    upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), upto[ends - cut.offsets[0].as_py()].astype(np.int64)


def _doc_of(ends, n):
    import numpy as np

    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) if n else np.zeros(0, np.int64)


def _mix(x):
    """A full mix of 64-bit values (the finaliser of splitmix64)."""
    import numpy as np

    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The end of a text, as a word and as a context.
END = 0x9E3779B97F4A7C15


def _word_hashes(vocabulary):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))


def _unigram_keys(h):
    import numpy as np

    return _mix(h ^ np.uint64(0xA0761D6478BD642F))


def _bigram_keys(before, h):
    import numpy as np

    return _mix(_mix(before) * np.uint64(0xD6E8FEB86659FD93) + h)


def _with_ends(h_of_ids, ends):
    """(before, word) hashes of all tokens, each text followed by its end; ``ends`` of that."""
    import numpy as np

    n, docs = len(h_of_ids), len(ends)
    at = ends + np.arange(docs)  # where the end tokens go
    word = np.empty(n + docs, np.uint64)
    is_end = np.zeros(n + docs, bool)
    is_end[at] = True
    word[~is_end] = h_of_ids
    word[at] = np.uint64(END)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[:1] = np.uint64(END)
    return before, word, at + 1


class BloomFilter:
    """Log-frequency Bloom filter in segments: (offset in bytes, bits) for each value of a key's first bits."""

    def __init__(self, segment_bits: int, offsets, sizes, buffer: bytes, top: int):
        import numpy as np

        self.segment_bits, self.top = segment_bits, top
        self.offsets, self.sizes = np.asarray(offsets, np.uint64), np.asarray(sizes, np.uint64)
        self.buffer = np.frombuffer(buffer, np.uint8)

    def levels(self, keys, most=None):
        """The level of each key, 0 if it is absent; with ``most``, the lesser of that and the key's level there, above which isn't probed."""
        import numpy as np

        found = np.zeros(len(keys), np.int64)
        for i in range(0, len(keys), AT_ONCE):
            part = slice(i, i + AT_ONCE)
            self._probe(keys[part], None if most is None else most[part], found[part])
        return found

    def _probe(self, keys, most, found) -> None:
        import numpy as np

        seg, key40 = split_key(keys, self.segment_bits)
        alive = np.flatnonzero(self.sizes[seg])
        if most is not None:
            alive = alive[most[alive] > 0]
        seg, (h1, h2) = seg[alive], probe_hashes(key40[alive])
        for level in range(1, self.top + 1):
            if most is not None and level > 1:
                more = np.flatnonzero(most[alive] >= level)
                if len(more) < len(alive):
                    alive, seg, h1, h2 = alive.take(more), seg.take(more), h1.take(more), h2.take(more)
            for probe in range(PROBES):
                p = bit_position(h1, h2, level, probe, self.sizes[seg])
                bits = self.buffer[self.offsets[seg] + (p >> np.uint64(3))] >> (p & np.uint64(7)).astype(np.uint8)
                set_ = np.flatnonzero(bits & 1)
                if len(set_) < len(alive):
                    alive, seg, h1, h2 = alive.take(set_), seg.take(set_), h1.take(set_), h2.take(set_)
            if not len(alive):
                break
            found[alive] = level

    def counts(self, levels):
        """The counts that levels stand for."""
        import numpy as np

        means = np.array([0.0, *(level_mean(q) for q in range(1, self.top + 1))])
        return means[levels]


def probe_hashes(key40):
    """Two hashes of each key, from which all its probes follow."""
    import numpy as np

    h1 = _mix(key40 + np.uint64(0x9E3779B97F4A7C15))
    return h1, (h1 * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def bit_position(h1, h2, level: int, probe: int, size):
    """The bit of a probe in a segment of ``size`` bits, below 2 ** 32."""
    import numpy as np

    h = h1 + np.uint64(level * PROBES + probe) * h2
    return (h >> np.uint64(32)) * size >> np.uint64(32)


def split_key(keys, segment_bits: int):
    """A key's segment and the forty bits after it."""
    import numpy as np

    seg = (keys >> np.uint64(64 - segment_bits)).astype(np.int64) if segment_bits else np.zeros(len(keys), np.int64)
    return seg, keys >> np.uint64(24 - segment_bits) & np.uint64((1 << 40) - 1)


def level_of(counts):
    """1 + floor(log(count) / log(BASE)), exact at the bounds by comparison."""
    import numpy as np

    top = 1 + int(math.log(max(1, int(counts.max(initial=1)))) / math.log(BASE)) + 1
    return np.searchsorted(BASE ** np.arange(top + 1), counts + 1e-9, side="right")


def level_mean(level: int) -> float:
    low, high = math.ceil(BASE ** (level - 1) - 1e-9), max(math.ceil(BASE**level - 1e-9) - 1, 1)
    return (low + max(low, high)) / 2


def _unique_sums(keys, counts):
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _counts(mod: int, rest: int, segment_bits: int, block: int):
    """mapInArrow function: the n-grams and the words of the training rows of a block with their counts, packed by segment.

    A row of n-grams has their hashes as keys, a row of words their characters,
    and how many of these each word has; '' is the end.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, kinds = ["seg", "keys", "counts", "sizes"], (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        for vocabulary, ids, ends, held, _, _ in _blocks(batches, mod, rest, block):
            docs, kept = _doc_of(ends, len(ids)), ~held
            ids = ids[kept[docs]]
            ends = np.cumsum(np.diff(ends, prepend=0)[kept])
            if not len(ends):
                continue
            h = _word_hashes(vocabulary)
            before, word, _ = _with_ends(h[ids], ends)
            keys, counts = np.unique(np.concatenate([_unigram_keys(word), _bigram_keys(before, word)]), return_counts=True)
            del before, word
            parts = np.arange((1 << segment_bits) + 1)
            seg, key40 = split_key(keys, segment_bits)
            bounds = np.searchsorted(seg, parts)
            packed = key40.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            counts = counts.astype("<u4")
            rows = [(s, packed[i:j].tobytes(), counts[i:j].tobytes(), None) for s, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i]

            counts = np.bincount(ids, minlength=len(vocabulary))
            seg, _ = split_key(h, segment_bits)
            some = np.flatnonzero(counts)
            some = some[np.argsort(seg[some], kind="stable")]
            words, counts = [vocabulary[i] for i in some], counts[some].astype("<u4")
            sizes = np.fromiter(map(len, words), "<u4", len(words))
            bounds = np.searchsorted(seg[some], parts)
            rows += [(s, b"".join(words[i:j]), counts[i:j].tobytes(), sizes[i:j].tobytes()) for s, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i]
            rows.append((0, b"", np.array([len(ends)], "<u4").tobytes(), np.zeros(1, "<u4").tobytes()))
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows[k : k + 64]), kinds)], names=names)

    return run


def _unpack(keys: bytes):
    import numpy as np

    wide = np.zeros((len(keys) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(keys, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


SEGMENTS = "seg int, ngrams long, top int, size long, bits binary, word binary, n long"


def _segment(max_bytes: int = 1 << 29):
    """mapInArrow function over rows sorted by segment: each segment's words with their counts, and its part of the filter, half of its bits set.

    More than ``max_bytes`` are an error, never a fuller filter; positions reach as far as the default.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = dict(zip(SEGMENTS.replace(",", "").split()[::2], (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64())))

        def batch(rows, /, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(rows, kind) for c, kind in kinds.items()], names=list(kinds))

        def finish(seg, keys, counts, words):
            every, times = list(words), list(words.values())
            for k in range(0, len(every), 50_000):
                yield batch(len(every[k : k + 50_000]), word=every[k : k + 50_000], n=times[k : k + 50_000])
            if not keys:
                return
            keys, counts = _unique_sums(np.concatenate(keys), np.concatenate(counts))
            levels = level_of(counts)
            size = max(64, math.ceil(int(levels.sum()) * PROBES / math.log(2)))
            if size >= 8 * max_bytes:
                raise ValueError(f"segment {seg} of the filter needs {size} bits, more than {max_bytes} bytes hold")
            bits, (h1, h2) = np.zeros(size, np.uint8), probe_hashes(keys)
            for level in range(1, int(levels.max()) + 1):
                some = levels >= level
                for probe in range(PROBES):
                    bits[bit_position(h1[some], h2[some], level, probe, np.uint64(size))] = 1
            yield batch(1, seg=[seg], ngrams=[len(keys)], top=[int(levels.max())], size=[size], bits=[np.packbits(bits, bitorder="little").tobytes()])

        at, keys, counts, words, held = None, [], [], {}, 0
        for b in batches:
            for seg, k, c, sizes in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if seg != at and at is not None:
                    yield from finish(at, keys, counts, words)
                    keys, counts, words, held = [], [], {}, 0
                at = seg
                c = np.frombuffer(c, "<u4").astype(np.int64)
                if sizes is not None:
                    stop = 0
                    for size, n in zip(np.frombuffer(sizes, "<u4").tolist(), c.tolist(), strict=True):
                        word = k[stop : stop + size]
                        words[word] = words.get(word, 0) + n
                        stop += size
                    continue
                keys.append(_unpack(k))
                counts.append(c)
                held += len(keys[-1])
                if held > 4 * SEGMENT_TOKENS and len(keys) > 1:
                    k1, c1 = _unique_sums(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [k1], [c1], len(k1) // 2
        if at is not None:
            yield from finish(at, keys, counts, words)

    return run


def _asked(segment_bits: int, block: int):
    """mapInArrow function: the n-grams of each block of texts, packed by segment, and as segment -1 where they stand in the texts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["block", "seg", "keys", "stops"]
        for vocabulary, ids, ends, _, _, row in _blocks(batches, 1, 1, block):
            before, word, stops = _with_ends(_word_hashes(vocabulary)[ids], ends)
            keys, places = np.unique(np.concatenate([_unigram_keys(word), _bigram_keys(before, word)]), return_inverse=True)
            seg, key40 = split_key(keys, segment_bits)
            bounds = np.searchsorted(seg, np.arange((1 << segment_bits) + 1))
            packed = key40.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            rows = [(row, -1, places.astype("<u4").tobytes(), stops.astype("<u8").tobytes())]
            rows += [(row, s, packed[i:j].tobytes(), None) for s, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i]
            for k in range(0, len(rows), 64):
                columns = zip((pa.int64(), pa.int32(), pa.binary(), pa.binary()), zip(*rows[k : k + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for kind, v in columns], names=names)

    return run


def _answers(top: int):
    """mapInArrow function over rows sorted by segment, its bits before what blocks ask it: the levels of each block's n-grams."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, model = None, None
        for b in batches:
            blocks, segs, levels = [], [], []
            for seg, block, payload, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if block is None:
                    at, model = seg, BloomFilter(0, [0], [size], payload, top)
                    continue
                keys = _unpack(payload)
                found = model.levels(keys << np.uint64(24)) if seg == at else np.zeros(len(keys), np.int64)
                blocks.append(block)
                segs.append(seg)
                levels.append(found.astype(np.uint8).tobytes())
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(segs, pa.int32()), pa.array(levels, pa.binary())], names=["block", "seg", "levels"])

    return run


def _answered(total: int, distinct: int):
    """mapInArrow function over rows sorted by block and segment: the model's score of each text of a block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        means = np.array([0.0, *map(level_mean, range(1, 256))])

        def finish(row, places, stops, levels):
            counts = means[np.frombuffer(b"".join(levels), np.uint8)][np.frombuffer(places, "<u4")]
            scores = _text_scores(*np.split(counts, 2), np.frombuffer(stops, "<u8").astype(np.int64), total, distinct)
            return pa.RecordBatch.from_arrays([pa.array(range(row, row + len(scores)), pa.int64()), pa.array(scores)], names=["row", "score"])

        at, places, stops, levels = None, b"", b"", []
        for b in batches:
            for row, seg, payload, ends in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if seg < 0:
                    if at is not None:
                        yield finish(at, places, stops, levels)
                    at, places, stops, levels = row, payload, ends, []
                else:
                    levels.append(payload)
        if at is not None:
            yield finish(at, places, stops, levels)

    return run


def _text_scores(single, pair, stops, total: int, distinct: int):
    """Scores of texts that stop at ``stops`` from the counts of their words and word pairs."""
    import numpy as np

    if not len(stops):
        return np.zeros(0)
    scale = total + 0.5 * (distinct + 1)
    context = np.r_[single[stops[0] - 1], single[:-1]]
    pair = np.minimum(pair, np.minimum(single, context))
    p = (pair + WEIGHT * (single + 0.5) / scale) / (context + WEIGHT)
    return np.add.reduceat(np.log10(p), np.r_[0, stops[:-1]])


def _by_broadcast(model: BloomFilter, vocabulary, ids, ends, total: int, distinct: int):
    import numpy as np

    h = _word_hashes(vocabulary)
    before, word, stops = _with_ends(h[ids], ends)
    single = np.empty(len(word), np.int64)
    end_at = stops - 1
    mask = np.ones(len(word), bool)
    mask[end_at] = False
    single[mask] = model.levels(_unigram_keys(h))[ids]
    end = model.levels(_unigram_keys(np.array([END], np.uint64)))[0]
    single[end_at] = end
    # a pair's count is taken as no higher than those of its words
    pair = model.levels(_bigram_keys(before, word), np.minimum(single, np.r_[end, single[:-1]]) if len(single) else single)
    return _text_scores(model.counts(single), model.counts(pair), stops, total, distinct)


SCORED = "word binary, rows array<long>, tfs array<int>, doc_id long, held int, n_tokens long, hot_known long, hot_base double, score double"


def _score(mod: int, rest: int, hot, bloom, total: int, distinct: int, block: int):
    """mapInArrow function: two kinds of rows for each block.

    One for each text, with what hot words give to the base score, and the model's
    score if ``bloom`` is broadcast; in place of a word it has its number, behind
    a byte that is in no text.  And one for each word that isn't hot, with the
    texts that hold it and how often.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = SCORED.replace(",", "").split()[::2]
        lists = pa.list_(pa.int64()), pa.list_(pa.int32())
        own = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()
        known, model = hot.value, bloom and BloomFilter(*bloom.value)
        for vocabulary, ids, ends, held, doc_ids, row in _blocks(batches, mod, rest, block):
            counts = np.fromiter(map(known.get, vocabulary, repeat(0)), np.int64, len(vocabulary))
            gains = np.where(counts > 0, np.log10(counts + 0.5), 0.0)
            docs, size = _doc_of(ends, len(ids)), len(ends)
            base = np.bincount(docs, gains[ids], size) if len(ids) else np.zeros(size)
            n_known = np.bincount(docs, counts[ids] > 0, size) if len(ids) else np.zeros(size)
            n_tokens = np.diff(ends, prepend=0) + 1
            scores = pa.array(_by_broadcast(model, vocabulary, ids, ends, total, distinct)) if model else pa.nulls(size, pa.float64())
            rows = np.arange(row, row + size)
            one = np.arange(size + 1, dtype=np.int32)
            columns = [
                pa.array([b"\xff%d" % r for r in rows.tolist()], pa.binary()), pa.ListArray.from_arrays(pa.array(one), pa.array(rows)),
                pa.ListArray.from_arrays(pa.array(one), pa.array(np.zeros(size, np.int32))), pa.array(doc_ids, pa.int64()), pa.array(held.astype(np.int32)),
                pa.array(n_tokens, pa.int64()), pa.array(n_known.astype(np.int64)), pa.array(base), scores,
            ]
            full = pa.RecordBatch.from_arrays(columns, names=names)
            yield from (full.slice(k, 20_000) for k in range(0, size, 20_000))

            some = counts[ids] == 0 if len(ids) else np.zeros(0, bool)
            n = max(1, size)
            pairs, times = np.unique(ids[some] * n + docs[some], return_counts=True)
            word, doc = pairs // n, pairs % n
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            told = pa.array(vocabulary, pa.binary()).take(pa.array(word[first], pa.int64()))
            offsets = pa.array(np.r_[first, len(word)], pa.int32())
            columns = [told, *(pa.ListArray.from_arrays(offsets, pa.array(v, kind.value_type)) for v, kind in zip((row + doc, times), lists))]
            full = pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(first), kind) for kind in own)], names=names)
            yield from (full.slice(k, 50_000) for k in range(0, full.num_rows, 50_000))

    return run


class LanguageModel:
    """A model of the rows of ``df`` whose crc32(id as text) mod ``mod`` is not ``rest``.

    Tokens are lower-cased words and one end a text.  Null texts count as empty,
    a null id as an empty text for the remainder.  Repeated rows count as often
    as they occur.  With no training rows, the base probabilities are those of
    an empty corpus.  Other columns are left out, whatever their names.
    ``filter_bytes`` bounds what is broadcast, not the filter: a larger one is
    probed by a join on its segments, with the same scores.
    """

    def __init__(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", mod: int = 5, rest: int = 1, filter_bytes: int = 128 << 20, block_tokens: int = BLOCK_TOKENS):
        spark = df.sparkSession
        small_batches(spark)
        self.mod, self.rest, self.block = mod, rest, block_tokens
        self.docs = df.selectExpr(f"`{text_col}` as text", f"cast(`{id_col}` as long) as doc_id")
        size = self.docs.agg(F.sum(F.octet_length("text") + F.lit(TOKEN_BYTES))).first()[0] or 0
        self.segment_bits = min(20, max(4, math.ceil(math.log2(max(1, size / TOKEN_BYTES / SEGMENT_TOKENS)))))
        counted = self.docs.mapInArrow(lean(_counts(mod, rest, self.segment_bits, block_tokens)), "seg int, keys binary, counts binary, sizes binary")
        dealt = counted.repartition(1 << self.segment_bits, "seg").sortWithinPartitions("seg")
        built = stored(dealt.mapInArrow(lean(_segment()), SEGMENTS), "lm-model")
        self.words = built.where("word is not null").select("word", "n")
        self.segments = built.where("seg is not null").drop("word", "n")
        self.tokens, self.distinct = (x or 0 for x in self.words.agg(F.sum("n"), F.count("*")).first())
        hot = self.words.where((F.col("n") * HOT_WORDS >= self.tokens) & (F.octet_length("word") <= HOT_LENGTH) & (F.col("n") > 0))
        self.hot = spark.sparkContext.broadcast({bytes(r.word): r.n for r in hot.collect()})
        self.filter_size, self.top = (x or 0 for x in self.segments.agg(F.sum(F.octet_length("bits")), F.max("top")).first())
        self.bloom = spark.sparkContext.broadcast(self._gather()) if self.filter_size <= filter_bytes else None

    def _gather(self) -> tuple:
        """The filter's segments, together of a size that can be broadcast, on the driver."""
        n = 1 << self.segment_bits
        offsets, sizes, parts, at = [0] * n, [0] * n, [], 0
        for r in self.segments.toLocalIterator():
            offsets[r.seg], sizes[r.seg] = at, r.size
            parts.append(bytes(r.bits))
            at += len(r.bits)
        return self.segment_bits, offsets, sizes, b"".join(parts) or b"\0", self.top

    def _by_join(self) -> DataFrame:
        """(row, score) by a filter in segments: they answer blocks of texts, and the answers are put together by block."""
        asked = stored(self.docs.mapInArrow(lean(_asked(self.segment_bits, self.block)), "block long, seg int, keys binary, stops binary"), "lm-asked")
        none = F.lit(None).cast("long")
        bits = self.segments.select("seg", none.alias("block"), F.col("bits").alias("payload"), "size")
        questions = bits.union(asked.where("seg >= 0").select("seg", "block", "keys", none))
        dealt = questions.repartition(1 << self.segment_bits, "seg").sortWithinPartitions("seg", F.col("block").asc_nulls_first())
        answers = dealt.mapInArrow(lean(_answers(self.top)), "block long, seg int, levels binary")
        places = asked.where("seg < 0").select("block", "seg", "keys", "stops")
        parts = max(int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << self.segment_bits)
        back = places.union(answers.select("block", "seg", "levels", F.lit(None).cast("binary"))).repartition(parts, "block").sortWithinPartitions("block", "seg")
        return back.mapInArrow(lean(_answered(self.tokens, self.distinct)), "row long, score double")

    def score(self) -> DataFrame:
        """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
        told = self.docs.mapInArrow(lean(_score(self.mod, self.rest, self.hot, self.bloom, self.tokens, self.distinct, self.block)), SCORED)
        ends = self.words.where("word = cast('' as binary)").agg(F.sum("n")).first()[0] or 0
        n, own = F.coalesce(F.col("n"), F.lit(0)), ["doc_id", "held", "n_tokens", "hot_known", "hot_base", "score"]
        joined = told.join(self.words, "word", "left").select(
            F.log10(n + 0.5).alias("gain"), (n > 0).cast("int").alias("known"), *own, F.explode(F.arrays_zip("rows", "tfs")).alias("x")
        )
        tf = F.col("x.tfs")
        sums = joined.groupBy(F.col("x.rows").alias("row")).agg(
            F.sum(tf * F.col("gain")).alias("rare_base"), F.sum(tf * F.col("known")).alias("rare_known"), *(F.max(c).alias(c) for c in own)
        )
        if self.bloom is None:
            sums = sums.drop("score").join(self._by_join(), "row")
        norm = math.log10(self.tokens + 0.5 * (self.distinct + 1))
        return sums.select(
            "doc_id", (F.col("held") == 1).alias("held_out"), "n_tokens",
            (F.col("hot_known") + F.col("rare_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
            F.lit(self.tokens).cast("long").alias("train_tokens"),
            (F.col("hot_base") + F.col("rare_base") + F.lit(math.log10(ends + 0.5)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
            "score",
        )
