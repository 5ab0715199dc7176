"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece belongs to a reciprocal-capacity class: the least of the class lengths
capacity // k that it fits into, and a sequence of that class takes exactly k
pieces, whatever they are, so workers fill their sequences independently and
nothing is shuffled.  What a plain harmonic packing wastes, the gap between a
piece and its class length, is cut away first: a document gives whole sequences,
then pieces that are as long as a class, until a short rest remains, for which
there are closer classes; a cut leaves no rest shorter than the shortest of
these.  Classes are few, so that few sequences are open.  At the end of a worker's
rows, the pieces of its unfilled sequences are laid end to end and cut at the
capacity; the last stretch is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from functools import cache

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import binary_list, lean, slices, small_batches

#: Pieces of a sequence in the classes that cuts go by, and in those of short rests.
CUTS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128)
RESTS = (93, 102, 113, 128, 146, 170, 204, 256)
#: And of texts that are shorter still.
TINY = (341, 512, 682, 1024, 1365, 2048, 4096)
#: Pieces of words, of which a worker keeps the ids.
KEPT_PIECES = 400_000

#: What the vocabulary's pre-tokeniser takes for a piece (fixed value); {L} letters, {N} numbers.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"
#: Characters below this are the same in all Unicode versions and normal forms; texts with others go word by word.
PLAIN_BELOW = 0x250
SPACE = "\t\n\x0b\x0c\r "


def plain_patterns():
    """(matches a text of plain characters only, pieces of such a text in lower case)."""
    import re
    import unicodedata

    kind = lambda c: unicodedata.category(c)[0]
    some = [c for c in map(chr, range(33, PLAIN_BELOW)) if kind(c) not in "CZ" and all(ord(x) < PLAIN_BELOW for x in c.lower())]
    of = lambda k: "".join(re.escape(c) for c in some if kind(c) == k)
    plain = "".join(map(re.escape, some)) + SPACE
    return re.compile(f"[{plain}]*").fullmatch, re.compile(PIECE.replace("{L}", of("L")).replace("{N}", of("N"))).findall


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself if it is printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(rest)}


class Kept(dict):
    """Values of ``make`` by key, those asked for of late: at ``limit`` the older half goes."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTokenizer:
    """Token ids of a text, by way of the pieces of its words.

    For byte-level vocabularies that lower-case, drop white space and never merge
    across pieces: the ids of a text are those of its pieces, one after another,
    so each piece is merged once.  Ids come as little-endian unsigned 32-bit
    values.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.plain, self.split = plain_patterns()
        self.pieces = Kept(self._piece, KEPT_PIECES)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])

    def ids(self, text: bytes) -> bytes:
        return self._ids(text.decode("utf-8", "replace"))

    def _ids(self, text: str) -> bytes:
        if "<|" not in text and self.plain(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text.lower())))
        words = text.encode("utf-8", "replace").split()  # at ASCII white space only
        if len(words) > 1:
            return b"".join(map(self._ids, (w.decode() for w in words)))
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def class_lengths(capacity: int) -> list[int]:
    """The lengths of all classes, the longest first; each class k holds pieces of up to capacity // k."""
    return sorted({capacity // k for k in (*CUTS, *RESTS, *TINY) if k <= capacity}, reverse=True)


def class_of(length: int, capacity: int) -> int:
    """The number of pieces in a sequence of this piece's class."""
    return capacity // min(x for x in class_lengths(capacity) if x >= length)


@cache
def _cuts(capacity: int) -> tuple[list[int], int, int]:
    """The lengths that pieces are cut to, the longest rest that isn't cut, and the shortest that a cut leaves."""
    rests = [capacity // k for k in RESTS if k <= capacity] or [1]
    return [capacity // k for k in CUTS if k <= capacity], max(rests), max(1, min(rests) - 3)


def cut(length: int, capacity: int) -> list[int]:
    """The piece lengths of a document of ``length`` tokens."""
    lengths, longest, shortest = _cuts(capacity)
    whole, rest = divmod(length, capacity)
    if whole and 0 < rest < shortest:  # the last whole one is cut further
        whole, rest = whole - 1, rest + capacity
    pieces = [capacity] * whole
    while rest > longest:
        piece = next((x for x in lengths if x == rest or x <= rest - shortest), rest)
        pieces.append(piece)
        rest -= piece
    return pieces + [rest] * bool(rest)


class Packer:
    """The open sequences of one worker.  ``emit`` gets (document, start, ids, sequence, offset)."""

    def __init__(self, capacity: int, first: int, emit):
        self.capacity, self.next, self.emit, self.open = capacity, first, emit, {}
        self.kinds = [0, *(class_of(n, capacity) for n in range(1, capacity + 1))]

    def close(self, pieces) -> None:
        offset = 0
        for doc, start, ids in pieces:
            self.emit(doc, start, ids, self.next, offset)
            offset += len(ids)
        self.next += 1

    def add(self, doc, start: int, ids) -> None:
        k = self.kinds[len(ids)]
        held = self.open.setdefault(k, [])
        held.append((doc, start, ids))
        if len(held) == k:
            self.close(self.open.pop(k))

    def finish(self) -> None:
        """Lays the pieces of the unfilled sequences end to end."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in pieces)
        room, held, at = 0, [], 0
        for doc, start, ids in pieces:
            done = 0
            while done < len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    left -= room
                    held = []
                n = min(room, len(ids) - done)
                held.append((doc, start + done, ids[done : done + n]))
                done, room = done + n, room - n
                if not room:
                    self.close(held)
                    at += 1


OUTPUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    df: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = 4096, end_id: int = 2, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents of ``df``, packed into sequences of at most ``capacity`` tokens.

    A document's tokens are those of its whole text and ``end_id``; null counts
    as empty, so every row has a token at least.  Repeated rows and null ids are
    documents of their own.  ``with_ids`` adds each piece's token ids.  Other
    columns are left out, whatever their names.  An empty table gives an empty
    result.  ``capacity`` is best a power of two.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tokenizer, end, rows = _tokenizer(tokenizer_path), end_id.to_bytes(4, "little"), []
        task = TaskContext.get()

        def emit(doc, start, ids, sequence, offset):
            doc_id, total = doc
            row = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset)
            rows.append((*row, ids) if with_ids else row)

        packer = Packer(capacity, (task.partitionId() if task else 0) << 36, emit)

        def batch():
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array([x.astype("i4") for x in columns[7]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in (part for batch in batches for part in slices(batch)):
            for text, doc_id in zip(binary_list(b.column(0)), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(tokenizer.ids(text) + end, "<u4")
                start = 0
                for n in cut(len(ids), capacity):
                    packer.add((doc_id, len(ids)), start, ids[start : start + n])
                    start += n
                if len(rows) >= 20_000:
                    yield batch()
        packer.finish()
        if rows:
            yield batch()

    small_batches(df.sparkSession)
    ddl = OUTPUT + (", ids array<int>" if with_ids else "")
    names = T.StructType.fromDDL(ddl).names
    return df.selectExpr(f"`{text_col}`", f"cast(`{id_col}` as long)").mapInArrow(lean(run), ddl)
