"""Quality scores by gated-attention multiple-instance learning.

A document is a bag of passages.  Each passage is encoded from its characters and
the recurrence of its words; a gated attention weighs the encodings, and the
weighted sum decides.  Only documents have labels, so encoder, attention and
decision are learned together, by gradients of the documents' loss.  The model
is fitted on a bounded sample of the labelled rows, each with all its passages,
and is of a fixed size, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import binary_list, lean, release_memory, small_batches, stored

#: Words of a passage.
PASSAGE = 48
#: Groups of bytes whose shares describe a passage: each ASCII mark by itself.
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
GROUPS = 7 + len(PUNCTUATION)
WORD_FEATURES = 9
FEATURES = GROUPS + WORD_FEATURES
HIDDEN, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 14, 64, 0.004, 1e-4, 11


def _groups():
    import numpy as np

    group = np.zeros(256, np.int64)  # 0: control
    for b in range(256):
        c = chr(b)
        if c in " \t\n\r\x0b\x0c":
            group[b] = 1 if c == " " else 2
        elif b >= 0x80:
            group[b] = 3
        elif c.islower():
            group[b] = 4
        elif c.isupper():
            group[b] = 5
        elif c.isdigit():
            group[b] = 6
        elif b in PUNCTUATION:
            group[b] = 7 + PUNCTUATION.index(b)
    return group


_tables: dict = {}


def passages(text: bytes):
    """(passages, FEATURES): one row for each ``PASSAGE`` words of the whole text; a text without words has one row."""
    import numpy as np

    if not _tables:
        _tables["group"] = _groups()
        _tables["space"] = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    group, space = _tables["group"], _tables["space"]
    words = text.split()
    n = len(words)
    if not n:
        out = np.zeros((1, FEATURES))
        out[0, -1] = 1
        return out
    buf = np.frombuffer(text, np.uint8)
    gap = space[buf]
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    first = np.arange(0, n, PASSAGE)
    p = len(first)
    bounds = np.r_[0, start[first[1:]], len(buf)]
    sizes = np.diff(bounds)
    counts = np.bincount(np.repeat(np.arange(p) * GROUPS, sizes) + group[buf], minlength=p * GROUPS).reshape(p, GROUPS)
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    most = np.maximum.accumulate(ids)
    lengths = np.fromiter(map(len, words), np.float64, n)
    flags = np.zeros((n, 6))
    flags[:, 0] = np.r_[True, most[1:] > most[:-1]]  # new to the document
    flags[1:, 1] = ids[1:] == ids[:-1]
    flags[2:, 2] = ids[2:] == ids[:-2]
    initial = buf[start]
    flags[:, 3] = (initial >= 65) & (initial <= 90)
    flags[:, 4] = lengths / 10
    flags[:, 5] = lengths == 1
    many = np.minimum(PASSAGE, n - first)[:, None]
    out = np.empty((p, FEATURES))
    out[:, :GROUPS] = counts / sizes[:, None]
    out[:, GROUPS : GROUPS + 6] = np.add.reduceat(flags, first, axis=0) / many
    out[:, GROUPS + 6] = many[:, 0] / PASSAGE
    out[:, GROUPS + 7] = np.add.reduceat((lengths / 10) ** 2, first) / many[:, 0]
    out[:, GROUPS + 8] = 0
    return out


def _sigmoid(x):
    import numpy as np

    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(w: dict, x, starts):
    """Logits of bags of passages ``x`` that begin at ``starts``, with what the gradients need."""
    import numpy as np

    sizes = np.diff(np.r_[starts, len(x)])
    bag = np.repeat(np.arange(len(starts)), sizes)
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t, g = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
    s = (t * g) @ w["attend"]
    e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return z @ w["decide"] + w["decide0"], (bag, h, t, g, a, z)


def gradients(w: dict, x, starts, kept, dy) -> dict:
    import numpy as np

    bag, h, t, g, a, z = kept
    dz = dy[:, None] * w["decide"]
    da = (h * dz[bag]).sum(axis=1)
    ds = a * (da - np.add.reduceat(a * da, starts)[bag])
    dtg = ds[:, None] * w["attend"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ w["value"].T + dg @ w["gate"].T) * (1 - h * h)
    return {
        "encode": x.T @ dh, "encode0": dh.sum(axis=0), "value": h.T @ dt, "gate": h.T @ dg,
        "attend": (t * g).T @ ds, "decide": z.T @ dy, "decide0": np.array(dy.sum()),
    }


def train(bags: list, labels, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Weights for bags of passages with labels of 0 or 1, by Adam on the log loss; the same for the same input.

    Passages stay as they come, in single precision if they do so; a batch at a
    time is scaled, so memory is that of the bags.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES))
    sizes = np.array([len(b) for b in bags], np.int64)
    first = np.cumsum(sizes) - sizes
    mean, scale = every.mean(axis=0, dtype=np.float64), every.std(axis=0, dtype=np.float64) + 1e-3
    labels = np.asarray(labels, float)
    share = (labels.sum() + 1) / (len(labels) + 2)
    n = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {
        "encode": n(FEATURES, HIDDEN), "encode0": np.zeros(HIDDEN), "value": n(HIDDEN, ATTENTION), "gate": n(HIDDEN, ATTENTION),
        "attend": n(ATTENTION), "decide": n(HIDDEN), "decide0": np.array(np.log(share / (1 - share))),
    }
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    if not bags:
        w["decide"] *= 0
    for epoch in range(epochs if bags else 0):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            rows = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in some])
            x = np.clip((every[rows].astype(float) - mean) / scale, -6, 6)
            starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
            y, kept = forward(w, x, starts)
            grads = gradients(w, x, starts, kept, (_sigmoid(y) - labels[some]) / len(some))
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k, d in grads.items():
                d = d + DECAY * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w | {"mean": mean, "scale": scale}


def predict(w: dict, bags: list):
    """Scores of bags of raw passages."""
    import numpy as np

    if not bags:
        return np.zeros(0)
    x = np.clip((np.concatenate(bags) - w["mean"]) / w["scale"], -6, 6)
    starts = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
    return _sigmoid(forward(w, x, starts)[0])


def remainder(id_col: str, mod: int) -> Column:
    """crc32(id as text) mod ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % mod


class QualityModel:
    """Fitted on rows of ``docs`` (id, text) that ``labels`` (id, label of 0 or 1) marks.

    Labelled ids are taken in the order of a hash of the id, ``sample`` at most,
    and fewer where their texts have more than ``most_passages`` passages
    together; of each that is taken, all passages count.  Labels other than
    exactly 0 or 1 are left out; of several labels of an id the smallest counts,
    as does one of several texts.  Null texts count as empty ones; null ids are
    never labelled.  With no labelled rows, every score is one half.
    """

    def __init__(
        self, docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample: int = 8000, most_passages: int = 400_000,
    ):
        small_batches(docs.sparkSession)
        number = F.col(f"`{label_col}`").cast("double")
        marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), number.alias("label")).where("label in (0.0, 1.0) and id is not null")
        marked = marked.groupBy("id").agg(F.min("label").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text).join(F.broadcast(marked), "id").select("text", "label", "id")
        encoded = rows.mapInArrow(lean(_encode), "label int, n int, features binary, id long")
        encoded = stored(encoded.groupBy("id").agg(F.min(F.struct("label", "n", "features")).alias("x")).select("id", "x.*"), "quality-training")
        order = [F.xxhash64("id"), F.col("id")]
        taken, total = [], 0
        for r in encoded.select("id", "n").orderBy(*order).collect():  # ``sample`` rows at most
            total += r.n
            if total > most_passages and taken:
                break
            taken.append(r.id)
        if total > most_passages:
            encoded = encoded.where(F.col("id").isin(taken))
        self.weights = self._fit(encoded.select("label", "n", "features").toLocalIterator())
        self.shared = docs.sparkSession.sparkContext.broadcast(self.weights)

    @staticmethod
    def _fit(rows) -> dict:
        import numpy as np

        rows = sorted(((bytes(r.features), r.label) for r in rows))
        bags = [np.frombuffer(features, np.float32).reshape(-1, FEATURES) for features, _ in rows]
        return train(bags, [label for _, label in rows])

    def score(self, df: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """``df`` with a score from 0 to 1 for each row, from its whole text alone; null texts count as empty.

        Equal texts get equal scores.  A column of the name ``score_col`` is
        replaced.  Only texts go to Python, and only scores come back.  An empty
        table gives an empty result.
        """
        small_batches(df.sparkSession)
        weights = self.shared

        @F.arrow_udf("double")
        def score(texts):
            import pyarrow as pa

            found, scores = binary_list(texts), []
            for k in range(0, len(found), 64):
                scores += predict(weights.value, [passages(t) for t in found[k : k + 64]]).tolist()
            del found
            release_memory()
            return pa.array(scores, pa.float64())

        return df.withColumn(score_col, score(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def _encode(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for text, label, id_ in zip(binary_list(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = passages(text).astype(np.float32)
            row = [label], [len(x)], [x.tobytes()], [id_]
            kinds = pa.int32(), pa.int32(), pa.binary(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["label", "n", "features", "id"])
