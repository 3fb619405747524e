"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage of the whole text is
encoded: byte-class shares, word-length and repetition measures and hashed word counts go
through a tanh layer. Gated attention, softmax_k w.(tanh(V h_k) * sigmoid(U h_k)), weighs the
passages; the score is a logistic function of the weighted sum. All weights are learnt
together from document labels, in numpy, on at most ``FIT_ROWS`` labelled documents (taken in
the order of a hash of their id, of at most ``FIT_TOTAL`` passages together, whatever the length
of each; the encodings of those alone reach the driver). Scoring is one pass over the documents without a shuffle.

Labels are used only where crc32(doc_id as text) mod 5 is not 0; labels, lang, source and
doc_id never enter a score.

Defined results: null and blank texts are a bag of one passage without words and get that
bag's score; without usable labels of both values every score is the smoothed share of label
1; rows with a null doc_id are scored and not held out; labels that are null or outside 0/1
are skipped, a doc_id with several labels counts with the largest; repeated rows each return
a row; an empty table gives an empty result; clashing extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.llm.common import ship, slices, text_bytes

PASSAGE_WORDS = 64
FIT_ROWS = 6000
FIT_TOTAL = 64 * FIT_ROWS  # passages that the fitted documents have together
BUCKETS = 48
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
HIDDEN, GATE = 24, 16
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.01, 1e-4


def _classes():
    import numpy as np
    kind = np.zeros(256, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".", b",", b"!?",
                               b"|", b"$", b"#", b"%&*", b":;", b"()[]{}<>", b"@/\\", b"-_'\"`"), 1):
        kind[list(chars)] = k
    kind[128:] = 17
    return kind


N_CLASSES = 18
N_FEATURES = N_CLASSES + BUCKETS + 7


def passages(texts: list[bytes]):
    """(features float32 of all passages, number of passages of each text)."""
    import numpy as np
    from kohort.llm import words
    kind, rows, owners = _classes(), [], []
    for data, owner, starts in words.segments(texts):
        a, b = words.spans(data, ~words.SPACE)
        seg = np.searchsorted(starts, a, "right") - 1
        first = np.searchsorted(a, starts)  # the segment's first word
        nth = np.arange(len(a)) - first[seg]
        new = nth % PASSAGE_WORDS == 0
        n_words = np.diff(np.append(first, len(a)))
        own = np.repeat(owner, -(-n_words // PASSAGE_WORDS))
        if not len(a):
            continue
        of_word = np.cumsum(new) - 1
        n = int(of_word[-1]) + 1
        begin = a[new]
        # a passage's bytes go up to the next one's, or to the end of its segment; those before
        # a segment's first word belong to no passage
        of_byte = np.repeat(np.arange(n), np.diff(np.append(begin, len(data))))
        close = np.append(starts[1:], len(data))[seg[new]] - 1
        edge = np.zeros(len(data) + 1, np.int8)
        np.add.at(edge, begin, 1)
        np.subtract.at(edge, np.minimum(np.append(begin[1:], len(data)), close), 1)
        k = np.where(np.cumsum(edge[:-1], dtype=np.int8)[begin[0]:] > 0, kind[data[begin[0]:]], N_CLASSES)
        counts = np.bincount(of_byte * (N_CLASSES + 1) + k, minlength=n * (N_CLASSES + 1)).reshape(n, N_CLASSES + 1)[:, :N_CLASSES]
        h = words.Hasher(words.LOWER[data])(a, b)
        per = np.bincount(of_word, minlength=n)
        hashed = np.bincount(of_word * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
        same = np.zeros(len(a), bool)
        same[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
        key = np.sort((of_word.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        distinct = np.bincount((key[fresh] >> np.uint64(44)).astype(np.int64), minlength=n)
        length = b - a
        x = np.empty((n, N_FEATURES), np.float32)
        x[:, :N_CLASSES] = counts / counts.sum(axis=1, keepdims=True)
        x[:, N_CLASSES:N_CLASSES + BUCKETS] = hashed / per[:, None]
        for j, v in enumerate((np.bincount(of_word, same, n) / per, distinct / per, np.log1p(per) / 4, np.bincount(of_word, length, n) / per / 10,
                               np.bincount(of_word, length <= 2, n) / per, np.bincount(of_word, length > 14, n) / per,
                               np.sqrt(np.maximum(0, np.bincount(of_word, length * length, n) / per - (np.bincount(of_word, length, n) / per) ** 2)) / 5)):
            x[:, N_CLASSES + BUCKETS + j] = v
        rows.append(x)
        owners.append(own)
    n_of = np.zeros(len(texts), np.int64)
    if owners:
        n_of += np.bincount(np.concatenate(owners), minlength=len(texts))
    made = np.concatenate(rows) if rows else np.zeros((0, N_FEATURES), np.float32)
    # a text without words is one passage of zeros
    at = np.repeat(np.cumsum(n_of) - n_of, n_of == 0)
    made = np.insert(made, at, 0, axis=0) if len(at) else made
    return made, np.maximum(n_of, 1)


def forward(model: dict, x, n_of):
    """(scores of the bags, what the gradient needs)."""
    import numpy as np
    starts = np.cumsum(n_of) - n_of
    bag = np.repeat(np.arange(len(n_of)), n_of)
    z = (x - model["mean"]) / model["scale"]
    h = np.tanh(z @ model["E"] + model["e"])
    v, u = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    s = (v * u) @ model["w"]
    p = np.exp(s - np.maximum.reduceat(s, starts)[bag])
    p /= np.add.reduceat(p, starts)[bag]
    rep = np.add.reduceat(p[:, None] * h, starts)
    y = 1 / (1 + np.exp(-np.clip(rep @ model["c"] + model["b"], -30, 30)))
    return y, (starts, bag, z, h, v, u, p, rep)


def gradients(model: dict, x, n_of, label):
    """Gradients of the mean log loss."""
    import numpy as np
    y, (starts, bag, z, h, v, u, p, rep) = forward(model, x, n_of)
    d = (y - label) / len(label)
    g = {"c": rep.T @ d, "b": d.sum()}
    d_rep = d[:, None] * model["c"]
    d_h = p[:, None] * d_rep[bag]
    d_p = (h * d_rep[bag]).sum(axis=1)
    d_s = p * (d_p - np.add.reduceat(p * d_p, starts)[bag])
    g["w"] = (v * u).T @ d_s
    d_vu = d_s[:, None] * model["w"]
    d_v, d_u = d_vu * u * (1 - v * v), d_vu * v * u * (1 - u)
    g["V"], g["U"] = h.T @ d_v, h.T @ d_u
    d_h = (d_h + d_v @ model["V"].T + d_u @ model["U"].T) * (1 - h * h)
    g["E"], g["e"] = z.T @ d_h, d_h.sum(axis=0)
    return g


def fit(x, n_of, label, seed: int = 5) -> dict:
    """Weights learnt from bags (features, passages of each bag, labels)."""
    import numpy as np
    rnd = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    model = {"E": rnd.normal(0, 0.15, (x.shape[1], HIDDEN)), "e": np.zeros(HIDDEN), "V": rnd.normal(0, 0.3, (HIDDEN, GATE)),
             "U": rnd.normal(0, 0.3, (HIDDEN, GATE)), "w": rnd.normal(0, 0.3, GATE), "c": rnd.normal(0, 0.3, HIDDEN), "b": np.zeros(())}
    model = {k: v.astype(np.float32) for k, v in model.items()}
    fixed = {"mean": mean.astype(np.float32), "scale": scale.astype(np.float32)}
    m1, m2, t = {k: 0.0 for k in model}, {k: 0.0 for k in model}, 0
    starts = np.cumsum(n_of) - n_of
    steps = EPOCHS * -(-len(label) // BATCH)
    for _ in range(EPOCHS):
        order = rnd.permutation(len(label))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            rows = np.concatenate([np.arange(starts[i], starts[i] + n_of[i]) for i in pick])
            g = gradients(model | fixed, x[rows], n_of[pick], label[pick])
            t += 1
            rate = RATE * (1 - (t - 1) / steps)
            for k in model:
                d = g[k] + DECAY * model[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                model[k] = (model[k] - rate * (m1[k] / (1 - 0.9 ** t)) / (np.sqrt(m2[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return model | fixed


def held_out(folds: int, fold: int):
    """True where crc32(doc_id as text) mod folds is the held-out fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def sample_ids(labels: DataFrame, target: str, folds: int, fold: int, rows: int) -> DataFrame:
    """At most ``rows`` (doc_id, label) that may be learnt from, by the order of a hash of the id."""
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).where(~held_out(folds, fold))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("int").alias("label")))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sample_within(docs: DataFrame, chosen: DataFrame, size, rows: int, total: int) -> DataFrame:
    """The ids of chosen, in its order, until their documents would be more than ``rows`` or of more than
    ``total`` size together. An id that alone is too much is passed over; no other length matters."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size")).join(F.broadcast(chosen), "doc_id")
    per = found.groupBy("doc_id").agg(F.first("label").alias("label"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.xxhash64("doc_id").alias("h"))
    taken, left, room = [], rows, total
    for r in sorted(per.collect(), key=lambda r: (r.h, r.doc_id)):  # one row an id of the bounded sample
        if r.n > rows or r["size"] > total:
            continue
        left, room = left - r.n, room - r["size"]
        if left < 0 or room < 0:
            break
        taken.append((r.doc_id, r.label))
    return docs.sparkSession.createDataFrame(taken, "doc_id long, label int")


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model, or {"prior": share} without labels of both values."""
    import numpy as np
    ship(docs.sparkSession)
    n_passages = F.greatest(F.lit(1), F.ceil(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) / PASSAGE_WORDS)).cast("long")
    chosen = sample_within(docs, sample_ids(labels, "quality", FOLDS, HELD_OUT, FIT_ROWS), n_passages, FIT_ROWS, FIT_TOTAL)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.mil_quality import passages
        for b in (part for batch in batches for part in slices(batch)):
            x, n_of = passages(text_bytes(b, "text"))
            ends = np.cumsum(n_of)
            flat = [x[e - n:e].tobytes() for e, n in zip(ends, n_of)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(flat, pa.binary())], names=["doc_id", "label", "x"])

    got = found.mapInArrow(run, "doc_id long, label int, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"], kind="stable")
    label = got["label"].to_numpy(np.float32)
    if len(set(label)) < 2:
        return {"prior": (float(label.sum()) + 1) / (len(label) + 2)}
    bags = [np.frombuffer(v, np.float32).reshape(-1, N_FEATURES) for v in got["x"]]
    return fit(np.concatenate(bags), np.array([len(v) for v in bags]), label)


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """Rows (row struct of docs' columns, score double, n_passages long)."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from kohort.llm.mil_quality import forward, passages
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x, n_of = passages(text_bytes(part, "text"))
                y = np.full(len(n_of), model["prior"]) if "prior" in model else forward(model, x, n_of)[0]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(y.astype(float)), pa.array(n_of)], names=["row", "score", "n_passages"])

    return docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted; and n_passages."""
    model = train(docs, labels)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    out = out.select("row.doc_id", "score", "n_passages")
    return out.select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with docs' columns."""
    return scored(docs, train(docs, labels)).where(F.col("score") >= THRESHOLD).select("row.*")
