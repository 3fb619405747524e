"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of hashed table rows: one for the whole word and two for its
first bytes (so inflected and compounded forms share weights). Filters of several widths run
over the word sequence of the whole text, each is max-pooled over the text, and a logistic
layer gives the score. All labelled documents are learnt from. If there are at most ``FIT_ROWS`` (of at
most ``FIT_TOTAL`` words together), embeddings, filters and output layer are learnt together from their
hashed words in one task. If there are more, the first of them, in the order of a hash of their
id, only give the weights to start from; then each of ``SHARDS`` tasks goes over its share of all of
them, whatever the length of each, and the tasks' weights, of fixed size, are averaged, ``ROUNDS`` times.
Max pooling sends a gradient to one place a filter, so steps are cheap.

One part in five of the labelled documents is set aside to calibrate: for each language the threshold
with the best F1 is found there (the whole set's where a language has too few toxic documents; with
more than ``FIT_ROWS`` documents it is found among ``CELLS`` steps, from counts).
The language chooses the threshold of the extra column toxic_in_language, never the score.

Labels are used only where crc32(doc_id as text) mod 3 is not 1.

Defined results: null and blank texts have the score of the empty word sequence; without
usable labels of both values every score is the smoothed share of label 1; rows with a null
doc_id are scored and not held out; labels that are null or outside 0/1 are skipped; repeated
rows each return a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohort.llm.common import cut, ship, slices, text_bytes
from kohort.llm.mil_quality import held_out, sample_ids, sample_within

FIT_ROWS = 8000
FIT_TOTAL = 1024 * FIT_ROWS  # words that the fitted documents have together
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
ROWS, DIM = 1 << 15, 8
PREFIXES = (4, 6)
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, BATCH, RATE = 8, 32, 0.01
CALIBRATE_TOXIC = 20  # a language's own threshold needs so many toxic documents
STEP_WORDS = 1 << 16
SHARDS, ROUNDS, REFINE_RATE = 32, 2, 0.002  # of the passes over all labelled documents
BLOCK_DOCS, BLOCK_WORDS = 256, 1 << 18  # a packed block ends at either
CELLS = 10_000  # steps of the scores that thresholds are counted in


def word_rows(texts: list[bytes]):
    """(table rows of every word, int32 words x (1 + prefixes); number of words of each text)."""
    import numpy as np
    from kohort.llm import words
    rows, owners = [np.zeros((0, 1 + len(PREFIXES)), np.int32)], [np.zeros(0, np.int64)]
    for data, owner, starts in words.segments(texts):
        data = words.LOWER[data]
        a, b = words.spans(data, words.ALNUM)
        owners.append(owner[np.searchsorted(starts, a, "right") - 1])
        h = words.Hasher(data)
        cols = [h(a, b)] + [h(a, np.minimum(b, a + p)) + np.uint64(p) for p in PREFIXES]
        rows.append(np.stack([(c % np.uint64(ROWS)).astype(np.int32) for c in cols], axis=1))
    return np.concatenate(rows), np.bincount(np.concatenate(owners), minlength=len(texts))


def start(seed: int) -> dict:
    import numpy as np
    rnd = np.random.default_rng(seed)
    model = {"T": rnd.normal(0, 0.1, (ROWS, DIM)), "c": rnd.normal(0, 0.3, len(WIDTHS) * FILTERS), "b": np.full((), -2.0)}
    model |= {f"W{w}": rnd.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS} | {f"k{w}": np.zeros(FILTERS) for w in WIDTHS}
    return {k: v.astype(np.float32) for k, v in model.items()}


def forward(model: dict, rows, n_of):
    """(scores, pooled values, padded embeddings, text starts, convolutions, places of the words).

    A text is followed by 2 (widest - 1) blanks; no window starts in the second half of them, so
    none reaches the next text."""
    import numpy as np
    lap = WIDTHS[-1] - 1
    pad = 2 * lap
    n_pad = n_of + pad
    starts = np.cumsum(n_pad) - n_pad
    x = np.zeros((int(n_pad.sum()) + lap, DIM), np.float32)
    closed = (np.cumsum(n_pad)[:, None] - np.arange(1, lap + 1)).ravel()
    at = np.arange(len(rows)) + np.repeat(np.arange(len(n_of)) * pad, n_of)
    x[at] = sum(model["T"][rows[:, j]] for j in range(rows.shape[1]))
    n = int(n_pad.sum())
    pooled, conv, lo = [], [], 0
    taps = x @ np.concatenate([t for w in WIDTHS for t in model[f"W{w}"]], axis=1)  # every filter's every column at every word
    for w in WIDTHS:
        y = taps[:n, lo:lo + FILTERS].copy()
        for j in range(1, w):
            y += taps[j:n + j, lo + j * FILTERS:lo + (j + 1) * FILTERS]
        lo += w * FILTERS
        y[closed] = -1e30
        pooled.append(np.maximum.reduceat(y, starts))
        conv.append(y)
    p = np.maximum(np.concatenate(pooled, axis=1) + np.concatenate([model[f"k{w}"] for w in WIDTHS]), 0)
    return 1 / (1 + np.exp(-np.clip(p @ model["c"] + model["b"], -30, 30))), p, x, starts, conv, at


def gradients(model: dict, rows, n_of, label, weight):
    """Gradients of the mean weighted log loss; the table's as (rows, values)."""
    import numpy as np
    if len(n_of) == 1 and n_of[0] > 2 * STEP_WORDS:
        y, p, x, peaks, at, rows = _peaks(model, rows)
    else:
        y, p, x, starts, conv, at = forward(model, rows, n_of)
        stops = np.append(starts[1:], len(conv[0]))
        peaks = [np.stack([a + c[a:b].argmax(axis=0) for a, b in zip(starts, stops)]) for c in conv]  # texts x filters
    d = (y - label) * weight / len(label)
    g = {"c": p.T @ d, "b": d.sum()}
    d_p = d[:, None] * model["c"] * (p > 0)
    d_x = np.zeros_like(x)
    for k, w in enumerate(WIDTHS):
        d_k = d_p[:, k * FILTERS:(k + 1) * FILTERS]
        g[f"k{w}"] = d_k.sum(axis=0)
        best = peaks[k]
        g_w = np.zeros_like(model[f"W{w}"])
        for j in range(w):
            taken = x[best + j]                                   # texts x filters x dim
            g_w[j] = np.einsum("tfd,tf->df", taken, d_k)
            np.add.at(d_x, (best + j).ravel(), (d_k[:, :, None] * model[f"W{w}"][j].T[None]).reshape(-1, DIM))
        g[f"W{w}"] = g_w
    hit = np.flatnonzero(d_x[at].any(axis=1))
    return y, g, rows[hit], d_x[at[hit]]


def _peaks(model: dict, rows):
    """What gradients needs of one long text, found in windows: (score, pooled values, embeddings of the
    words of the pooled places and what follows them, the places among these, those of the words, their rows)."""
    import numpy as np
    lap, n = WIDTHS[-1] - 1, len(rows)
    top = [np.full(FILTERS, -np.inf, np.float32) for _ in WIDTHS]
    place = [np.zeros(FILTERS, np.int64) for _ in WIDTHS]
    for a in range(0, n, STEP_WORDS):
        m = min(n, a + STEP_WORDS + lap) - a
        conv = forward(model, rows[a:a + m], np.array([m]))[4]
        for k, y in enumerate(conv):
            y = y[:STEP_WORDS] if a + m < n else y  # later windows lie in the next part
            i = y.argmax(axis=0)
            v = y[i, np.arange(FILTERS)]
            place[k] = np.where(v > top[k], a + i, place[k])
            top[k] = np.maximum(top[k], v)
    near = np.unique(np.concatenate([(b[:, None] + np.arange(w)).ravel() for b, w in zip(place, WIDTHS)]))
    at = np.flatnonzero(near < n)  # beyond the text are blanks
    x = np.zeros((len(near), DIM), np.float32)
    x[at] = sum(model["T"][rows[near[at], j]] for j in range(rows.shape[1]))
    p = np.maximum(np.concatenate(top)[None] + np.concatenate([model[f"k{w}"] for w in WIDTHS]), 0)
    return 1 / (1 + np.exp(-np.clip(p @ model["c"] + model["b"], -30, 30))), p, x, [np.searchsorted(near, b)[None] for b in place], at, rows[near[at]]


def _batch_gradients(model: dict, rows, n_of, label, weight):
    """Gradients of a batch, summed over parts of about STEP_WORDS words: (gradients, table rows, values)."""
    import numpy as np
    ends = np.cumsum(n_of)
    g, hits, a = {}, [], 0
    while a < len(n_of):
        base = ends[a] - n_of[a]
        b = max(a + 1, int(np.searchsorted(ends, base + STEP_WORDS, "right")))
        share = (b - a) / len(n_of)
        _, part, hit, d_hit = gradients(model, rows[base:ends[b - 1]], n_of[a:b], label[a:b], weight[a:b])
        g = {k: g.get(k, 0) + share * v for k, v in part.items()}
        hits.append((hit, share * d_hit))
        a = b
    return g, np.concatenate([h for h, _ in hits]), np.concatenate([d for _, d in hits])


def _weights(label, share: float):
    import numpy as np
    return np.where(label == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) * 0.5 + 0.5


def _step(model: dict, m1: dict, m2: dict, t: int, rate: float, rows, n_of, label, weight) -> None:
    """The t-th step of the model, in place, with its running means of gradients and of their squares."""
    import numpy as np
    g, hit, d_hit = _batch_gradients(model, rows, n_of, label, weight)
    for k in g:
        m1[k] = 0.9 * m1[k] + 0.1 * g[k]
        m2[k] = 0.999 * m2[k] + 0.001 * g[k] * g[k]
        model[k] = (model[k] - rate * (m1[k] / (1 - 0.9 ** t)) / (np.sqrt(m2[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    if len(hit):  # the table's rows move only where a word was pooled (sparse Adagrad)
        at, which = np.unique(hit.ravel(), return_inverse=True)
        d = np.zeros((len(at), DIM), np.float32)
        np.add.at(d, which, np.repeat(d_hit, hit.shape[1], axis=0))
        m2["T"][at] += d * d
        model["T"][at] -= 5 * rate * d / (np.sqrt(m2["T"][at]) + 1e-6)


def fit(rows, n_of, label, seed: int = 9) -> dict:
    """Weights learnt from word rows, words of each text and labels."""
    import numpy as np
    rnd = np.random.default_rng(seed)
    model = start(seed)
    m1, m2, t = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    starts = np.cumsum(n_of) - n_of
    share = label.mean()
    weight = _weights(label, share)
    steps = EPOCHS * -(-len(label) // BATCH)
    for _ in range(EPOCHS):
        order = rnd.permutation(len(label))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            own = np.concatenate([rows[starts[i]:starts[i] + n_of[i]] for i in pick])
            t += 1
            _step(model, m1, m2, t, RATE * (1 - (t - 1) / steps), own, n_of[pick], label[pick], weight[pick])
    return model


def score(model: dict, rows, n_of):
    """Scores of many texts, in steps of about STEP_WORDS words."""
    import numpy as np
    if "prior" in model:
        return np.full(len(n_of), model["prior"])
    out, ends = [], np.cumsum(n_of)
    a = 0
    while a < len(n_of):
        base = ends[a] - n_of[a]
        b = max(a + 1, int(np.searchsorted(ends, base + STEP_WORDS, "right")))
        if b == a + 1 and n_of[a] > 2 * STEP_WORDS:
            out.append(_long(model, rows[base:ends[a]]))
        else:
            out.append(forward(model, rows[base:ends[b - 1]], n_of[a:b])[0])
        a = b
    return np.concatenate(out) if out else np.zeros(0)


def _long(model: dict, rows):
    """One long text: windows of it overlap by widest - 1 words, their pooled maxima are joined."""
    import numpy as np
    lap, n = WIDTHS[-1] - 1, len(rows)
    parts = [forward(model, rows[a:a + STEP_WORDS + lap], np.array([min(n, a + STEP_WORDS + lap) - a]))[1] for a in range(0, n, STEP_WORDS)]
    p = np.max(parts, axis=0)
    return 1 / (1 + np.exp(-np.clip(p @ model["c"] + model["b"], -30, 30)))


def thresholds(y, label, lang) -> dict:
    """Best F1 threshold of each language; under None, of all."""
    import numpy as np

    def best(s, t):
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(t[order])
        f1 = 2 * hits / (np.arange(len(s)) + 1 + t.sum())
        f1[:-1][s[order][:-1] == s[order][1:]] = -1  # a cut lies between different scores
        i = int(f1.argmax())
        return float((s[order][i] + (s[order][i + 1] if i + 1 < len(s) else 0)) / 2)

    out = {None: best(y, label) if label.any() else THRESHOLD}
    for k in set(lang):
        own = np.array([x == k for x in lang])
        out[k] = best(y[own], label[own]) if label[own].sum() >= CALIBRATE_TOXIC else out[None]
    return out


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict, dict]:
    """(model, thresholds by language), learnt from all usable labels."""
    chosen = sample_ids(labels, "toxic", FOLDS, HELD_OUT, FIT_ROWS)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out(FOLDS, HELD_OUT)).select(F.col("doc_id").cast("long").alias("doc_id"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    within = sample_within(docs, chosen, n_words, FIT_ROWS, FIT_TOTAL)
    model, cuts = _train_on(docs, within)
    if usable.distinct().count() <= FIT_ROWS:
        left = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(chosen), "doc_id", "left_semi").join(F.broadcast(within), "doc_id", "left_anti")
        if left.isEmpty():
            return model, cuts
    held = packed(docs, labels)
    return refine(held, model)


def packed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (n_of, label, aside, lang, x): blocks of all documents that may be learnt from, with their words' table
    rows, compressed. A document's block and place follow from its id's hash, not from the table's layout."""
    ship(docs.sparkSession)
    key = F.col("doc_id").cast("long").alias("doc_id")
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out(FOLDS, HELD_OUT))
             .groupBy(key).agg(F.max("toxic").cast("int").alias("label")))
    texts = docs.select(key, F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("doc_id").isNotNull()).where(~held_out(FOLDS, HELD_OUT))
    both = (known.select("doc_id", "label", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(0).alias("kind"))
            .unionByName(texts.select("doc_id", F.lit(None).cast("int").alias("label"), "text", "lang", F.lit(1).alias("kind"))).withColumn("h", F.xxhash64("doc_id")))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from kohort.llm.toxic_cnn import BLOCK_DOCS, BLOCK_WORDS, word_rows
        own, now, label, words = [], None, 0, 0

        def block():
            n_of, of, aside, lang, x = zip(*own)
            small = pa.compress(np.concatenate(x).astype(np.uint16).T.tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([n_of], pa.list_(pa.int32())), pa.array([of], pa.list_(pa.int32())), pa.array([aside], pa.list_(pa.bool_())),
                                               pa.array([lang], pa.list_(pa.string())), pa.array([small], pa.binary())], names=["n_of", "label", "aside", "lang", "x"])

        for b in (part for batch in batches for part in slices(batch, 256)):
            ids, of, kinds, h, lang = (b.column(c).to_pylist() for c in ("doc_id", "label", "kind", "h", "lang"))
            rows, n_of = word_rows(text_bytes(b, "text"))
            ends = np.cumsum(n_of)
            for k in range(b.num_rows):
                if kinds[k] == 0:
                    now, label = ids[k], of[k]
                elif ids[k] == now:
                    own.append((int(n_of[k]), label, h[k] // SHARDS % 5 == 4, lang[k], rows[ends[k] - n_of[k]:ends[k]]))
                    words += int(n_of[k])
                    if len(own) >= BLOCK_DOCS or words >= BLOCK_WORDS:
                        yield block()
                        own, words = [], 0
        if own:
            yield block()

    shards = both.repartitionById(SHARDS, F.pmod("h", F.lit(SHARDS)).cast("int")).sortWithinPartitions("h", "doc_id", "kind", F.xxhash64("text"))
    return cut(shards.mapInArrow(run, "n_of array<int>, label array<int>, aside array<boolean>, lang array<string>, x binary"))


def _blocks(batches: Iterator) -> Iterator:
    """(words of each document, labels, whether set aside, languages, word rows) of the packed rows."""
    import numpy as np
    import pyarrow as pa
    for b in batches:
        for k in range(b.num_rows):
            n_of, label, aside = (np.array(b.column(c)[k].as_py()) for c in ("n_of", "label", "aside"))
            flat = pa.decompress(b.column("x")[k].as_py(), int(n_of.sum()) * (1 + len(PREFIXES)) * 2, codec="zstd", asbytes=True)
            yield n_of, label.astype(np.float32), aside, b.column("lang")[k].as_py(), np.frombuffer(flat, np.uint16).reshape(1 + len(PREFIXES), -1).T.astype(np.int32)


def refine(held: DataFrame, model: dict) -> tuple[dict, dict]:
    """(model, thresholds by language): passes over all packed documents from the given weights."""
    import numpy as np
    spark = held.sparkSession
    of = held.select(F.explode(F.arrays_zip("label", "aside")).alias("e")).groupBy("e.label").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("e.aside")).alias("learn")).collect()
    n, learn = ({r["label"]: r[c] for r in of} for c in ("n", "learn"))
    if not n.get(0) or not n.get(1):
        return {"prior": (n.get(1, 0) + 1) / (sum(n.values()) + 2)}, {None: THRESHOLD}
    model = start(9) if "prior" in model else model
    if learn[0] and learn[1]:
        share = learn[1] / (learn[0] + learn[1])
        for r in range(ROUNDS):
            sent, rate = spark.sparkContext.broadcast(model), REFINE_RATE * (1 - r / ROUNDS)

            def run(batches: Iterator, sent=sent, rate=rate) -> Iterator:
                import pyarrow as pa
                from kohort.llm.toxic_cnn import BATCH, _blocks, _flat, _step, _weights
                own = {k: v.copy() for k, v in sent.value.items()}
                m1, m2, t, n = {k: np.zeros_like(v) for k, v in own.items()}, {k: np.zeros_like(v) for k, v in own.items()}, 0, 0
                for n_of, label, aside, _, rows in _blocks(batches):
                    starts, use = np.cumsum(n_of) - n_of, np.flatnonzero(~aside)
                    for lo in range(0, len(use), BATCH):
                        pick = use[lo:lo + BATCH]
                        t, n = t + 1, n + len(pick)
                        _step(own, m1, m2, t, rate, np.concatenate([rows[starts[i]:starts[i] + n_of[i]] for i in pick]), n_of[pick], label[pick], _weights(label[pick], share))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([_flat(own).tobytes()], pa.binary())], names=["n", "w"])

            def mean(batches: Iterator) -> Iterator:
                import pyarrow as pa
                total, docs = 0.0, 0
                for p in sorted((p for b in batches for p in b.to_pylist()), key=lambda p: (p["n"], p["w"][:64])):  # SHARDS rows of fixed size
                    total, docs = total + p["n"] * np.frombuffer(p["w"], np.float32).astype(np.float64), docs + p["n"]
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array([(total / docs).astype(np.float32).tobytes()], pa.binary())], names=["w"])

            model = _shaped(held.mapInArrow(run, "n long, w binary").repartition(1).mapInArrow(mean, "w binary").collect()[0]["w"])
    return model, _counted_thresholds(held, model)


def _counted_thresholds(held: DataFrame, model: dict) -> dict:
    """As thresholds, for all documents set aside: their scores are counted by language in CELLS steps."""
    sent = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from kohort.llm.toxic_cnn import CELLS, _blocks, score
        for n_of, label, aside, lang, rows in _blocks(batches):
            use = np.flatnonzero(aside)
            if len(use):
                y = score(sent.value, rows[np.repeat(aside, n_of)], n_of[use])
                yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in use], pa.string()), pa.array(np.floor(y * CELLS).astype(np.int32)), pa.array(label[use].astype(np.int32))], names=["lang", "cell", "toxic"])

    counts = held.mapInArrow(run, "lang string, cell int, toxic int").groupBy("lang", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
    every = counts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    both = counts.where("lang IS NOT NULL").select(F.lit(False).alias("every"), "lang", "cell", "n", "toxic").unionByName(
        every.select(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang"), "cell", "n", "toxic"))
    group = Window.partitionBy("every", "lang")
    down = group.orderBy(F.col("cell").desc())      # at most CELLS + 1 rows a language
    f1 = both.select("every", "lang", "cell", F.sum("toxic").over(group).alias("total"), F.sum("toxic").over(down).alias("hits"), F.sum("n").over(down).alias("taken"),
                     ((F.col("cell") + F.coalesce(F.lead("cell").over(down) + 1, F.lit(0))) / (2.0 * CELLS)).alias("cut"))
    best = (f1.groupBy("every", "lang").agg(F.max_by("cut", F.struct(2 * F.col("hits") / (F.col("taken") + F.col("total")), F.col("cell"))).alias("cut"), F.first("total").alias("total"))
            .where((F.col("every") & (F.col("total") > 0)) | (F.col("total") >= CALIBRATE_TOXIC)).collect())      # a row a language
    return {None: THRESHOLD} | {None if r["every"] else r["lang"]: r["cut"] for r in best}


def _train_on(docs: DataFrame, chosen: DataFrame) -> tuple[dict, dict]:
    """(model, thresholds by language) learnt in one task from a bounded number of documents; the driver
    gets the weights, of fixed size, and the thresholds."""
    import numpy as np
    ship(docs.sparkSession)
    found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
             .join(F.broadcast(chosen), "doc_id"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.toxic_cnn import word_rows
        for b in (part for batch in batches for part in slices(batch)):
            rows, n_of = word_rows(text_bytes(b, "text"))
            ends = np.cumsum(n_of)
            flat = [rows[e - n:e].tobytes() for e, n in zip(ends, n_of)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(flat, pa.binary())], names=["doc_id", "lang", "label", "x"])

    def learn(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.toxic_cnn import _flat, _learnt
        own = [b for b in batches if b.num_rows]
        if own:
            model, cuts = _learnt(pa.Table.from_batches(own).to_pandas())
            prior, flat = model.get("prior"), None if "prior" in model else _flat(model).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([prior], pa.float64()), pa.array([flat], pa.binary()), pa.array([list(cuts)], pa.list_(pa.string())),
                                              pa.array([list(cuts.values())], pa.list_(pa.float64()))], names=["prior", "w", "lang", "cut"])

    rows = found.mapInArrow(run, "doc_id long, lang string, label int, x binary").repartition(1)  # FIT_ROWS rows at most
    got = rows.mapInArrow(learn, "prior double, w binary, lang array<string>, cut array<double>").collect()
    if not got:
        return {"prior": 0.5}, {None: THRESHOLD}
    return {"prior": got[0]["prior"]} if got[0]["w"] is None else _shaped(got[0]["w"]), dict(zip(got[0]["lang"], got[0]["cut"]))


def _flat(model: dict):
    """All weights in the order of their names in start()."""
    import numpy as np
    return np.concatenate([np.ravel(v) for v in model.values()]).astype(np.float32)


def _shaped(flat: bytes) -> dict:
    """The model whose weights these are."""
    import numpy as np
    like = start(9)
    parts = np.split(np.frombuffer(flat, np.float32), np.cumsum([v.size for v in like.values()])[:-1])
    return {k: v.reshape(like[k].shape) for k, v in zip(like, parts)}


def _learnt(got) -> tuple[dict, dict]:
    """(model, thresholds by language) of the documents' word rows, languages and labels."""
    import numpy as np
    got = got.sort_values(["doc_id", "x"], kind="stable")
    label = got["label"].to_numpy(np.float32)
    if len(set(label)) < 2:
        prior = (float(label.sum()) + 1) / (len(label) + 2)
        return {"prior": prior}, {None: THRESHOLD}
    texts = [np.frombuffer(v, np.int32).reshape(-1, 1 + len(PREFIXES)) for v in got["x"]]
    n_of = np.array([len(v) for v in texts])
    aside = np.arange(len(label)) % 5 == 4
    if len(set(label[~aside])) < 2 or not aside.any():
        aside[:] = False
    learn = np.flatnonzero(~aside)
    model = fit(np.concatenate([texts[i] for i in learn]), n_of[learn], label[learn])
    rest = np.flatnonzero(aside)
    if not len(rest):
        return model, {None: THRESHOLD}
    y = score(model, np.concatenate([texts[i] for i in rest]), n_of[rest])
    lang = [v if isinstance(v, str) else None for v in got["lang"].to_numpy()[rest]]
    cuts = thresholds(y, label[rest], [v for v in lang])
    return model, cuts


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """Rows (doc_id, lang, score, n_words)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: the table and the filters

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from kohort.llm.toxic_cnn import score, word_rows
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows, n_of = word_rows(text_bytes(part, "text"))
                y = score(sent.value, rows, n_of)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(y.astype(float)), pa.array(n_of)],
                                                 names=["doc_id", "lang", "score", "n_words"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .mapInArrow(run, "doc_id long, lang string, score double, n_words long"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted; and n_words, toxic_in_language."""
    model, cuts = train(docs, labels)
    cut = F.lit(cuts[None])
    for lang, value in sorted((k, v) for k, v in cuts.items() if k is not None):
        cut = F.when(F.col("lang") == lang, value).otherwise(cut)
    return scored(docs, model).select(
        "doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_words", (F.col("score") >= cut).cast("int").alias("toxic_in_language"))
