"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of letters and digits, A-Z lower-cased) are hashed to buckets, and
the buckets seen in enough training documents have embeddings. Filters of
several widths slide over the words; each filter's rectified outputs are
max-pooled over the whole text, and a logistic layer turns them into the score.
A filter's output is a sum of one table row for each word it covers, so scoring
costs a few gathers a word and reads texts of any length whole.

Training reads labels only where ``crc32(doc_id as text) mod 5`` is not 0, and
of these a sample by hash, of at most ``MAX_POSITIVE`` toxic and
``MAX_NEGATIVE`` other documents of at most ``MAX_FIT_BYTES``; these bounds are
what keeps the fit in the driver's memory. A fifth of the labelled documents, by another hash, is never in
the sample. All labelled documents outside it, however many, are scored where
they lie and counted in a histogram for each language, of which the driver reads
at most a row for each language and bin; a language's threshold is the one with
the largest F1. It is averaged with the threshold of all languages together,
which has the weight of ``PRIOR_LABELS`` toxic documents (and that one likewise
with 0.5), so that few labels move it little and no number of labels switches it
off; a language without labels has the pooled threshold. The sample takes more of
one kind of label than of the other once a bound binds, so that what is left is
weighted back to the kinds' numbers among all labels. The language decides the
threshold, never the score.

Defined results: a null or empty text is scored as one unknown word; a null id
counts as the empty string (held out); repeated rows are scored alike; labels
that are null are left out; without labels of both kinds every score is the
share of toxic labels; an empty table gives an empty result; extra columns pass
through ``with_scores`` and a column named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, release, table
from .near_dedup import Shingler

MAX_POSITIVE, MAX_NEGATIVE = 2000, 4000
#: Labelled documents of more bytes are not in the fit sample, so that its words fit the driver (6,000 x some 80 KB); like all others they calibrate and are scored whole.
MAX_FIT_BYTES = 100_000
BUCKET_BITS, MIN_DOCS = 20, 4
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
BATCH, RATE = 64, 0.01
#: Passes over the sample: EPOCHS, or as many as make STEPS batches.
EPOCHS, STEPS = 8, 600
PAD = max(WIDTHS) - 1
#: Toxic documents that the pooled threshold counts for, beside a language's own.
PRIOR_LABELS = 30
#: Bins of log odds a unit, and the log odds beyond which the outer bins hold everything.
BINS, BIN_END = 32, 12
#: ``best_threshold`` of fewer toxic documents is 0.5.
MIN_TO_CALIBRATE = 30

_WORD = np.ones(256, bool)
_WORD[:128] = [chr(i).isalnum() for i in range(128)]
SEPARATOR = ~_WORD


def held_out(col):
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def calibrates(col):
    """Labelled documents that are never trained on: a fifth, by a hash of their own."""
    return F.pmod(F.xxhash64(F.lit("calibration"), F.coalesce(col.cast("string"), F.lit(""))), F.lit(5)) == 0


def buckets_of(texts: list[bytes | None], shingler: Shingler) -> list[np.ndarray]:
    """Bucket of each word of each text."""
    out: list[np.ndarray] = []
    group, size = [], 0

    def flush() -> None:
        h, at = shingler.word_hashes(np.frombuffer(b"\n".join(group), np.uint8))
        bounds = np.searchsorted(at, np.concatenate([[0], np.cumsum([len(t) + 1 for t in group])]))
        small = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        out.extend(small[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))

    for t in texts:
        group.append(t or b"")
        size += len(group[-1])
        if size >= 1 << 20:
            flush()
            group, size = [], 0
    if group:
        flush()
    return out


def _flat(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all texts with padding (row 0) after each, and the pairs (start, end) of their own positions."""
    lengths = np.array([max(1, len(d)) for d in docs])
    starts = np.concatenate([[0], np.cumsum(lengths + PAD)])
    flat = np.zeros(starts[-1], np.int64)
    for s, d in zip(starts, docs, strict=False):
        flat[s : s + len(d)] = d
    return flat, np.stack([starts[:-1], starts[:-1] + lengths], 1).ravel()


@dataclass
class Model:
    lookup: np.ndarray  # bucket -> row of the embedding; 0: unknown
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)
    pooled_threshold: float = 0.5  # of languages without labels

    def pooled(self, docs: list[np.ndarray], argmax: bool = False):
        """Max-pooled outputs (documents x all filters); and where each was largest."""
        flat, pairs = _flat(docs)
        feats, places = [], []
        for w, (f, b) in enumerate(zip(self.filters, self.bias, strict=True)):
            tables = [self.embedding @ f[k] for k in range(WIDTHS[w])]
            conv = tables[0][flat]
            for k in range(1, WIDTHS[w]):
                conv[:-k] += tables[k][flat[k:]]
            conv = np.concatenate([conv, np.full((1, FILTERS), -np.inf, conv.dtype)])  # reduceat wants its last end inside
            feats.append(np.maximum.reduceat(conv, pairs, axis=0)[::2] + b)
            if argmax:
                places.append(np.stack([a + conv[a:e].argmax(0) for a, e in pairs.reshape(-1, 2)]))
        x = np.concatenate(feats, 1)
        return (x, flat, places) if argmax else x

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if not len(docs):
            return np.zeros(0)
        z = np.maximum(self.pooled([self.lookup[d] for d in docs]), 0) @ self.out + self.out_bias + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))  # in single floats all beyond 17 would be 1


class _Adam:
    def __init__(self, params: list[np.ndarray]):
        self.m, self.v, self.t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def step(self, params: list[np.ndarray], grads: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _evidence(docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in MIN_DOCS documents or more, and how many standard errors their log odds of toxicity are from even."""
    size = 1 << BUCKET_BITS
    counts = [np.zeros(size), np.zeros(size)]
    for d, label in zip(docs, y, strict=True):
        counts[int(label)][np.unique(d)] += 1
    neg, pos = counts
    seen = np.flatnonzero(neg + pos >= MIN_DOCS)
    n1, n0 = y.sum(), len(y) - y.sum()
    a, b = pos[seen] + 0.5, neg[seen] + 0.5
    return seen, (np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))) / np.sqrt(1 / a + 1 / b)


def loss_gradients(model: Model, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted mean logistic loss, in the order of ``params_of``; the embedding of unknown words is fixed at 0."""
    e, out = model.embedding, model.out
    x, flat, places = model.pooled(rows, argmax=True)
    act = np.maximum(x, 0)
    p = 1 / (1 + np.exp(-np.clip(act @ out + model.out_bias, -30, 30)))
    g = ((p - y) * weight / len(rows)).astype(e.dtype)
    gx = (g[:, None] * out) * (x > 0)
    ge, gf, gb = np.zeros_like(e), [], []
    for w, width in enumerate(WIDTHS):
        part = gx[:, w * FILTERS : (w + 1) * FILTERS]
        grad = np.zeros_like(model.filters[w])
        for k in range(width):
            r = flat[np.minimum(places[w] + k, len(flat) - 1)]  # documents x filters
            grad[k] = np.einsum("nfd,nf->df", e[r], part)
            np.add.at(ge, r.ravel(), (part[:, :, None] * model.filters[w][k].T[None]).reshape(-1, DIM))
        gf.append(grad)
        gb.append(part.sum(0))
    ge[0] = 0
    return [ge, *gf, *gb, act.T @ g, np.array([g.sum()], e.dtype)]


def train(docs: list[np.ndarray], y: np.ndarray, seed: int = 3, steps: int = STEPS) -> Model:
    """Fits the model; one embedding dimension starts from the evidence of each bucket, all else at random."""
    rng = np.random.default_rng(seed)
    seen, z = _evidence(docs, y)
    lookup = np.zeros(1 << BUCKET_BITS, np.int32)
    lookup[seen] = np.arange(1, len(seen) + 1)
    e = rng.normal(0, 0.1, (len(seen) + 1, DIM)).astype(np.float32)
    e[0] = 0
    e[1:, 0] = np.clip(z / 4, -2, 2)
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] = np.abs(f[:, 0]) + 0.3
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = np.full(FILTERS * len(WIDTHS), 0.2, np.float32)
    out_bias = np.full(1, -1.0, np.float32)
    model = Model(lookup, e, filters, bias, out, float(out_bias[0]))
    rows = [lookup[d] for d in docs]
    params = [e, *filters, *bias, out, out_bias]
    adam = _Adam(params)
    weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (len(y) - y.sum())))
    epochs = max(EPOCHS, -(-steps * BATCH // max(1, len(rows))))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            batch = order[at : at + BATCH]
            grads = loss_gradients(model, [rows[i] for i in batch], y[batch], weight[batch])
            grads[-2] = grads[-2] + 1e-4 * out
            adam.step(params, grads, RATE / (1 + EPOCHS * epoch / epochs))
            model.out_bias = float(out_bias[0])
    return model


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the largest F1; among equals the middle one; 0.5 where there are too few labels."""
    if y.sum() < MIN_TO_CALIBRATE or y.sum() == len(y):
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    ends = np.append(s[1:] < s[:-1], True)  # a threshold can't part equal scores
    best = np.flatnonzero(ends & (f1 >= f1[ends].max() - 1e-12))
    k = best[len(best) // 2]
    below = s[k + 1] if k + 1 < len(s) else 0.0
    return float((s[k] + below) / 2)


def bin_of(score):
    """Of the log odds, from -BINS * BIN_END to BINS * BIN_END - 1; those of 0 and 1 aren't finite, and are in the outer bins."""
    low, high = F.lit(-BINS * BIN_END), F.lit(BINS * BIN_END - 1)
    odds = F.when((score > 0) & (score < 1), F.floor(F.log(score / (1 - score)) * BINS)).when(score >= 1, high).otherwise(low)
    return F.least(F.greatest(odds, low), high).cast("int")


def histogram_threshold(hist: pd.DataFrame) -> float:
    """The threshold with the largest F1, from rows (bin, clean, toxic); among equals the middle one."""
    h = hist.groupby("bin")[["clean", "toxic"]].sum().sort_index(ascending=False)
    hits, flagged = h.toxic.cumsum().to_numpy(), (h.clean + h.toxic).cumsum().to_numpy()
    f1 = 2 * hits / (flagged + hits[-1])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[len(best) // 2]
    if h.index[k] == -BINS * BIN_END:
        return 0.0
    below = h.index[k + 1] + 1 if k + 1 < len(h) else -BINS * BIN_END
    return float(1 / (1 + np.exp(-(h.index[k] + below) / 2 / BINS)))


def choose_thresholds(hist: pd.DataFrame, fitted: tuple[int, int] = (0, 0)) -> tuple[dict, float]:
    """Of each language and of all together, from rows (lang, bin, clean, toxic) and how many (clean, toxic) documents the fit took away from them."""
    weight = {c: 1 + k / max(1, hist[c].sum()) for c, k in zip(("clean", "toxic"), fitted, strict=True)}

    def shrunk(h: pd.DataFrame, towards: float) -> float:
        n = h.toxic.sum()
        weighted = h.assign(**{c: h[c] * w for c, w in weight.items()})
        return float((n * histogram_threshold(weighted) + PRIOR_LABELS * towards) / (n + PRIOR_LABELS)) if n else towards

    pooled = shrunk(hist, 0.5)
    return {str(lang): shrunk(h, pooled) for lang, h in hist.groupby("lang")}, pooled


def calibration_histogram(model: Model, docs: DataFrame, rest: DataFrame) -> DataFrame:
    """lang, bin, clean, toxic: numbers of documents with labels in ``rest`` (doc_id, toxic). Texts are scored before the join and never shuffled."""
    scored = with_scores(docs.select("doc_id", "lang", "text").filter(~held_out(F.col("doc_id"))), model)
    scored = scored.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), bin_of(F.col("score")).alias("bin"))
    return scored.join(rest, "doc_id").groupBy("lang", "bin").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 3) -> Model | float:
    """The model; or, where one of the two labels is missing, the share of toxic ones."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    trained = ~calibrates(F.col("doc_id"))
    number = lambda x: F.coalesce(F.sum(x.cast("int")), F.lit(0))
    n, n1, m, m1 = known.agg(F.count("*"), number(F.col("toxic")), number(trained), number(trained & (F.col("toxic") == 1))).first()
    if not 0 < n1 < n:
        return n1 / n if n else 0.0
    usable = known.filter(trained) if 0 < m1 < m else known
    long = docs.filter(F.octet_length("text") > MAX_FIT_BYTES).select("doc_id")
    usable = usable.join(long, "doc_id", "left_anti")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.filter("toxic = 1").orderBy(*order).limit(MAX_POSITIVE).unionByName(usable.filter("toxic = 0").orderBy(*order).limit(MAX_NEGATIVE))
    # at most MAX_POSITIVE + MAX_NEGATIVE ids
    found = docs.select("doc_id", "lang", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    @F.pandas_udf("binary")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler(1, SEPARATOR)
        for t in texts:
            yield pd.Series([b.astype(np.int32).tobytes() for b in buckets_of(list(t), shingler)])

    # and as many rows: however often an id is repeated, one of its texts is fitted
    hashes = found.select("doc_id", "toxic", hashed("text").alias("words"))
    sample = hashes.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("words").alias("words")).toPandas().sort_values("doc_id", ignore_index=True)
    words = [np.frombuffer(w, np.int32) for w in sample.words]
    y = sample.toxic.to_numpy().astype(np.float32)
    if not 0 < y.sum() < len(y):
        return n1 / n
    model = train(words, y, seed)
    model.shift = float(np.log(n1 / (n - n1)))  # from even odds, which the class weights made, to those of all labels
    rest = known.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    hist = calibration_histogram(model, docs, rest).toPandas()
    model.thresholds, model.pooled_threshold = choose_thresholds(hist, (int((1 - y).sum()), int(y.sum())))
    return model


def with_scores(docs: DataFrame, model: Model | float) -> DataFrame:
    """``docs`` with score, and rejected: the score reaches its language's threshold."""
    if not isinstance(model, Model):
        return docs.withColumn("score", F.lit(float(model))).withColumn("rejected", F.col("score") >= 0.5)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler, m = Shingler(1, SEPARATOR), shared.value
        for t in texts:
            buckets, parts, i = buckets_of(list(t), shingler), [], 0
            while i < len(buckets):  # groups of about 200,000 words
                j, n = i, 0
                while j < len(buckets) and (j == i or n + len(buckets[j]) < 200_000):
                    n += len(buckets[j])
                    j += 1
                parts.append(m.scores(buckets[i:j]))
                i = j
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
        release()

    threshold = F.lit(model.pooled_threshold)
    for lang, x in sorted(model.thresholds.items()):
        threshold = F.when(F.coalesce(F.col("lang"), F.lit("")) == lang, F.lit(x)).otherwise(threshold)
    return docs.withColumn("score", score(F.col("text").cast("binary"))).withColumn("rejected", F.col("score") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    names = docs.columns
    hidden = {c: f"c{i}" for i, c in enumerate(names) if c not in ("doc_id", "lang", "text")}
    model = fit(docs, labels)
    scored = with_scores(docs.select(*[c.alias(hidden.get(n, n)) for c, n in zip(columns(docs), names, strict=True)]), model)
    return scored.filter(~F.col("rejected")).select(*[F.col(hidden.get(n, n)).alias(n) for n in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_scores(docs.select("doc_id", "lang", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")
