"""Toxicity: a convolutional text classifier trained with numpy, with thresholds calibrated by language.

Words (runs of letters, lower-cased) are hashed to rows of an embedding table; filters of several widths slide over the
text, the largest response of each counts (max pooling), and a logistic layer turns them into a score. Training back-propagates
through the winning positions only. Buckets that occur in few training texts stay zero, so a rare word cannot be
learned by heart; the model that is sent to the tasks holds the other buckets' responses alone.

The model is fitted on the driver to a bounded sample of labelled rows: at most `sample` ids, those with the smallest hashes, one row each, of at most
`longest` words. The bounds concern the fit alone. A fifth of the labelled ids, by another hash, is never fitted to. A language's threshold comes from all labelled rows that were not fitted to,
by counts in score bins to which the bins of all languages add the weight of PRIOR positives, and these in turn start from PRIOR rows of either kind to both sides of 0.5: with few labels a threshold stays near the
common one, or that near 0.5, with many it is its own, without a step between them. Scoring is a narrow pass over whole texts.

Cases: a null text is empty; an empty text has a score like any other, from padding alone; texts of any length are pooled
block by block; conflicting labels of an id count as the higher; null labels and ids are not learned from; of several texts with one id the fit takes the
one with the least hash; without any labelled rows every score is
the prior 0 and no document is toxic; an unknown or null language takes the threshold of all; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import staged

#: Positives that the threshold of all languages counts for in each language's own.
PRIOR = 20
#: Bins of equal width that scores are counted by.
BINS = 1000
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows fitted to at most; longest: words of such a row at most; buckets: rows of the embedding table; least and least_share: training texts that a bucket must occur in, and their share; block: words scored at once."""

    sample: int = 12_000
    longest: int = 1 << 16
    buckets: int = 1 << 17
    size: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    least: int = 3
    least_share: float = 0.001
    epochs: int = 6
    least_steps: int = 1000
    batch: int = 32
    rate: float = 0.02
    decay: float = 1e-3
    seed: int = 7
    block: int = 1 << 13


class WordRows:
    """Table rows of a text's words: their bucket numbers, or what slots holds at these. 0 is padding."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets, self.slots, self.known = buckets, slots, {}

    def __call__(self, text: str) -> np.ndarray:
        words = LETTERS.findall(text.lower())
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        except KeyError:
            if len(known) > 300_000:
                known.clear()
            for w in words:
                if w not in known:
                    bucket = 1 + zlib.crc32(w.encode()) % (self.buckets - 1)
                    known[w] = bucket if self.slots is None else int(self.slots[bucket])
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


@dataclass
class Model:
    """table: a row for each bucket that slots names (row 0: all others), with the responses of the filters of each width at each offset side by side."""

    settings: Settings
    slots: np.ndarray | None = None
    table: np.ndarray | None = None
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: float = 0.0
    fitted: frozenset[str] = frozenset()

    def words(self) -> WordRows:
        return WordRows(self.settings.buckets, self.slots)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scores of texts given as table rows. Texts are taken together up to a block of words, longer ones block by block."""
        if self.out is None:
            return np.zeros(len(texts))
        s = self.settings
        best = np.empty((len(texts), len(s.widths) * s.filters), np.float32)
        at = 0
        while at < len(texts):
            end, n = at + 1, len(texts[at])
            while end < len(texts) and n + len(texts[end]) <= s.block:
                n += len(texts[end])
                end += 1
            best[at:end] = self._pooled(texts[at:end]) if n <= s.block else self._long(texts[at])
            at = end
        z = np.maximum(best + self.bias, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def _pooled(self, texts: list[np.ndarray], windows: int | None = None) -> np.ndarray:
        """The largest response of each filter in each text (in its first windows, if these are given), from one gather for all of them."""
        s = self.settings
        widest = max(s.widths)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + widest)
        begins = ends - lengths - widest
        flat = np.zeros(int(ends[-1]) + widest, np.int32)
        for b, t in zip(begins.tolist(), texts):
            flat[b : b + len(t)] = t
        all_ = self.table[flat]
        out, column = [], 0
        for w in s.widths:
            n = len(flat) - w + 1
            r = all_[:n, column : column + s.filters].copy()
            for o in range(1, w):
                r += all_[o : o + n, column + o * s.filters : column + (o + 1) * s.filters]
            column += w * s.filters
            # windows that reach into the next text lie between a text's last window and the next one's first, and are left out
            edges = np.stack([begins, begins + windows if windows else ends - w + 1], 1).ravel()
            out.append(np.maximum.reduceat(r, edges, axis=0)[::2])
        return np.concatenate(out, axis=1)

    def _long(self, text: np.ndarray) -> np.ndarray:
        s = self.settings
        reach = max(s.widths) - 1
        last = (len(text) - 1) // s.block * s.block
        parts = [self._pooled([text[at : at + s.block + reach]], s.block) for at in range(0, last, s.block)]
        return np.max([*parts, self._pooled([text[last:]])], axis=0)


def gradients(x: list[np.ndarray], y: np.ndarray, emb: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, out: np.ndarray, out_bias: np.ndarray):
    """Logistic loss summed over texts of bucket numbers, its gradients by filters, bias, out and out_bias, and those by embeddings as (buckets, rows)."""
    widest, size = max(f.shape[0] for f in filters), filters[0].shape[2]
    lengths = np.fromiter(map(len, x), np.int64, len(x))
    ends = np.cumsum(lengths + widest)
    begins = ends - lengths - widest
    flat = np.zeros(int(ends[-1]), np.int64)
    for b, t in zip(begins.tolist(), x):
        flat[b : b + len(t)] = t
    v = emb[flat]
    wins, tops = [], []
    for f in filters:
        w = f.shape[0]
        n = len(flat) - w + 1
        r = v[:n] @ f[0]
        for o in range(1, w):
            r += v[o : o + n] @ f[o]
        win = np.stack([b + r[b : e - w + 1].argmax(0) for b, e in zip(begins.tolist(), ends.tolist())])
        wins.append(win)
        tops.append(r[win, np.arange(size)])
    h = np.concatenate(tops, axis=1) + bias
    active = h > 0
    z = (h * active) @ out + out_bias[0]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    d = (p - y).astype(h.dtype)
    loss = float((np.logaddexp(0, z) - y * z).sum())
    dh = d[:, None] * out * active
    rows, row_grads, filter_grads = [], [], []
    for j, f in enumerate(filters):
        dj = dh[:, j * size : (j + 1) * size]
        g = np.zeros_like(f)
        for o in range(f.shape[0]):
            spots = flat[wins[j] + o]
            g[o] = np.einsum("bfk,bf->kf", emb[spots], dj)
            rows.append(spots.ravel())
            row_grads.append((dj[:, :, None] * f[o].T).reshape(-1, f.shape[1]))
        filter_grads.append(g)
    return loss, [*filter_grads, dh.sum(0), d @ (h * active), d.sum(keepdims=True)], (np.concatenate(rows), np.concatenate(row_grads))


def train(texts: list[np.ndarray], labels: np.ndarray, s: Settings) -> Model:
    """Fit texts of bucket numbers by Adam on the logistic loss. Without both kinds of labels, or any bucket that is common enough, the model has no output layer."""
    model = Model(s)
    if not len(texts) or not labels.any() or labels.all():
        return model
    rng = np.random.default_rng(s.seed)
    seen = np.zeros(s.buckets, np.int32)
    for t in texts:
        seen[np.unique(t)] += 1
    known = seen >= max(s.least, s.least_share * len(texts))
    known[0] = False
    if not known.any():
        return model
    emb = (rng.normal(0, 0.1, (s.buckets, s.size)) * known[:, None]).astype(np.float32)
    filters = [rng.normal(0, 0.3, (w, s.size, s.filters)).astype(np.float32) for w in s.widths]
    bias = np.zeros(len(s.widths) * s.filters, np.float32)
    out = rng.normal(0, 0.3, len(s.widths) * s.filters).astype(np.float32)
    prior = labels.mean()
    out_bias = np.array([np.log(prior / (1 - prior))], np.float32)
    params = [*filters, bias, out, out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    emb_m, emb_v = np.zeros_like(emb), np.zeros_like(emb)
    batches = -(-len(texts) // s.batch)
    epochs = max(s.epochs, -(-s.least_steps // batches))  # small samples take more rounds
    step, steps = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), s.batch):
            batch = order[at : at + s.batch]
            _, grads, (rows, row_grads) = gradients([texts[i] for i in batch], labels[batch], emb, filters, bias, out, out_bias)
            rate = s.rate * (1 - step / steps)  # falls to nothing, so that the last steps settle
            step += 1
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            for p, g, (m, q) in zip(params, grads, moments):
                g = g / len(batch) + s.decay * p
                m += 0.1 * (g - m)
                q += 0.001 * (g * g - q)
                p -= rate * (m / c1) / (np.sqrt(q / c2) + 1e-8)
            at_rows, inverse = np.unique(rows, return_inverse=True)
            g = np.zeros((len(at_rows), s.size), np.float32)
            np.add.at(g, inverse, row_grads)
            g = g / len(batch) + s.decay * emb[at_rows]
            emb_m[at_rows] += 0.1 * (g - emb_m[at_rows])
            emb_v[at_rows] += 0.001 * (g * g - emb_v[at_rows])
            emb[at_rows] -= rate * (emb_m[at_rows] / c1) / (np.sqrt(emb_v[at_rows] / c2) + 1e-8) * known[at_rows, None]
    used = np.flatnonzero(known)
    model.slots = np.zeros(s.buckets, np.int32)
    model.slots[used] = 1 + np.arange(len(used))
    rows = np.concatenate([np.zeros((1, s.size), np.float32), emb[used]])
    model.table = np.concatenate([rows @ f[o] for f in filters for o in range(f.shape[0])], axis=1).astype(np.float32)
    model.bias, model.out, model.out_bias = bias, out, float(out_bias[0])
    return model


def fold(id_: Column) -> Column:
    """crc32 of the id as text modulo 5."""
    return F.crc32(id_.cast("string").cast("binary")) % 5


def _labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(known_id, label) of the labelled ids outside fold 0; label is 1 if any of an id's labels is above 0."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
    return known.groupBy(F.col(id_col).alias("known_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of labelled rows outside fold 0. At most s.sample rows of at most s.longest bucket numbers come to the driver."""
    fitted_to = F.pmod(F.xxhash64("known_id"), F.lit(5)) != 0
    chosen = _labelled(labels, id_col, label_col).where(fitted_to).orderBy(F.xxhash64(F.lit(s.seed), "known_id"), "known_id").limit(s.sample)
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most s.sample rows
    rows = rows.join(F.broadcast(chosen), F.col("doc") == F.col("known_id")).select(F.col("known_id").cast("string").alias("id"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordRows(s.buckets)
        for batch in batches:
            ids = [words(t.as_py()) for t in batch["text"]]
            fits = pa.array([len(x) <= s.longest for x in ids], pa.bool_())
            columns = [batch["id"], batch["label"], pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.filter(fits) for c in columns], ["id", "label", "ids"])

    found = rows.mapInArrow(run, "id string, label int, ids binary")
    one = found.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("ids").alias("h"), "ids")).alias("text"))
    got = sorted(one.select("id", "label", "text.ids").collect())
    model = train([np.frombuffer(r[2], np.int32) for r in got], np.array([float(r[1]) for r in got]), s)
    model.fitted = frozenset(r[0] for r in got)
    return model


def thresholds(scored: DataFrame, labels: DataFrame, model: Model, id_col: str = "id", lang_col: str = "lang", score_col: str = "score", label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(language, threshold): where the F1 of all labelled rows that were not fitted to is best, by language and, at null, for all.

    scored is a staged table; the result is one, too, of a row for each language of a labelled document and one more.
    """
    known = _labelled(labels, label_id, label_col)
    fitted = scored.sparkSession.createDataFrame([(i,) for i in sorted(model.fitted)], "fitted_id string")
    # at most s.sample ids
    known = known.join(F.broadcast(fitted), F.col("known_id").cast("string") == F.col("fitted_id"), "left_anti")
    rows = scored.join(known, F.col(id_col) == F.col("known_id"))
    score_bin = F.least(F.floor(F.col(score_col) * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    counts = staged(rows.groupBy(F.col(lang_col).alias("language"), score_bin).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("hits")), "scores")
    # PRIOR rows of either kind
    first = scored.sparkSession.createDataFrame([(None, BINS * 3 // 4, PRIOR, PRIOR), (None, BINS // 4, PRIOR, 0)], "language string, bin int, n bigint, hits bigint")
    counts = counts.unionByName(first)
    common = counts.groupBy(F.col("bin").alias("b")).agg(F.sum("n").alias("all_n"), F.sum("hits").alias("all_hits"))
    share = F.lit(PRIOR / counts.agg(F.sum("hits")).first()[0])
    langs = counts.select("language").union(counts.select(F.lit(None).cast("string").alias("language"))).distinct()
    # common has at most BINS rows
    grid = langs.select("language", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin")).join(F.broadcast(common), F.col("bin") == F.col("b"))
    own = counts.where("language is not null").select(F.col("language").alias("l"), F.col("bin").alias("ob"), "n", "hits")
    grid = grid.join(own, (F.col("language") == F.col("l")) & (F.col("bin") == F.col("ob")), "left")
    grid = grid.select("language", "bin", (F.coalesce("n", F.lit(0)) + share * F.col("all_n")).alias("n"), (F.coalesce("hits", F.lit(0)) + share * F.col("all_hits")).alias("hits"))
    down = Window.partitionBy("language").orderBy(F.col("bin").desc())
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    f1 = 2 * F.sum("hits").over(so_far) / (F.sum("n").over(so_far) + F.sum("hits").over(Window.partitionBy("language")))
    # in the middle of the gap between the lowest bin that counts as toxic and the next one below with rows in it
    below = F.coalesce(F.lead("bin").over(down) + 1, F.lit(0))
    grid = grid.select("language", "bin", f1.alias("f1"), ((F.col("bin") + below) / F.lit(2.0 * BINS)).alias("threshold"))
    best = grid.groupBy("language").agg(F.max_by("threshold", F.struct("f1", "bin")).alias("threshold"))
    return staged(best, "thresholds")


def flagged(scored: DataFrame, limits: DataFrame, name: str = "toxic", lang_col: str = "lang", score_col: str = "score") -> DataFrame:
    """Add name: whether a row's score reaches its language's threshold. limits: from thresholds()."""
    common = limits.where("language is null").select("threshold").first()[0]
    own = limits.where("language is not null").select(F.col("language").alias("__l"), F.col("threshold").alias("__t"))
    out = scored.join(own, F.col(lang_col) == F.col("__l"), "left")
    limit = F.coalesce("__t", F.lit(common))
    return out.select(*scored.columns, (F.col(score_col) >= limit).alias(name))


def scored_rows(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score behind its columns. Narrow: whole rows pass through, whatever their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = m.words()
        for batch in batches:
            scores = m.scores([words(t.as_py() or "") for t in batch.column(text_at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score_col, DoubleType()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """id and score of each row, and lang if its column is given."""
    rows = docs.select(F.col(id_col).alias("id"), *([F.col(lang_col).alias("lang")] if lang_col else []), F.col(text_col).alias("text"))
    return scored_rows(rows, model).drop("text")


def keep_clean(docs: DataFrame, labels: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """docs without the rows whose score reaches their language's threshold. Texts are scored once, into a staged table from which thresholds and rows are read."""
    if model.out is None:
        return docs
    scored = staged(scored_rows(docs, model, text_col, "__score"), "scored", "zstd")
    limits = thresholds(scored, labels, model, id_col, lang_col, "__score", id_col, label_col)
    return flagged(scored, limits, "__toxic", lang_col, "__score").where("not __toxic").select(*docs.columns)
