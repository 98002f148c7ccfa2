"""Quality classifier: random-indexing vectors, pooled by document, then a network of two
layers with temperature-calibrated probabilities, all in numpy.

Random indexing: each word as it stands (signs and case kept) and each run of three
characters is a hash bucket with a fixed sparse ternary vector; the vector of a bucket
is its own plus the mean of its neighbours', over the whole corpus, less the mean of all. Words
meet the words beside them, runs the run that follows. Every partition sends one row for
each bucket it met; the sums end in a table of fixed size, ``2 * BUCKETS`` rows, which
goes to the driver and into the tasks.

A document is the mean of its words' vectors, the mean of its runs' vectors and the mean
of its pairs': the vector of two words in a row is the product of their ternary vectors,
place by place. Means are drawn to that of the corpus by ``PRIOR`` words, since short
texts tell little. The network has no other input. It is fitted on at most ``TRAIN_ROWS``
labelled rows, chosen by a hash of doc_id; a fifth of them only sets the temperature.

Only the text is an input of the score. Null text counts as empty, and an empty text
has the score the network gives to no words. Rows repeat freely, each is scored on its
own; an empty table gives an empty result; without labels of both kinds every score
is the share of label 1, or 0.5. A column of ``docs`` with the name of the score is
kept as ``<name>_input``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tesserae.llm.common import HashCache, set_aside
from tesserae.runtime import tune

BUCKETS, DIM, NONZERO = 4096, 64, 4
WIDTH = 3 * DIM
#: Words, runs and pairs of the corpus mean that each document is mixed with.
PRIOR = (10, 40, 10)
#: Bound of the labelled sample the network is fitted on.
TRAIN_ROWS = 20_000
HIDDEN, STEPS, SEED, DECAY = 32, 400, 5, 1e-3
#: Characters and words that are handled at once.
CHUNK = 400_000


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    places = rng.random((2 * BUCKETS, DIM)).argsort(1)[:, :NONZERO]
    out = np.zeros((2 * BUCKETS, DIM), np.float32)
    np.put_along_axis(out, places, rng.choice(np.array([-1.0, 1.0], np.float32), places.shape), 1)
    return out


def word_codes(text: str, words: HashCache) -> np.ndarray:
    return (words.of(text.split()) % np.uint64(BUCKETS)).astype(np.int64)


def run_codes(text: str) -> np.ndarray:
    """The bucket of each run of three characters, the text between two blanks."""
    p = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    p = np.where(p <= 32, np.uint32(32), p)
    h = p[:-2] * np.uint32(0x9E3779B1) + p[1:-1] * np.uint32(0x85EBCA77) + p[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return BUCKETS + (h >> np.uint32(20)).astype(np.int64)


def _streams(texts: list[str | None], words: HashCache) -> Iterator[tuple[list[int], list[np.ndarray], list[np.ndarray]]]:
    """(numbers of the texts, the codes of their words, of their runs) by chunks of texts."""
    held, w, r, n = [], [], [], 0
    for i, text in enumerate(texts):
        held.append(i)
        w.append(word_codes(text or "", words))
        r.append(run_codes(text) if len(w[-1]) else np.zeros(0, np.int64))  # a blank text has no run
        n += len(r[-1])
        if n >= CHUNK:
            yield held, w, r
            held, w, r, n = [], [], [], 0
    if held:
        yield held, w, r


def _joined(parts: list[np.ndarray], gap: int) -> np.ndarray:
    """One array with ``gap`` times -1 behind each part, so that texts do not meet."""
    wall = np.full(gap, -1, np.int64)
    return np.concatenate([x for part in parts for x in (part, wall)])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of vectors over all of ``docs`` (text)."""
    rows = 2 * BUCKETS
    index = index_vectors()
    places = np.stack([np.flatnonzero(v) for v in index])
    signs = np.take_along_axis(index, places, 1)

    def count(batches):
        words, total, seen = HashCache(), np.zeros(rows * DIM), np.zeros(rows)

        def meet(a, b):
            for k in range(NONZERO):
                total[:] += np.bincount(a * DIM + places[b, k], signs[b, k], rows * DIM)

        for batch in batches:
            for _, w, r in _streams(batch.column(0).to_pylist(), words):
                w, r = _joined(w, 1), _joined(r, 3)
                for codes in (w, r):
                    seen += np.bincount(codes[codes >= 0], minlength=rows)
                real = (w[1:] >= 0) & (w[:-1] >= 0)
                left, right = w[:-1][real], w[1:][real]
                meet(left, right)
                meet(right, left)
                real = (r[3:] >= 0) & (r[:-3] >= 0)
                meet(r[:-3][real], r[3:][real])
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[met]), pa.array(list(total.reshape(rows, DIM)[met].astype(np.float32)), pa.list_(pa.float32()))], ["id", "n", "v"])

    def add(batches):
        total, seen = {}, {}
        for batch in batches:
            for i, n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False), strict=True):
                total[i] = total[i] + v if i in total else v.astype(np.float64)
                seen[i] = seen.get(i, 0.0) + n
        ids = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([seen[i] for i in ids], pa.float64()), pa.array([total[i].astype(np.float32) for i in ids], pa.list_(pa.float32()))], ["id", "n", "v"])

    schema = "id long, n double, v array<float>"
    sums = docs.select("text").mapInArrow(count, schema).repartition("id").mapInArrow(add, schema)
    out, share = index.astype(np.float64), np.zeros(rows)
    for row in sums.collect():  # at most 2 * BUCKETS rows
        out[row["id"]] += np.array(row["v"]) / max(row["n"], 1.0)
        share[row["id"]] = row["n"]
    for part in (slice(0, BUCKETS), slice(BUCKETS, rows)):
        out[part] -= share[part] @ out[part] / max(share[part].sum(), 1.0)
    return out.astype(np.float32)


class Pool:
    """texts -> the mean vectors of the words, runs and pairs of each."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.index, self.words = vectors, index_vectors()[:BUCKETS], HashCache()

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), WIDTH), np.float32)
        for held, *streams in _streams(texts, self.words):
            for k, parts in enumerate(streams):
                n = np.array([len(x) for x in parts])
                # counts by text and bucket, times the vectors: cheaper than adding up a vector a word
                flat = np.repeat(np.arange(len(held)) * BUCKETS - k * BUCKETS, n) + np.concatenate(parts)
                counts = np.bincount(flat, minlength=len(held) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)
                out[held, k * DIM : (k + 1) * DIM] = counts @ self.vectors[k * BUCKETS : (k + 1) * BUCKETS] / (n + PRIOR[k])[:, None]
            for i, w in zip(held, streams[0], strict=True):
                pairs = np.zeros(DIM, np.float32)
                for at in range(0, len(w) - 1, CHUNK // 8):
                    part = self.index[w[at : at + CHUNK // 8 + 1]]
                    pairs += np.einsum("nd,nd->d", part[:-1], part[1:])
                out[i, 2 * DIM :] = pairs / (max(len(w) - 1, 0) + PRIOR[2])
        return out


class Network:
    """Standardised inputs, one hidden layer of tanh, a logit over a temperature."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        self.base, self.layers = (float(y.mean()) if len(y) else 0.5), None
        if len(y) < 10 or not 0 < self.base < 1:
            return self
        rng = np.random.default_rng(SEED)
        own = rng.random(len(y)) < 0.8
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-3
        z, t = (x - self.mean) / self.scale, y.astype(np.float64)
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        rows = np.flatnonzero(own)
        for step in range(1, STEPS + 1):
            pick = rng.choice(rows, min(len(rows), 1024), replace=False)
            a, want = z[pick], t[pick]
            hid = np.tanh(a @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3], -30, 30))) - want) / len(pick)
            back = np.outer(err, p[2]) * (1 - hid**2)
            for k, g in enumerate([a.T @ back + DECAY * p[0], back.sum(0), hid.T @ err + DECAY * p[2], err.sum(keepdims=True)]):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.layers, self.temperature = p, 1.0
        if (~own).any():
            logit = self._logit(x[~own])
            loss = lambda c: np.logaddexp(0, np.where(y[~own] == 1, -1, 1) * logit / c).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, y of at most about ``rows`` labelled ids, by a hash of the id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(rows / n * 1_000_000))
    return known


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, Network]:
    """docs: doc_id, text; labels: doc_id and the label, only those to learn from."""
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")  # other columns may clash
    vectors = word_vectors(docs)
    sample = docs.join(F.broadcast(labelled_sample(labels, label, TRAIN_ROWS)), "doc_id").select("text", F.col("y").cast("long"))

    def pooled(batches):
        pool = Pool(vectors)
        for batch in batches:
            x = pool(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), batch.column(1)], ["x", "y"])

    rows = sample.mapInArrow(pooled, "x array<float>, y long").toArrow()  # at most about TRAIN_ROWS rows
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH) if rows.num_rows else np.zeros((0, WIDTH), np.float32)
    y = rows.column("y").to_numpy()
    order = np.lexsort((*x.T[:8], y))  # the same fit in whatever order rows arrive
    return vectors, Network().fit(x[order].astype(np.float64), y[order])


def with_score(docs: DataFrame, model: tuple[np.ndarray, Network], text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score``."""
    vectors, network = model
    tune(docs.sparkSession)
    docs = set_aside(docs, [score])
    names, at = docs.columns, docs.columns.index(text)

    def rate(batches):
        pool = Pool(vectors)
        for batch in batches:
            s = network.score(pool(batch.column(at).to_pylist()).astype(np.float64)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*names, score])

    return docs.mapInArrow(rate, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def held_out(mod: int, at: int):
    """Whether crc32 of doc_id as text leaves ``at`` by ``mod``; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == at, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(3, 1)).select("doc_id", "quality")
    scored = with_score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
