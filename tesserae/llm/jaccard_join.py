"""N-gram Jaccard join by chosen paths.

Each text is the set of its five-word shingles, embedded by MinHash into ``TOKENS``
tokens, so that two texts share a token with the probability of their similarity. A
run splits all texts on a sampled token, splits the buckets that stay large on the next
sampled token, down to ``DEPTH``, and compares all pairs of a small bucket. Runs repeat
until a pair at the threshold is missed with at most ``1 - RECALL``, whatever depth its
buckets reach: runs = log(1 - RECALL) / log(1 - SIMILARITY ** DEPTH).

A bucket that is still large at ``DEPTH`` holds texts that are alike, or a very common
passage; it is cut into blocks and compared block by block, so no task gets more than
two blocks and no pair is left out. A pair is compared only in the first run whose
bucket it shares, first by the tokens, then exactly on the shingle sets. Tasks return
counts and the least member of each component of their bucket, never pairs.

Texts with equal words are one class from the start, known by 64 bits of their digest. A
class is named by the least doc_id in it. A text without words has links to none. A text
of fewer than five words is one shingle. Null doc_id is joined as any other and is never
a name: a class of null ids only has none. Texts of one doc_id are joined one by one. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import HashCache, as_row, join_skewed, odd_numbers, shingles
from tesserae.runtime import cut, discard, tune

WIDTH, SIMILARITY = 5, 0.8
TOKENS, DEPTH, RECALL = 64, 3, 0.9999


def missed(runs: int, similarity: float = SIMILARITY) -> float:
    """How likely no run of ``runs`` puts two texts of that similarity on one whole path."""
    same = [math.comb(TOKENS, m) * similarity**m * (1 - similarity) ** (TOKENS - m) for m in range(TOKENS + 1)]
    return sum(p * (1 - math.comb(m, DEPTH) / math.comb(TOKENS, DEPTH)) ** runs for m, p in enumerate(same))


def runs_for(recall: float) -> int:
    return next(n for n in range(1, 1000) if missed(n) <= 1 - recall)


RUNS = runs_for(RECALL)
SMALL, BLOCK = 64, 256
LAST = 2**63 - 1
#: A pair at the threshold has at least this share of equal tokens but for 4.5 standard deviations.
LEAST_TOKENS = SIMILARITY - 4.5 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / TOKENS)

PATH = ", ".join(f"k{d}:bigint" for d in range(1, DEPTH + 1))
EMBEDDED = f"doc_id long, t long, d1 long, d2 long, size int, sketch binary, paths array<struct<{PATH}>>"


class Embedding:
    """Everything that is drawn from seeds: multipliers and the sampled tokens of each run."""

    def __init__(self):
        self.words = odd_numbers(WIDTH, 1)
        self.hashes = odd_numbers(TOKENS, 2)
        self.salts = odd_numbers(RUNS, 3)
        rng = np.random.default_rng(4)
        self.sampled = np.stack([rng.choice(TOKENS, DEPTH, replace=False) for _ in range(RUNS)])
        self.cache = HashCache()

    def set_of(self, text: str | None) -> tuple[np.ndarray, bytes]:
        words = (text or "").lower().split()
        hashed = self.cache.of(words)
        return shingles(hashed, WIDTH, self.words), xxhash.xxh3_128_digest(hashed.tobytes())

    def tokens(self, s: np.ndarray) -> np.ndarray:
        out = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 2048):
            np.minimum(out, (s[at : at + 2048, None] * self.hashes).min(0), out=out)
        return out >> np.uint64(24)

    def paths(self, tokens: np.ndarray) -> np.ndarray:
        """RUNS x DEPTH keys; a key holds the run and all tokens up to its depth."""
        key, out = self.salts.copy(), np.empty((RUNS, DEPTH), np.uint64)
        for d in range(DEPTH):
            key = (key ^ tokens[self.sampled[:, d]]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            out[:, d] = key
        return out.view(np.int64)


def embed(docs: DataFrame) -> DataFrame:
    tune(docs.sparkSession)
    path_type = pa.struct([(f"k{d}", pa.int64()) for d in range(1, DEPTH + 1)])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches):
        e = Embedding()
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            keys, offsets = [], [0]
            for doc_id, text, t_hash in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                s, digest = e.set_of(text)
                d1, d2 = np.frombuffer(digest, np.int64).tolist()
                sketch = b""
                if len(s):
                    t = e.tokens(s)
                    sketch = (t & np.uint64(255)).astype(np.uint8).tobytes()
                    keys.append(e.paths(t))
                offsets.append(offsets[-1] + (RUNS if len(s) else 0))
                for col, v in zip(cols, (doc_id, t_hash, d1, d2, len(s), sketch), strict=True):
                    col.append(v)
            flat = np.concatenate(keys) if keys else np.zeros((0, DEPTH), np.int64)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, d]) for d in range(DEPTH)], fields=list(path_type))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), lists], ["doc_id", "t", "d1", "d2", "size", "sketch", "paths"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, EMBEDDED)


def leaf_buckets(reps: DataFrame) -> DataFrame:
    """rep, run, key, n: the buckets where each text ends, those of one text left out."""
    rows, total = reps.select("rep", F.posexplode("paths").alias("run", "p")).select("rep", "run", "p.*"), reps.count() * RUNS
    leaves = []
    for d in range(1, DEPTH + 1):
        key = f"k{d}"
        sizes = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
        rows = cut(join_skewed(rows, sizes, [key], "n", total), f"jaccard-level{d}")
        done = rows if d == DEPTH else rows.filter(F.col("n") <= SMALL)
        leaves.append(done.select("rep", "run", F.col(key).alias("key"), "n"))
        rows = rows.filter(F.col("n") > SMALL).drop("n")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def in_blocks(rows: DataFrame) -> DataFrame:
    """Adds key2 and block: a large bucket becomes all pairs of its blocks of texts."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    small = rows.filter(F.col("n") <= BLOCK).withColumn("key2", F.col("key")).withColumn("block", F.lit(0))
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("__b")).cast("int")
    large = rows.filter(F.col("n") > BLOCK).withColumn("__b", blocks).withColumn("block", own)
    large = large.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
    low, high = F.least("block", "__other"), F.greatest("block", "__other")
    return small.unionByName(large.withColumn("key2", F.xxhash64("key", low, high)).drop("__b", "__other"))


def _pairs(key, block, run, sketch, leaves, size):
    """Index pairs of rows with equal key2 that are compared in this run and look alike.
    Rows are sorted by key2."""
    first, second = [], []
    n, step = len(key), 1
    at = np.arange(n)
    # two blocks meet in one key; rows of one block meet under their own key
    change = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    mixed = np.zeros(len(change), bool)
    if n:
        low, high = np.minimum.reduceat(block, change), np.maximum.reduceat(block, change)
        mixed = low != high
    while step < n:
        i = at[: n - step]
        i = i[key[i] == key[i + step]]
        if not len(i):
            break
        j = i + step
        ok = (block[i] != block[j]) | ~mixed[group[i]]
        a, b = size[i], size[j]
        ok &= np.minimum(a, b) >= SIMILARITY * np.maximum(a, b) - 1e-9
        i, j = i[ok], j[ok]
        if len(i):
            shared = (leaves[i] == leaves[j]) & (leaves[i] != 0)
            ok = shared.argmax(1) == run[i]
            i, j = i[ok], j[ok]
        if len(i):
            ok = (sketch[i] == sketch[j]).mean(1) >= LEAST_TOKENS
            first.append(i[ok])
            second.append(j[ok])
        step += 1
    empty = np.zeros(0, np.int64)
    return (np.concatenate(first), np.concatenate(second)) if first else (empty, empty)


def _groups(batches):
    """Tables of whole groups: rows arrive sorted by key2, which is column 0."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        key = t.column(0).to_numpy()
        last = np.flatnonzero(key != key[-1])
        cut_at = last[-1] + 1 if len(last) else 0
        if cut_at:
            yield t.slice(0, cut_at).combine_chunks()
        rest = t.slice(cut_at)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _arrays(t: pa.Table):
    n = t.num_rows
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(n, TOKENS)
    leaves = t.column("leaves").combine_chunks().flatten().to_numpy().reshape(n, RUNS)
    return (t.column("key2").to_numpy(), t.column("block").to_numpy(), t.column("run").to_numpy(), sketch, leaves, t.column("size").to_numpy())


def candidates(rows: DataFrame) -> DataFrame:
    """The rows that have a partner to verify in their bucket."""

    def find(batches):
        for t in _groups(batches):
            i, j = _pairs(*_arrays(t))
            keep = np.zeros(t.num_rows, bool)
            keep[i] = keep[j] = True
            yield from t.filter(pa.array(keep)).to_batches()

    return rows.mapInArrow(find, rows.schema)


def verified(rows: DataFrame) -> DataFrame:
    """rows with text, sorted by key2 -> rep, root, texts, docs: for each text in a bucket its
    links found there and the least text that they lead to."""

    def check(batches):
        e = Embedding()
        for t in _groups(batches):
            i, j = _pairs(*_arrays(t))
            rep, copies, texts = t.column("rep").to_numpy(), t.column("copies").to_numpy(), t.column("text")
            sets: dict[int, np.ndarray] = {}
            order = np.argsort(i, kind="stable")
            root = rep.copy()
            links = np.zeros((2, t.num_rows), np.int64)
            good = []
            for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
                for k in (a, b):
                    if k not in sets:
                        sets[k] = e.set_of(texts[k].as_py())[0]
                x, y = sets[a], sets[b]
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9:
                    good.append((a, b))
            if not good:
                continue
            g = np.array(good)
            for a, b in ((g[:, 0], g[:, 1]), (g[:, 1], g[:, 0])):
                links[0] += np.bincount(a, minlength=len(rep))
                links[1] += np.bincount(a, copies[b], len(rep)).astype(np.int64)
            while True:
                low = np.minimum(root[g[:, 0]], root[g[:, 1]])
                before = root.copy()
                np.minimum.at(root, g[:, 0], low)
                np.minimum.at(root, g[:, 1], low)
                if (before == root).all():
                    break
            met = links[0] > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[met]), pa.array(root[met]), pa.array(links[0][met]), pa.array(links[1][met])], ["rep", "root", "texts", "docs"])

    return rows.mapInArrow(check, "rep long, root long, texts long, docs long")


def components(edges: DataFrame) -> DataFrame:
    """a, b -> node, comp (its least node) by alternating large and small stars."""

    def stars(e: DataFrame, small: bool, total: int) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        back = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        near = both.unionByName(back).filter("u <> v")
        near = near.filter("v < u") if small else near
        low = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        joined = join_skewed(near, low, ["u"], "n", total)  # a hub has an edge to each text like it
        moved = joined.filter("v <> m") if small else joined.filter("v > u")
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if small:
            out = out.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = mark(now)
    while True:
        large = cut(stars(now, False, 2 * state[0]), "stars")
        after = cut(stars(large, True, 2 * state[0]), "stars")
        discard(now)
        discard(large)
        now, told = after, mark(after)
        if told == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        state = told


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, o (doc_id, null last), t (hash of the text), comp (null without words),
    class_id, n_links, n_text_links; a row a row of ``docs``."""
    embedded = cut(embed(docs), "jaccard-embedded").withColumn("o", F.coalesce("doc_id", F.lit(LAST)))
    classes = embedded.filter("size > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("name"), F.min(F.struct("o", "t")).alias("h"), F.count("*").alias("copies"))
    classes = cut(classes.select("d1", "d2", F.col("d1").alias("rep"), "name", F.col("h.o").alias("ho"), F.col("h.t").alias("ht"), "copies"), "jaccard-classes")
    # one row stands for its class, and its text is read for it
    own = classes.withColumn("o", F.col("ho")).withColumn("t", F.col("ht"))
    reps = embedded.join(own, ["d1", "d2", "o", "t"])
    reps = cut(reps.select("rep", "ho", "ht", "copies", "size", "sketch", "paths").dropDuplicates(["rep"]), "jaccard-texts")
    leaves = cut(leaf_buckets(reps), "jaccard-leaves")
    by_run = [F.coalesce(F.max(F.when(F.col("run") == r, F.col("key"))), F.lit(0)) for r in range(RUNS)]
    own = leaves.groupBy("rep").agg(F.array(*by_run).alias("leaves"))
    rows = in_blocks(leaves).join(reps.select("rep", "copies", "size", "sketch").join(own, "rep"), "rep")
    order = ["key2", "block", "run", "rep", "copies", "size", "sketch", "leaves"]
    found = cut(candidates(rows.select(*order).repartition("key2").sortWithinPartitions("key2")), "jaccard-candidates")
    wanted = reps.select("rep", "ho", "ht").join(found.select("rep").distinct(), "rep")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ho"), F.xxhash64("text").alias("ht"), "text").filter("text is not null")
    # equal rows of the one that stands for a class are read once
    texts = texts.join(wanted, ["ho", "ht"]).groupBy("rep").agg(F.min("text").alias("text"))
    full = found.join(texts, "rep").select(*order, "text").repartition("key2").sortWithinPartitions("key2", "rep")
    met = cut(verified(full), "jaccard-links")
    comps = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    comps = comps.unionByName(comps.select(F.col("comp").alias("node"), "comp").distinct())  # the least node too
    names = classes.join(comps, F.col("rep") == F.col("node")).groupBy("comp").agg(F.min("name").alias("least"))
    comps = comps.join(names, "comp")
    links = met.groupBy(F.col("rep").alias("r")).agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    member = join_skewed(embedded.select("doc_id", "o", "t", "d1", "d2"), classes, ["d1", "d2"], "copies", embedded.count(), "left")
    out = member.join(links, F.col("rep") == F.col("r"), "left").join(comps, F.col("rep") == F.col("node"), "left")
    return out.select(
        "doc_id", "o", "t", F.coalesce("comp", "rep").alias("comp"), F.coalesce("least", "name", "doc_id").alias("class_id"),
        (F.coalesce("docs", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
    )


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links (documents at the threshold), n_text_links (other texts)."""
    return _classes(docs).select("doc_id", "class_id", "n_links", "n_text_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: of the least doc_id, null last, then of the least
    hash of the text, then the least row as JSON. Texts without words have no class and stay."""
    keys = cut(_classes(docs).filter("comp is not null").groupBy("comp", "o", "t").agg(F.count("*").alias("n")), "jaccard-keys")
    lead = keys.groupBy("comp").agg(F.min(F.struct("o", "t")).alias("lead"), F.count("*").alias("texts"))
    # what goes, and what stays but stands in several rows
    odd = join_skewed(keys, lead, ["comp"], "texts", keys.count()).withColumn("gone", F.struct("o", "t") != F.col("lead")).filter("gone or n > 1")
    odd = cut(odd.select(F.col("o").alias("__o"), F.col("t").alias("__t"), "gone"), "jaccard-odd")
    keyed = as_row(docs).withColumn("__o", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__t", F.xxhash64("text"))
    alone = keyed.join(odd, ["__o", "__t"], "left_anti").select("__row.*")
    several = keyed.join(odd.filter("not gone"), ["__o", "__t"], "left_semi")
    return alone.unionByName(several.groupBy("__o", "__t").agg(F.min_by("__row", F.to_json("__row")).alias("__row")).select("__row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
