"""Toxicity: a noisy-channel restorer in front of a linear score.

A text may hide words by digits and signs for letters, by blanks between letters or by
repeated letters. Such words become a lattice of the characters each sign can stand
for, the ways to shorten a run and, between spaced letters, the word breaks that may
stand there; Viterbi decoding finds the path that is likeliest under a character model
times the channel. The character model holds trigram counts of all documents over a
fixed alphabet, so it has at most ``len(ALPHABET) + 1`` cubed rows.

A word is decoded if it has a letter and a sign (at its ends too) or a letter that
stands twice or more; all of it is decoded, whatever its length. Where the lattice has
one open place only, its decision is read from tables made of the same prices.

The restored words are scored by evidence: whole words and word beginnings whose
counts in toxic and other labelled documents differ significantly. Letters that stood
apart are also searched for such words at every place, since the breaks were guessed. A
logistic regression turns the strongest evidence of a text into a probability.

At most ``TRAIN_ROWS`` labelled rows of each label are learnt from, by a hash of
doc_id, and at most ``TERMS`` terms are kept. Only the text is an input of the score.
Null text counts as empty; rows repeat freely; an empty table gives an empty result;
without labels of both kinds every score is the share of label 1, or 0. A column of
``docs`` with the name of the score is kept as ``<name>_input``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tesserae.llm.common import set_aside
from tesserae.llm.quality_model import held_out, labelled_sample
from tesserae.runtime import tune

ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüß"
SIZE = len(ALPHABET) + 1
#: Bounds of what is learnt: labelled rows of each label, and terms of evidence.
TRAIN_ROWS, TERMS = 15_000, 5_000
#: Least log-likelihood ratio of a term, least documents that hold it.
LEAST_G2, LEAST_DOCS = 25.0, 5
THRESHOLD = 0.3
#: A longer word must decode to trigrams that have been met; it is not remembered.
LONG = 64
#: Prices: a letter as it stands, a shorter run of two or of more, a sign dropped before or
#: behind a word (also: one that is no punctuation), a break or none where letters stand
#: apart by one or by more characters.
AS_IS, SHORTER_TWO, SHORTER, DROPPED, RARELY_DROPPED = -0.1, -2.0, -0.7, -1.5, -8.0
BREAK, WIDE_JOIN = -3.0, -4.0

#: The letters that a sign can stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
#: Signs that also stand as punctuation before or behind a word.
BEFORE, BEHIND = "(*#|+", "!*#|+("
LETTERS, MARKS = ALPHABET, re.escape("".join(SIGNS))
#: What may be one hidden word; other characters stand between words.
PIECE = re.compile(rf"[{LETTERS}{MARKS}]+")
OPEN = re.compile(rf"[{MARKS}]|([{LETTERS}])\1")
LETTER = re.compile(rf"[{LETTERS}]")
DOUBLE = re.compile(rf"([{LETTERS}])\1+")
PLAIN = re.compile(rf"([{LETTERS}]+)[.,;:]?$")
SIGN_RUN = re.compile(rf"^([{LETTERS}]+)(([{MARKS}])\3*)$")
SINGLE = rf"[{LETTERS}0-9@$!]"
SPACED = re.compile(rf"(?<![{LETTERS}0-9@$!])(?:{SINGLE}[ .\-_*]{{1,3}}){{3,}}{SINGLE}(?![{LETTERS}0-9@$!])")
WORD = re.compile(r"[a-zà-öø-ÿ]+")
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}


def _table() -> np.ndarray:
    """Code point -> number in the alphabet; 0 stands for anything between words."""
    out = np.zeros(0x180, np.int64)
    for c, i in CODE.items():
        out[ord(c)] = i
    return out


def _single_table() -> np.ndarray:
    """Code point -> whether it may be a letter of a spaced word."""
    out = np.zeros(0x180, bool)
    out[[ord(c) for c in ALPHABET + "0123456789@$!"]] = True
    return out


SINGLES = _single_table()


def _has_spaced(text: str) -> bool:
    """Whether four letters or signs stand alone and near to each other: a quick test before
    the pattern."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = SINGLES[np.minimum(points, len(SINGLES) - 1)]
    at = np.flatnonzero(one[1:-1] & ~one[:-2] & ~one[2:])
    return len(at) >= 4 and bool((at[3:] - at[:-3] <= 12).any())


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts as an array of SIZE x SIZE x SIZE."""
    table = _table()

    def count(batches):
        total, held, chars = np.zeros(SIZE**3, np.int64), [], 0

        def add():
            # two blanks between texts: each begins and ends as words do behind a full stop
            points = np.frombuffer(f"  {'  '.join(held)}  ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            c = table[np.minimum(points, len(table) - 1)]
            total[:] += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
            held.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.append(text)
                    chars += len(text)
                if chars > 500_000:
                    add()
                    chars = 0
        if held:
            add()
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["gram", "n"])

    sums = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE**3)
    for row in sums.collect():  # at most SIZE ** 3 rows
        out[row["gram"]] = row["n"]
    return out.reshape(SIZE, SIZE, SIZE)


class Restorer:
    """Viterbi decoding of what may hide words; the rest passes as it is."""

    def __init__(self, counts: np.ndarray, limit: int = 100_000):
        two = counts.sum(2, keepdims=True)
        back = (counts.sum(0) + 0.1) / (counts.sum(0).sum(1, keepdims=True) + 0.1 * SIZE)
        logp = np.log((counts + 2 * back[None]) / (two + 2))
        self.met = (counts > 0).ravel().tolist()
        self.logp = logp.ravel().tolist()
        # a letter that stands twice between y and z: whether once is the better reading
        two_l = np.stack([logp[:, k, k] for k in range(SIZE)], 1)
        l_two = np.stack([logp[k, k, :] for k in range(SIZE)], 0)
        self.once = (logp - two_l[:, :, None] - l_two[None] + SHORTER_TWO > 0).tolist()
        self.seen: dict[str, str] = {}
        self.ends: dict[tuple[str, str, int], str] = {}
        self.limit = limit

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each run of equal characters the strings it can stand for, with channel costs."""
        out, i, n = [], 0, len(token)
        while i < n:
            c, j = token[i], i
            while j < n and token[j] == c:
                j += 1
            own = c in CODE
            letters, price = (c, AS_IS) if own else (SIGNS[c], -1.0 - 0.3 * len(SIGNS[c]))
            ways = []
            if not own and (i == 0 or j == n):
                ways.append(("", DROPPED if c in (BEFORE if i == 0 else BEHIND) else RARELY_DROPPED))
            shorter = SHORTER_TWO if own and j - i == 2 else SHORTER
            for letter in letters:
                ways.append((letter, price + (shorter if j - i > 1 else 0.0)))
                if j - i > 1:
                    ways.append((letter * 2, price + (SHORTER if j - i > 2 else 0.0)))
            out.append(ways)
            i = j
        return out

    @staticmethod
    def spaced_lattice(run: str) -> list[list[tuple[str, float]]]:
        """As ``lattice`` for letters that stand apart, with a way to break between them."""
        out: list[list[tuple[str, float]]] = []
        gap = 0
        for c in run:
            if c in CODE or c in "0123456789@$!":
                if out:
                    out.append([("", 0.0), (" ", BREAK)] if gap < 2 else [("", WIDE_JOIN), (" ", 0.0)])
                out.append([(c, AS_IS)] if c in CODE else [(x, -1.0) for x in SIGNS[c]])
                gap = 0
            else:
                gap += 1
        return out

    def best(self, lattice: list[list[tuple[str, float]]], only_met: bool = False) -> str | None:
        """The likeliest path; with ``only_met`` None if each one has a trigram never met."""
        # a path is a string and the path before it, so a step costs the same in any token
        logp, met = self.logp, self.met
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for ways in lattice:
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, path) in states.items():
                for string, price in ways:
                    s, at, known = score + price, state, True
                    for c in string:
                        gram = at * SIZE + CODE.get(c, 0)
                        s, at, known = s + logp[gram], gram % (SIZE * SIZE), known and met[gram]
                    if (known or not only_met) and (at not in after or s > after[at][0]):
                        after[at] = (s, (string, path))
            states = after
        ends = [(s + logp[at * SIZE], path) for at, (s, path) in states.items() if not only_met or met[at * SIZE]]
        if not ends:
            return None
        path, parts = max(ends, key=lambda x: x[0])[1], []
        while path:
            parts.append(path[0])
            path = path[1]
        return "".join(reversed(parts))

    def _end(self, core: str, sign: str, n: int) -> str:
        """What a run of one sign behind letters stands for; it depends on two letters only."""
        key = (core[-2:], sign, min(n, 3))
        if (got := self.ends.get(key)) is None:
            stem = key[0] if len(core) > 1 else core
            at = 0
            for c in stem:
                at = at * SIZE % (SIZE * SIZE) + CODE[c]
            found = []
            for string, price in self.lattice(stem + sign * key[2])[-1]:
                s, now = price, at
                for c in string:
                    gram = now * SIZE + CODE[c]
                    s, now = s + self.logp[gram], gram % (SIZE * SIZE)
                found.append((s + self.logp[now * SIZE], string))
            got = self.ends[key] = max(found)[1]
        return got

    def _keeps_doubles(self, word: str, ends: bool) -> bool:
        """Whether letters that stand twice stay so; false where runs are longer, touch each
        other or, unless the token ends there, the end."""
        last = -1
        for m in DOUBLE.finditer(word):
            i, j = m.span()
            if j - i > 2 or i == last or (j == len(word) and not ends):
                return False
            y = CODE[word[i - 1]] if i else 0
            z = CODE[word[j]] if j < len(word) else 0
            if self.once[y][CODE[word[i]]][z]:
                return False
            last = j
        return True

    def decode(self, token: str) -> str:
        """The likeliest reading of a piece (letters and signs, a letter at least)."""
        if (got := self.seen.get(token)) is not None:
            return got
        m = SIGN_RUN.match(token)
        core = m[1] if m else token
        if (m or not any(c in SIGNS for c in token)) and self._keeps_doubles(core, not m):
            return core + self._end(core, m[3], len(m[2])) if m else token
        if len(token) > LONG:
            return self.best(self.lattice(token), only_met=True) or token
        if len(self.seen) >= self.limit:
            self.seen.clear()
        out = self.seen[token] = self.best(self.lattice(token))
        return out

    def _pieces(self, token: str) -> str:
        return PIECE.sub(lambda m: self.decode(m[0]) if OPEN.search(m[0]) and LETTER.search(m[0]) else m[0], token)

    def restore(self, text: str) -> str:
        """Lower-case text with hidden words restored. A piece of more than ``LONG`` characters
        stays as it is if every reading of it has a trigram that no text has."""
        text = text.lower()
        if _has_spaced(text):
            text = SPACED.sub(lambda m: self.best(self.spaced_lattice(m[0])), text)
        return re.sub(r"\S+", lambda m: self._pieces(m[0]), text)

    def words(self, token: str) -> list[str]:
        """The restored words of one token of a lower-case text."""
        if m := PLAIN.match(token):  # most tokens; the answer is the same without this line
            core = m[1]
            return [core] if not DOUBLE.search(core) or self._keeps_doubles(core, True) else WORD.findall(self.decode(core))
        return WORD.findall(self._pieces(token) if OPEN.search(token) else token)


def terms(word: str) -> list[str]:
    """A word as evidence: itself, and its beginnings of four to six letters."""
    return ["=" + word, *(word[:n] for n in (4, 5, 6) if len(word) > n)]


class Reader:
    """text -> what it holds of ``of(word)``, remembered by token."""

    def __init__(self, counts: np.ndarray, of, restore: bool = True, limit: int = 200_000):
        self.restorer, self.of, self.on, self.limit, self.known = Restorer(counts), of, restore, limit, {}

    def tokens(self, text: str | None) -> tuple[set[str], list[str]]:
        """Distinct tokens of the lower-case text, and the runs of spaced letters as restored."""
        text, runs = (text or "").lower(), []
        if self.on and _has_spaced(text):
            text = SPACED.sub(lambda m: runs.append(self.restorer.best(self.restorer.spaced_lattice(m[0]))) or runs[-1], text)
        return set(text.split()), runs

    def found(self, tokens: set[str]) -> list:
        out, known = [], self.known
        for token in tokens:
            got = known.get(token)
            if got is None:
                words = self.restorer.words(token) if self.on else WORD.findall(token)
                got = tuple(x for w in words for x in self.of(w))
                if len(token) <= LONG:
                    if len(known) >= self.limit:
                        known.clear()
                    known[token] = got
            if got:
                out += got
        return out


def evidence(texts: list[str | None], reader: Reader, weight: dict[str, float]) -> np.ndarray:
    """The strongest evidence of each text: largest, second, mean of five, its count, length.
    ``reader`` gives (word, weight) of the words that have one."""
    out = np.zeros((len(texts), 5))
    sizes = sorted({len(t) - 1 for t in weight if t[0] == "=" and len(t) > 5})
    for i, text in enumerate(texts):
        tokens, runs = reader.tokens(text)
        best = dict(reader.found(tokens))
        for run in runs:
            run = run.replace(" ", "")
            for n in sizes:
                for k in range(len(run) - n + 1):
                    if w := weight.get("=" + run[k : k + n]):
                        best[run[k : k + n]] = w
        found = sorted(best.values(), reverse=True)
        if found:
            out[i, 0], out[i, 2], out[i, 3] = found[0], sum(found[:5]) / 5, np.log1p(len(found))
            out[i, 1] = found[1] if len(found) > 1 else 0
        out[i, 4] = np.log1p(len(tokens)) / 10
    return out


def _weigh(weight: dict[str, float]):
    starts = {t[:4] for t in weight if t[0] != "="}

    def of(word: str) -> list[tuple[str, float]]:
        if "=" + word not in weight and word[:4] not in starts:
            return []
        w = max((weight.get(t, 0.0) for t in terms(word)), default=0.0)
        return [(word, w)] if w else []

    return of


class Logistic:
    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.base, self.w = (float(y.mean()) if len(y) else 0.0), None
        if not 0 < self.base < 1:
            return self
        z = np.c_[x, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        ridge = np.diag([0.1] * x.shape[1] + [1e-6])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
        self.w = w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.w, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic"):
    """docs: doc_id, text; labels: doc_id and the label, only those to learn from."""
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")  # other columns may clash
    counts = character_counts(docs)
    parts = [labelled_sample(labels.filter(F.col(label) == y), label, TRAIN_ROWS) for y in (0, 1)]
    # an id with both labels counts as toxic
    ids = parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.max("y").cast("long").alias("y"))
    sample = docs.join(F.broadcast(ids), "doc_id").select("text", "y").filter("text is not null")

    def count(batches):
        reader, held = Reader(counts, terms), {}

        def flush():
            names = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([held[k][0] for k in names], pa.int64()), pa.array([held[k][1] for k in names], pa.int64())], ["term", "other", "toxic"])
            held.clear()

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in set(reader.found(reader.tokens(text)[0])):
                    held.setdefault(term, [0, 0])[y] += 1
                if len(held) > 200_000:
                    yield from flush()
        yield from flush()

    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    weight: dict[str, float] = {}
    if n0 and n1:
        df = sample.mapInArrow(count, "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("b"), F.sum("toxic").alias("a"))
        p = (F.col("a") + F.col("b")) / F.lit(float(n0 + n1))
        part = lambda x, n: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (p * n))).otherwise(0.0)
        log_odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
        best = df.withColumn("g2", 2 * (part("a", n1) + part("b", n0))).withColumn("w", log_odds)
        best = best.filter((F.col("a") >= LEAST_DOCS) & (F.col("w") > 2) & (F.col("g2") >= LEAST_G2)).orderBy(F.desc("g2"), "term").limit(TERMS)
        weight = {r["term"]: r["w"] for r in best.select("term", "w").collect()}  # at most TERMS rows

    def rate(batches):
        reader = Reader(counts, _weigh(weight))
        for batch in batches:
            x = evidence(batch.column(0).to_pylist(), reader, weight)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sample.mapInArrow(rate, "x array<double>, y long").toArrow()  # at most about 2 * TRAIN_ROWS rows
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 5) if rows.num_rows else np.zeros((0, 5))
    return counts, weight, Logistic().fit(x, rows.column("y").to_numpy().astype(float))


def with_score(docs: DataFrame, model, text: str = "text", score: str = "score", restore: bool = True) -> DataFrame:
    """``docs`` with a column ``score``; ``restore=False`` reads the texts as they stand."""
    counts, weight, logistic = model
    tune(docs.sparkSession)
    docs = set_aside(docs, [score])
    names, at = docs.columns, docs.columns.index(text)

    def rate(batches):
        reader = Reader(counts, _weigh(weight), restore)
        for batch in batches:
            s = logistic.score(evidence(batch.column(at).to_pylist(), reader, weight))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*names, score])

    return docs.mapInArrow(rate, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(4, 2)).select("doc_id", "toxic")
    scored = with_score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
