"""Toxicity behind obfuscation: decode a noisy channel, then score the restored text.

Channel: a writer replaces letters by look-alikes (m0r0n), stretches them (looooser) and spaces them out (m o r o n).
A suspicious token becomes a lattice whose positions hold the letters it may stand for, a stretched run one or two
copies, a spaced run optional word ends between its letters. A Viterbi search finds the likeliest reading under a
character trigram model counted over all documents. Other tokens stand for themselves.

Scoring: a logistic regression over the restored words of a document and their first 4, 5 and 6 letters. It is fitted on
a bounded sample of the labelled rows (SAMPLE documents, by hash), with all features that tell more about their labels than
chance would; so their number is bounded by the sample's.

Defined results: null and empty texts have no words and get the score of a document without features (the intercept);
without usable labels of documents that are there every score is 0; labels of one document that contradict each other count as toxic; a null
doc_id is never held out and never learned from; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import batched
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, slices

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 20_000
#: Documents of the sample that a feature is in, at least.
SUPPORT = 4
#: A feature's log likelihood ratio is above the logarithm of the number of features by this much, at least.
CHANCE = 1.0
#: Readings that a worker remembers; words, or features, that it counts before it sends them.
CACHE = 80_000
#: Words that are cut into trigrams at once, documents whose features are sent at once.
WORDS, ROWS = 10_000, 1_000
#: In counts of features: all documents. No word is empty.
ALL = ""

# What a sign may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "¢": "c", "£": "l", "(": "c", "<": "c", "*": "aeiou"}
EDGE = " "
#: Stands for all letters from here on, so that the alphabet is bounded.
OTHER = "\u0250"
#: Cost of a look-alike (a natural logarithm), of reading a doubled letter as one, and of an optional word end.
SWAP, SINGLE, SPLIT = 0.5, 1.5, 2.5

_SIGNS = re.escape("".join(LOOKS))
_LETTER = r"[^\W\d_]"
#: A stretched letter, or a sign that a letter stands next to.
_ODD = re.compile(rf"({_LETTER})\1\1|{_LETTER}[{_SIGNS}]+{_LETTER}|^[{_SIGNS}]+{_LETTER}|{_LETTER}[{_SIGNS}]+$|({_LETTER})\2.*\d")
_SIGN = rf"[\w{_SIGNS}]"
#: What may stand between spaced letters besides white space: any sign that is no letter's look-alike, and four that people use so.
_BETWEEN = rf"(?:[^\w\s{_SIGNS}]|[._*~\-])"
#: Four or more single signs or letters with white space between all of them, however much, or with runs of one sign, blanks around
#: them or not, or with the same short mixed gap. Brackets and exclamation marks may stand around them.
_SPACED = re.compile(
    rf"(?<![\w@$€¢£]){_SIGN}(?:(?:\s+{_SIGN}){{3,}}|\s*(?P<by>{_BETWEEN})(?P=by)*\s*{_SIGN}(?:\s*(?P=by)+\s*{_SIGN}){{2,}}|(?P<gap>[ .\-_*~]{{1,3}})(?:{_SIGN}(?P=gap)){{2,}}{_SIGN})(?!{_BETWEEN}?[\w@$€¢£])"
)
_TRIPLE = re.compile(rf"({_LETTER})\1\1")
_TRIPLES = tuple(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile(rf"{_LETTER}+")
#: Ordinary punctuation around a word.
_AROUND = ".,;:?!\"'()[]{}«»„“”‚‘’¿¡…-–—"
_TRIM = re.compile(r"^[^\w@$!|+€¢£(<*]+|[^\w@$|+€¢£*]+$")


def shape(c: str) -> str:
    """The model's alphabet: Latin letters as they are, other letters as one, anything else as an edge."""
    return min(c, OTHER) if c.isalpha() else EDGE


def trigrams(words: dict[str, int]) -> pa.RecordBatch:
    """(gram, count) over counted words, each between two edges before and one after it."""
    sizes = np.array([len(w) + 3 for w in words])
    text = "".join(f"{EDGE}{EDGE}{w}{EDGE}" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c[c >= ord(OTHER)] = ord(OTHER)
    code = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    within = np.ones(len(c), bool)
    ends = np.cumsum(sizes)
    within[ends - 1] = within[ends - 2] = False  # these windows reach into the next word
    keys, which = np.unique(code[within[:-2]], return_inverse=True)
    weights = np.repeat(np.fromiter(words.values(), float, len(words)), sizes)[:-2][within[:-2]]
    count = np.bincount(which, weights, len(keys)).astype(np.int64)
    low = (1 << 21) - 1
    grams = [chr(k >> 42) + chr(k >> 21 & low) + chr(k & low) for k in keys.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(count)], names=["gram", "count"])


def char_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, count): character trigrams within words, over all documents."""

    def counted(tokens: Counter) -> Iterator[pa.RecordBatch]:
        return (trigrams(dict(some)) for some in batched(tokens.items(), WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        tokens: Counter = Counter()
        for batch in slices(batches, "text"):
            for t in batch.column(0).to_pylist():
                if t:
                    tokens.update(_WORDS.findall(t.lower()))
            if len(tokens) > CACHE:
                yield from counted(tokens)
                tokens = Counter()
        yield from counted(tokens)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "gram string, count long").groupBy("gram").agg(F.sum("count").alias("count"))


class CharModel:
    """log P(letter | two before), backing off to one before and none. The alphabet bounds its size."""

    def __init__(self, grams: dict[str, int]):
        self.tri, self.two, self.one = dict(grams), Counter(), Counter()
        for g, c in grams.items():
            self.two[g[1:]] += c
            self.one[g[2]] += c
        self.ctx3, self.ctx2 = Counter(), Counter()
        for g, c in grams.items():
            self.ctx3[g[:2]] += c
            self.ctx2[g[1]] += c
        self.total = max(1, sum(self.one.values()))
        self._seen: dict[str, float] = {}

    def log(self, gram: str) -> float:
        got = self._seen.get(gram)
        if got is None:
            p = (self.one[gram[2]] + 0.5) / (self.total + 0.5 * (len(self.one) + 1))
            p = (self.two[gram[1:]] + 3.0 * p) / (self.ctx2[gram[1]] + 3.0)
            p = (self.tri.get(gram, 0) + 3.0 * p) / (self.ctx3[gram[:2]] + 3.0)
            if len(self._seen) >= CACHE:
                self._seen.clear()
            got = self._seen[gram] = math.log(p)
        return got


def lattice(token: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """For each position the letters it may be, with costs. A choice may be two letters or, past a spaced letter,
    a letter and a word end."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i + 1
        while j < len(token) and token[j] == c:
            j += 1
        choices = [(c, 0.0)] if c.isalpha() else [(x, SWAP) for x in LOOKS.get(c, "")]
        if not choices:
            choices = [(EDGE, 0.0)]
        run = j - i
        if run >= 2 and choices[0][0] != EDGE and not spaced:
            single = 0.0 if run >= 3 else SINGLE
            out.append([(x, cost + single) for x, cost in choices] + [(x * 2, cost) for x, cost in choices])
        else:
            for _ in range(run):
                out.append(choices + ([(x + EDGE, cost + SPLIT) for x, cost in choices] if spaced else []))
        i = j
    return out


def decode(token: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest reading of a token, by Viterbi over states of the last two letters."""
    best: dict[str, tuple[float, tuple]] = {EDGE * 2: (0.0, ())}
    log = model.log
    for choices in lattice(token, spaced):
        new: dict[str, tuple[float, tuple]] = {}
        for state, (score, path) in best.items():
            for letters, cost in choices:
                s, at = score - cost, state
                for x in letters:
                    y = shape(x)
                    if y == EDGE and at[1] == EDGE:
                        continue
                    s += log(at + y)
                    at = at[1] + y if y != EDGE else EDGE * 2
                if at not in new or s > new[at][0]:
                    new[at] = (s, (path, letters))
        best = new
    score, path = max(((s + (log(at + EDGE) if at[1] != EDGE else 0.0), p) for at, (s, p) in best.items()), key=lambda x: x[0])
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


class Restorer:
    """Restored words of a text; readings of tokens are remembered."""

    def __init__(self, model: CharModel):
        self.model, self._seen, self._alone = model, {}, {}

    def token(self, token: str) -> tuple[str, ...]:
        got = self._seen.get(token)
        if got is None:
            plain = token.strip(_AROUND)
            plain = plain if plain.isalpha() else _TRIM.sub("", token)
            read = _WORDS.findall(plain)
            if _ODD.search(plain):
                read = [*_WORDS.findall(decode(plain.rstrip("!"), self.model)), *(read if len(read) == 1 else ())]
            if len(self._seen) >= CACHE:
                self._seen.clear()
            got = self._seen[token] = tuple(read)
        return got

    def pieces(self, text: str) -> Iterator[tuple[str, tuple[str, ...]]]:
        """Each token of the lower-cased text, or run of spaced letters, with the words that it is read as."""
        low, at = text.lower(), 0
        for m in _SPACED.finditer(low):
            letters = m[0][:: 1 + len(m["gap"])] if m["gap"] else "".join(m[0].replace(m["by"] or " ", " ").split())
            if sum(map(str.isalpha, letters)) * 2 >= len(letters):
                yield from ((t, self.token(t)) for t in low[at : m.start()].split())
                apart, whole = decode(letters, self.model, spaced=True).split(), decode(letters, self.model)
                yield m[0], tuple(dict.fromkeys([*apart, whole]))
                at = m.end()
        yield from ((t, self.token(t)) for t in low[at:].split())

    def text(self, text: str) -> str:
        """The whole text, lower-cased, each token as it is read; tokens without letters stay."""
        return " ".join(w for t, read in self.pieces(text) for w in (read or (t,)))

    def alone(self, token: str) -> tuple[str, ...]:
        """Words of a token in which letters may be spaced by signs: s.p.a.c.e.d."""
        got = self._alone.get(token)
        if got is None:
            if len(self._alone) >= CACHE:
                self._alone.clear()
            got = self._alone[token] = tuple(w for _, read in self.pieces(token) for w in read)
        return got

    def words(self, text: str | None) -> set[str]:
        """Distinct words of a text as they are read, those of pieces(). Plain words, nearly all, are told by cheap string
        methods; only the others are looked at closely, and texts with spaced letters."""
        if not text:
            return set()
        low = text.lower()
        out: set[str] = set()
        if _SPACED.search(low):
            for _, read in self.pieces(text):
                out.update(read)
            return out
        parts = low.split()
        stretched = any(t in low for t in _TRIPLES) or not low.isascii() and _TRIPLE.search(low) is not None
        for t in set(parts):
            word = t if t.isalpha() else t.strip(_AROUND)
            if word.isalpha() and not (stretched and _TRIPLE.search(word)):
                out.add(word)
            else:
                out.update(self.alone(t))
        return out


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in (4, 5, 6) if len(word) > n)]


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


class Classifier:
    def __init__(self, grams: dict[str, int], weights: dict[str, float], bias: float):
        self.grams, self.weights, self.bias = grams, weights, bias
        self._ready = None

    def __getstate__(self) -> dict:
        return {"grams": self.grams, "weights": self.weights, "bias": self.bias, "_ready": None}

    def score(self, text: str | None) -> float:
        if self._ready is None:
            self._ready = Restorer(CharModel(self.grams))
        weights, found = self.weights, set()
        for w in self._ready.words(text):
            if w in weights:
                found.add(w)
            for n in (4, 5, 6):
                if len(w) <= n:
                    break
                if (f := w[:n] + "~") in weights:
                    found.add(f)
        x = self.bias + sum(weights[f] for f in sorted(found))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, x))))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int | None = 2, sample: int = SAMPLE) -> Classifier:
    """Character counts over all documents; the classifier from at most `sample` labelled rows outside the held fold.

    The driver gets the counts (bounded by the alphabet), the sample's labels and its chosen features."""
    spark = docs.sparkSession
    grams = char_counts(docs).toArrow()
    grams = dict(zip(grams["gram"].to_pylist(), grams["count"].to_pylist(), strict=True))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if held is not None:
        usable = usable.where(_fold(folds) != held)
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = {r["doc_id"]: r["toxic"] for r in picked.toLocalIterator()}
    shared = spark.sparkContext.broadcast((grams, picked))
    ids = F.broadcast(spark.createDataFrame(pa.table({"doc_id": pa.array(list(picked), pa.int64())})))
    chosen = docs.select("doc_id", "text").join(ids, "doc_id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, set[str]]]:
        """One text at a time: the features of a slice take twenty times its size."""
        kept("toxicity")
        restore = Restorer(CharModel(shared.value[0]))
        for batch in slices(batches, "text"):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield shared.value[1][i], {f for w in restore.words(t) for f in features(w)}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts() -> pa.RecordBatch:
            names = list(pos.keys() | neg.keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[n] for n in names], pa.int64()), pa.array([neg[n] for n in names], pa.int64())], names=["f", "pos", "neg"])

        pos, neg = Counter(), Counter()
        for y, s in found(batches):
            (pos if y else neg).update([ALL, *s])
            if len(pos) + len(neg) > CACHE:
                yield counts()
                pos, neg = Counter(), Counter()
        if pos or neg:
            yield counts()

    counted = chosen.mapInArrow(tally, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counted = counted.where((F.col("pos") + F.col("neg") >= SUPPORT) | (F.col("f") == ALL)).persist()
    every = counted.where(F.col("f") == ALL).first()
    n_pos, n_neg = (every["pos"], every["neg"]) if every else (0, 0)
    if not n_pos or not n_neg:
        counted.unpersist()
        return Classifier(grams, {}, 60.0 if n_pos else -60.0)
    # Log likelihood ratio of a feature and the label, from counts of documents with the feature.
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    a, b, n = F.col("pos").cast("double"), F.col("neg").cast("double"), float(n_pos + n_neg)
    gain = part(a, (a + b) * n_pos / n) + part(b, (a + b) * n_neg / n) + part(n_pos - a, (n - a - b) * n_pos / n) + part(n_neg - b, (n - a - b) * n_neg / n)
    # Among n features without any bearing on the label, some gain log n by chance.
    least = math.log(max(1, counted.count() - 1)) + CHANCE
    telling = counted.where((F.col("f") != ALL) & (gain >= least)).select("f", gain.alias("gain")).toArrow().to_pylist()
    counted.unpersist()
    names = [r["f"] for r in sorted(telling, key=lambda r: (-r["gain"], r["f"]))]
    if not names:
        return Classifier(grams, {}, math.log(n_pos / n_neg))
    at = spark.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((y, sorted(at.value[f] for f in s if f in at.value)) for y, s in found(batches))
        for some in batched(rows, ROWS):
            toxic, sets = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(sets, pa.list_(pa.int32()))], names=["y", "x"])

    rows = chosen.mapInArrow(encode, "y int, x array<int>").toArrow()
    rows = sorted(zip(rows["y"].to_pylist(), rows["x"].to_pylist(), strict=True))  # so that reruns add up in one order
    w, bias = regress([x for _, x in rows], np.array([y for y, _ in rows], float), len(names))
    return Classifier(grams, dict(zip(names, w.tolist(), strict=True)), bias)


def regress(rows: list[list[int]], y: np.ndarray, n: int, ridge: float = 0.05, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge, by accelerated gradient steps over sparse rows."""
    where = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.array([c for r in rows for c in r], np.int64)
    w, bias = np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = np.bincount(where, w[cols], len(rows)) + bias
        r = 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))) - y
        g = np.append(np.bincount(cols, r[where], n) + ridge * w, r.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def score(docs: DataFrame, model: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out`, in [0, 1]. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != out]
    schema = docs.select(*(F.col(f"`{c}`") for c in names)).withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        for batch in slices(batches, text):
            got = [shared.value.score(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*names, out])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


#: From this score on a document counts as toxic.
THRESHOLD = 0.3


def held_out_report(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels of rows whose crc32(doc_id as text) mod folds is not held."""
    rows = docs.select("doc_id", "text")
    scored = score(rows, fit(rows, labels, folds, held))
    return scored.select("doc_id", F.coalesce(_fold(folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
