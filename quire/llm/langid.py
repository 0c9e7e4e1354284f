"""Language identification by unigram models over pieces, with segmentations summed out.

The pieces are those of a fixed public vocabulary; a word is its letters behind the vocabulary's word mark. A language
gives each piece a probability, and a word the sum over all segmentations of the product of its pieces' probabilities,
which the forward algorithm adds up from left to right. A text's likelihood is the product over its words.

Fitting takes one step of expectation maximisation from even pieces: the forward-backward algorithm gives every
piece's expected count in every word, all training documents are covered, and sums by (language, piece) leave at most
languages * pieces rows. A letter that is no piece counts as a piece of the smallest probability, so any word can be scored.

Defined results: a null text or one without letters is 'und' with score 0, and so is every text if there is nothing to
learn from; ties go to the first language by name; a null doc_id is not held out and not learned from; repeated
rows give repeated results and count as often as they stand there; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, slices

MARK = "▁"
UNDETERMINED = "und"
#: Added to each piece's expected count.
SMOOTHING = 0.1
#: Distinct words that a worker counts before it hands on what it has.
CACHE = 150_000
#: From this many letters on a word is scored by itself, in bounded memory.
LONG = 2_000
CHUNK = 20_000
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def words(text: str | None) -> list[str]:
    """Runs of letters (Unicode's categories L), lower-cased."""
    found = _WORD.findall(text.lower()) if text else []
    if "".join(found).isalpha():
        return found
    return [w for f in found for w in ([f] if f.isalpha() else _LETTERS.findall(f))]  # numerals that are no digits go


def load_pieces(path: str) -> dict[str, int]:
    """Piece -> number. Reads the public sentencepiece file; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}


class Lattices:
    """Looks up all pieces in many words at once, and sums over segmentations with numpy.

    Words of one length are a matrix of code points. Substrings are hashed by extending them letter by letter; two
    tables of piece numbers, the second for pieces whose place in the first is taken, answer which of them are pieces."""

    BITS, BASE, SPREAD = 21, U64(0x9E3779B97F4A7C15), (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))

    def __init__(self, vocab: dict[str, int]):
        self.size = max(vocab.values()) + 1
        self.unknown, self.none = self.size, self.size + 1  # a letter that is no piece; no piece
        self.longest = max(map(len, vocab))
        self.keys = np.zeros(self.size + 2, U64)
        for piece, number in vocab.items():
            h = 0
            for c in piece:
                h = (h * int(self.BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
            self.keys[number] = h
        self.tables = [np.full(1 << self.BITS, self.none, np.int32) for _ in self.SPREAD]
        for number in vocab.values():
            for table, spread in zip(self.tables, self.SPREAD, strict=True):
                slot = (int(self.keys[number]) * int(spread) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.BITS)
                if table[slot] == self.none:
                    table[slot] = number
                    break
            else:
                raise ValueError("both places of a piece are taken")

    def find(self, h: np.ndarray) -> np.ndarray:
        out = self.tables[0][h * self.SPREAD[0] >> U64(64 - self.BITS)]
        taken = np.flatnonzero(out != self.none)  # by the piece in question or another one
        wrong = taken[self.keys[out[taken]] != h[taken]]
        second = self.tables[1][h[wrong] * self.SPREAD[1] >> U64(64 - self.BITS)]
        out[wrong] = np.where(self.keys[second] == h[wrong], second, self.none)
        return out

    def arcs(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length: by piece length k, the piece that starts at each position (words x positions)."""
        n = len(words[0]) + 1
        letters = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(U64)
        return self.pieces(letters)

    def pieces(self, letters: np.ndarray) -> list[np.ndarray]:
        out, h, n = [], letters, letters.shape[1]
        for k in range(1, min(n, self.longest) + 1):
            if k > 1:
                h = h[:, : n - k + 1] * self.BASE + letters[:, k - 1 :]
            found = self.find(np.ascontiguousarray(h).reshape(-1)).reshape(h.shape)
            if k == 1:
                found[found == self.none] = self.unknown
            out.append(found)
        return out

    def likelihoods(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log P(word) by language (words x languages), by the forward algorithm. probs: pieces x languages, with rows
        for an unknown letter and for no piece."""
        if len(words[0]) >= LONG:
            return np.stack([self.long_likelihood(w, probs) for w in words])
        arcs = self.arcs(words)
        n = arcs[0].shape[1]
        alpha, logs = [np.ones((len(words), probs.shape[1]))], np.zeros((len(words), probs.shape[1]))
        for j in range(1, n + 1):
            a = alpha[j - 1] * probs[arcs[0][:, j - 1]]
            for k in range(2, min(j, len(arcs)) + 1):
                piece = arcs[k - 1][:, j - k]
                here = np.flatnonzero(piece != self.none)  # long pieces are rare
                if len(here):
                    a[here] += alpha[j - k][here] * probs[piece[here]]
            alpha.append(a)
            if j > len(arcs):
                alpha[j - len(arcs) - 1] = None
            if j % 16 == 0:  # keep the numbers in range: only the last few are read again
                top = a.max(1, keepdims=True)
                for i in range(max(0, j - len(arcs) + 1), j + 1):
                    alpha[i] = alpha[i] / top
                logs += np.log(top)
        return logs + np.log(alpha[n])

    def expectations(self, words: list[str], weights: np.ndarray, counts: np.ndarray) -> None:
        """Adds each piece's expected count, all pieces being as likely, times the words' weights (words x languages) to
        counts (pieces x languages): forward and backward sums over the segmentations."""
        if len(words[0]) >= LONG:
            for w, weight in zip(words, weights, strict=True):
                self.long_expectations(w, weight, counts)
            return
        arcs = self.arcs(words)
        n, p = arcs[0].shape[1], 1.0 / self.size
        here = [[np.flatnonzero(a[:, i] != self.none) for i in range(a.shape[1])] for a in arcs]
        # Logarithms of the sums, so that words of any length stay in range.
        up, down = np.full((n + 1, len(words)), -np.inf), np.full((n + 1, len(words)), -np.inf)
        up[0] = down[n] = 0.0
        lp = np.log(p)
        for j in range(1, n + 1):
            total = np.ones(len(words))  # relative to the one letter before, which is always a step
            for k in range(2, min(j, len(arcs)) + 1):
                at = here[k - 1][j - k]
                total[at] += np.exp(up[j - k][at] - up[j - 1][at])
            up[j] = up[j - 1] + lp + np.log(total)
        for i in range(n - 1, -1, -1):
            total = np.ones(len(words))
            for k in range(2, min(n - i, len(arcs)) + 1):
                at = here[k - 1][i]
                total[at] += np.exp(down[i + k][at] - down[i + 1][at])
            down[i] = down[i + 1] + lp + np.log(total)
        pieces, shares, rows = [], [], []
        for k in range(1, len(arcs) + 1):
            for i in range(n - k + 1):
                at = here[k - 1][i]
                if len(at):
                    pieces.append(arcs[k - 1][at, i])
                    shares.append(np.exp(up[i][at] + down[i + k][at] - up[n][at] + lp))
                    rows.append(at)
        pieces, shares, rows = np.concatenate(pieces), np.concatenate(shares), np.concatenate(rows)
        for lang in range(counts.shape[1]):
            counts[:, lang] += np.bincount(pieces, shares * weights[rows, lang], len(counts))

    def steps(self, word: str, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, length, piece) of the pieces in one word, by start, some letters at a time."""
        letters = np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)[None, :]
        chunks = range(0, letters.shape[1], CHUNK)
        for lo in reversed(chunks) if backwards else chunks:
            arcs = self.pieces(letters[:, lo : lo + CHUNK + self.longest - 1])
            at = [np.flatnonzero(a[0, :CHUNK] != self.none) for a in arcs]
            start = np.concatenate(at)
            order = np.argsort(start, kind="stable")
            length = np.repeat(np.arange(1, len(arcs) + 1), [len(x) for x in at])
            piece = np.concatenate([a[0, x] for a, x in zip(arcs, at, strict=True)])
            yield start[order] + lo, length[order], piece[order]

    def long_likelihood(self, word: str, probs: np.ndarray) -> np.ndarray:
        """log P(word) by language; holds as many sums as the longest piece has letters."""
        size = self.longest + 1
        ahead, logs = np.zeros((size, probs.shape[1])), np.zeros(probs.shape[1])
        ahead[0], now, here = 1.0, 0, np.ones(probs.shape[1])
        for starts, lengths, pieces in self.steps(word):
            for i, k, p in zip(starts.tolist(), lengths.tolist(), probs[pieces], strict=True):
                if i != now:  # the first piece from here: what led here is complete
                    ahead[now % size] = 0.0
                    now, here = i, ahead[i % size]
                    if i % 16 == 0:
                        top = here.copy()
                        ahead /= top
                        logs += np.log(top)
                ahead[(i + k) % size] += here * p
        return logs + np.log(ahead[(len(word) + 1) % size])

    def sums(self, word: str, backwards: bool) -> np.ndarray:
        """Logarithms of the sums over segmentations of what stands before (backwards: from) each place, all pieces being
        as likely."""
        n, size, p = len(word) + 1, self.longest + 1, 1.0 / self.size
        out, ring, scale = np.zeros(n + 1), [0.0] * size, 0.0
        ring[n % size if backwards else 0] = 1.0
        for starts, lengths, _ in self.steps(word, backwards):
            ends = np.flatnonzero(np.r_[True, starts[1:] != starts[:-1]]).tolist()
            spans = list(zip(ends, [*ends[1:], len(starts)], strict=True))
            starts, lengths = starts.tolist(), lengths.tolist()
            for a, b in reversed(spans) if backwards else spans:
                i = starts[a]
                if backwards:
                    value = ring[i % size] = p * sum(ring[(i + k) % size] for k in lengths[a:b])
                else:
                    value = ring[i % size]
                    ring[i % size] = 0.0
                    for k in lengths[a:b]:
                        ring[(i + k) % size] += value * p
                out[i] = math.log(value) + scale
                if not 1e-100 < value < 1e100:
                    ring = [x / value for x in ring]
                    scale += math.log(value)
        if not backwards:
            out[n] = math.log(ring[n % size]) + scale
        return out

    def long_expectations(self, word: str, weights: np.ndarray, counts: np.ndarray) -> None:
        """expectations() of one word; holds two numbers a letter."""
        up, down, lp = self.sums(word, False), self.sums(word, True), -math.log(self.size)
        for starts, lengths, pieces in self.steps(word):
            shares = np.exp(up[starts] + down[starts + lengths] - up[-1] + lp)
            counts += np.bincount(pieces, shares, len(counts))[:, None] * weights[None, :]

    def by_length(self, words: list[str]) -> Iterator[np.ndarray]:
        """Indexes of words of one length, a bounded number of letters at a time."""
        if not words:
            return
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        for block in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            step = max(1, 200_000 // (int(sizes[block[0]]) + 1))
            for at in range(0, len(block), step):
                yield block[at : at + step]


_LATTICES: dict[str, Lattices] = {}


def lattices(path: str) -> Lattices:
    if path not in _LATTICES:
        _LATTICES[path] = Lattices(load_pieces(path))
    return _LATTICES[path]


def piece_counts(docs: DataFrame, path: str, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, piece, count): expected piece counts over all documents whose language is known."""

    def flush(counts: dict[str, Counter], lat: Lattices) -> pa.RecordBatch:
        names = sorted(counts)
        every = list(set().union(*counts.values()))
        weights = np.array([[counts[n][w] for n in names] for w in every], float)
        sums = np.zeros((lat.size + 2, len(names)))
        for block in lat.by_length(every):
            lat.expectations([every[i] for i in block], weights[block], sums)
        piece, name = np.nonzero(sums[: lat.size])
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in name], pa.string()), pa.array(piece.astype(np.int32)), pa.array(sums[piece, name])], names=["lang", "piece", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(path)
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in slices(batches, "text"):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[name].update(words(t))
            if sum(map(len, counts.values())) > CACHE:
                yield flush(counts, lat)
                counts = defaultdict(Counter)
        if any(counts.values()):
            yield flush(counts, lat)

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return known.mapInArrow(run, "lang string, piece int, count double").groupBy("lang", "piece").agg(F.sum("count").alias("count"))


class Model:
    """Languages and each piece's probability in each of them; holds languages * pieces numbers."""

    def __init__(self, names: list[str], probs: np.ndarray, path: str):
        self.names, self.probs, self.path = names, probs, path

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior of each text; distinct words are scored once for all of them."""
        cut = [words(t) for t in texts]
        if not self.names:
            return [(UNDETERMINED, 0.0)] * len(texts)
        every = list(set().union(*cut))
        lat, table = lattices(self.path), np.zeros((len(every), len(self.names)))
        for block in lat.by_length(every):
            table[block] = lat.likelihoods([every[i] for i in block], self.probs)
        at = {w: k for k, w in enumerate(every)}
        out = []
        for found in cut:
            if not found:
                out.append((UNDETERMINED, 0.0))
                continue
            total = table[[at[w] for w in found]].sum(0)
            best = int(total.argmax())
            out.append((self.names[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out

    def text(self, text: str | None) -> tuple[str, float]:
        return self.texts([text])[0]


def fit(docs: DataFrame, path: str, lang: str = "lang", text: str = "text") -> Model:
    """The model of all documents of known language. Collects languages * pieces sums, whatever the corpus's size."""
    lat = lattices(path)
    rows = piece_counts(docs, path, lang, text).toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((lat.size + 2, len(names)))
    at = {n: k for k, n in enumerate(names)}
    if rows.num_rows:
        np.add.at(counts, (rows["piece"].to_numpy(), np.array([at[n] for n in rows["lang"].to_pylist()])), rows["count"].to_numpy())
    counts += SMOOTHING
    counts[lat.none] = 0.0
    return Model(names, counts / counts.sum(0, keepdims=True), path)


def predict(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, lang_pred, score (the language's posterior, all languages equally likely before)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text"):
            got = m.texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text).alias("text")).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")


def held_out_report(docs: DataFrame, path: str, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows whose crc32(doc_id as text) mod folds is not held."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    model = fit(docs.where(fold != held), path)
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
