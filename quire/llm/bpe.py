"""Byte-level BPE encoding and decoding with a vectorised pre-tokeniser.

Pre-tokens are found without a regular expression. Every code point has a class; a small automaton over
classes says at which code points a pre-token starts. An automaton step is a function from states to states, and
composing functions is associative, so the states of all positions come from a blocked prefix scan over numpy
arrays: fold each block of code points into one function, scan the blocks' functions, then replay all blocks at once.
The slices feed a merge loop whose results are cached by the slice's bytes.

Defined results: a null text is encoded as the empty text (no ids); ids and decoded bytes round-trip for every text.
Repeated rows give repeated results; other columns are passed through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, slices

# Classes of code points. The contraction classes are set where an apostrophe starts 's 't 'm 'd 'll 've 're.
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE2, QUOTE3 = range(7)
# States after a code point.
START, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_BLANK, AFTER_SPACE, TAKE2, TAKE1 = range(8)

# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def class_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            table[cp] = LETTER
        elif major == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = SPACE
    table[0x20] = BLANK
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and starts[class, state]: does a pre-token start at a code point of this class."""
    nxt, starts = np.zeros((7, 8), np.uint8), np.zeros((7, 8), bool)
    for s in range(8):
        if s in (TAKE2, TAKE1):  # inside a contraction; its letters follow for certain
            nxt[:, s], starts[:, s] = (TAKE1 if s == TAKE2 else START), False
            continue
        for cls, run in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
            nxt[cls, s], starts[cls, s] = run, s not in (run, AFTER_BLANK)
        for cls, take in ((QUOTE2, TAKE1), (QUOTE3, TAKE2)):
            inside = s in (IN_OTHER, AFTER_BLANK)  # then the apostrophe is an ordinary character of a run
            nxt[cls, s], starts[cls, s] = (IN_OTHER if inside else take), not inside
        # Whether white space inside a run of it starts a pre-token depends on what follows: see boundaries().
        nxt[BLANK, s], nxt[SPACE, s] = AFTER_BLANK, AFTER_SPACE
        starts[BLANK, s] = starts[SPACE, s] = s not in (AFTER_BLANK, AFTER_SPACE)
    return nxt, starts


NEXT, STARTS = _automaton()
BLOCK = 64
#: Bytes of text whose boundaries are found at once: the arrays take some forty times as many.
SLICE_BYTES = 500_000


def scan_states(cls: np.ndarray) -> np.ndarray:
    """The state before each position: prefix composition of the positions' transition functions, in blocks."""
    n = len(cls)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T) * np.uint8(8)  # row j: the j-th position of each block
    table = NEXT.ravel()
    folded = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, 1)  # each block as one function of the state
    for j in range(BLOCK):
        folded = table[grid[j] + folded]
    scan, step = folded, 1
    while step < blocks:  # scan the blocks' functions by doubling: apply the earlier one, then the later one
        scan = np.concatenate([scan[:, :step], np.take_along_axis(scan[:, step:], scan[:, :-step], 0)], 1)
        step *= 2
    state = np.append(np.uint8(START), scan[START, :-1])
    before = np.empty((BLOCK, blocks), np.uint8)
    for j in range(BLOCK):
        before[j] = state
        state = table[grid[j] + state]
    return before.T.reshape(-1)[:n]


def boundaries(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. cp: the code points of texts on end; first: indexes of the texts' first ones.

    Between texts the caller puts one code point 0 (class OTHER), which no text's pre-token may reach over."""
    cls = class_table()[cp]
    c1, c2 = np.append(cp[1:], 0), np.append(cp[2:], [0, 0])[: len(cp)]
    quote = cp == 0x27
    short = np.isin(c1, [ord(x) for x in "sdmt"])
    long = ((c1 == ord("l")) & (c2 == ord("l"))) | (np.isin(c1, [ord("v"), ord("r")]) & (c2 == ord("e")))
    cls[quote & short] = QUOTE2
    cls[quote & long] = QUOTE3
    # A text starts anew: its first code point sees START. The separator before it is replaced by a white space class
    # whose successor state starts everything but white space; white space is settled below from `first`.
    sep = first[1:] - 1
    cls[sep] = SPACE
    before = scan_states(cls)
    starts = STARTS[cls, before]
    white = (cls == BLANK) | (cls == SPACE)
    white[sep] = False
    prev_white = np.append(False, white[:-1])
    next_plain = np.append(~white[1:], False)
    next_plain[sep - 1] = False  # the last of a text: its run of white space goes on to the end
    if len(first):
        next_plain[-1] = False
    starts = np.where(white, ~prev_white | next_plain, starts)
    starts[first[first < len(starts)]] = True
    starts[sep] = True
    return starts


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Merges of a rank file, cached by pre-token. A cache entry is dropped only when the cache is full."""

    CACHE = 200_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache = ranks, {}
        self.pieces = {i: b for b, i in ranks.items()}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: again and again join the adjacent pair of lowest rank, leftmost first.

        A heap of pairs with linked neighbours keeps this at n log n for pre-tokens of any length."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := right[i]) >= n or end[j] != stop:
                continue
            alive[j], end[i], right[i] = False, stop, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if (p := left[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def ids(self, pieces: list[bytes]) -> list[int]:
        cache, out = self.cache, []
        for p in pieces:
            got = cache.get(p)
            if got is None:
                got = self.merge(p)
                if len(p) <= 64:
                    if len(cache) >= self.CACHE:
                        cache.clear()
                    cache[p] = got
            out.extend(got)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def pretokens(texts: list[str]) -> Iterator[list[bytes]]:
    """The UTF-8 slices of each text, all texts' boundaries found in one pass."""
    joined = "\0".join(texts)
    if not joined and len(texts) <= 1:
        yield from ([] for _ in texts)
        return
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    lens = np.array([len(t) for t in texts])
    first = np.append(0, np.cumsum(lens + 1)[:-1])
    at = np.flatnonzero(boundaries(cp, first))
    width = 1 + (cp > 0x7F).astype(np.uint8) + (cp > 0x7FF) + (cp > 0xFFFF)
    offset = np.append(0, np.cumsum(width, dtype=np.int64))
    raw = joined.encode("utf-8", "surrogatepass")
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, first + lens)
    cuts = offset[at].tolist()
    for k in range(len(texts)):
        marks = [*cuts[lo[k] : hi[k]], int(offset[first[k] + lens[k]])]
        yield [raw[a:b] for a, b in zip(marks, marks[1:], strict=False)]


def encoder(path: str) -> Encoder:
    encoders = kept("bpe")
    if path not in encoders:
        encoders[path] = Encoder(load_ranks(path))
    return encoders[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", ends: str | None = None) -> DataFrame:
    """docs with the array column `ids`; `ends`, if named, gets each token's end as a byte offset of the UTF-8 text,
    from which any span of tokens maps back to the text. A column of the same name as a result is replaced."""
    keep = [f for f in docs.schema.fields if f.name not in (ids, ends)]
    schema = T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(ends, T.ArrayType(T.LongType()))] if ends else [])])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, text, SLICE_BYTES):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            coded = [enc.ids(p) for p in pretokens(texts)]
            cols = [*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(coded, pa.list_(pa.int32()))]
            if ends:
                cols.append(pa.array([np.cumsum([len(enc.pieces[i]) for i in c], dtype=np.int64).tolist() for c in coded], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """tokens with the binary column `out`: the bytes that the ids stand for (a null list: no bytes)."""
    keep = [f for f in tokens.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.BinaryType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            got = [enc.decode(x or ()) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(got, pa.binary())], names=schema.fieldNames())

    return tokens.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", ids: str | None = None) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256; encodes, then decodes the ids.

    Both steps share a worker; the id lists leave it only as the column `ids`, if that is named."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *([T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, text, SLICE_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, a, b, lists = [], [], [], []
            for pieces in pretokens(texts):
                coded = enc.ids(pieces)
                packed = np.array(coded, "<u4")
                n.append(len(coded))
                a.append(hashlib.sha256(packed.tobytes()).hexdigest())
                b.append(hashlib.sha256(enc.decode(coded)).hexdigest())
                lists.append(packed.view(np.int32))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(lists, pa.list_(pa.int32()))] if ids else [])], names=schema.fieldNames())

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias(text)).mapInArrow(run, schema)
