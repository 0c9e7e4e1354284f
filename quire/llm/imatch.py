"""I-Match fingerprints over randomised lexicons.

Terms: runs of characters that are no ASCII sign or blank, A-Z lower-cased. Lexicon: the terms whose document frequency lies
in a band of shares of all documents.

Sub-lexicons are fixed by the lexicon's terms alone: each of SEEDS random numberings gives every term a level, which it reaches
with probability 2**-level (the leading zero bits of a digest of seed and term). A numbering has a sub-lexicon for each of
LEVELS: the terms that reach it. All documents are fingerprinted over the same SEEDS * len(LEVELS) sub-lexicons, from one in 4
terms to one in 4,096, so that texts of any length have some that catch about one of their terms.

Fingerprint: a digest of the document's distinct lexicon terms, sorted, and one of those in each sub-lexicon (nothing if it has
none). A document without lexicon terms has a digest of its whole text only.
Likeness: 1 for equal sets of lexicon terms; else the share of equal digests among the sub-lexicons of one level that
catch a term of either document: the highest level at which half of the sub-lexicons or more do so, or else the first.

Driver and broadcast hold the lexicon: at most (mean number of distinct terms in a document) / (lower share) terms, whatever
the corpus's size. It is counted before it is fetched; beyond LEXICON terms it stays a table, to which the texts' distinct terms are
joined, and what is left of them goes back to the texts: the same fingerprints.

Defined results: a null text is empty; documents stand in order of doc_id (nulls first), then of a digest of their text; a
single document is its own next one; repeated rows stand next to each other as rows of their own; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_dir, numbered, slices

#: The band: shares of all documents that a term is in, at least and at most.
BAND = (0.0005, 0.05)
SEEDS, LEVELS = 24, (2, 4, 6, 8, 10, 12)
#: The most terms of a lexicon that every worker holds; a larger one is joined.
LEXICON = 1_000_000
#: Distinct terms that a worker counts before it hands on what it has.
CACHE = 250_000
#: Ranges of documents, and the most of them that a range should have.
RANGES, RANGE_ROWS = 4096, 4096
#: Bytes of UTF-8: A-Z lower-cased, other signs of ASCII but digits and letters as blanks.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_NONE = "...."


def terms(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").translate(_BYTES).split())


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): terms and the number of documents they are in, counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "df"])
        for batch in slices(batches, "text"):
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(terms(t))
            if len(counts) > CACHE:
                yield flush()
                counts = Counter()
        if counts:
            yield flush()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> list[str] | DataFrame:
    """The terms within the band, sorted; more than LEXICON of them as a written table (term)."""
    n = docs.count()
    df = F.col("df")
    checkpoint_dir(docs.sparkSession)
    seen = Observation()
    rows = frequencies(docs, text).where((df >= band[0] * n) & (df <= band[1] * n) & (df > 1)).select("term").observe(seen, F.count(F.lit(1)).alias("n")).checkpoint()
    return rows if seen.get["n"] > LEXICON else sorted(rows.toArrow()["term"].to_pylist())


def levels(term: bytes) -> list[int]:
    """The highest of LEVELS that a term reaches in each numbering, as a count of levels."""
    bits = [int.from_bytes(hashlib.md5(b"%d %b" % (seed, term)).digest()[:7]) >> 4 for seed in range(SEEDS)]
    return [bisect_right(LEVELS, 52 - b.bit_length()) for b in bits]


#: A fingerprint's digests as numbers, for comparison: that of all terms, and of each sub-lexicon (-1: no terms).
Mark = tuple[str, np.ndarray]


def digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def marked(words: list[bytes], reached: np.ndarray, whole: str) -> Mark:
    """The mark of a text's sorted lexicon terms, with the levels that they reach; whole: a digest of the text."""
    numbers = np.full((len(LEVELS), SEEDS), -1, np.int32)
    if not words:
        return whole, numbers
    md5, held = hashlib.md5, np.array(words, object)
    for level in range(len(LEVELS)):
        seed, term = np.nonzero(reached > level)
        if not len(seed):
            break
        caught, ends = held[term].tolist(), np.searchsorted(seed, np.arange(SEEDS + 1)).tolist()
        numbers[level] = [int.from_bytes(md5(b" ".join(caught[a:b])).digest()[:2]) if a < b else -1 for a, b in zip(ends, ends[1:], strict=False)]
    return md5(b" ".join(words)).hexdigest()[:16], numbers


class Lexicon:
    """Numbers and levels of the terms; levels are worked out where they are first asked for."""

    def __init__(self, found: list[str]):
        self.terms, self._at, self._levels = found, None, None

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "_at": None, "_levels": None}

    def mark(self, text: str) -> Mark:
        if self._at is None:
            self._at = {t.encode(): k for k, t in enumerate(self.terms)}
            self._levels = np.full((SEEDS, len(self.terms)), -1, np.int8)
        words = sorted(terms(text) & self._at.keys())  # bytes of UTF-8 are in order of code points
        found = [self._at[w] for w in words]
        reached = self._levels[:, found]
        for k in np.flatnonzero(reached[0] < 0).tolist():
            self._levels[:, found[k]] = reached[:, k] = levels(words[k])
        return marked(words, reached, digest(text))

    def fingerprint(self, text: str) -> str:
        return written(self.mark(text))


def written(mark: Mark) -> str:
    """A fingerprint: the digest of all terms, then the digests of the sub-lexicons' terms, level by level."""
    return mark[0] + "".join([_NONE if x < 0 else f"{x:04x}" for x in mark[1].ravel().tolist()])


def likeness(a: Mark, b: Mark) -> float:
    if a[0] == b[0]:
        return 1.0
    x, y = a[1], b[1]
    some = ((x >= 0) | (y >= 0)).sum(1)
    equal = ((x == y) & (x >= 0)).sum(1)
    few = np.flatnonzero(2 * some[1:] < SEEDS)
    level = int(few[0]) if len(few) else len(LEVELS) - 1  # the last one before the first that too few catch
    return float(equal[level] / some[level]) if some[level] else 0.0


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the value; of sorted bounds, a root of them is looked at twice."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda arr: F.size(F.filter(arr, lambda x: x <= value))
    array = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    part = below(array([p[0] for p in parts]))
    table = F.from_json(F.lit(str(parts)), F.lit("array<array<bigint>>"))
    return F.when(part == 0, 0).otherwise((part - 1) * step + below(F.element_at(table, F.greatest(part, F.lit(1)))))


def in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, tail, dealt and sorted by range and order of documents; a row with tail 1 repeats the first
    document of the next range (behind the last: of the first) at the end of a range.

    The bounds of the ranges are estimated shares of the ids, so each has about as many documents, however the ids lie;
    there are RANGES of them at most, which bounds what the driver and the broadcast of their first documents' ids hold."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, _ = numbered(rows)
    n = rows.count()
    if not n:
        return rows.select("doc_id", "text", F.lit(0).alias("range"), F.lit(0).alias("tail"))
    parts = min(RANGES, -(-n // RANGE_ROWS))
    shares = [k / parts for k in range(1, parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx("row", shares, 20 * parts).alias("q")).first()["q"])) if shares else []
    rows = rows.withColumn("range", _range_of(F.col("row"), bounds).cast("int"))
    firsts = rows.groupBy("range").agg(F.min("row").alias("row")).toArrow().sort_by("range")  # a row for each range
    numbers, ids = firsts["range"].to_pylist(), firsts["row"].to_pylist()
    before = pa.table({"row": pa.array(ids, pa.int64()), "_to": pa.array([numbers[-1], *numbers[:-1]], pa.int32())})
    heads = rows.join(F.broadcast(docs.sparkSession.createDataFrame(before)), "row").dropDuplicates(["row"]).select("doc_id", "text", "row", F.col("_to").alias("range"), F.lit(1).alias("tail"))
    both = rows.select("doc_id", "text", "row", "range", F.lit(0).alias("tail")).unionByName(heads)
    return both.repartition("range").sortWithinPartitions("range", "tail", "row").drop("row")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, lex: list[str] | DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the column `out`, each text's fingerprint. A column of that name is replaced."""
    names = [c for c in docs.columns if c != out]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    if isinstance(lex, DataFrame):
        held = rows.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.array(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("texts"))
        return _joined_marks(held, lex, lambda marks: (written(marks[0]),), {out: pa.string()}).select("row.*", out)
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon(lex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            got = [shared.value.fingerprint(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*names, out])

    return rows.mapInArrow(run, rows.withColumn(out, F.lit("")).schema)


def _joined_marks(rows: DataFrame, lex: DataFrame, report: Callable[[list[Mark]], tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    """(row, *kinds) of rows (row, texts): report's values for the marks of each row's texts, with a lexicon (term) that is joined.

    Rows are numbered and written without their texts; a term that many texts hold is in at most the band's share of them."""
    checkpoint_dir(rows.sparkSession)
    own = rows.schema["row"].dataType
    numbered_schema = T.StructType([T.StructField("row", own), T.StructField("no", T.LongType()), T.StructField("wholes", T.ArrayType(T.StringType())), T.StructField("terms", T.ArrayType(T.ArrayType(T.StringType())))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(batch.num_rows):
                texts = batch.column(1)[k].as_py()
                found = [[w.decode("utf-8", "surrogatepass") for w in sorted(terms(t))] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([no]), pa.array([[digest(t) for t in texts]], pa.list_(pa.string())), pa.array([found], pa.list_(pa.list_(pa.string())))], names=numbered_schema.fieldNames())
                no += 1

    held = rows.select("row", "texts").mapInArrow(split, numbered_schema).checkpoint()
    each = held.select("no", F.posexplode("terms").alias("of", "terms")).select("no", "of", F.explode("terms").alias("term"))
    known = each.join(lex, "term").groupBy("no").agg(F.collect_list(F.struct("of", "term")).alias("known"))
    schema = T.StructType([T.StructField("row", own), *(T.StructField(n, T.DoubleType() if k == pa.float64() else T.StringType()) for n, k in kinds.items())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wholes, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words: list[list[bytes]] = [[] for _ in wholes]
                for x in known or ():
                    words[x["of"]].append(x["term"].encode())
                out.append(report([marked(w, np.array([levels(x) for x in w], np.int8).T, d) for w, d in zip(map(sorted, words), wholes, strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds.values(), strict=True))], names=schema.fieldNames())

    return held.select("no", "row", "wholes").join(known, "no", "left").select("row", "wholes", "known").mapInArrow(join, schema)


def _in_order(docs: DataFrame, take: Callable, schema: str) -> DataFrame:
    """take(id, text, text of the next document) for each document, as rows of a schema."""
    names, types = zip(*(f.split(":") for f in schema.split(", ")), strict=True)
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a row waits for the next one
        for batch in slices(batches, "text"):
            out = []
            for i, t, at, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[2] == at:
                    out.append(take(held[0], held[1], t))
                held = None if tail else (i, t, at)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=list(names))

    return in_ranges(docs).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, types, strict=True)))


def edit_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    lex = lexicon(docs)
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    if isinstance(lex, DataFrame):
        rows = _in_order(docs, lambda i, t, after: (i, len(t), sha(edited(t, after)), [t, edited(t, after), after]), "doc_id:long, n_chars:long, edited_sha256:string, texts:array<string>")
        report = lambda m: (written(m[0]), written(m[1]), likeness(m[0], m[1]), likeness(m[0], m[2]))
        kinds = {"fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
        return _joined_marks(rows.select(F.struct("doc_id", "n_chars", "edited_sha256").alias("row"), "texts"), lex, report, kinds).select("row.*", *kinds)
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon(lex))
    last: list = [None, None]  # the text that came last as a next one, and its mark

    def take(i: int, t: str, after: str) -> tuple:
        lex = shared.value
        mark = last[1] if last[0] == t else lex.mark(t)
        last[:] = after, lex.mark(after)
        e = edited(t, after)
        changed = mark if e == t else lex.mark(e)
        return i, len(t), sha(e), written(mark), written(changed), likeness(mark, changed), likeness(mark, last[1])

    return _in_order(docs, take, "doc_id:long, n_chars:long, edited_sha256:string, fingerprint:string, edited_fingerprint:string, near_edited:double, near_next:double")


def oracle_sql() -> str:
    """The same report as DuckDB SQL."""
    none, width = f"'{_NONE}'", 4 * SEEDS
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(length(text), 0) AS n FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following,
  coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
e AS (SELECT *, left(text, n - n // 4) || CASE WHEN n < 4 THEN '' ELSE left(following, n // 4) END AS edited FROM o),
v AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
t AS (SELECT doc_id, kind, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))) AS term FROM v),
lex AS (SELECT term FROM t WHERE kind = 0 GROUP BY term
  HAVING count(*) >= {BAND[0]} * (SELECT count(*) FROM d) AND count(*) <= {BAND[1]} * (SELECT count(*) FROM d) AND count(*) > 1),
seeds AS (SELECT range AS seed FROM range({SEEDS})),
levels AS (SELECT unnest([{", ".join(map(str, range(len(LEVELS))))}]) AS level, unnest([{", ".join(str(1 << (52 - x)) for x in LEVELS)}]::BIGINT[]) AS most),
s AS (SELECT term, seed, level FROM (SELECT term, seed, ('0x' || substr(md5(seed::VARCHAR || ' ' || term), 1, 13))::BIGINT AS bits FROM lex, seeds) x JOIN levels ON bits < most),
inside AS (SELECT t.doc_id, t.kind, t.term FROM t JOIN lex ON t.term = lex.term),
whole AS (SELECT doc_id, kind, md5(string_agg(term, ' ' ORDER BY term)) AS h FROM inside GROUP BY doc_id, kind),
part AS (SELECT doc_id, kind, level, seed, substr(md5(string_agg(i.term, ' ' ORDER BY i.term)), 1, 4) AS h FROM inside i JOIN s ON i.term = s.term GROUP BY doc_id, kind, level, seed),
grid AS (SELECT doc_id, kind, level, seed FROM v, levels, seeds),
full_ AS (SELECT g.doc_id, g.kind, g.level, g.seed, coalesce(h, {none}) AS h FROM grid g LEFT JOIN part p ON g.doc_id = p.doc_id AND g.kind = p.kind AND g.level = p.level AND g.seed = p.seed),
marks AS (SELECT doc_id, kind, string_agg(h, '' ORDER BY level, seed) AS marks FROM full_ GROUP BY doc_id, kind),
f AS (SELECT v.doc_id, v.kind, substr(coalesce(w.h, md5(v.text)), 1, 16) || m.marks AS f FROM v JOIN marks m ON v.doc_id = m.doc_id AND v.kind = m.kind LEFT JOIN whole w ON v.doc_id = w.doc_id AND v.kind = w.kind),
pairs AS (SELECT e.doc_id, 0 AS what, a.f AS x, b.f AS y FROM e JOIN f a ON e.doc_id = a.doc_id AND a.kind = 0 JOIN f b ON e.doc_id = b.doc_id AND b.kind = 1
  UNION ALL SELECT e.doc_id, 1, a.f, b.f FROM e JOIN f a ON e.doc_id = a.doc_id AND a.kind = 0 JOIN f b ON e.next_id = b.doc_id AND b.kind = 0),
cells AS (SELECT doc_id, what, x, y, level, substr(x, 17 + {width} * level + 4 * seed, 4) AS p, substr(y, 17 + {width} * level + 4 * seed, 4) AS q FROM pairs, (SELECT level FROM levels) l, seeds),
sums AS (SELECT doc_id, what, level, left(any_value(x), 16) = left(any_value(y), 16) AS same,
  count(*) FILTER (WHERE p <> {none} OR q <> {none}) AS n_some, count(*) FILTER (WHERE p = q AND p <> {none}) AS n_equal FROM cells GROUP BY doc_id, what, level),
open_ AS (SELECT *, coalesce(min(CASE WHEN level > 0 AND 2 * n_some < {SEEDS} THEN level END) OVER (PARTITION BY doc_id, what), {len(LEVELS)}) AS stop FROM sums),
likes AS (SELECT doc_id, what, CASE WHEN same THEN 1.0::DOUBLE WHEN n_some = 0 THEN 0.0::DOUBLE ELSE n_equal::DOUBLE / n_some END AS likeness FROM open_ WHERE level = stop - 1)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint, p.likeness AS near_edited, q.likeness AS near_next
FROM e JOIN f a ON e.doc_id = a.doc_id AND a.kind = 0 JOIN f b ON e.doc_id = b.doc_id AND b.kind = 1
JOIN likes p ON e.doc_id = p.doc_id AND p.what = 0 JOIN likes q ON e.doc_id = q.doc_id AND q.what = 1
"""
