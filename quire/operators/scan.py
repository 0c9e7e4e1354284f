"""One look through a document's output for all strings that must not be there.

All byte forms of a document's covered strings go into one automaton (Aho-Corasick), which runs over the output once in each of
five readings: as it is, with digits of hexadecimal numbers in lower case, with white space collapsed, without any, and with the
escapes of literal strings undone. The time grows with the output and what is found in it, not with the number of strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as functions.strings.WHITE has it (a fixed value).
_WHITE = re.compile("[ \t\n\x0b\x0c\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_CONTINUED, _ESCAPED = re.compile(r"\\(?:\r\n|\r|\n)"), re.compile(r"\\(.)")
_WORD = re.compile(r"\w")
#: Shorter strings count as whole words and whole strings of a file only.
LEAST = 4
#: Byte forms that are reported by name.
FORMS = ("utf8", "utf16be", "utf16be-bom", "utf16le", "utf16le-bom", "latin1")
RAW, LOWER, COLLAPSED, TIGHT, UNESCAPED = range(5)


def _collapsed(text: str) -> str:
    return _WHITE.sub(" ", text).strip(" ")


def byte_forms(s: str) -> dict[str, bytes]:
    be, le = s.encode("utf-16-be", "surrogatepass"), s.encode("utf-16-le", "surrogatepass")
    out = {"utf8": s.encode("utf-8", "surrogatepass"), "utf16be": be, "utf16be-bom": b"\xfe\xff" + be, "utf16le": le, "utf16le-bom": b"\xff\xfe" + le}
    return out | ({"latin1": s.encode("latin-1")} if all(c <= "\xff" for c in s) else {})


def _needles(s: str) -> Iterator[tuple[bytes, int, str, bool]]:
    """(bytes, reading, what is found, only as a whole word)."""
    forms, flat = byte_forms(s), _collapsed(s)
    for name, b in forms.items():
        yield b, RAW, name, False
    yield flat.encode("utf-8", "surrogatepass"), COLLAPSED, "text", False
    if len(flat) >= LEAST:
        short = byte_forms(flat)
        for b in short.values():
            yield b, RAW, "recoverable", False
            yield b.hex().encode(), LOWER, "recoverable", False
        for name in ("utf8", "latin1"):
            if name in short:
                yield short[name], UNESCAPED, "recoverable", False
        yield short["utf8"], COLLAPSED, "recoverable", False
        yield flat.replace(" ", "").encode("utf-8", "surrogatepass"), TIGHT, "recoverable", False
    else:
        b = flat.encode("utf-8", "surrogatepass")
        for reading in (RAW, COLLAPSED):
            yield b, reading, "recoverable", True
        yield b"(" + b + b")", RAW, "recoverable", False
        for h in (b, byte_forms(flat)["utf16be-bom"]):
            yield b"<" + h.hex().encode() + b">", LOWER, "recoverable", False


def _alone(hay: str, start: int, end: int) -> bool:
    """Does a match (of UTF-8 shown as Latin-1) stand between characters that are no letters, digits or _?"""
    before, after = hay[max(0, start - 4) : start].encode("latin-1").decode("utf-8", "ignore"), hay[end : end + 4].encode("latin-1").decode("utf-8", "ignore")
    return not (before and _WORD.match(before[-1])) and not (after and _WORD.match(after[0]))


def found_in(strings: list[str], content: bytes, text: str) -> list[set[str]]:
    """What of each string is in a file's content and its text: names of byte forms, text (with white space collapsed) and recoverable."""
    out: list[set[str]] = [set() for _ in strings]
    keys: dict[str, list[tuple[int, int, str, bool]]] = {}
    for k, s in enumerate(strings):
        for needle, reading, what, word in _needles(s):
            if needle:
                keys.setdefault(needle.decode("latin-1"), []).append((k, reading, what, word))
            else:
                out[k].add(what)
    if not keys:
        return out
    automaton = ahocorasick.Automaton()
    for key, uses in keys.items():
        automaton.add_word(key, (len(key), uses))
    automaton.make_automaton()
    raw, plain = content.decode("latin-1"), _collapsed(text)
    shown = lambda t: t.encode("utf-8", "surrogatepass").decode("latin-1")
    hays = {RAW: raw, LOWER: raw.lower(), COLLAPSED: shown(plain), TIGHT: shown(_WHITE.sub("", text)), UNESCAPED: _ESCAPED.sub(r"\1", _CONTINUED.sub("", raw))}
    for reading, hay in hays.items():
        for end, (size, uses) in automaton.iter(hay):
            for k, where, what, word in uses:
                if where == reading and what not in out[k] and (not word or _alone(hay, end + 1 - size, end + 1)):
                    out[k].add(what)
    return out


def scanned(output: DataFrame, covered: DataFrame) -> DataFrame:
    """(doc_id, covered, readable, found) of each covered string (doc_id, covered); found lists what found_in says of it.

    output: (doc_id, text) and, if it has that column, content: the file's bytes, else those of the text. A document without output is
    looked through as an empty one; an unreadable one (null text or content) has readable = false."""
    content = F.col("content") if "content" in output.columns else F.encode("text", "UTF-8")
    there = output.select("doc_id", "text", content.alias("content"), F.lit(True).alias("there"))
    wanted = covered.where("covered IS NOT NULL").groupBy("doc_id").agg(F.collect_set("covered").alias("strings"))
    rows = wanted.join(there, "doc_id", "left").select("doc_id", "strings", "text", "content", "there")
    schema = T.StructType([covered.schema["doc_id"], T.StructField("covered", T.StringType()), T.StructField("readable", T.BooleanType()), T.StructField("found", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                strings, text, content, there = (batch.column(c)[k].as_py() for c in range(1, 5))
                readable = not there or text is not None and content is not None
                got = found_in(strings, content or b"", text or "") if readable else [set() for _ in strings]
                ids = batch.column(0).slice(k, 1).take(pa.array([0] * len(strings)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(strings), pa.array([readable] * len(strings)), pa.array([sorted(x) for x in got], pa.list_(pa.string()))], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
