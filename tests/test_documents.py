"""Assertions on small literal tables."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.ranges import bad_part, order_list, parse_ranges, parse_rect
from quire.functions.strings import collapse, expand_tokens, half_up
from quire.operators import annots, diff, edit, grouping, leaks, pages, redact, scan, text
from quire.operators.model import Model
from quire.schema import LINES, OCR_WORDS, TEXT_ITEMS
from quire.sources import text_documents as src
from quire.sources.paths import resolve_within, split_name


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ranges(spark):
    n = F.lit(6)
    assert one(spark, parse_ranges(F.lit("1-3,5"), n)) == [0, 1, 2, 4]
    assert one(spark, parse_ranges(F.lit("3-1, 9-5, x, 2"), n)) == [0, 1, 2, 4, 5]
    assert one(spark, parse_ranges(F.lit(""), n)) == []
    assert one(spark, parse_ranges(F.lit(None).cast("string"), n)) == []
    assert one(spark, parse_ranges(F.lit("1-99999999999"), n)) == [0, 1, 2, 3, 4, 5]
    assert one(spark, order_list(F.lit("4-2,1,3"), n)) == [4, 3, 2, 1]
    assert one(spark, bad_part(F.lit("1,x,3"))) == "x"
    assert tuple(one(spark, parse_rect(F.lit("2:1,2.5,30,4")))) == (2, 1.0, 2.5, 30.0, 4.0)
    assert one(spark, parse_rect(F.lit("2:1,2"))) is None


def test_strings(spark):
    assert one(spark, half_up(F.lit(-2.5))) == -2
    assert one(spark, collapse(F.lit(" a  b \n"))) == "a b"
    assert one(spark, expand_tokens("{page}/{pages} {date} {title}", F.lit(2), F.lit(9), "2024-01-01", F.lit(None).cast("string"))) == "2/9 2024-01-01 "


def test_search(spark):
    d = docs(spark, "Alpha line one", "x\nBeta line two BETA", None, "")
    assert [(r.doc_id, r.page, r.line_no) for r in text.search_lines(d, "beta").collect()] == [(1, 1, 2)]
    assert text.search_lines(d, "bEta", case_sensitive=True).count() == 0
    assert [r.char_at for r in text.search_occurrences(d, "beta").collect()] == [0, 14]
    assert text.search_occurrences(d, "b").count() == 0
    with pytest.raises(ValueError):
        text.search_lines(d, "")


def test_occurrences_are_where_they_stand(spark):
    d = docs(spark, "\u0130\u0130 abc", "aXbx" * 3 + "xx", "the " * 40_000)
    assert [r.char_at for r in text.search_occurrences(d.where("doc_id = 0"), "abc").collect()] == [3]
    assert [r.char_at for r in text.search_occurrences(d.where("doc_id = 1"), "bX").collect()] == [2, 6, 10]
    many = text.search_occurrences(d.where("doc_id = 2"), "the")
    assert many.agg(F.count(F.lit(1)), F.max("char_at"), F.count_if(F.col("char_at") == (F.col("occurrence") - 1) * 4)).first()[:] == (40_000, 159_996, 40_000)


def test_snippet_is_cut(spark):
    hit = text.search_lines(docs(spark, "a" * 200), "a").first()
    assert len(hit.snippet) == 160 and hit.snippet.endswith("...")


def test_page_algebra(spark):
    rows = spark.createDataFrame([(1, p, 0, 600.0, 800.0) for p in (1, 2, 3)], "doc_id bigint, page bigint, rot int, w double, h double")
    assert [(r.part_no, r.page) for r in pages.split(rows, ["1-2", "3"]).orderBy("part_no", "out_page").collect()] == [(1, 1), (1, 2), (2, 3)]
    assert [r.page for r in pages.delete(rows, "2").orderBy("pos").collect()] == [1, 3]
    assert [r.page for r in pages.arrange(rows, "", "3,1").orderBy("pos").collect()] == [3, 1, 2]
    assert [r.page for r in pages.arrange(rows, "3", "3,2,2").orderBy("pos").collect()] == [2, 1]
    assert [r.rot for r in pages.rotate(rows, -90, "2").orderBy("page").collect()] == [0, 270, 0]
    with pytest.raises(ValueError):
        pages.rotate(rows, 45)
    turned = rows
    for _ in range(4):
        turned = pages.rotate(turned, 90)
    assert [r.rot for r in turned.collect()] == [0, 0, 0]


def test_edit(spark):
    d = docs(spark, "foo bar\nfoo baz foo", "delete me\nkeep me", "none", None)
    first = {r.doc_id: r.text for r in edit.replacements(d, "FOO", "x$1").collect()}
    assert first == {0: "x$1 bar\nfoo baz foo"}
    every = edit.replacements(d, "foo", "x", every=True).first()
    assert (every.text, every.replaced) == ("x bar\nx baz x", 2)
    assert edit.replacements(d, "delete ", "").first().text == "me\nkeep me"
    assert {r.doc_id: r.text for r in edit.apply(d, "foo", "x").collect()}[2] == "none"
    assert edit.splice("abcdef", [(0, 2, "X"), (1, 3, "Y"), (4, 5, "")]) == ("Xcdf", 2)
    assert edit.splice("ab", [(0, 0, "x"), (1, 5, "no"), (2, 1, "no"), (2, 2, "y")]) == ("xaby", 2)


def test_redaction(spark):
    d = docs(spark, "public info\nsecret password hunter2\nmore public", "nothing here")
    lines = src.lines(d)
    marked = redact.find_or_rects(lines, "secret", [])
    assert [r.text for r in redact.redacted_pages(marked).orderBy("doc_id").collect()] == ["public info\nmore public", "nothing here"]
    report = {r.doc_id: r for r in redact.covered_report(marked).collect()}
    assert (report[0].exit_code, report[0]["pass"], report[1].exit_code) == (0, True, 2)
    # The first line's band is 746.5 to 761.9: a rectangle over its upper half only touches it.
    partial = redact.coverage(lines, [(1, 0.0, 755.0, 999.0, 20.0)])
    assert {r.doc_id: r.exit_code for r in redact.covered_report(partial).collect()} == {0: 3, 1: 3}
    assert {r.exit_code for r in redact.covered_report(partial, on_partial="leave").collect()} == {2}
    assert redact.redacted_pages(partial, redact.covered_report(partial)).count() == 0
    with pytest.raises(ValueError):
        redact.coverage(lines, [(1, 0.0, 0.0, -1.0, 5.0)])


def test_verifier_catches_planted_leaks(spark):
    covered = spark.createDataFrame([(0, "hunter2"), (1, "hunter2"), (2, "hunter2"), (3, "h 2"), (4, "gone")], "doc_id bigint, covered string")
    out = docs(spark, "still hunter2", "gone", None, "h\n2")
    got = {r.doc_id: r for r in redact.verify(out, covered).collect()}
    assert got[0].utf8 and got[0].present_in_extraction
    assert not got[1].present_in_bytes and not got[1].present_in_extraction
    assert got[2].present_in_bytes and got[2].present_in_extraction  # unreadable output is no proof
    assert not got[3].present_in_bytes and got[3].present_in_extraction
    assert not got[4].present_in_bytes  # no output at all
    verdict = redact.verification(redact.verify(out, covered))
    report = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 0), (5, 2), (6, 3), (7, 0)], "doc_id bigint, exit_code int")
    more = out.unionByName(spark.createDataFrame([(5, "a"), (6, "b"), (7, "c"), (8, "d")], out.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")).select(out.columns))
    # 6 was refused, 7 has no verdict, 8 no report.
    assert {r.doc_id for r in redact.gate(more, verdict, report).collect()} == {1, 5}


def test_recoverable_strings(spark):
    covered = spark.createDataFrame([(k, "hunter2") for k in range(6)] + [(6, "ab"), (7, "ab"), (8, "ab"), (9, "se cret")], "doc_id bigint, covered string")
    texts = ["hun ter2", "68756E74657232", "h\\unter2", "gone", None, "hunter2", "cab abc", "x ab.", "(ab)", "se  cret"]
    got = {r.doc_id: r.recoverable for r in redact.recoverable(docs(spark, *texts), covered).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True, 8: True, 9: True}


def test_strings_with_pattern_signs_are_found(spark):
    signs = ["\\E[", "a.*b(", "$1 \\Q x", "(paren)", "x\\y z", "[a-z]+", "\\E"]
    covered = spark.createDataFrame([(k, s) for k, s in enumerate(signs)] + [(100 + k, s) for k, s in enumerate(signs)], "doc_id bigint, covered string")
    out = spark.createDataFrame([(k, f"so {s} it is") for k, s in enumerate(signs)] + [(100 + k, "nothing") for k in range(len(signs))], "doc_id bigint, text string")
    assert {r.doc_id: r.recoverable for r in redact.recoverable(out, covered).collect()} == {k: k < 100 for k in (*range(7), *range(100, 107))}
    assert {r.doc_id: r.utf8 for r in redact.verify(out, covered).collect()} == {k: k < 100 for k in (*range(7), *range(100, 107))}


def test_byte_forms_are_found():
    s = "Zürich 12"
    for content, found in (
        (s.encode(), {"utf8", "recoverable"}), (s.encode("utf-16-be"), {"utf16be", "recoverable"}), (b"\xfe\xff" + s.encode("utf-16-be"), {"utf16be", "utf16be-bom", "recoverable"}),
        (b"\xff\xfe" + s.encode("utf-16-le"), {"utf16le", "utf16le-bom", "recoverable"}), (s.encode("latin-1"), {"latin1", "recoverable"}), (s.encode("latin-1").hex().upper().encode(), {"recoverable"}),
        (s.encode("utf-16-le").hex().encode(), {"recoverable"}), ("\\Z\\ürich\\\n 1\\2".encode("latin-1"), {"recoverable"}), (b"Zurich 12", set()),
    ):
        got = scan.found_in([s, "other"], content, "")
        assert got[0] - {"utf16be", "utf16le"} == found - {"utf16be", "utf16le"} and found <= got[0] and not got[1]
    assert scan.found_in([s], b"", "at Z ü r i c h 1 2")[0] == {"recoverable"}
    assert scan.found_in([s], b"", "Zürich \n 12")[0] == {"text", "recoverable"}
    # Short strings: whole words and whole strings of a file only.
    for content, is_there in ((b"an ok,", True), ("äokä".encode(), False), (b"tokyo", False), (b"(ok)", True), (b"<6F6b>", True), (b"<feff006f006b>", True), (b"6f6b", False)):
        assert ("recoverable" in scan.found_in(["ok"], content, "")[0]) == is_there, content


def test_many_strings_in_one_pass():
    strings = [f"secret number {k}" for k in range(5000)]
    got = scan.found_in(strings, b"secret number 42 and more " * 20_000, "")
    assert sum("recoverable" in g for g in got) == 2  # 4 and 42


def test_redaction_fails_closed(spark):
    lines = spark.createDataFrame([(0, 1, 1, "a", None, 700.0, 50.0, 14.0), (0, 1, 2, "b", 50.0, 600.0, 50.0, 14.0), (0, 2, 1, "c", 50.0, 700.0, 50.0, 14.0)], LINES)
    rects = spark.createDataFrame([(0, 1, 40.0, 690.0, 100.0, 30.0)], "doc_id bigint, page bigint, rx double, ry double, rw double, rh double")
    assert {(r.page, r.line_no): r.coverage for r in redact.coverage_by(lines, rects).collect()} == {(1, 1): "full", (1, 2): "none", (2, 1): "none"}
    marked = redact.coverage(lines, [(2, 40.0, 690.0, 100.0, 30.0)])
    assert {r.page: r.text for r in redact.redacted_pages(marked).collect()} == {1: "a\nb", 2: ""}


def items(spark, rows):
    return spark.createDataFrame([(1, 1, k, t, float(x), float(y), float(w), 12.0) for k, (t, x, y, w) in enumerate(rows)], TEXT_ITEMS)


def test_table_cells(spark):
    table = [(t, x, 700 - 20 * r, w) for r in range(4) for t, x, w in (("Design system", 50, 80), (str(r), 400, 8), ("$10", 460, 25))]
    got = {r.text: r for r in grouping.table_cells(items(spark, table)).collect()}
    assert not got["Design system"].cell
    assert got["1"].cell and got["1"].gap_before > 200


def test_wide_run_is_cut_at_a_column(spark):
    rows = [i for r in range(3) for i in (("Invoice #42  1", 50, 700 - 20 * r, 330), ("Qty", 330, 700 - 20 * r, 40))]
    got = [r.text for r in grouping.table_cells(items(spark, [*rows, ("plain prose line", 50, 600, 120)])).collect()]
    assert got.count("Invoice #42") == 3 and got.count("1") == 3 and got.count("Qty") == 3 and got.count("plain prose line") == 1


def test_prose_stays_one_line(spark):
    got = grouping.table_cells(items(spark, [i for r in range(4) for i in (("left", 50, 700 - 20 * r, 30), ("right", 82, 700 - 20 * r, 30))])).collect()
    assert len(got) == 4 and not any(r.cell for r in got)


def test_baselines(spark):
    got = grouping.baseline_lines(items(spark, [("b", 60, 700, 5), ("a", 50, 701.5, 5), ("c", 50, 680, 5)])).orderBy("line_no").collect()
    assert [(r.text, r.y) for r in got] == [("ab", 700.0), ("c", 680.0)]


def test_ocr_lines(spark):
    words = [("over", 10, 50, 103, 112, 90), ("the", 56, 80, 100, 112, 90), ("dog", 86, 110, 100, 114, 90), ("don", 10, 40, 200, 212, 80), ("'t", 40.5, 50, 200, 212, 80), ("junk", 10, 40, 300, 312, 10)]
    rows = spark.createDataFrame([(1, 1, k, t, float(a), float(b), float(c), float(d), float(e)) for k, (t, a, b, c, d, e) in enumerate(words)], OCR_WORDS)
    assert [r.text for r in grouping.ocr_lines(rows).orderBy("line_no").collect()] == ["over the dog", "don't"]


def test_diff(spark):
    pairs = spark.createDataFrame([(1, 2, "pay\ntotal: $10\nbye", "pay\ntotal: $12\nbye\nnew footer")], "left_doc bigint, right_doc bigint, a string, b string")
    rows = diff.diff(pairs)
    s = diff.summary(rows).first()
    assert (s.added, s.removed, s.same) == (2, 1, 2)
    assert [r.op for r in rows.orderBy("seq").collect()] == ["same", "del", "add", "same", "add"]
    assert diff.diff(pairs, only_changes=True).count() == 3


def by_table(a, b):
    """The walk over the whole table: equal lines go together, else a deletion comes first where it does as well."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("same", i, j))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or table[i + 1][j] >= table[i][j + 1]):
            out.append(("del", i, None))
            i += 1
        else:
            out.append(("add", None, j))
            j += 1
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcdex"), max_size=14), st.lists(st.sampled_from("abcdfy"), max_size=14))
def test_diff_is_a_longest_alignment(a, b):
    want = by_table(a, b)
    for most in (None, -1, 10**6, 3):
        assert diff.align(a, b, most) == want


def test_diff_of_long_texts():
    rng = random.Random(1)
    a = [f"line {rng.randrange(50_000)}" for _ in range(200_000)]
    b = list(a)
    for k in range(300):
        at = rng.randrange(len(b))
        b[at : at + rng.randrange(3)] = [f"line {rng.randrange(50_000)}"] * rng.randrange(3)
    rows = diff.align(a, b)
    assert [a[i] for op, i, _ in rows if op != "add"] == a and [b[j] for op, _, j in rows if op != "del"] == b
    assert sum(op == "same" for op, *_ in rows) > 199_000
    small, other = a[:700], [x for k, x in enumerate(a[:700]) if k % 5] + a[5000:5100]
    assert diff.align(small, other) == diff.align(small, other, -1) == by_table(small, other)
    assert len(diff.align([f"a{k}" for k in range(100_000)], [f"b{k}" for k in range(100_000)])) == 200_000


def test_versions_of_a_hot_line_are_dealt_out(spark):
    d = spark.range(0, 400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("hot\n"), F.col("id").cast("string"), F.lit("\nend"))).otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    rows = diff.compare(d)
    got = {(r.left_doc, r.right_doc, r.op, r.left_line, r.right_line) for r in rows.collect()}
    pairs = diff.versions(d).join(d.select(F.col("doc_id").alias("left_doc"), F.col("text").alias("a")), "left_doc").join(d.select(F.col("doc_id").alias("right_doc"), F.col("text").alias("b")), "right_doc")
    assert got == {(r.left_doc, r.right_doc, r.op, r.left_line, r.right_line) for r in diff.diff(pairs).collect()} and len(got) == 299 * 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.0")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    try:
        found = diff.versions(d.repartition(8))
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.skewJoin.skewedPartitionThresholdInBytes", "adaptive.skewJoin.skewedPartitionFactor", "adaptive.advisoryPartitionSizeInBytes"):
            spark.conf.unset(f"spark.sql.{name}")


def test_viewport_and_inverse(spark):
    lit = lambda v: F.lit(float(v))
    for rot in (0, 90, 180, 270, -90):
        m, w, h = g.viewport(lit(10), lit(20), lit(600), lit(800), 2.0, F.lit(rot))
        x, y = g.apply(m, lit(100), lit(300))
        back = g.apply(g.invert(m), x, y)
        got = spark.range(1).select(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), back[0].alias("bx"), back[1].alias("by")).first()
        assert 0 <= got.x <= got.w and 0 <= got.y <= got.h
        assert math.isclose(got.bx, 100) and math.isclose(got.by, 300)


def test_coverage_of_runs(spark):
    lit = lambda v: F.lit(float(v))

    def span(dx, dy, box):
        return one(spark, g.covered(F.lit("SECRET VALUE"), lit(100), lit(200), lit(dx), lit(dy), lit(12), *map(lit, box)))

    assert (span(120, 0, (90, 190, 200, 40)).start, span(120, 0, (90, 190, 200, 40)).end) == (0, 12)
    assert (span(120, 0, (100, 190, 60, 40)).start, span(120, 0, (100, 190, 60, 40)).end) == (0, 6)
    assert span(120, 0, (400, 190, 60, 40)) is None
    assert span(0, 120, (80, 190, 40, 200)).end == 12
    assert span(-120, 0, (-50, 180, 200, 40)).frac == 1.0


def test_boxes():
    import numpy as np

    p = np.full((300, 400, 4), 255, np.uint8)
    p[60:80, 50:170, :3] = 0
    p[100:200:4, 300:380, :3] = 0  # strokes
    p[250:254, 10:14, :3] = 0  # a speck
    assert leaks.boxes_of(400, 300, p.tobytes()) == [(50, 60, 120, 20, 1.0)]
    p[:, :, :3] = 0
    assert leaks.boxes_of(400, 300, p.tobytes()) == []
    ring = np.full((40, 40, 4), 255, np.uint8)
    ring[5:35, 5:35, :3] = 0
    ring[10:30, 10:30, :3] = 255
    assert len(leaks._regions((ring[..., 0] == 0))) == 1


def test_model():
    m = Model().step(1, "open", None, None, None, ["a", "b", "c"])
    moved = m.step(2, "reorder", "a", "c", None, None)
    assert [p[0] for p in moved.pages] == ["b", "c", "a"]
    assert m.step(2, "reorder", "a", "a", None, None) is m
    assert moved.step(3, "undo", None, None, None, None).pages == m.pages
    assert moved.step(3, "undo", None, None, None, None).step(4, "redo", None, None, None, None).pages == moved.pages
    assert [p[0] for p in m.step(2, "blank", "a", None, None, None).pages] == ["a", "blank2", "b", "c"]
    assert [p[0] for p in m.step(2, "duplicate", "b", None, None, None).pages] == ["a", "b", "b+2", "c"]
    assert m.step(2, "rotate", "a", None, 270, None).step(3, "rotate", "a", None, 90, None).pages[0][1] == 0
    for k in range(100):
        m = m.step(k, "rotate", "a", None, 90, None)
    assert len(m.past) == 80


def test_model_annotations():
    m = Model().step(1, "open", None, None, None, ["a", "b"]).step(2, "annAdd", "a", None, None, None, '{"x": 10, "y": 20, "w": 30, "text": "t"}')
    assert m.anns[0] == {"ann_id": "a2", "page_id": "a", "x": 10, "y": 20, "w": 30, "text": "t"}
    assert m.step(3, "flip", "a", None, 3, None).anns[0] | {"x": 560.0, "y": 780.0} == m.step(3, "flip", "a", None, 3, None).anns[0]
    assert m.step(3, "flip", "b", None, 1, None).anns == m.anns and m.step(3, "flip", "none", None, 1, None).anns == m.anns
    gone = m.step(3, "delete", "a", None, None, None)
    assert not gone.anns and gone.step(4, "undo", None, None, None, None).anns == m.anns
    assert m.step(3, "annUpd", "a2", None, None, None, '{"text": "u"}').anns[0]["text"] == "u"
    assert not m.step(3, "annDel", "a2", None, None, None).anns
    assert m.step(3, "unknown", "a", None, None, None) is m


def test_unique_names_and_values(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "doc_id bigint, seq bigint, name string")
    assert [r.name for r in annots.unique_names(rows).orderBy("seq").collect()] == ["a", "a_2", "b"]


def test_paths(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").symlink_to("/")
    assert resolve_within(str(tmp_path), "in/x.pdf").endswith("in/x.pdf")
    for bad in ("../x", "/etc/passwd", "out/etc/passwd", "a\0b"):
        with pytest.raises(ValueError):
            resolve_within(str(tmp_path), bad)
    assert split_name("p-%d-%s.pdf", 2, "1-3,5") == "p-2-1-3_5.pdf"
