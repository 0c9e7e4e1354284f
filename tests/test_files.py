from pyspark.sql import functions as F

from quire.sources import files


def test_rejects(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7\n...", "b.pdf": b"%PD", "c.pdf": b"GIF89a......."}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path[-5:]: r for r in files.pdf_files(spark, str(tmp_path)).collect()}
    assert got["a.pdf"].reject_reason is None and bytes(got["a.pdf"].content).startswith(b"%PDF-")
    assert (got["b.pdf"].reject_reason, got["c.pdf"].reject_reason, got["c.pdf"].content) == ("too short", "no PDF header", None)
    assert spark.range(1).select(files.reject_reason(F.lit(None).cast("binary"), F.lit(9))).first()[0] == "too short"


def test_sizes(spark):
    w, h = files.fit_page(F.lit(4000.0), F.lit(1000.0))
    side, quality = files.clamp_compression(F.lit(99.6), F.lit(2.0))
    assert tuple(spark.range(1).select(w, h, side, quality).first()) == (2000.0, 500.0, 400, 0.95)


def test_session_round_trip(spark):
    df = spark.createDataFrame([(1, "n", [(1, 90, 2)], "é\n")], "doc_id bigint, name string, pages array<struct<page:bigint,rot:int,flip:int>>, text string")
    assert files.restore_session(files.session_json(df)).collect() == df.select("doc_id", "name", "pages", "text").collect()
    assert files.restore_session(spark.createDataFrame([(2, "{")], "doc_id bigint, session string")).first().name is None
