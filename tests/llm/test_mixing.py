from oracle import assert_same
from pyspark.sql import functions as F

from quire.llm import mixing
from quire.llm.queries import ORACLE_SQL, QUERIES


def poured(sizes, weights=(1, 2, 3), most=3):
    """Targets by pouring what is left over again and again."""
    total, free, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    left = total
    while True:
        share = {k: left * w[k] / sum(w[j] for j in free) for k in free}
        full = {k for k in free if share[k] > most * sizes[k]}
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        free -= full
        if not full:
            return [out[k] if k not in free else share[k] for k in range(len(sizes))]


def test_targets(spark):
    for sizes in ([100, 10, 1], [5, 5, 5, 5, 1000], [1, 1, 1], [0, 10, 20]):
        df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
        got = [r.target for r in mixing.targets(df).orderBy("source").collect()]
        assert all(abs(a - b) < 1e-6 for a, b in zip(got, poured(sizes), strict=True)), (sizes, got)


def test_rows(spark):
    rows = [(k, "a" if k % 3 else None, "w " * (k % 50 + 1)) for k in range(3000)] + [(None, "b", None), (5, "b", ""), (5, "b", ""), (1, "c", "x " * 20000), (7, "a", "x"), (7, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    first = mixing.taken(df).collect()
    assert sorted(map(str, first)) == sorted(map(str, mixing.taken(df.repartition(7)).collect()))
    assert len(first) == len(rows)
    for r in first:
        assert r.taken <= 3 * r.size
    by = {}
    for r in first:
        key = (r.source_size, r.target)
        by.setdefault(key, [0, 0])[0] += r.taken
        by[key][1] = max(by[key][1], r.size)
    for (_, target), (taken, largest) in by.items():
        assert abs(taken - target) <= 2 * largest + 1
    mixed = mixing.sample(df.withColumn("extra", F.lit(1)))
    assert mixed.columns == ["doc_id", "source", "text", "extra"]
    assert mixed.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(r.taken for r in first)
    assert mixing.taken(df.limit(0)).count() == 0
    # Names that the mix uses itself.
    odd = df.withColumns({c: F.lit(f"{c}!") for c in ("_size", "_row", "_start", "_copies", "_src", "_doc", "_salt", "a.b")})
    again = mixing.sample(odd)
    assert again.columns == odd.columns and again.where("_row = '_row!' AND _doc = '_doc!' AND _size = '_size!'").count() == mixed.count()


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(QUERIES["op4_source_mix"](spark, sf), ORACLE_SQL["op4_source_mix"], sf)


def test_thousands_of_sources(spark):
    df = spark.range(0, 12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4000).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"))
    got = mixing.taken(df)
    total = got.agg(F.sum("size"), F.sum("taken"), F.count_if(F.col("taken") > 3 * F.col("size"))).first()
    assert got.count() == 12_000 and total[2] == 0 and abs(total[1] - total[0]) < 0.1 * total[0]
