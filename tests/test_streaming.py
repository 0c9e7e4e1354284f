import random

from pyspark.sql import functions as F

from quire.operators import model
from quire.operators.model import Model
from quire.schema import ACTIONS
from quire.sources import fixtures
from quire.streaming.replay import replay_stream


def streamed(spark, log, cuts, tmp_path, name):
    """The stream's last page lists, the log coming in parts of seq."""
    for low, high in zip([0, *cuts], [*cuts, 10**9], strict=True):
        log.where((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = replay_stream(spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log"))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    last = log.groupBy("doc_id").agg(F.max("seq").alias("as_of"))
    return sorted(map(tuple, spark.table(name).join(last, ["doc_id", "as_of"], "left_semi").drop("as_of").collect()))


def test_stream_ends_where_the_batch_ends(spark, tmp_path):
    log = fixtures.actions(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 4")).select(*ACTIONS.fieldNames()).cache()
    assert streamed(spark, log, [12], tmp_path, "replayed") == sorted(map(tuple, model.replay(log).collect()))


def random_log(doc, n, seed):
    """Edits of a document of ten pages, with long runs of undo and redo, past the depth that is kept."""
    rng = random.Random(seed)
    ids, out = [f"p{k}" for k in range(10)], [(doc, 1, "open", None, None, None, [f"p{k}" for k in range(10)], None)]
    seq = 1
    while seq < n:
        kind = rng.choice(["rotate", "flip", "reorder", "delete", "duplicate", "blank", "annAdd", "annDel", "undo", "redo", "setRots"])
        for _ in range(rng.randint(1, 120) if kind in ("undo", "redo") else 1):
            seq += 1
            target, other = rng.choice(ids), rng.choice(ids)
            if kind in ("duplicate", "blank"):
                ids.append(f"{target}+{seq}" if kind == "duplicate" else f"blank{seq}")
            out.append((doc, seq, kind, f"a{rng.randint(2, seq)}" if kind == "annDel" else target, other, rng.choice([90, 180, 1, 2]), [target, other], '{"x": 1, "text": "t"}' if kind == "annAdd" else None))
            ids = ids[-30:]
    return out


def whole(log, depth):
    """The same by whole copies of every state."""
    m, past, future = Model(), [], []
    for _, seq, kind, target, other, amount, ids, payload in log:
        if kind == "undo":
            if past:
                future.insert(0, m)
                m = past.pop()
        elif kind == "redo":
            if future:
                past.append(m)
                m = future.pop(0)
        else:
            new = Model(m.pages, m.anns).step(seq, kind, target, other, amount, ids, payload)
            if kind == "open":
                past, future = [], []
            elif new.past:  # something was done
                past, future = [*past, m][-depth:], []
            m = Model(new.pages, new.anns)
    return m


def test_differences_are_as_good_as_copies():
    for seed in range(20):
        log, m = random_log(1, 700, seed), Model()
        for k, (_, *step) in enumerate(log, 1):
            m = m.step(*step)
            assert len(m.past) <= model.DEPTH
            if k % 50 == 0 or k == len(log):
                assert (m.pages, m.anns) == (lambda w: (w.pages, w.anns))(whole(log[:k], model.DEPTH))


def test_undo_goes_back_as_far_as_is_kept():
    m = Model().step(1, "open", None, None, None, ["a"])
    for k in range(100):
        m = m.step(2 + k, "rotate", "a", None, 1, None)
    for k in range(200):
        m = m.step(200 + k, "undo", None, None, None, None)
    assert m.pages[0][1] == 20 and len(m.future) == 80
    for k in range(200):
        m = m.step(500 + k, "redo", None, None, None, None)
    assert m.pages[0][1] == 100


def test_long_logs(spark, tmp_path):
    rows = [r for doc in (1, 2) for r in random_log(doc, 3000, doc)] + random_log(3, 100_000, 3)
    log = spark.createDataFrame(rows, ACTIONS)
    want = sorted(map(tuple, model.replay(log).collect()))
    assert {r[0] for r in want} == {1, 2, 3}
    assert streamed(spark, log, [40, 41, 900, 2500], tmp_path, "long_logs") == want
