import numpy as np

from parcela.operators.diagnostics import acceptance_ratios
from parcela.streaming import chains as stream_chains
from parcela.streaming import diagnostics as D

from .test_grid import local


def test_windowed_acceptance_matches_batch(spark, tmp_path):
    rows = [(0, i, "two_tree" if i % 3 else "one_tree", (i % 7) / 4) for i in range(500)]
    log = spark.createDataFrame(rows, D.LOG)
    for k in range(4):
        log.filter(f"step % 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log.filter("step < 50").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))  # a replay
    q = D.windowed_acceptance(D.read_log(spark, str(tmp_path / "log"), 2), 100).writeStream.format("memory").queryName("acc").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window, r.proposal): (r.proposals, round(r.acceptance, 9)) for r in spark.table("acc").collect()}
    want = {(r.window, r.proposal): (r.proposals, round(r.acceptance, 9)) for r in acceptance_ratios(log, 100).collect()}
    assert got == want


def test_streamed_chain_keeps_its_state(spark, tmp_path):
    ticks = spark.createDataFrame([(0, 30), (1, 30)], "chain_id long, steps int")
    for k in range(3):
        ticks.coalesce(1).write.parquet(str(tmp_path / f"t/{k}"))
    stream = spark.readStream.schema("chain_id long, steps int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "t"))
    q = stream_chains.run(stream, local(), 4, 4, 4, {"two_tree": 0.5, "one_tree": 0.5}).writeStream.format("memory").queryName("walk").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("walk").collect()
    assert sorted((r.chain_id, r.step) for r in rows) == [(c, s) for c in (0, 1) for s in (30, 60, 90)]
    for r in rows:
        assert sorted(np.bincount(r.districts)[1:]) == [4, 4, 4, 4] and r.proposals > 0
