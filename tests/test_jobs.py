"""The jobs over copies of small tables: against plain Python, run again, over growing input, and from the command line."""

import logging
import re
import subprocess
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import pandas as pd
import pytest

from jobs import common, corpus_graph, ensemble_report
from parcela.sources import ensemble
from parcela.sources import tables as S

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, folder, name, rows):
    """A file of the table ``documents`` in ``folder``."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = folder / f"_{name}"
    df.coalesce(1).write.parquet(str(made))
    (folder / "documents.parquet").mkdir(exist_ok=True)
    next(made.glob("part-*.parquet")).rename(folder / "documents.parquet" / f"{name}.parquet")


def plain_graph(rows, min_chars=20):
    units, held = Counter(), {}
    for _, text, lang, source, _ in rows:
        u = f"{lang or 'none'}/{source or 'none'}"
        for name in (u, lang or "none"):
            units[name, "documents"] += 1
            units[name, "characters"] += len(text or "")
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= min_chars:
                held.setdefault(key, set()).add(u)
    edges = Counter()
    for us in held.values():
        for a, b in combinations(sorted(us), 2):
            edges[a, b] += 1
            la, lb = a.split("/")[0], b.split("/")[0]
            if la != lb:
                edges[min(la, lb), max(la, lb)] += 1
    return {k: n for k, n in units.items()}, dict(edges)


def graph_of(df):
    units, edges = {}, {}
    for r in df.collect():
        assert r.level == 1 + ("/" in r.unit_a)
        if r.kind == "node":
            units[r.unit_a, "documents"], units[r.unit_a, "characters"] = r.documents, r.characters
        else:
            edges[r.unit_a, r.unit_b] = r.lines
    return units, edges


A, B, C = "a line that several sources hold", "Another LINE, with capitals and ünïcode", "one more line of enough characters"
FIRST = [
    (1, f"{A}\nshort\n{B}", "en", "s1", 0), (2, f"  {A.upper()} \n{C}", "en", "s2", 0), (3, f"{B}\n{B}\n{B}", "de", "s1", 0), (4, None, None, "s1", 0), (5, "", "fr", None, 0),
    (6, A, "en", "s1", 0),
]
SECOND = [(7, f"{C}\n{A}", "de", "s1", 0), (8, f"{C}\r\n{B}\t", "en", "s3", 0), (9, f"{A}\n{B}\n{C}", None, None, 0), (1, f"{A}\nshort\n{B}", "en", "s1", 0)]


def test_corpus_graph_over_growing_input(spark, tmp_path, caplog):
    """Two runs over growing input equal one over all of it; each reads only what is new; a third changes nothing."""
    caplog.set_level(logging.INFO, "jobs")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    docs(spark, tmp_path, "first", FIRST)
    assert graph_of(corpus_graph.run(spark, str(tmp_path), out, mark)) == plain_graph(FIRST)
    docs(spark, tmp_path, "second", SECOND)
    caplog.clear()
    whole = graph_of(corpus_graph.run(spark, str(tmp_path), out, mark))
    assert whole == plain_graph(FIRST + SECOND)
    assert [int(n) for n in re.findall(r"read (\d+) documents", caplog.text)] == [len(SECOND)]
    caplog.clear()
    again = corpus_graph.run(spark, str(tmp_path), out, mark)
    assert graph_of(again) == whole and "documents" not in re.sub(r"documents\.parquet", "", caplog.text)
    assert "graph has" in caplog.text and again.count() == len({k for k, _ in whole[0]}) + len(whole[1])
    once = corpus_graph.run(spark, str(tmp_path), str(tmp_path / "once"), str(tmp_path / "once_mark"), corpus_graph.Settings(files_per_trigger=1))
    assert graph_of(once) == whole


def test_corpus_graph_goes_on_after_a_batch_that_failed(spark, tmp_path, monkeypatch):
    """Increments that a failed attempt left are replaced when the batch is taken again."""
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    docs(spark, tmp_path, "first", FIRST)
    corpus_graph.run(spark, str(tmp_path), out, mark)
    docs(spark, tmp_path, "second", SECOND)
    good = corpus_graph.added_edges
    monkeypatch.setattr(corpus_graph, "added_edges", lambda *_: 1 / 0)  # units and keys of the batch are written by then
    with pytest.raises(Exception, match="ZeroDivisionError"):
        corpus_graph.run(spark, str(tmp_path), out, mark)
    assert spark.read.parquet(f"{out}/keys").filter("batch = 1").count()
    monkeypatch.setattr(corpus_graph, "added_edges", good)
    assert graph_of(corpus_graph.run(spark, str(tmp_path), out, mark)) == plain_graph(FIRST + SECOND)


def test_corpus_graph_with_other_settings_and_nothing_to_read(spark, tmp_path):
    docs(spark, tmp_path, "first", FIRST[:0])
    assert corpus_graph.run(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "mark")).count() == 0
    docs(spark, tmp_path, "more", FIRST)
    got = corpus_graph.run(spark, str(tmp_path), str(tmp_path / "out2"), str(tmp_path / "mark2"), corpus_graph.Settings(min_chars=5))
    assert graph_of(got) == plain_graph(FIRST, 5)


def test_corpus_graph_is_a_graph_of_the_library(spark, tmp_path):
    """Sources as districts: shared lines between languages are the cut edges."""
    from pyspark.sql import functions as F

    from parcela.operators import observables as O

    docs(spark, tmp_path, "all", FIRST + SECOND)
    g = corpus_graph.run(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "mark")).filter("level = 2")
    edges = g.filter("kind = 'edge'").select(F.col("unit_a").alias("src"), F.col("unit_b").alias("dst"), F.col("lines").alias("connections"))
    plan = g.filter("kind = 'node'").select(F.lit(0).alias("plan_id"), F.col("unit_a").alias("node"), F.element_at(F.split("unit_a", "/"), 1).alias("district"))
    want = sum(n for (a, b), n in plain_graph(FIRST + SECOND)[1].items() if "/" in a and a.split("/")[0] != b.split("/")[0])
    assert O.cut_edges(edges, plan).first().cut_edges == want > 0


# ---------------------------------------------------------------- the report


def reported(df) -> pd.DataFrame:
    return df.toPandas().sort_values(["measure", "plan_id", "district", "election"]).reset_index(drop=True)


def test_ensemble_report_again_and_in_part(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    whole = reported(ensemble_report.run(spark, SF, str(tmp_path)))
    assert re.search(r"read 150 rows of customer", caplog.text) and "rows of cut_edges" in caplog.text
    assert set(whole.measure) == set(ensemble_report.MEASURES)
    again = reported(ensemble_report.run(spark, SF, str(tmp_path)))
    pd.testing.assert_frame_equal(whole, again)
    # a run over one measure leaves the partitions of the others
    part = reported(ensemble_report.run(spark, SF, str(tmp_path), ensemble_report.Settings(measures=["balanced"], tolerance=1000.0)))
    assert (part[part.measure == "balanced"].value == 1).all()
    pd.testing.assert_frame_equal(part[part.measure != "balanced"].reset_index(drop=True), whole[whole.measure != "balanced"].reset_index(drop=True))
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")) == before


def test_ensemble_report_over_an_ensemble_file(spark, tmp_path):
    """Maps of a file give what the same plans give."""
    from pyspark.sql import functions as F

    g = S.customer_lattice(spark, SF)
    plans = S.customer_plans(g.nodes, 2)
    writer = ensemble.Writer(spark, str(tmp_path / "maps"), ensemble.Header(2, 0, 1))
    writer.output(ensemble.node_map(plans).withColumn("step", F.col("plan_id")))
    s = ensemble_report.Settings(measures=["cut_edges", "population", "seats"], ensemble=str(tmp_path / "maps"))
    got = reported(ensemble_report.run(spark, SF, str(tmp_path / "a"), s)).assign(plan_id=lambda d: d.plan_id.str.removeprefix("step"))
    want = reported(ensemble_report.run(spark, SF, str(tmp_path / "b"), ensemble_report.Settings(measures=s.measures)))
    pd.testing.assert_frame_equal(got, want[want.plan_id.isin(["0", "1"])].reset_index(drop=True))


def test_settings(tmp_path):
    assert common.settings(ensemble_report.Settings, str(ROOT / "jobs/ensemble_report.toml")) == ensemble_report.Settings()
    assert common.settings(corpus_graph.Settings, str(ROOT / "jobs/corpus_graph.toml")) == corpus_graph.Settings()
    (tmp_path / "x.toml").write_text("tolerence = 1")
    with pytest.raises(ValueError, match="tolerence"):
        common.settings(ensemble_report.Settings, str(tmp_path / "x.toml"))
    with pytest.raises(ValueError, match="perimeter"):
        ensemble_report.Settings(measures=["perimeter"])


@pytest.mark.parametrize("job", ["ensemble_report", "corpus_graph"])
def test_command_line(spark, tmp_path, job):
    """A process of its own makes and stops its session; a second one finds what the first has kept."""
    more = ["--checkpoint", str(tmp_path / "mark")] if job == "corpus_graph" else []
    args = [sys.executable, "-m", f"jobs.{job}", "--tables", SF, "--output", str(tmp_path / "out"), "--config", str(ROOT / f"jobs/{job}.toml"), *more]
    logs = [subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=300, check=True).stderr for _ in range(2)]
    assert all("has" in x and "rows of" in x for x in logs)
    if job == "corpus_graph":
        assert re.search(r"batch 0: read 200 documents", logs[0]) and "batch" not in re.sub(r"batch(es)?=|micro-?batch", "", logs[1].split("jobs.corpus_graph")[-1])
        assert spark.read.parquet(str(tmp_path / "out/graph")).filter("kind = 'node' AND level = 2").agg({"documents": "sum"}).first()[0] == 200


def test_jobs_do_without_the_corpus_operators():
    for p in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        assert not re.search(r"(from|import) +(parcela\.llm|corpus_pipeline)", p.read_text()), p
