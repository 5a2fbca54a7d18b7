"""The pipeline, stage by stage, against plain code on a small table; and the corpus operators' absence."""

import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from parcela.llm import mixing, tokens, toxicity

from . import data
from .test_operators import toxic_corpus

ROOT = Path(__file__).resolve().parent.parent.parent


def test_stages(spark, tmp_path):
    toxic, labels = toxic_corpus(600)
    rows = [(1000 + i, t, lang, "big") for i, t, lang, _ in toxic] + [r for r in data.ROWS if r[0] is not None]
    docs = data.documents(spark, tmp_path, rows)
    lab = spark.createDataFrame([(1000 + i, q, y) for i, q, y in labels], "doc_id long, quality int, toxic int")
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]

    def run(name, df):
        out = stages[name](spark, df, sf)
        out.write.parquet(str(tmp_path / f"out-{name}"))
        return spark.read.parquet(str(tmp_path / f"out-{name}"))

    def ids(df):
        return Counter(r[0] for r in df.select("doc_id").collect())

    clean = run("toxicity", docs)
    assert clean.columns == docs.columns
    model = toxicity.fit(docs, lab)
    assert ids(clean) == ids(toxicity.with_scores(docs.drop("score"), model).filter("not rejected"))
    bad = {1000 + i for i, _, y in labels if y}
    assert len(bad & set(ids(clean))) < 0.05 * len(bad) and len(set(ids(docs)) - bad - set(ids(clean))) < 0.03 * len(rows)

    exact = run("exact_dedup", clean)
    least = {}
    for r in clean.select("doc_id", "text").collect():
        least[data.normal(r.text)] = min(least.get(data.normal(r.text), 10**9), r.doc_id)
    assert exact.columns == docs.columns and ids(exact) == Counter(least.values())

    near = run("near_dedup", exact)
    have = sorted(exact.select("doc_id", "text").collect())
    sets = [data.shingles(r.text, 5) for r in have]
    kept = {have[r].doc_id for r in data.components(sets)}
    assert near.columns == docs.columns and set(ids(near)) == kept and max(ids(near).values()) == 1

    mixed = run("mixing", near)
    assert mixed.columns == docs.columns and set(ids(mixed)) == kept
    assert ids(mixed) == ids(mixing.mix_sources(near))

    packed = run("packing", mixed)
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    want = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.select("text").collect())
    got = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert sum(r.n for r in got) == want and all(r.n == r.end <= 4096 for r in got) and len(got) <= -(-want // 4096) + 1

    whole = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, whole.select(*key).collect())) == Counter(map(tuple, packed.select(*key).collect()))


def test_scores_of_one_calibrate(spark, tmp_path, monkeypatch):
    """A labelled document outside the sample whose score is 1, as texts with much evidence get it from single floats."""
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 40)
    monkeypatch.setattr(toxicity, "MAX_NEGATIVE", 80)

    def surer(*args, f=toxicity.train):
        model = f(*args)
        model.out, model.out_bias = model.out * 20, model.out_bias * 20
        return model

    monkeypatch.setattr(toxicity, "train", surer)
    rows, labels = toxic_corpus(600)
    docs = data.documents(spark, tmp_path, rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clean = {r.doc_id for r in corpus_pipeline.remove_toxic(spark, docs, str(tmp_path)).select("doc_id").collect()}
    bad = {i for i, _, y in labels if y}
    assert len(bad & clean) < 0.1 * len(bad) and len(clean) > 0.8 * (len(rows) - len(bad))
    ends = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (1e-12,), (1 - 1e-12,)], "s double").select(toxicity.bin_of(F.col("s")))
    end = toxicity.BINS * toxicity.BIN_END
    assert [r[0] for r in ends.collect()] == [-end, end - 1, 0, -end, end - 1]


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "parcela", tmp_path / "parcela", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_broken_corpus_operators_are_not_hidden(tmp_path):
    shutil.copytree(ROOT / "parcela", tmp_path / "parcela", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "parcela/llm/queries.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "no_such_module" in done.stderr and done.returncode
