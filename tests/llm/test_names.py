"""Columns of the documents whose names the operators could use themselves, in every operator and stage."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from parcela.llm import exact_dedup, fingerprint, line_dedup, mixing, near_dedup, packing, sharding, token_output, toxicity, url_filter

from . import data

NAMES = """__file __row __no __rid __s __b __gone __none _metadata rid rid_ RID file_hash file_row file_number source_key block_of a.b c`d x_y
gone empty score_ rejected score rejected_ label sig grp nb tokens total epochs mix_place_ vslot size n_lines_ piece epoch_""".split()


def hostile(spark, tmp_path):
    df = data.documents(spark, tmp_path, extra=False)
    df = df.select("*", *[F.concat(F.lit(n + "="), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES if n != "RID"])
    path = str(tmp_path / "hostile.parquet")
    df.write.parquet(path)
    return spark.read.parquet(path)


def kept_whole(df, names):
    """Every column is there and still says what it said."""
    assert set(names) <= set(df.columns)
    rows = df.select("doc_id", F.struct(*[F.col("`" + n.replace("`", "``") + "`").alias(f"v{i}") for i, n in enumerate(names)]).alias("v")).collect()
    for r in rows:
        assert list(r.v) == [f"{n}={'-' if r.doc_id is None else r.doc_id}" for n in names]
    return Counter(r.doc_id for r in rows)


def test_columns_with_names_of_ours(spark, tmp_path):
    docs = hostile(spark, tmp_path)
    names = [n for n in NAMES if n != "RID"]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    assert kept_whole(exact_dedup.drop_exact_duplicates(docs), names).total() == exact_dedup.exact_dedup(docs).filter("kept").count()
    assert kept_whole(near_dedup.drop_near_duplicates(docs), names)[19] == 1
    assert set(kept_whole(mixing.mix_sources(docs), [n for n in names if n not in mixing.RESULTS])) == {r[0] for r in data.ROWS}
    assert kept_whole(line_dedup.dedup_lines(docs), names) == Counter(r[0] for r in data.ROWS)
    kept_whole(toxicity.drop_toxic(docs, labels), names)
    for df in (packing.pack_documents(docs), token_output.packed_matrix(docs), sharding.shard_documents(docs)[0], fingerprint.fingerprints(docs)):
        assert df.count()
    pages = docs.select("*", F.col("doc_id").alias("page_id"), F.lit("http://a.b/").alias("url"))
    assert url_filter.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")).count() == len(data.ROWS)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = hostile(spark, tmp_path)
    spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept_whole(out, [n for n in NAMES if n != "RID"])
