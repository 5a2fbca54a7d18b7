"""64-bit ids beside null ids, and arrays that can't be read."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcela.llm import common, line_dedup, packing, token_output

from . import data

BIG = [2**60 + 1, 2**60 + 3, None, -(2**62) - 1, 2**53 + 1, None]
ROWS = [(i, f"text number {k} " * (1 + 700 * (k == 1)), "en", "a") for k, i in enumerate(BIG)]


def test_ids_of_64_bits_beside_null_ids(spark, tmp_path):
    """All in one group, where a column of doubles would merge them."""
    docs = data.documents(spark, tmp_path, ROWS)
    packed = packing.pack_documents(docs).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(BIG) and {r.doc_id for r in packed if r.start > 0} <= set(BIG)
    assert len({r.sequence_id >> 32 for r in packed}) == 1
    whole = token_output.unpacked(token_output.packed_matrix(docs))
    assert Counter(whole[whole.piece == 0].doc_id.tolist()) == Counter(BIG)
    stage = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in stage if r.piece == 0) == Counter(BIG)


def test_pieces_of_batches_are_bounded_by_rows_and_bytes():
    texts = ["x" * 10] * 700 + ["y" * 3000] * 5 + ["z" * 9000] + [None] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    pieces = list(common.slices([batch, batch.slice(0, 0)], 512, 8192))
    assert [t for p in pieces for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows <= 512 and (p.num_rows == 1 or p.nbytes <= 8192) for p in pieces)


def test_settings_are_put_back(spark):
    before = spark.conf.get(common.BATCH_ROWS)
    with pytest.raises(RuntimeError), common.small_batches(spark, 7):
        assert spark.conf.get(common.BATCH_ROWS) == "7"
        raise RuntimeError
    assert spark.conf.get(common.BATCH_ROWS) == before


def test_lines_never_stay_because_arrays_cannot_be_read(spark, tmp_path):
    docs = data.documents(spark, tmp_path, [(i, "the very same line in all of them\nline of its own %d here" % i, "en", "a") for i in range(5)])
    folder, shards, units = line_dedup.line_arrays(docs)
    assert "://" in folder
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    probe = lambda where: raw.mapInArrow(lambda b: line_dedup._probe(b, line_dedup.Arrays(where, shards, units, 3), 20), "doc_id long, text binary, n_lines long, n_dropped long")
    assert sorted(r.n_dropped for r in probe(folder).collect()) == [0, 1, 1, 1, 1]
    with pytest.raises(Exception, match="does not exist|No such file|Cannot list|FileNotFound"):
        probe(folder + "-moved").collect()
    other = data.documents(spark, tmp_path, [(1, "a line that nobody else has at all", "en", "a")], name="other")
    with pytest.raises(Exception, match="lack a line|is missing"):
        probe(line_dedup.line_arrays(other)[0]).collect()


def test_a_missing_shard_is_an_error(spark, tmp_path):
    docs = data.documents(spark, tmp_path, [(i, f"line number {i:05d} of some length", "en", "a") for i in range(64)])
    folder, shards, units = line_dedup.line_arrays(docs, shard_keys=8, batch_bytes=64)
    assert shards >= 8 and units >= 4
    arrays = line_dedup.Arrays(folder, shards, units, 3)
    keys = line_dedup._pairs([line_dedup._hash(f"line number {i:05d} of some length".encode()) for i in range(64)])
    unit = arrays.shard_of(keys) % units
    for u in range(units):
        assert not arrays.answer(u, keys[unit == u])["hit"].any()
    arrays.of(0).clear()
    with pytest.raises(RuntimeError, match="missing"):
        arrays.answer(0, keys[unit == 0])


@pytest.mark.parametrize("copies", [1, 8])
def test_a_task_reads_each_unit_once_however_much_text_it_has(spark, tmp_path, monkeypatch, copies):
    lines = [f"line number {i:05d} of some length" for i in range(64)]
    rows = [(i, "\n".join(lines[i % 7 :: 3]), "en", "a") for i in range(40 * copies)]
    docs = data.documents(spark, tmp_path, rows)
    folder, shards, units = line_dedup.line_arrays(docs, shard_keys=8, batch_bytes=64)
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1].encode() for r in rows]})
    monkeypatch.setattr(line_dedup, "CHUNK_BYTES", 2000)
    arrays = line_dedup.Arrays(folder, shards, units, 3)
    out = list(line_dedup._probe(iter([batch]), arrays, 20))
    assert len(out) > 5 and sum(b.num_rows for b in out) == len(rows)
    assert arrays.reads == units >= 4
    monkeypatch.setattr(line_dedup, "HELD_BYTES", 4000)  # what a task holds stays bounded: then it reads them again
    again = line_dedup.Arrays(folder, shards, units, 3)
    assert pa.Table.from_batches(line_dedup._probe(iter([batch]), again, 20)) == pa.Table.from_batches(out)
    assert again.reads > units
