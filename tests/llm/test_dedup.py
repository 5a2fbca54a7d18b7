import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from parcela.llm import exact_dedup, line_dedup, near_dedup
from parcela.llm.components import components

from . import data


def ids(rows):
    return [(r[0] is None, r[0] or 0) for r in rows]


def test_exact_dedup(spark, tmp_path):
    docs = data.documents(spark, tmp_path)
    got = exact_dedup.exact_dedup(docs, block_bytes=64).collect()
    groups = {}
    for i, t, _, _ in data.ROWS:
        groups.setdefault(data.normal(t), []).append(i)
    keep = {t: min((x is None, x or 0) for x in g) for t, g in groups.items()}
    want = Counter((i, None if keep[data.normal(t)][0] else keep[data.normal(t)][1], len(groups[data.normal(t)]), hashlib.sha256(data.normal(t).encode()).hexdigest()) for i, t, _, _ in data.ROWS)
    assert Counter((r.id, r.keep_id, r.group_size, bytes(r.sha).hex()) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)  # one row each, also where rows repeat
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


@pytest.mark.parametrize("size", [1, 2, 7, 4096])
def test_exact_dedup_block_sizes(spark, tmp_path, size):
    rows = [(i, t, "en", "a") for i, t in enumerate(["abcabc", "abcab", "abcabcabc", "cbacba", "abcabc", "", "a", "abcabcabc", "ab", "ba"])]
    got = {r.id: r.keep_id for r in exact_dedup.exact_dedup(data.documents(spark, tmp_path, rows), block_bytes=size).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 5, 6: 6, 7: 2, 8: 8, 9: 9}


def test_exact_dedup_of_blocks_that_share_a_hash(spark, tmp_path, monkeypatch):
    """With a hash of one value for all blocks, the bytes alone decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") * 0)
    rows = [(i, t, "en", "a") for i, t in enumerate(["abcabc", "abcab", "abcabc", "", "xyz", "xyz"])]
    got = {r.id: r.keep_id for r in exact_dedup.exact_dedup(data.documents(spark, tmp_path, rows), block_bytes=2).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 4}


@pytest.mark.parametrize("words", [4, 5])
def test_near_dedup(spark, tmp_path, words):
    docs = data.documents(spark, tmp_path)
    got = near_dedup.near_duplicates(docs, words).collect()
    sets = [data.shingles(t, words) for _, t, _, _ in data.ROWS]
    root = data.components(sets)
    least = {}
    for (i, _, _, _), r in zip(data.ROWS, root, strict=True):
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    want = Counter((i, len(s), i if not s else None if least[r][0] else least[r][1]) for (i, _, _, _), s, r in zip(data.ROWS, sets, root, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = near_dedup.drop_near_duplicates(docs, words)
    empty = sum(not s for s in sets)
    assert kept.columns == docs.columns and kept.count() == len({r for r, s in zip(root, sets, strict=True) if s}) + empty


def near_copies(n, seed):
    """A family whose members are edited more and more, beside unrelated texts."""
    rng, vocabulary = random.Random(seed), [f"v{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w) if i % 4 else " ".join(rng.choice(vocabulary) for _ in range(40)))
    return out


def test_near_dedup_loses_no_link(spark, tmp_path, monkeypatch):
    texts = near_copies(160, 1)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    docs = data.documents(spark, tmp_path, rows)
    root = data.components([data.shingles(t, 4) for t in texts])
    for block in (2048, 16):  # in one block, and in pairs of blocks
        monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 4).collect()}
        assert got == dict(enumerate(root))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5)]
    up = list(range(200))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


def brute_lines(rows):
    keys = lambda t: [line.strip(" \t\n\x0b\x0c\r").translate(data.LOWER) for line in (t or "").split("\n")]
    found = {}
    for n, (i, t, _, _) in enumerate(rows):
        for k in set(keys(t)):
            found.setdefault(k, []).append((i is not None, i or 0, n))
    gone = {k: max(v)[:2] for k, v in found.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t, _, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if k not in gone or gone[k] == (i is not None, i or 0)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("batch_bytes", [1 << 20, 40])
def test_line_dedup(spark, tmp_path, batch_bytes):
    rng = random.Random(3)
    pool = [f"line number {i} is long enough to count" for i in range(30)] + ["short", "", "   ", "A" * 19, "ä" * 20]
    rows = data.ROWS + [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))), "en", "a") for i in range(60)]
    docs = data.documents(spark, tmp_path, rows)
    got = line_dedup.dedup_lines(docs, shard_keys=4, batch_bytes=batch_bytes)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(rows)


def test_perfect_hash():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, (5000, 2), dtype=np.uint64)
    mph = line_dedup.PerfectHash(keys)
    assert sorted(mph.index(keys)) == list(range(5000))
    assert (line_dedup.PerfectHash.load(mph.dump()).index(keys) == mph.index(keys)).all()
    assert line_dedup.PerfectHash(keys[:0]).index(keys[:3]).tolist() == [-1, -1, -1]


def test_empty_tables(spark, tmp_path):
    docs = data.documents(spark, tmp_path, [])
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert near_dedup.near_duplicates(docs, 4).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0


def test_shingler_matches_plain_words():
    texts = [t for _, t, _, _ in data.ROWS] + ["A b\x0bC\x1fd  e f", "ä Ä"]
    got = list(near_dedup.Shingler(3).sets([t.encode() if t is not None else None for t in texts]))
    assert [len(s) for s in got] == [len(data.shingles(t, 3)) for t in texts]
    seen = {}
    for t, s in zip(texts, got, strict=True):
        assert seen.setdefault(data.shingles(t, 3), s.tobytes()) == s.tobytes()


def test_row_ids_do_not_depend_on_the_split(spark, tmp_path):
    from parcela.llm.common import stored, with_row_ids

    docs = data.documents(spark, tmp_path)
    a = with_row_ids(docs, "r").select("r", "doc_id", "text").collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        b = with_row_ids(docs, "r").select("r", "doc_id", "text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert Counter(map(tuple, a)) == Counter(map(tuple, b)) and len({r.r for r in a}) == len(data.ROWS)
    memory = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    assert stored(docs) is docs and with_row_ids(stored(memory), "r").count() == 2
    assert exact_dedup.drop_exact_duplicates(memory).count() == 1 and near_dedup.drop_near_duplicates(memory).count() == 1


@pytest.mark.parametrize("share", [0.50, 0.62])
def test_a_shared_template_is_not_searched_in_all_pairs(spark, tmp_path, caplog, share):
    """A thousand texts of one template with no link, and some that are linked within it: under 5 % of the pairs are looked at, no link is lost."""
    import logging

    n = 150
    t = int(n * 2 * share / (1 + share))
    base, own = [f"t{i}" for i in range(t + 4)], lambda i: [f"u{i}x{k}" for k in range(n - t)]
    rows = [(i, " ".join(base + own(i))) for i in range(1000)]
    rows += [(2000 + i, " ".join([*base, *own(i)[:-3], "last", "words", "differ"])) for i in range(0, 1000, 100)]
    path = str(tmp_path / "template.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    caplog.set_level(logging.INFO, "parcela.llm.near_dedup")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.read.parquet(path), 5).collect()}
    assert got == {i: i % 2000 if i >= 2000 else i for i, _ in rows}
    looked = [int(x.args[1]) for x in caplog.records if "searched whole" in x.msg]
    assert looked and looked[0] < 0.05 * len(rows) * (len(rows) - 1) / 2


def test_prefixes_of_linked_sets_meet():
    """Whatever shingles count as common, two sets at the threshold share one of their prefixes."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    keys = None
    for _ in range(60):
        n = int(rng.integers(1, 60))
        words = [f"w{x}" for x in rng.integers(0, 500, n + 4)]
        texts = [" ".join(words), " ".join(words[: len(words) - int(rng.integers(0, 4))]), " ".join(words + [f"z{rng.integers(0, 9)}"] * int(rng.integers(0, 4)))]
        sets = list(near_dedup.Shingler(5).sets([t.encode() for t in texts]))
        pool = np.unique(np.concatenate(sets)).view(np.int64)
        keys = np.sort(rng.choice(pool, rng.integers(0, len(pool) + 1), replace=False))
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([t.encode() for t in texts])], ["rid", "text"])
        out = next(near_dedup._prefixes(iter([batch]), 5, 80, (keys, rng.integers(1, 9, len(keys)))))
        held = {i: {b for r, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True) if r == i} for i in range(3)}
        for i, j in ((0, 1), (0, 2), (1, 2)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert held[i] & held[j]
