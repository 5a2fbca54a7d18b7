"""Hard negatives and language identification, against plain implementations."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from parcela.llm import hard_negatives, language_id

from . import data

# ---------------------------------------------------------------- hard negatives


def vectors(spark, tmp_path, rows, kind="array<double>", name="embeddings"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int")
    for c in ("rid", "v", "cell", "score", "rank", "own", "other", "x", "anchor"):
        df = df.withColumn(c, F.lit("clash"))
    path = str(tmp_path / f"{name}.parquet")
    df.repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def mined(rows, n_pos=5, n_neg=10, low=30, high=90):
    """The contract by plain loops; rows (vec_id, vector, label), told apart by their place."""
    part = []
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            part.append((k, i, label, [math.floor(256 * x) for x in v]))
    out = []
    none_last = lambda i: (i is None, i or 0)
    for k, i, label, v in part:
        if i is None or i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), none_last(j), m, j, other == label) for m, j, other, w in part if m != k]
        scored.sort(key=lambda r: r[:3])
        for p in [r for r in scored if r[4]][:n_pos]:
            near = [r for r in scored if not r[4] and low * -p[0] <= 100 * -r[0] <= high * -p[0]]
            out += [(i, p[3], rank, r[3], -p[0], -r[0]) for rank, r in enumerate(near[:n_neg], 1)]
    return Counter(out)


def found(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(seed, n, d, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    label = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, labels, n))  # a hot label
    x = (centres[label] * 0.4 + rng.normal(size=(n, d)) * rng.random(d)) * 0.3
    return [(int(i), [float(y) for y in x[i]], int(label[i])) for i in range(n)]


@pytest.mark.parametrize("d", [1, 3, 24])
def test_hard_negatives_brute_force(spark, tmp_path, d):
    rows = clustered(d, 700, d)
    df = vectors(spark, tmp_path, rows)
    want = mined(rows)
    assert want and found(hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)) == want
    # many small cells and several blocks of anchors give the same
    assert found(hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, row_values=64 * d, anchor_values=2 * d)) == want
    few = mined(rows, 2, 3, 0, 100)
    assert found(hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, n_positives=2, n_negatives=3, low=0, high=100)) == few


def test_hard_negatives_hostile_rows(spark, tmp_path):
    """Ties, copies, shared and null ids, nulls, non-finite values, other lengths, negative and zero scores."""
    rows = clustered(9, 250, 6)
    rows += [(i, v, label) for i, v, label in rows[:120]]  # every row twice: ids and vectors repeat
    rows += [(1000 + i, [0.5] * 6, i % 3) for i in range(60)]  # ties
    rows += [
        (2000, None, 1), (2100, [0.1] * 6, None), (2200, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1), (2300, [float("nan")] * 6, 1), (2400, [float("inf")] + [0.0] * 5, 1),
        (2500, [], 1), (2600, [0.25, -0.5], 2), (None, [0.5] * 6, 1), (None, [0.5] * 6, 2), (-100, [-0.5] * 6, 0), (3000, [0.0] * 6, 3), (3100, [1e5] * 6, 3), (3200, [-1e5] * 6, 3),
    ]
    want = mined(rows)
    got = hard_negatives.hard_negatives(vectors(spark, tmp_path, rows), F.col("vec_id") % 100 == 0)
    assert got.schema.simpleString() == "struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>"
    assert found(got) == want and any(k[4] <= 0 for k in mined(rows, low=0, high=100))


def test_hard_negatives_empty_and_too_long(spark, tmp_path):
    some = vectors(spark, tmp_path, [(100, [1e12, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.5], 2)])
    assert hard_negatives.hard_negatives(some, F.col("vec_id") % 100 == 0).count() == 0  # the anchor's scores would not fit
    assert hard_negatives.hard_negatives(some.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    alone = vectors(spark, tmp_path, [(100, [1.0], 1), (1, [1.0], 2)], "array<float>", "alone")
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(alone, F.col("vec_id") % 100 == 0, n_negatives=0)


def test_rotation_bounds_discard_early_and_lose_nothing():
    """Of pairs outside the window, most go before the last components; none inside goes."""
    rng = np.random.default_rng(4)
    ints = np.floor(rng.normal(size=(2000, 32)) * 2.0 ** -np.arange(32)[None, :] * 4000).astype(np.int64)
    q = np.linalg.eigh(ints.T.astype(float) @ ints)[1][:, ::-1].copy()
    a, b = hard_negatives.Rotated(ints[:50], q), hard_negatives.Rotated(ints, q)
    exact = ints[:50] @ ints.T
    low, high = np.sort(exact, 1)[:, -40] * 1.0, np.full(50, np.inf)
    seen = np.zeros(exact.shape, bool)
    for i, j, s in hard_negatives.survivors(a, 0, 50, b, np.arange(2000), low, high, np.ones((50, 2000), bool)):
        seen[i, j] = True
        assert (s == exact[i, j]).all()
    assert (seen | (exact < low[:, None])).all() and seen.sum() < 0.1 * seen.size
    assert abs(q.T @ q - np.eye(32)).max() < 1e-12


# ---------------------------------------------------------------- language


PLAIN_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def identified(train, texts, orders=5, penalty=7.0):
    """Word-first backoff by plain dictionaries."""
    counts = defaultdict(Counter)
    for text, lang in train:
        for w in PLAIN_WORD.findall((text or "").lower()):
            counts[0, lang][w] += 1
            for n in range(1, orders + 1):
                counts[n, lang].update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
    langs = sorted({lang for _, lang in counts})
    rel = {k: {x: max(math.log10(n / sum(c.values())), -penalty) for x, n in c.items()} for k, c in counts.items()}

    def scores(w):
        for n in [0, *range(orders, 0, -1)]:
            items = [w] if n == 0 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
            known = [x for x in items if any(x in rel.get((n, lang), {}) for lang in langs)]
            if known:
                return [sum(rel.get((n, lang), {}).get(x, -penalty) for x in known) / len(known) for lang in langs]
        return [-penalty] * len(langs)

    out = []
    for t in texts:
        ws = PLAIN_WORD.findall((t or "").lower())
        if not ws or not langs:
            out.append(("und", 0.0))
            continue
        total = [sum(x) for x in zip(*map(scores, ws), strict=True)]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        out.append((langs[best], 1 / sum(math.exp((x - total[best]) / math.sqrt(len(ws)) * math.log(10)) for x in total)))
    return out


TEACH = [
    (1, "the sun rose over the river and the old mill", "en"), (2, "die sonne ging über dem fluss auf und die alte mühle", "de"), (3, "le soleil se leva sur la rivière et le vieux moulin", "fr"),
    (4, "the boats drifted past", "en"), (5, "die boote trieben vorbei, die boote", "de"), (6, None, "fr"), (7, "???", "es"), (8, "words of no language", None), (8, "les bateaux", "fr"),
]
ASK = [
    (11, "the river", None), (12, "der fluss", "en"), (13, "rivières", None), (14, None, None), (15, "", "de"), (16, " 123 ½ ²_ ", None), (17, "qqq", None), (18, "日本語", None), (19, "über soleil the", None),
    (20, "the river", None), (None, "la mühle", None), (21, "x" * 90 + " " + "mühle " * 3000, None), (22, "élément", None),
]


def test_language_id_brute_force(spark, tmp_path):
    teach = data.documents(spark, tmp_path, [(i, t, lang, "s") for i, t, lang in TEACH], name="teach")
    ask = data.documents(spark, tmp_path, [(i, t, lang, "s") for i, t, lang in ASK], name="ask")
    got = sorted(((r.doc_id or 0, r.lang_pred, round(r.score, 5)) for r in language_id.identify(ask, language_id.fit(teach)).collect()))
    want = identified([(t, lang) for _, t, lang in TEACH if lang is not None], [t for _, t, _ in ASK])
    assert got == sorted((i or 0, lang, round(p, 5)) for (i, _, _), (lang, p) in zip(ASK, want, strict=True))
    assert {r[1] for r in got} >= {"en", "de", "fr", "und"}


def test_language_id_with_nothing_learned_or_asked(spark, tmp_path):
    empty = data.documents(spark, tmp_path, [(1, "12", "en", "s")], name="empty")
    model = language_id.fit(empty)
    docs = data.documents(spark, tmp_path)
    assert model.langs == [] and {(r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_language_id_long_text(monkeypatch):
    """A text of over a megabyte is taken in parts and scored as a whole."""
    items = language_id._hashes(["xx", "yy", "x", "y"])
    model = language_id.Model(["a", "b"], np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), items, np.array([5, 5, 3, 3]), {(0, "a"): 10, (0, "b"): 10, (1, "a"): 9, (1, "b"): 9}, 7.0)
    text = "xx " * 300_000 + "yy " * 200_000
    assert len(text) > language_id.PLAIN and len(list(language_id.words(text))) > 5
    lang, p = model.predict([text])[0]
    monkeypatch.setattr(language_id, "PLAIN", len(text))
    assert (lang, p) == model.predict([text])[0] and lang == "a"


def test_language_model_is_bounded(spark):
    rows = [(0, "en", f"w{i}", 1 + i % 7) for i in range(700)] + [(1, "en", c, 5000) for c in "abc"]
    entries = spark.createDataFrame(rows, "ord int, lang string, item string, n long")
    kept = language_id.most_frequent(entries, 250).collect()
    assert Counter(r.ord for r in kept) == {0: 200, 1: 3} and {r.n for r in kept if r.ord == 0} == {6, 7}


def test_language_id_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = language_id.query(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(held) > 150 and sum(held) >= 0.98 * len(held)
