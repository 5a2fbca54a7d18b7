import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcela.llm import fingerprint, mixing, packing, sharding, token_output, tokens, toxicity, url_filter

from . import data

# ---------------------------------------------------------------- sharding


def test_sharding(spark, tmp_path):
    docs = data.documents(spark, tmp_path)
    placed, slot_map = sharding.shard_documents(docs, 3)
    rows = placed.collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in data.ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= {0, 1, 2}
    # heaviest slot first to the least loaded shard, by brute force
    loads, want_map = [0, 0, 0], {}
    for r in sorted(slot_map.collect(), key=lambda r: (-r.bytes, r.vslot)):
        j = loads.index(min(loads))
        loads[j] += r.bytes
        want_map[r.vslot] = j
    assert {r.vslot: r.shard for r in slot_map.collect()} == want_map


def test_sharding_law_and_stored_map(spark, tmp_path):
    """Bytes near equal though a third of the rows has no id and one text; rows lie where the stored map says; versions follow each other."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 3 == 0 else i if i % 3 == 1 else 7, "the same text" if i % 3 == 0 else "x" * int(rng.integers(0, 400)), "en", "a") for i in range(6000)]
    docs, folder = data.documents(spark, tmp_path, rows), str(tmp_path / "map")
    placed, slot_map = sharding.shard_documents(docs, 5, 512, map_folder=folder)
    where = {r.vslot: r.shard for r in slot_map.collect()}
    got = placed.select("doc_id", "size", "vslot", "shard", "slot").collect()
    assert all(where[r.vslot] == r.shard for r in got) and len(got) == 6000
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    assert set(sums) == set(range(5)) and max(sums.values()) < 1.02 * min(sums.values())
    assert Counter(r.shard for r in got) == Counter({s: max(r.slot for r in got if r.shard == s) + 1 for s in range(5)})
    again = sharding.shard_documents(docs, 5, 512, map_folder=folder)[1]
    assert {r.vslot: r.shard for r in again.collect()} == where and again.first().version == 1
    grown, new = sharding.shard_documents(docs, 6, 512, map_folder=folder)
    to = {r.vslot: r.shard for r in new.collect()}
    assert new.first().version == 2 and {r.vslot: r.shard for r in sharding.load_map(spark, folder, 1).collect()} == where
    moved = sum(r.bytes for r in new.collect() if where[r.vslot] != r.shard)
    assert abs(moved / sum(sums.values()) - 1 / 6) < 0.02  # the least that fills a sixth shard
    assert all(to[r.vslot] == r.shard for r in grown.select("vslot", "shard").collect())
    assert sharding.load_map(spark, folder, 9) is None and sharding.shard_documents(docs.limit(0), 5)[0].count() == 0


def test_rebalancing_moves_only_the_excess(spark):
    loads = spark.createDataFrame([(s, 100 + s % 7, 1) for s in range(200)], "vslot int, bytes long, n long")
    old = sharding.build_map(loads, 4)
    new = sharding.rebalance(old, loads, 5)
    a, b = ({r.vslot: (r.shard, r.version) for r in m.collect()} for m in (old, new))
    sums = Counter()
    for r in new.collect():
        sums[r.shard] += r.bytes
    assert set(sums) == set(range(5)) and max(sums.values()) <= 1.05 * min(sums.values()) and {v for _, v in b.values()} == {2}
    assert sum(a[s][0] != b[s][0] for s in a) <= 45
    fewer = sharding.rebalance(new, loads, 3)
    assert {r.shard for r in fewer.collect()} == {0, 1, 2}


# ---------------------------------------------------------------- fingerprints


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def spark_hash(*values):
    """xxhash64 of Spark: each value's bytes with the hash so far as the seed; nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64(v.encode() if isinstance(v, str) else v, seed=h).intdigest()
    return h


def brute_fingerprint(text):
    lanes, ident = [0] * 128, [0] * 8
    for par in text.split("\n"):
        for i in range(4):
            h = spark_hash(i.to_bytes(4, "little"), par)
            ident[2 * i], ident[2 * i + 1] = (ident[2 * i] + (h & 0xFFFFFFFF)) % 2**32, (ident[2 * i + 1] + (h >> 32)) % 2**32
        w = data.SPACE.split(par.strip(" \t\n\x0b\x0c\r"))
        for s, k in Counter(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2)) if w != [""]).items():
            h0 = spark_hash(*s)
            h1 = spark_hash(h0.to_bytes(8, "little"))
            bits = [(h >> i) & 1 for low in (0, 32) for h in (h0, h1) for i in range(low, low + 32)]
            lanes = [x + k * (2 * b - 1) for x, b in zip(lanes, bits, strict=True)]
    return lanes, ident


def brute_likeness(a, b):
    if a == b:
        return 1.0
    x, y = np.array(a[0], float), np.array(b[0], float)
    norm = math.sqrt(x @ x) * math.sqrt(y @ y)
    return min(1.0, max(0.0, (x @ y) / norm)) if norm else 0.0


def brute_next(rows):
    """Rows in descending id, nulls last; ties by length (the order among equal texts doesn't show)."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), len(r[1] or "")))


def test_fingerprints(spark, tmp_path):
    rows = [r for r in data.ROWS if r[1] != data.BASE or r[0] != 7] + [(5000, "far away\nid", "en", "a"), (-3, "negative id", "en", "a"), (-(2**63), "least id", "en", "a"), (60, "same " * 70_000 + "end", "en", "a")]
    docs = data.documents(spark, tmp_path, rows)
    f = fingerprint.fingerprints(docs)
    near = [fingerprint.likeness(F.col("own"), F.col(x)).alias(x[0]) for x in ("edited", "next")]
    got = f.select("doc_id", "n_chars", "edited_sha256", fingerprint.as_hex(F.col("own")).alias("fp"), fingerprint.as_hex(F.col("edited")).alias("efp"), *near).collect()
    order = brute_next(rows)
    of = [brute_fingerprint(r[1] or "") for r in order]
    hexed = lambda fp: "".join(f"{x % 2**32:08x}" for x in [*fp[1], *fp[0]])
    want = {}
    for i, r in enumerate(order):
        t, n = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        edited = brute_fingerprint(e)
        want[r[0]] = (len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(of[i]), hexed(edited), brute_likeness(of[i], edited), brute_likeness(of[i], of[(i + 1) % len(order)]))
    assert len(got) == len(rows) == len(want)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.fp, r.efp) == want[r.doc_id][:4]
        assert abs(r.e - want[r.doc_id][4]) < 1e-9 and abs(r.n - want[r.doc_id][5]) < 1e-9
    assert want[60][4] > 0.99  # a lane of 70,000 equal shingles doesn't wrap


def test_fingerprints_of_ids_that_repeat(spark, tmp_path):
    """Most rows share an id or have none: each still has its own successor, and all make one round."""
    rows = [(None if i % 2 else 5, f"text number {i // 4}", "en", "a") for i in range(400)] + [(9, "last", "en", "a")]
    w = fingerprint.with_next(data.documents(spark, tmp_path, rows)).select("rid", "next_rid").collect()
    to = {r.rid: r.next_rid for r in w}
    assert len(to) == len(set(to.values())) == 401
    at, seen = next(iter(to)), set()
    while at not in seen:
        seen.add(at)
        at = to[at]
    assert len(seen) == 401
    one = data.documents(spark, tmp_path, rows[-1:], name="one")
    r = fingerprint.fingerprints(one).first()
    assert r.own == r.next and fingerprint.fingerprints(one.limit(0)).count() == 0


def test_fingerprint_is_a_sum_over_paragraphs(spark, tmp_path):
    texts = ["alpha beta gamma delta\nsecond line of words\nthird", "third\nalpha beta gamma delta\nsecond line of words", "alpha beta gamma delta", "second line of words\nthird", "alpha beta gamma delta\nsecond line of words"]
    got = {r.doc_id: r for r in fingerprint.fingerprints(data.documents(spark, tmp_path, [(i, t, "en", "a") for i, t in enumerate(texts)])).select("doc_id", "own").collect()}
    assert got[0].own == got[1].own != got[4].own
    spark_rows = spark.createDataFrame([(got[2].own, got[3].own, got[0].own)], "a struct<lanes:array<bigint>,ident:array<bigint>>, b struct<lanes:array<bigint>,ident:array<bigint>>, c struct<lanes:array<bigint>,ident:array<bigint>>")
    r = spark_rows.select((fingerprint.combined(F.col("a"), F.col("b")) == F.col("c")).alias("added"), (fingerprint.combined(F.col("c"), F.col("b"), -1) == F.col("a")).alias("deleted")).first()
    assert r.added and r.deleted


def test_likeness_follows_shared_wording(spark, tmp_path):
    words = [f"w{i * 7919 % 10007}" for i in range(1000)]
    rows = [(4, " ".join(words), "en", "a"), (3, " ".join(words[:700] + [f"x{i}" for i in range(300)]), "en", "a"), (2, " ".join(f"y{i}" for i in range(1000)), "en", "a"), (1, "", "en", "a")]
    f = fingerprint.fingerprints(data.documents(spark, tmp_path, rows)).select("doc_id", fingerprint.likeness(F.col("own"), F.col("next")).alias("near"))
    near = {r.doc_id: r.near for r in f.collect()}
    assert abs(near[4] - 0.7) < 0.25 and near[3] < 0.3 and near[2] == 0


# ---------------------------------------------------------------- url filter

PAGES = [
    (1, "http://Foo.NET/x", ""), (2, "https://a.example.net/en/1?q=/de/", ""), (3, "https://notexample.net/en/1", ""), (4, "http://example.com/de/2#top", ""),
    (5, "http://m.example.com/fr/2", ""), (6, None, ""), (7, "no scheme/net/", ""), (8, "http://x.org/fr/", ""), (9, "http://foo.net", ""), (10, "HTTP://BÜCHER.org?x=/fr/", ""),
    (11, "http://a.b/c://d.net/", ""), (1, "http://Foo.NET/x", ""), (None, "http://net/", ""),
]


def test_url_rules(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([], "page_id long, bad int")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, outcomes).collect())
    assert got == Counter([
        (1, "foo.net", "/x", "net/", "block"), (2, "a.example.net", "/en/1", "example.net/en/", "allow"), (3, "notexample.net", "/en/1", "net/", "block"),
        (4, "example.com", "/de/2", "example.com/de/", "block"), (5, "m.example.com", "/fr/2", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "x.org", "/fr/", "org/fr/", "allow"), (9, "foo.net", "", None, "allow"), (10, "bÜcher.org", "", None, "allow"), (11, "a.b", "/c://d.net/", None, "allow"),
        (1, "foo.net", "/x", "net/", "block"), (None, "net", "/", "net/", "block"),
    ])


def test_url_reputation(spark):
    """A host with many bad pages goes; one bad page alone doesn't; subdomains inherit from their domain."""
    urls = [(i, "http://bad.spam.com/") for i in range(40)] + [(100 + i, "http://good.com/") for i in range(60)] + [(200, "http://once.com/"), (201, "http://new.spam.com/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, int(i < 3)) for i in range(60)] + [(200, 1)], "page_id long, bad int")
    verdict = {r.host: r.verdict for r in url_filter.filter_urls(pages, outcomes).collect()}
    assert verdict["bad.spam.com"] == "block" and verdict["good.com"] == "allow" and verdict["once.com"] == "allow"
    r = {x.host: x for x in url_filter.host_reputation(pages.select(url_filter.host_of(F.col("url")).alias("host"), "page_id").join(outcomes, "page_id", "left")).collect()}
    assert r["new.spam.com"].n == 0 and r["new.spam.com"].rate > 0.5 > r["good.com"].rate
    assert url_filter.filter_urls(pages.limit(0), outcomes).count() == 0


def test_beta_quantile():
    """Against the share of the density under it, by fine sums, and draws."""
    rng = np.random.default_rng(1)
    for a, b in ((0.3, 0.4), (1, 1), (2, 30), (500, 20), (40000, 60000), (0.05, 3)):
        q = url_filter.beta_quantile(np.array([a]), np.array([b]), 0.05)[0]
        assert abs((rng.beta(a, b, 400_000) < q).mean() - 0.05) < 0.002
    assert abs(url_filter.beta_quantile(np.array([1.0]), np.array([1.0]), 0.05)[0] - 0.05) < 1e-3


def test_url_hostile_rows(spark):
    """Empty and very long urls, null hosts beside labelled ones; reputation alone blocks."""
    rows = [(1, ""), (2, "http://" + "a" * 100_000 + "/x"), (3, "http://bad.com/" + "p" * 1_000_000), (4, None), (5, "http:///nohost"), (6, "://"), (7, "http://a:80:90/")]
    rows += [(10 + i, f"http://bad.com/{i}") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(10 + i, 1) for i in range(30)] + [(4, 0), (999, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes).collect()}
    assert len(got) == len(rows) and got[3].verdict == got[10].verdict == "block" and got[3].rule is None and got[3].n == 30 and 0.5 < got[3].bound < got[3].rate < 1
    assert all(got[i].verdict == "allow" and got[i].host == "" for i in (1, 4, 5, 6)) and got[7].host == "a:80:90" and len(got[2].host) == 100_000


def test_url_registered_domains(spark):
    want = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk:8080": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com:443": ("x.com", "com"), "m.x.com": ("x.com", "com"),
        "x.example": ("x.example", "example"), "net": ("net", "net"), "": ("", ""), "fooco.uk": ("fooco.uk", "uk"),
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    d, s = url_filter.domain_and_suffix(F.col("host"))
    assert {r.host: (r.d, r.s) for r in hosts.select("host", d.alias("d"), s.alias("s")).collect()} == want
    assert hosts.filter("host = 'x.example'").select(url_filter.domain_and_suffix(F.col("host"), ("x.example",))[1]).first()[0] == "x.example"
    # owners under co.uk don't share a prior: bad hosts of one leave those of another alone, and pull their own down
    rows = [(f"h{i}.bad.co.uk", 1) for i in range(40)] + [(f"h{i}.good{j}.co.uk", 0) for i in range(4) for j in range(10)]
    rows += [("new.bad.co.uk:81", None), ("new.good1.co.uk", None)]
    r = {x.host: x.rate for x in url_filter.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert r["new.bad.co.uk:81"] > 0.8 and r["new.good1.co.uk"] < 0.3


# ---------------------------------------------------------------- mixing


def test_bisection():
    t = [1000, 100, 10, 0]
    a = mixing.bisect_exponent(t, max_repetition=3.0)
    e = mixing.repetitions(t, a)
    assert abs(max(e) - 3) < 1e-6 and abs(min(e) - 1) < 1e-9 and e[3] == 1
    h = mixing.bisect_exponent(t, target_entropy=0.8)
    assert abs(mixing.entropy(mixing.weights(t, h)) - 0.8) < 1e-9
    assert mixing.bisect_exponent(t, max_repetition=1e9) == 0 and mixing.bisect_exponent([0, 0], max_repetition=2) == 1
    assert abs(mixing.bisect_exponent(t, target_entropy=0) - 1) < 1e-9  # beyond reach: the natural mix


def test_mixing(spark, tmp_path):
    rows = [(i, f"word{i} " * (1 + i % 9), "en", "big" if i % 10 else "small") for i in range(2000)] + [(5000 + i, None, "en", None) for i in range(3)]
    docs = data.documents(spark, tmp_path, rows)
    got = mixing.mix_sources(docs, n_blocks=64).toPandas()
    words = got.text.fillna("").str.split().str.len()
    per, orig = words.groupby(got.source.fillna("-")).sum(), defaultdict(int)
    for _, t, _, s in rows:
        orig[s or "-"] += len((t or "").split())
    share = {s: per[s] / orig[s] for s in ("big", "small")}
    assert share["big"] == 1 and abs(share["small"] - 2) < 0.05
    assert set(got.doc_id) == {r[0] for r in rows}  # nothing is dropped
    assert (got[got.source.isna()].groupby("doc_id").size() == 1).all()
    assert got.mix_place.between(0, 1).all()
    # each stretch of the stream holds the sources at their weights
    got["w"] = words
    got = got[got.w > 0].sort_values("mix_place")
    first = got[got.mix_place < 0.25].groupby("source").w.sum()
    assert abs(first["small"] / first["big"] - per["small"] / per["big"]) < 0.05
    assert len(got[got.epoch == 1][got.source == "small"]) and mixing.mix_sources(docs.limit(0)).count() == 0
    again = mixing.mix_sources(docs.repartition(7), n_blocks=64).select("doc_id", "epoch", "mix_place").toPandas().sort_values(["doc_id", "epoch"], ignore_index=True)
    pd.testing.assert_frame_equal(again, mixing.mix_sources(docs, n_blocks=64).select("doc_id", "epoch", "mix_place").toPandas().sort_values(["doc_id", "epoch"], ignore_index=True))


def test_mixing_counts_tokens(spark):
    """A source of long unspaced text is as large as its tokens, and isn't repeated as if it held a word a document."""
    rng = np.random.default_rng(6)
    rows = [(i, "the sun rose over a quiet river " * 4, "prose") for i in range(40)]
    rows += [(100 + i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/"), 2000)), "junk") for i in range(40)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), n_blocks=16).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert n["junk"] == 40 and n["prose"] > 60


def test_epochs_never_under_one_without_a_budget():
    rng = np.random.default_rng(7)
    for _ in range(500):
        t = [int(x) for x in rng.integers(1, 10**6, 5)]
        assert min(mixing.repetitions(t, mixing.bisect_exponent(t, max_repetition=2.0))) >= 1


def brute_mix(rows, tokens, n_blocks, **target):
    """Every row of the mix, from the definition: (doc_id, source, epoch, block, mix_place rounded)."""
    i4 = lambda x: x.to_bytes(4, "little", signed=True)
    at, sizes = [], defaultdict(int)
    for (i, t, _, s), n in zip(rows, tokens, strict=True):
        h = spark_hash(t, i4(0)) if i is None else spark_hash(i.to_bytes(8, "little", signed=True), i4(0))
        at.append(("n" if s is None else "s" + s, signed(h) % n_blocks))
        sizes[at[-1]] += n
    total = defaultdict(int)
    for (s, _), n in sizes.items():
        total[s] += n
    names = sorted(total)
    epochs = dict(zip(names, mixing.repetitions([total[s] for s in names], mixing.bisect_exponent([total[s] for s in names], **target), target.get("budget")), strict=True))
    places = defaultdict(list)
    for s in names:
        mine = [b for x, b in sizes if x == s]
        for e in range(max(1, math.ceil(epochs[s]))):
            before = 0
            order = sorted(mine, key=lambda b: (signed(spark_hash(s, i4(b), i4(e), i4(0))), b))
            for rank, b in enumerate(order):
                n = sizes[s, b]
                if e + 1 <= epochs[s] or before + n / 2 <= (epochs[s] - e) * total[s]:
                    places[s, b].append((e, (e * total[s] + before) / (epochs[s] * total[s]) if total[s] else rank / len(order)))
                before += n
    return Counter((r[0], r[3], e, k[1], round(p, 9)) for r, k in zip(rows, at, strict=True) for e, p in places[k])


@pytest.mark.parametrize("target", [{"max_repetition": 2.0}, {"max_repetition": 3.5}, {"target_entropy": 1.2}, {"max_repetition": 4.0, "budget": 9000.0}])
def test_mixing_against_brute_force(spark, tmp_path, tokenizer, target):
    rng = np.random.default_rng(8)
    rows = data.ROWS + [(1000 + i, "some words of a text " * int(rng.integers(0, 6)), "en", ["a", "b", "c", "d", None, ""][int(rng.integers(6)) if i % 3 else 0]) for i in range(300)]
    tokens_of = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in rows]
    got = mixing.mix_sources(data.documents(spark, tmp_path, rows), n_blocks=16, **{"max_repetition": None} | target).select("doc_id", "source", "epoch", "block", "mix_place").collect()
    assert Counter((r.doc_id, r.source, r.epoch, r.block, round(r.mix_place, 9)) for r in got) == brute_mix(rows, tokens_of, 16, **target)


def test_mixing_hostile_rows(spark, tmp_path):
    docs = data.documents(spark, tmp_path)
    got = mixing.mix_sources(docs).toPandas()
    assert set(got.doc_id.dropna()) == {r[0] for r in data.ROWS if r[0] is not None} and len(got) >= len(data.ROWS)


# ---------------------------------------------------------------- tokens, packing, token output

TRICKY = ["a<|endoftext|>b c <|startoftext|>", "x <|start oftext|> y", "É é e\u0301 \x1c\x1d z", "ΣΑΣ ß İ", "", " \n", "don't I'LL 3.14 ok\x85q", "a\u00a0b", "e \u0301x", "中文字 русский дом. ﬁne ǅ ʰa", "q" * 300, "é, è. ..., --", "x,y. z,", "🙂🙂, 🙂.", "word%%% émen$$$ it's's ab'' c' d's, e<|f f<|endoftext|> g<|> h|>, İ!! Σ!! x_y_ ___ a1!! ﬁ?! é\u0301.. "]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.tokenizer_path())


def test_encoder(tokenizer, monkeypatch):
    texts = TRICKY + [t or "" for _, t, _, _ in data.ROWS]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for group, memo in ((1 << 20, 200_000), (7, 5)):
        monkeypatch.setattr(tokens, "GROUP_BYTES", group)
        monkeypatch.setattr(tokens, "MEMO", memo)
        got = list(tokens.Encoder(tokens.tokenizer_path()).encode([t.encode() for t in texts]))
        assert [x.tolist() for x in got] == want
    assert [x.tolist() for x in tokens.Encoder(tokens.tokenizer_path()).encode([None, b"a"])] == [[], tokenizer.encode("a").ids]


def test_encoder_on_the_corpus(tokenizer):
    import duckdb

    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.Encoder(tokens.tokenizer_path()).encode([t.encode() for t in texts])] == want


def test_packing(spark, tmp_path, tokenizer):
    docs = data.documents(spark, tmp_path)
    want = Counter()
    ids = {}
    for i, t, _, _ in data.ROWS:
        x = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        ids.setdefault(i, []).append(x)
        for p, s in enumerate(range(0, len(x), 100)):
            part = x[s : s + 100]
            want[(i, p, s, len(part), zlib.crc32(part.tobytes()))] += 1
    for kw in ({}, {"by": "dot"}, {"group_pieces": 20}, {"max_docs": 3}, {"max_cost": 6000 + 100 * 100}):
        got = packing.pack_documents(docs, capacity=100, **kw).toPandas()
        assert Counter((None if d != d else int(d), p, s, n, c) for d, p, s, n, c in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
        for _, g in got.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 100
            assert len(g) <= kw.get("max_docs", 4096) and (g.length**2).sum() <= kw.get("max_cost", 10**9)
    total = sum(n for _, _, _, n, _ in want.elements())
    assert packing.pack_documents(docs, capacity=100).select("sequence_id").distinct().count() <= math.ceil(total / 100) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_limits_bind_only_where_set():
    lengths = np.random.default_rng(5).integers(1, 41, 400)
    most = lambda w=None, **kw: np.bincount(packing.best_fit(lengths, 100, **kw)[0], w).max()
    assert most(max_docs=100) > 3 >= most(max_docs=3)
    squares = lengths.astype(float) ** 2
    assert most(squares, max_docs=100) > 2000 >= most(squares, max_docs=100, max_cost=2000)


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 60, 200)
    bins, offsets = packing.best_fit(lengths, 100, 5, 4000)
    room = []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = [(j, r) for j, r in enumerate(room) if r[0] >= n and r[1] >= 1 and r[2] >= n * n]
        norm = lambda r: ((r[0] - n) / 100) ** 2 + 0.001 * ((r[1] - 1) / 5) ** 2 + 0.001 * ((r[2] - n * n) / 4000) ** 2
        if fits:
            best = min(norm(r) for _, r in fits)
            assert abs(norm(room[bins[i]]) - best) < 1e-12
        else:
            assert bins[i] == len(room)
            room.append([100, 5, 4000])
        r = room[bins[i]]
        r[0], r[1], r[2] = r[0] - n, r[1] - 1, r[2] - n * n


def test_capacity_tree_against_brute_force():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 400).tolist()
    rows, left = token_output.best_fit_decreasing(lengths, 100), []
    sizes = []
    for i in sorted(range(400), key=lambda i: (-lengths[i], i)):
        fit = [x for x in left if x >= lengths[i]]
        if fit:
            left.remove(min(fit))
            left.append(min(fit) - lengths[i])
        else:
            left.append(100 - lengths[i])
    sizes = sorted(100 - sum(lengths[i] for i in r) for r in rows)
    assert sizes == sorted(left) and sorted(i for r in rows for i in r) == list(range(400))


def test_token_output_round_trip(spark, tmp_path, tokenizer):
    docs = data.documents(spark, tmp_path)
    rows = token_output.packed_matrix(docs, width=64, group_bytes=8000)
    path = str(tmp_path / "matrix")
    token_output.write_matrix(rows, path)
    matrix = spark.read.parquet(path)
    pdf = matrix.toPandas()
    got = Counter()
    texts = defaultdict(dict)
    assert pdf.row_id.is_unique
    for r in pdf.itertuples():
        assert len(r.input_ids) == 2 * 64 and r.cu_seqlens[-1] == r.n_tokens <= 64
        assert list(r.position_resets) == list(r.cu_seqlens[:-1])
        pos = token_output.position_ids(list(r.cu_seqlens), 64)
        assert all(pos[a] == 0 for a in r.position_resets) and pos.max() < 64
        assert (np.frombuffer(r.input_ids, "<u2")[r.n_tokens :] == token_output.PAD_ID).all()
    for d, p, x in token_output.unpacked(matrix).itertuples(index=False):
        got[(None if d is None or d != d else int(d), p, tuple(x.tolist()))] += 1
    want = Counter()
    for i, t, _, _ in data.ROWS:
        x = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(x), 64)):
            want[(i, p, tuple(x[s : s + 64]))] += 1
    assert got == want and texts == {}
    assert token_output.packed_matrix(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- toxicity


def toxic_corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    rows, labels = [], []
    for i in range(n):
        w = rng.choice(vocabulary, rng.integers(5, 120)).tolist()
        bad = i % 6 == 0
        if bad:
            for _ in range(2):
                w.insert(int(rng.integers(len(w))), str(rng.choice(["vile", "Stupid,", "scum"])))
        rows.append((i, " ".join(w), "de" if i % 3 else "en", "a"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark, tmp_path):
    rows, labels = toxic_corpus(1500)
    docs = data.documents(spark, tmp_path, rows + [(9000, None, None, None), (9001, "", "en", "a"), (None, "stupid scum vile", "xx", "a"), (0, rows[0][1], "en", "a")])
    lab = spark.createDataFrame(labels + [(9000, 0, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = toxicity.with_scores(docs.drop("score"), model).select("doc_id", "score", "rejected", toxicity.held_out(F.col("doc_id")).alias("held")).toPandas()
    assert got.score.between(0, 1).all() and len(got) == 1504
    assert set(got.doc_id[got.held & got.doc_id.notna()].astype(int)) == {i for i in {*range(1500), 9000, 9001} if zlib.crc32(str(i).encode()) % 5 == 0}
    m = got.merge(pd.DataFrame(labels, columns=["doc_id", "q", "y"]), on="doc_id")
    held = m[m.held]
    assert ((held.score >= 0.5) == held.y).mean() > 0.97 and (held.rejected == held.y).mean() > 0.97
    clean = toxicity.drop_toxic(docs, lab)
    assert clean.columns == docs.columns and clean.filter("doc_id = 9001").count() == 1
    # the language never changes a score
    other = toxicity.with_scores(docs.drop("score").withColumn("lang", F.lit("fr")), model).select("doc_id", "score").toPandas()
    assert sorted(other.score) == sorted(got.score)


def test_every_label_outside_the_sample_calibrates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 60)
    monkeypatch.setattr(toxicity, "MAX_NEGATIVE", 120)
    rows, labels = toxic_corpus(1500)
    rows = [(i, t, "es" if i % 12 == 0 and i < 400 else "en", s) for i, t, _, s in rows]
    docs = data.documents(spark, tmp_path, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "choose_thresholds", lambda h, *a, f=toxicity.choose_thresholds: seen.append(h) or f(h, *a))
    model = toxicity.fit(docs, lab)
    open_ids = {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5}
    toxic = {i for i, _, y in labels if y} & open_ids
    (hist,) = seen
    assert hist.toxic.sum() == len(toxic) - 60 and (hist.clean + hist.toxic).sum() == len(open_ids) - 180
    es = hist[hist.lang == "es"]
    assert 0 < es.toxic.sum() < toxicity.MIN_TO_CALIBRATE and set(model.thresholds) == {"en", "es"}
    assert model.thresholds["es"] != 0.5 and model.pooled_threshold != 0.5
    n = es.toxic.sum()
    es = es.assign(clean=es.clean * (1 + 120 / hist.clean.sum()), toxic=es.toxic * (1 + 60 / hist.toxic.sum()))
    assert abs(model.thresholds["es"] - (n * toxicity.histogram_threshold(es) + 30 * model.pooled_threshold) / (n + 30)) < 1e-12
    # a language without labels has the pooled threshold
    x = toxicity.with_scores(docs.drop("score").withColumn("lang", F.lit("xx")), model).select("score", "rejected").toPandas()
    assert (x.rejected == (x.score >= model.pooled_threshold)).all()


def test_histogram_threshold_against_brute_force():
    rng = np.random.default_rng(2)
    y = rng.random(2000) < 0.1
    bins = np.round(rng.normal(np.where(y, -20, -70), 25)).astype(int)
    h = pd.DataFrame({"bin": bins, "clean": ~y * 1, "toxic": y * 1})
    f1 = lambda k: 2 * (y & (bins >= k)).sum() / ((bins >= k).sum() + y.sum())
    best = max(range(bins.min(), bins.max() + 1), key=f1)
    t = toxicity.histogram_threshold(h)
    assert abs(f1(np.ceil(np.log(t / (1 - t)) * toxicity.BINS - 1e-6)) - f1(best)) < 1e-12


def test_thresholds_do_not_depend_on_what_the_fit_took():
    """Whatever the sample took of each kind, thresholds are those at the ratio of all labels."""
    rng = np.random.default_rng(4)
    y = np.arange(40000) % 9 == 0
    bins = np.round(rng.normal(np.where(y, 0, -64), 32)).astype(int)

    def chosen(keep_clean, keep_toxic):
        kept = rng.random(len(y)) < np.where(y, keep_toxic, keep_clean)
        h = pd.DataFrame({"lang": "en", "bin": bins // 8 * 8, "clean": ~y * 1, "toxic": y * 1})
        took = h[~kept][["clean", "toxic"]].sum()
        return toxicity.choose_thresholds(h[kept], (int(took.clean), int(took.toxic)))[1]

    whole = chosen(1, 1)
    assert abs(chosen(0.9, 0.5) - whole) < 0.05 and abs(chosen(0.2, 0.8) - whole) < 0.05


def test_toxicity_without_both_labels(spark, tmp_path):
    docs = data.documents(spark, tmp_path)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, none) == 0.0 and toxicity.drop_toxic(docs, none).count() == len(data.ROWS)
    one = spark.createDataFrame([(i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, one) == 1.0
    assert toxicity.with_scores(docs.limit(0), 0.0).count() == 0


def test_thresholds():
    low = np.concatenate([np.full(40, 0.1), np.full(40, 0.3)])
    assert abs(toxicity.best_threshold(low, np.repeat([0, 1], 40)) - 0.2) < 1e-9
    assert toxicity.best_threshold(low[30:50], np.repeat([0, 1], 10)) == 0.5  # too few
    assert toxicity.best_threshold(np.array([0.1, 0.2]), np.array([0, 0])) == 0.5


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    k = len(toxicity.WIDTHS)
    m = toxicity.Model(np.arange(20, dtype=np.int32), rng.normal(size=(20, toxicity.DIM)), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], [rng.normal(size=toxicity.FILTERS) for _ in range(k)], rng.normal(size=toxicity.FILTERS * k), 0.1)
    m.embedding[0] = 0
    rows = [rng.integers(0, 20, n) for n in (0, 1, 2, 5, 30)]
    y, weight = np.array([0.0, 1, 0, 1, 1]), np.array([1.0, 2, 1, 2, 0.5])

    def loss():
        z = np.maximum(m.pooled(rows), 0) @ m.out + m.out_bias
        return float((weight * (np.logaddexp(0, z) - y * z)).mean())

    grads = toxicity.loss_gradients(m, rows, y, weight)
    for param, grad in zip([m.embedding, *m.filters, *m.bias, m.out], grads[:-1], strict=True):
        for i in rng.choice(param.size, 12):
            if param is m.embedding and i < toxicity.DIM:
                continue
            at, h = np.unravel_index(i, param.shape), 1e-6
            was = param[at]
            param[at] = was + h
            up = loss()
            param[at] = was - h
            down = loss()
            param[at] = was
            assert abs((up - down) / (2 * h) - grad[at]) < 1e-5
    m.out_bias += 1e-6
    up = loss()
    m.out_bias -= 2e-6
    assert abs((up - loss()) / 2e-6 - grads[-1][0]) < 1e-5


def test_long_texts_are_scored_whole_and_not_fitted(spark, tmp_path):
    rows, labels = toxic_corpus(400)
    filler = " ".join(f"w{i % 3000}" for i in range(230_000))
    rows += [(1000, filler + " vile scum", "en", "a"), (1001, filler, "en", "a"), (1002, "w1 " * 400_000 + "stupid scum", "de", "a")]
    docs = data.documents(spark, tmp_path, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(i, 1, 1) for i in (1000, 1001, 1002)], "doc_id long, quality int, toxic int"))
    s = {r.doc_id: r.score for r in toxicity.with_scores(docs.drop("score"), model).filter("doc_id >= 1000").select("doc_id", "score").collect()}
    assert s[1000] > s[1001] and s[1002] > 0.5


def test_strong_scores_stay_apart_through_the_query(spark, tmp_path, monkeypatch):
    """Log odds from 17 on, where a score in single floats is 1."""

    def surer(*args, f=toxicity.train):
        model = f(*args)
        model.out, model.out_bias = model.out * 3, model.out_bias * 3
        return model

    monkeypatch.setattr(toxicity, "train", surer)
    rows, labels = toxic_corpus(600)
    data.documents(spark, tmp_path, rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.query(spark, str(tmp_path)).toPandas()
    strong = got.score[got.score > 1 - 1e-7]
    assert len(got) == 600 and (got.score < 1).all() and strong.nunique() > 20


def test_repeated_rows_reach_the_fit_once(spark, tmp_path, monkeypatch):
    rows, labels = toxic_corpus(400)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = data.documents(spark, tmp_path, rows * 5)
    read = []
    monkeypatch.setattr(type(docs), "toPandas", lambda self, f=type(docs).toPandas: read.append(x := f(self)) or x)
    model = toxicity.fit(docs, lab)
    sample = read[0]
    assert "words" in sample and sample.doc_id.is_unique and 100 < len(sample) < 400
    once = toxicity.fit(data.documents(spark, tmp_path, rows, name="once"), lab)
    assert (model.embedding == once.embedding).all() and (model.out == once.out).all()


def test_convolution_against_plain_loops():
    rng = np.random.default_rng(0)
    m = toxicity.Model(np.arange(50, dtype=np.int32), rng.normal(size=(50, toxicity.DIM)), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], [rng.normal(size=toxicity.FILTERS) for _ in toxicity.WIDTHS], rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)), 0.1)
    m.embedding[0] = 0
    docs = [rng.integers(0, 50, n) for n in (0, 1, 2, 3, 17)]
    for d, s in zip(docs, m.scores(docs), strict=True):
        x = [0] * max(1, len(d)) + [0] * toxicity.PAD
        x[: len(d)] = d.tolist()
        feats = []
        for w, f, b in zip(toxicity.WIDTHS, m.filters, m.bias, strict=True):
            conv = [sum(m.embedding[x[i + k]] @ f[k] for k in range(w)) for i in range(max(1, len(d)))]
            feats += list(np.max(conv, axis=0) + b)
        z = np.maximum(feats, 0) @ m.out + m.out_bias
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-9


def test_url_evidence_decides_through_the_query(spark, tmp_path):
    """Planted tables: a host, a domain and a suffix whose pages are bad block, also where a host has no label; the SQL agrees on every row."""
    hosts = [("bad.mixed.com", 40, 40), ("ok.mixed.com", 0, 60), ("new.spam.com", 0, 0), ("fresh.bad", 0, 0), ("calm.info", 0, 0)]
    hosts += [(f"h{i}.spam.com", 12, 12) for i in range(6)] + [(f"d{i}.bad", 8, 8) for i in range(30)]
    hosts += [(f"d{i}.info", i % 2, 10) for i in range(20)] + [(f"d{i}.com", i % 3 == 0, 10) for i in range(20)]
    pages, labels, n = [], [], 0
    for host, bad, count in hosts:
        pages.append((10_000 + len(pages), f"http://{host}/about"))  # no document, so no label
        for i in range(count):
            n += 1
            pages.append((10_000 + len(pages), f"http://{host}/{n}"))
            labels.append((n, 1, int(i < bad)))
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    got = url_filter.query(spark, str(tmp_path)).toPandas().sort_values("page_id").reset_index(drop=True)
    verdict = got.groupby("host").verdict.agg(set)
    assert verdict["bad.mixed.com"] == verdict["h0.spam.com"] == verdict["d0.bad"] == {"block"}
    assert verdict["ok.mixed.com"] == verdict["calm.info"] == verdict["d1.info"] == verdict["d1.com"] == {"allow"}
    assert verdict["new.spam.com"] == verdict["fresh.bad"] == {"block"}  # by their domain and their suffix
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(url_filter.SQL).df().sort_values("page_id").reset_index(drop=True)
    assert (got.verdict == want.verdict).all() and (got.bound - want.bound).abs().max() < 2e-6


def test_url_posterior_beats_the_overall_rate_on_held_out_labels(spark):
    """Log loss of labels that took no part in the fit, for hosts that differ."""
    rng = np.random.default_rng(4)
    rows = [(f"h{h}.d{h % 12}.com", int(rng.random() < p)) for h, p in enumerate(rng.beta(0.6, 1.4, 60)) for _ in range(16)]
    fit, held = rows[::2], rows[1::2]
    rate = {r.host: r.rate for r in url_filter.host_reputation(spark.createDataFrame(fit, "host string, bad int")).collect()}
    overall = sum(b for _, b in fit) / len(fit)
    loss = lambda of: -np.mean([np.log(of(h) if b else 1 - of(h)) for h, b in held])
    assert loss(rate.get) < 0.9 * loss(lambda h: overall)
