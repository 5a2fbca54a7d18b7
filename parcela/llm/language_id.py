"""Language identification by words first, with backoff to ever shorter character n-grams.

Fitting counts the words (runs of letters, lower-cased) of every labelled row by
language, in tasks first. From the words' counts come those of the character
n-grams of each order up to ``ORDERS`` in words with a blank at both ends. Nothing
is sampled. The model keeps the most frequent entries (word or n-gram, language)
down to a count at which at most ``MAX_ENTRIES`` of the words, and as many of each
order, remain; how many those are is read from a histogram of the counts. The
bound makes the model of one size whatever the corpus, so that it may be broadcast;
a word that falls out is scored by its n-grams, as any unseen word.

Scoring takes each word of a text, as often as it occurs:

* a known word scores the logarithm (base 10) of its relative frequency in each
  language, and ``-PENALTY`` in languages without it;
* an unseen one is scored by its n-grams of the longest order of which some are
  known, as the mean over the known ones; a word without any scores the penalty
  everywhere.

The language with the best mean over all words is the prediction (ties: the first
by name). ``score`` is its share of the softmax over the languages' sums, where a
text's evidence counts as ``TEMPER`` times the square root of its words.

Defined results: a null text and one without letters are ``und`` with score 0, and
so is every text where nothing could be learned; a run of over ``LONG`` letters
counts as several words; rows without language or id don't teach (an id without a
number isn't held out either); repeated rows teach as often as they occur and are
scored alike; languages are any strings, the empty one included; extra columns
pass by unread. Texts of any length are taken word by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, release, slices, table, written

ORDERS = 5
MAX_ENTRIES = 200_000
PENALTY = 7.0
TEMPER = 1.0
LONG = 100
#: Counts held by a task before it hands them on.
HELD = 100_000
#: Matches of a long text taken at a time; characters of a text that isn't long; numbers of a scoring step.
MATCHES, PLAIN, STEP_VALUES = 1 << 16, 1 << 20, 1 << 21
#: Counts up to EXACT have a class of the histogram each; beyond, FINE classes for each doubling.
EXACT, FINE = 1024, 32
UNKNOWN = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,%d}" % (LONG - 1))


def words(text: str) -> Iterator[list[str]]:
    """Lists of the words of a text, in order; several for a long one."""
    low = text.lower()
    if len(low) <= PLAIN:
        yield WORD.findall(low)
        return
    found = (m.group() for m in WORD.finditer(low))
    while part := list(islice(found, MATCHES)):
        yield part


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n: partial counts of a task's rows (lang, text)."""
    held: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
        held.clear()
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

    for b in slices(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for part in words(text):
                held.setdefault(lang, Counter()).update(part)
                if sum(map(len, held.values())) > HELD:
                    yield out()
    yield out()
    release()


def _grams_of(batches: Iterator[pa.RecordBatch], orders: int) -> Iterator[pa.RecordBatch]:
    """ord, lang, gram, n: partial counts over counted words (lang, word, n)."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(held)
        kinds = (pa.int32(), pa.string(), pa.string())
        cols = list(zip(*keys, strict=True)) or [()] * 3
        batch = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array(held.values(), pa.int64())], ["ord", "lang", "gram", "n"])
        held.clear()
        return batch

    for b in slices(batches, 4096):
        for lang, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for k in range(1, orders + 1):
                for g in grams(word, k):
                    held[k, lang, g] += n
            if len(held) > HELD:
                yield out()
    yield out()
    release()


def _count_class(n: Column) -> Column:
    return F.when(n <= EXACT, n).otherwise(EXACT + F.floor(F.log2(n / EXACT) * FINE) + 1).cast("int")


def most_frequent(entries: DataFrame, most: int) -> DataFrame:
    """Of the rows (ord, n, ...), those of each order down to the last class of counts with which there are no more than ``most``; a class stays or goes as a whole."""
    classes = entries.groupBy("ord", _count_class(F.col("n")).alias("c")).agg(F.count("*").alias("k")).collect()  # a few thousand rows at any size
    least = {}
    for order in {r.ord for r in classes}:
        room, cut = most, None
        for r in sorted((r for r in classes if r.ord == order), key=lambda r: -r.c):
            room -= r.k
            if room < 0:
                break
            cut = r.c
        least[order] = cut
    keep = F.lit(False)
    for order, cut in sorted(least.items()):
        if cut is not None:
            keep = keep | ((F.col("ord") == order) & (_count_class(F.col("n")) >= cut))
    return entries.filter(keep)


def _hashes(items: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for each string."""
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in items), np.uint64, len(items)).view(np.int64)


class Lexicon:
    """Scores of one kind of entry by 64-bit hash, a sparse row for each: which languages have it, and how far over the penalty."""

    def __init__(self, h: np.ndarray, langs: np.ndarray, scores: np.ndarray):
        order = np.lexsort((langs, h))
        self.keys, starts = np.unique(h[order], return_index=True)
        self.starts = np.append(starts, len(h)).astype(np.int64)
        self.langs, self.scores = langs[order].astype(np.int32), scores[order].astype(np.float32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash; -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def add(self, out: np.ndarray, to: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> None:
        """Adds the entries of ``rows``, times a weight each, to the rows ``to`` of ``out``."""
        n = self.starts[rows + 1] - self.starts[rows]
        total = np.concatenate([[0], np.cumsum(n)])
        entry = np.arange(total[-1]) + np.repeat(self.starts[rows] - total[:-1], n)
        np.add.at(out, (np.repeat(to, n), self.langs[entry]), self.scores[entry] * np.repeat(weight, n))


class Model:
    """Languages by name; a lexicon of words (order 0) and one of n-grams of each order. Bounded by MAX_ENTRIES an order."""

    def __init__(self, langs: list[str], order: np.ndarray, lang: np.ndarray, item: np.ndarray, n: np.ndarray, totals: dict[tuple[int, str], int], penalty: float):
        """Entries: order, number of the language, hash of the item, count. totals: of each order and language."""
        self.langs, self.penalty, self.orders = langs, penalty, []
        for k in range(max([0, *(o for o, _ in totals)]) + 1):
            mine = order == k
            total = np.array([totals.get((k, x), 1) for x in langs], np.float64)
            scores = np.maximum(np.log10(n[mine] / total[lang[mine]]), -penalty) + penalty
            self.orders.append(Lexicon(item[mine], lang[mine], scores))

    def word_scores(self, vocabulary: list[str]) -> np.ndarray:
        """Scores over the penalty of each word in each language."""
        out = np.zeros((len(vocabulary), len(self.langs)))
        rows = self.orders[0].find(_hashes(vocabulary))
        known = np.flatnonzero(rows >= 0)
        self.orders[0].add(out, known, rows[known], np.ones(len(known)))
        left = np.flatnonzero(rows < 0)
        for order in range(len(self.orders) - 1, 0, -1):
            if not len(left):
                break
            parts = [grams(vocabulary[i], order) for i in left]
            of = np.repeat(np.arange(len(left)), [len(p) for p in parts])
            rows = self.orders[order].find(_hashes([g for p in parts for g in p]))
            hit = rows >= 0
            n = np.bincount(of[hit], minlength=len(left))
            self.orders[order].add(out, left[of[hit]], rows[hit], 1 / n[of[hit]])
            left = left[n == 0]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        number: dict[str, int] = {}
        docs, ids, times = [], [], []
        for i, t in enumerate(texts):
            for part in words(t or ""):
                c = Counter(part)
                docs.append(np.full(len(c), i))
                ids.append(np.fromiter((number.setdefault(w, len(number)) for w in c), np.int64, len(c)))
                times.append(np.fromiter(c.values(), np.int64, len(c)))
        doc, word, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, ids, times))
        n_words = np.bincount(doc, n, len(texts))
        order = np.argsort(word, kind="stable")
        doc, word, n, vocabulary, k = doc[order], word[order], n[order], list(number), len(self.langs)
        sums, step = np.zeros(len(texts) * k), max(1, STEP_VALUES // max(1, k))
        for a in range(0, len(vocabulary) if k else 0, step):
            scores = self.word_scores(vocabulary[a : a + step])
            first, last = np.searchsorted(word, [a, a + step])
            for s in range(first, last, step):
                part = slice(s, min(last, s + step))
                place = doc[part, None] * k + np.arange(k)
                sums += np.bincount(place.ravel(), (scores[word[part] - a] * n[part, None]).ravel(), len(sums))
        out, sums = [], sums.reshape(len(texts), k)
        for total, n in zip(sums, n_words.tolist(), strict=True):
            if not n or not self.langs:
                out.append((UNKNOWN, 0.0))
                continue
            best = int(np.argmax(total))  # langs are sorted
            evidence = (total - total[best]) / n * np.sqrt(n) * np.log(10) * TEMPER
            out.append((self.langs[best], float(1 / np.exp(evidence).sum())))
        return out


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", orders: int = ORDERS, max_entries: int = MAX_ENTRIES, penalty: float = PENALTY) -> Model:
    """A model of all rows with text and language."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    counted = rows.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    known = written(counted, "words")
    parts = known.mapInArrow(lambda b: _grams_of(b, orders), "ord int, lang string, gram string, n long")
    shorter = parts.groupBy("ord", "lang", "gram").agg(F.sum("n").alias("n")).select("ord", "lang", F.col("gram").alias("item"), "n")
    entries = written(known.select(F.lit(0).alias("ord"), "lang", F.col("word").alias("item"), "n").unionByName(shorter), "entries")
    totals = {(r.ord, r.lang): r.n for r in entries.groupBy("ord", "lang").agg(F.sum("n").alias("n")).collect()}  # languages times orders
    langs = sorted({lang for _, lang in totals})
    kept = most_frequent(entries, max_entries).select("ord", "lang", F.xxhash64("item").alias("h"), "n").toArrow()  # no strings but languages
    order, lang, item, n = (kept.column(c).combine_chunks() for c in ("ord", "lang", "h", "n"))
    number = pc.index_in(lang, pa.array(langs, lang.type))
    model = Model(langs, *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (order, number, item, n)), totals, penalty)
    drop_written(known)
    drop_written(entries)
    return model


def _predicted(batches: Iterator[pa.RecordBatch], model: Model, text: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 256):
        found = model.predict(b.column(text).to_pylist())
        columns = [c for i, c in enumerate(b.columns) if i != text]
        names = [n for i, n in enumerate(b.schema.names) if i != text]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], [*names, "lang_pred", "score"])
    release()


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: doc_id, lang_pred, score. The model is broadcast; its size is bounded by the fit's parameters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _predicted(b, shared.value, 1), "doc_id long, lang_pred string, score double")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out. Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "lang", "text").filter(remainder(F.col("doc_id")) != 0))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
