"""Small hostile tables, and plain implementations to hold the operators against."""

from __future__ import annotations

import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the sun rose over a quiet river while seven old boats drifted past the mill and nobody on the bank said one word about it".split()
BASE = " ".join(WORDS * 3)

#: (doc_id, text, lang, source): nulls, empties, blanks, copies, near copies, a long text, non-ASCII, repeated lines.
ROWS = [
    (7, BASE, "en", "a"), (3, BASE, "en", "a"), (5, BASE.upper(), "en", "b"), (11, BASE.replace("mill", "dam", 1), "en", "a"),
    (1, None, "en", "a"), (2, "", None, "a"), (4, " \t\n", "de", None), (6, "one", "fr", "b"), (8, "One", "fr", "b"), (9, "two words", "es", "b"),
    (10, "Zeile eins ist lang genug hier\nkurz\nÜber alle Maßen schön, ζωή 日本語 🙂", "de", "c"),
    (12, "  zeile eins IST lang genug hier \nother line that is long enough too", "de", "c"),
    (13, "Zeile Eins ist lang genug hier\nother line that is long enough too\n\nother line that is long enough too", "de", "c"),
    (14, "a  b\tc\nd", "en", "c"), (15, "a b c d", "en", "c"), (16, " ".join(f"w{i % 977}" for i in range(6000)), "en", "a"),
    (17, " ".join(f"w{i % 977}" for i in range(5990)) + " end", "en", "a"), (None, "no id at all but some words here", "en", None), (7, BASE, "en", "a"),
    (18, "x" * 5000, "en", "a"), (19, ("y" * 4096) + "z", "en", "a"), (20, ("y" * 4096) + "z", "en", "b"), (21, "y" * 4096, "en", "b"),
]


def documents(spark, tmp_path, rows=None, extra=True, name="documents"):
    """Stored as Parquet, with columns that clash with names used inside operators."""
    rows = ROWS if rows is None else rows
    df = spark.createDataFrame([(i, t, lang, s, len(t) if t else 0) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for c in ("rid", "score", "block", "shard", "kept", "n_lines", "epoch", "grp", "b", "k", "h", "tokens"):
            df = df.withColumn(c, F.lit("clash"))
    path = str(tmp_path / f"{name}.parquet")
    df.repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def normal(text) -> str:
    return SPACE.sub(" ", text or "")


def shingles(text, n) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def components(sets: list[frozenset]) -> list[int]:
    """Index of the least member of each row's component, by comparing all pairs."""
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root
