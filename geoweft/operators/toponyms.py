"""Place names in running text, against the gazetteer's keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_NAMES = 500_000


def scan(text: str, known: set[str]) -> list[str]:
    """Names found from left to right: three capitalised words in a row, else two, else one; a failed longer run tries nothing shorter at that place."""
    words, found, i = text.split(), [], 0
    capital = [w[:1].isupper() for w in words] + [False, False]
    low = [w.lower() for w in words]
    while i < len(words):
        step = 1
        if capital[i] and capital[i + 1] and capital[i + 2]:
            a, b, c = low[i : i + 3]
            tries, span = (f"{a} {b} {c}", f"{a} {b}\t{c}", f"{a}\t{b}\t{c}", f"{a}\t{b} {c}"), 3
        elif capital[i] and capital[i + 1]:
            a, b = low[i : i + 2]
            tries, span = (f"{a}\t{b}", f"{a} {b}"), 2
        else:
            tries, span = ((low[i],) if capital[i] else ()), 1
        hit = next((t for t in tries if t in known), None)
        if hit is not None:
            found.append(hit)
            step = span
        i += step
    return found


def toponyms(posts: DataFrame, keys: list[str], text: str, known: DataFrame) -> DataFrame:
    """``keys, name``: one row for each name that :func:`scan` finds. The names must be few enough for one worker, which is checked."""
    listed = [r[0] for r in known.select("name").distinct().limit(MOST_NAMES + 1).collect()]
    if len(listed) > MOST_NAMES:
        raise ValueError(f"the gazetteer has more than {MOST_NAMES} names; use toponym_ngrams")
    shared = posts.sparkSession.sparkContext.broadcast(set(listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                for name in scan(t, shared.value) if t else ():
                    at.append(i)
                    out.append(name)
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(index) for k in range(len(keys))], pa.array(out, pa.string())], names=[*keys, "name"])

    schema = ", ".join(f"`{k}` {posts.schema[k].dataType.simpleString()}" for k in keys)
    return posts.select(*keys, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, name string")


def toponym_ngrams(posts: DataFrame, keys: list[str], text: str, known: DataFrame, longest: int = 3) -> DataFrame:
    """``keys, name``: every run of one to ``longest`` words that is a name, overlaps included; a plain join for gazetteers of any size."""
    words = posts.where(F.col(text).isNotNull()).select(*keys, F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}'’-]+"), lambda w: w != "").alias("w"))
    def starting(n: int) -> Column:
        """All runs of ``n`` words."""
        every = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, every).otherwise(F.array().cast("array<string>"))

    runs = F.flatten(F.array(*[starting(n) for n in range(1, longest + 1)]))
    return words.where(F.size("w") > 0).select(*keys, F.explode(runs).alias("name")).join(known.select("name").distinct(), "name").select(*keys, "name")
