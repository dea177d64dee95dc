"""Document fingerprints by locally consistent parsing (operator 3).

A text's code points are names.  Each level collapses runs of one name, labels every
position by deterministic coin tossing against its left neighbour (the lowest bit in which
the two differ, and that bit; three rounds leave a handful of labels), cuts phrases at the
labels' local minima and names each phrase by its content.  A cut depends on a few
neighbours only, so equal substrings get equal phrases wherever they stand, but for some at
their ends.  A fingerprint holds the ``KEPT`` smallest name hashes of two levels: the
highest, up to ``LEVELS``, that has at least ``LEAST`` phrases, and the one below it.  The
likeness of two fingerprints is the resemblance estimated from the smallest hashes of the
highest level that both hold.

Edited texts take their end from the next document in ascending id.  Documents are dealt by
ranges of their order - the id, then a hash of the text, then the row - so one id, or none, on
many rows is as many ranges as it takes.  The ranges' bounds come from about ``KEYS`` sampled
keys a range (they decide where ranges end, not what is next); each range gets a copy of the
next range's first document, so text moves once and no task sees more than its range.

Defined cases: null or empty text has the empty fingerprint, which is like itself (1) and
unlike any other (0); null ids come last; of repeated ids the text with the lesser xxhash64
comes first, and repeated rows follow each other; a single document follows itself; an empty
table gives no rows; texts are read whole; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import ROW, below, drop, numbered, slices, written

LEVELS, LEAST, KEPT = 4, 16, 48
#: Sampled keys a range.
KEYS = 64
#: Characters parsed at a time.
CHUNK = 1 << 17

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLD = np.uint64(0x9E3779B97F4A7C15)
_CHARS = _mix((np.arange(0x10000, dtype=np.uint64) + np.uint64(1)) * _GOLD)
_LOWEST = np.array([16] + [(n & -n).bit_length() - 1 for n in range(1, 0x10000)], dtype=np.uint8)


#: Odd factors by place in a phrase; a name is a multilinear hash of its parts.
_FACTORS = _mix((np.arange(1, 257, dtype=np.uint64)) * _GOLD) | np.uint64(1)


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three rounds of coin tossing; ``first`` are the texts' first positions."""
    coins = names.astype(np.uint16)
    for _ in range(3):
        left = np.empty_like(coins)
        left[1:] = coins[:-1]
        left[first] = 0
        np.bitwise_xor(coins, left, out=left)
        at = _LOWEST[left]
        coins >>= at
        coins &= 1
        at <<= 1
        coins = (at | coins.astype(np.uint8)) if coins.dtype != np.uint8 else at | coins
    return coins


def _up(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases' names and their texts, one level up."""
    edge = np.empty(len(names), dtype=bool)
    edge[0] = True
    np.not_equal(text[1:], text[:-1], out=edge[1:])
    new = edge.copy()
    new[1:] |= names[1:] != names[:-1]
    starts = np.flatnonzero(new)
    if len(starts) < len(names):
        runs = np.diff(np.append(starts, len(names))).astype(np.uint64)
        names, text, edge = names[starts], text[starts], edge[starts]
        many = runs > 1
        names[many] = _mix(names[many] + runs[many] * _GOLD)
    first = np.flatnonzero(edge)
    labels = _labels(names, first)
    falls = np.empty(len(names), dtype=bool)  # lower than the left neighbour
    np.less(labels[1:], labels[:-1], out=falls[1:])
    falls[0] = True
    rises = np.empty(len(names), dtype=bool)  # not above the right one, or the text's last
    np.less_equal(labels[:-1], labels[1:], out=rises[:-1])
    rises[-1] = True
    rises[first[1:] - 1] = True
    cut = falls
    cut &= rises
    cut |= edge
    starts = np.flatnonzero(cut)
    place = np.arange(len(names), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(names))))
    return _mix(np.add.reduceat(names * _FACTORS[place & 255], starts)), text[starts]


def fingerprints(texts: list[str]) -> list[str]:
    out = [""] * len(texts)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        _some(texts[at:end], out, at)
        at = end
    return out


def _some(texts: list[str], out: list[str], base: int) -> None:
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    if not len(points):
        return
    names = _CHARS[points & 0xFFFF]
    if (high := points > 0xFFFF).any():
        names[high] = _mix((points[high].astype(np.uint64) + np.uint64(1)) * _GOLD)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    levels = []
    for _ in range(LEVELS):
        names, text = _up(names, text)
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        levels.append((np.right_shift(names, np.uint64(32)).astype(np.uint32), ends))
    for k in range(len(texts)):
        own = [h[e[k] : e[k + 1]] for h, e in levels]
        if not len(own[0]):
            continue
        top = max((n for n in range(LEVELS) if len(own[n]) >= LEAST), default=0)
        parts = []
        for n in range(top, max(top - 2, -1), -1):
            h = own[n]
            if len(h) > 8 * KEPT:  # the smallest hashes, without sorting all
                h = np.unique(np.partition(h, 4 * KEPT)[: 4 * KEPT])
                h = h if len(h) >= KEPT else np.unique(own[n])
            else:
                h = np.unique(h)
            parts.append(f"{n + 1}:{base64.b64encode(h[:KEPT].astype('>u4').tobytes()).decode()}")
        out[base + k] = ";".join(parts)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = (dict(p.split(":") for p in f.split(";")) if f else {} for f in (a, b))
    both = x.keys() & y.keys()
    if not both:
        return 0.0
    level = max(both)
    h, g = (np.frombuffer(base64.b64decode(f[level]), dtype=">u4") for f in (x, y))
    union = np.union1d(h, g)[:KEPT] if min(len(h), len(g)) >= KEPT else np.union1d(h, g)
    if len(h) >= KEPT or len(g) >= KEPT:  # beyond the last kept hash of a full list nothing is known
        union = union[union <= min(x[-1] for x in (h, g) if len(x) >= KEPT)]
    return float(np.isin(union, np.intersect1d(h, g)).sum() / len(union)) if len(union) else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, after: dealt by ranges of the order and sorted; a range ends with a copy (``after``) of what follows it."""
    spark = docs.sparkSession
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    order = {"k0": F.col("doc_id").isNull().cast("long"), "k1": F.coalesce("doc_id", F.lit(0)), "k2": F.xxhash64("text"), "k3": F.xxhash64(ROW, F.lit(1))}
    rows = rows.withColumns(order)
    keys = written(rows.select(*order), "keys")
    n, total = int(spark.conf.get("spark.sql.shuffle.partitions")), keys.count()
    share = min(1.0, KEYS * n / max(total, 1))
    some = keys.filter(below(F.col("k3"), share))
    some = sorted(tuple(r) for r in some.collect())  # about KEYS a range
    bounds = [some[k * len(some) // n] for k in range(1, n)] if some else []

    @F.pandas_udf("int")
    def range_of(k0: pd.Series, k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, x) for x in zip(k0.tolist(), k1.tolist(), k2.tolist(), k3.tolist(), strict=True)], dtype="int32")

    # one row a range, as many as there are shuffle partitions
    firsts = sorted((r.range, tuple(r.first)) for r in keys.groupBy(range_of(*order).alias("range")).agg(F.min(F.struct(*order)).alias("first")).collect())
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
    drop(keys)

    @F.pandas_udf("array<int>")
    def ranges_of(k0: pd.Series, k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        keys = list(zip(k0.tolist(), k1.tolist(), k2.tolist(), k3.tolist(), strict=True))
        return pd.Series([[bisect_right(bounds, x), before[x]] if x in before else [bisect_right(bounds, x)] for x in keys])

    dealt = rows.select("doc_id", "text", *order, F.posexplode(ranges_of(*order)).alias("after", "range"))
    return dealt.repartitionById(n, "range").sortWithinPartitions("after", *order).select("doc_id", "text", "range", (F.col("after") > 0).alias("after"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, whose next isn't known yet
        for batch in slices(batches):
            rows = held + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            held = rows[-1:]
            own = [t for _, t, *_ in rows]
            pairs = [(i, edited(own[i], own[i + 1])) for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
            prints = fingerprints(own + [e for _, e in pairs])
            out = []
            for k, (i, text) in enumerate(pairs):
                f, g = prints[i], prints[len(own) + k]
                out.append((rows[i][0], len(own[i]), hashlib.sha256(text.encode()).hexdigest(), f, g, likeness(f, g), likeness(f, prints[i + 1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return with_next(docs).mapInArrow(run, SCHEMA)
