"""MinHash near-duplicates with sequential Bayesian verification (operator 9).

Texts are sets of word shingles (64-bit hashes; a false match has a chance of some 1e-14 a
pair).  Equal sets are one class from the start, so copies cost nothing further.  Classes
get ``BANDS * WIDTH`` MinHash values; those that agree in a band meet in a bucket.

Candidates: buckets with the same members count once.  In each bucket a hub, the class that
meets most others, is compared with the other members.  A bucket whose other members are by
then in one component is settled, so a group of copies never has its pairs listed.  The
members of what is left are compared across components in blocks of ``BLOCK``, signatures
against signatures and then parity sketches, and only pairs that stay likely leave the block.

Verification: signatures are compared ``BATCH`` values at a time, and a pair is dropped as
soon as the posterior chance that its similarity reaches the threshold falls below ``MISS``.
In blocks a parity sketch (for each of 8 bits or more a shingle, whether an odd number of
shingles falls on it) follows: two sketches differ in no more bits than the sets in shingles,
so this bound drops no link.  Survivors are verified on full sets; those of blocks with each
class's likeliest partner first, then what still crosses components.  A link at the threshold itself is missed with a chance of about
1e-5 in the banding (48 bands of 7) and ``MISS`` a batch in the pruning, others less.

Components grow by least labels and pointer jumping, as tables; nothing is collected.

Defined cases: null, empty or blank text has the empty set and is linked with nothing; a text
of fewer words than a shingle is one shingle; repeated rows are linked (equal sets) unless
empty; a null doc_id never is a component's id unless all its ids are null; an empty table
gives no rows; extra columns are kept by ``representatives``; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm.shared import ROW, drop, free, numbered, slices, written

WORDS, THRESHOLD = 5, 0.8
BANDS, WIDTH = 48, 7
BATCH, MISS = 48, 1e-5
BLOCK = 256
REMEMBERED = 300_000
#: What tells a row of the table apart.
AT = "struct<file:long,place:long>"

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: str | None, n: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles; words end at ASCII blanks, A-Z are lowered."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=_U)
    codes = np.fromiter(map(known.__getitem__, words), _U, len(words))
    factors = _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    if len(words) < n:
        return _mix((codes * factors[: len(codes)]).sum(keepdims=True) + _U(len(words)))
    total = codes[: len(codes) - n + 1] * factors[0]
    for k in range(1, n):
        total = total + codes[k : len(codes) - n + 1 + k] * factors[k]
    return np.unique(_mix(total))


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bits that an odd number of hashes falls on; a power of two of them, 8 or more a hash."""
    bits = max(4096, 1 << (8 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little")


def near_enough(sketches: list[np.ndarray], n: np.ndarray, p: np.ndarray, q: np.ndarray, hundredths: int) -> np.ndarray:
    """Which pairs (p, q) can be similar enough, by their sizes and parity sketches; n: sizes of the sets."""
    ok = 100 * np.minimum(n[p], n[q]) >= hundredths * np.maximum(n[p], n[q])
    most = (100 - hundredths) * (n[p] + n[q]) // (100 + hundredths)
    sizes = np.array([len(x) for x in sketches])
    width = np.minimum(sizes[p], sizes[q])
    for w in np.unique(width[ok]).tolist():
        own = np.flatnonzero(ok & (width == w))
        used, at = np.unique(np.concatenate((p[own], q[own])), return_inverse=True)
        # a sketch is folded to its half by adding its two halves' parities
        rows = np.stack([np.bitwise_xor.reduce(sketches[k].reshape(-1, w), axis=0) for k in used.tolist()]).view(np.uint64)
        x, y = at[: len(own)], at[len(own) :]
        step = max(1, (1 << 21) // w)
        for i in range(0, len(own), step):
            cut = slice(i, i + step)
            ok[own[cut]] = np.bitwise_count(rows[x[cut]] ^ rows[y[cut]]).sum(axis=1, dtype=np.int64) <= most[own[cut]]
    return ok


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * n + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
    return (x[:n] >> _U(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> _U(32)).astype(np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    short = (hashes >> _U(32)).astype(np.uint32)
    out = None
    for at in range(0, len(short), 1024):
        part = np.multiply.outer(a, short[at : at + 1024])
        part += b[:, None]
        low = part.min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def least_matches(threshold: float, miss: float = MISS, batch: int = BATCH, total: int = BANDS * WIDTH) -> list[int]:
    """For each number of compared values: the matches below which a pair is dropped.

    One byte of each value is compared, so values match with chance p = s + (1 - s) / 256.
    With an even prior the posterior that p is at least p0 after m of n matches is
    P(Binomial(n + 1, p0) <= m)."""
    p0, out = threshold + (1 - threshold) / 256, []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, 0
        while m <= n and (tail := tail + comb(n + 1, m) * p0**m * (1 - p0) ** (n + 1 - m)) < miss:
            m += 1
        out.append(m)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """row (a number), at, doc_id, n_shingles, d1, d2 (the set's digest), bands, sig of rows (at, doc_id, text); a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (a, b) = _Hashes(), _permutations(BANDS * WIDTH)
        factors = _mix(np.arange(1, WIDTH + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
        number = _mix(np.arange(1, BANDS + 1, dtype=_U))
        for batch in slices(batches):
            n, d1, d2, bands, sigs = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                own = shingles(text, words, known)
                n.append(len(own))
                if not len(own):
                    for x in (d1, d2, bands, sigs):
                        x.append(None)
                    continue
                digest = xxhash.xxh128_intdigest(own.tobytes())
                d1.append(_signed(digest >> 64))
                d2.append(_signed(digest & (1 << 64) - 1))
                sig = signature(own, a, b)
                bands.append(_mix((sig.reshape(BANDS, WIDTH).astype(_U) * factors).sum(axis=1) + number).view(np.int64))
                sigs.append(_mix(sig.astype(_U)).astype(np.uint8).tobytes())
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["at", "doc_id", "n_shingles", "d1", "d2", "bands", "sig"])

    made = rows.mapInArrow(run, f"at {AT}, doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary")
    return written(made.select(F.monotonically_increasing_id().alias("row"), "*"), "sketches")


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of all nodes in links (a, b); a table."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        # a table of its own: the sum over a hub's links has a row from every task, the join one a node
        near = written(both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m")), "near")
        hop = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        for k in range(2):
            told = labels.select(F.col("node").alias(f"at{k}"), F.col("label").alias(f"far{k}"))
            hop = hop.join(told, F.col("label") == F.col(f"at{k}"), "left").select("node", "old", F.least("label", f"far{k}").alias("label"))
        new = written(hop, "labels")
        drop(near, labels)
        if not new.filter("old <> label").limit(1).count():
            drop(both)
            return new
        labels = new


def _labelled(rows: DataFrame, labels: DataFrame | None, column: str, name: str) -> DataFrame:
    """The component's label of ``column``; nodes without links are their own."""
    if labels is None:
        return rows.withColumn(name, F.col(column))
    own = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
    return rows.join(own, F.col(column) == F.col("__n"), "left").withColumn(name, F.coalesce("__l", column)).drop("__n", "__l")


class Finder:
    """Finds the links of one table.  ``close`` drops its tables."""

    def __init__(self, docs: DataFrame, words: int, threshold: float, miss: float):
        self.words, self.threshold, self.miss = words, threshold, miss
        narrow = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
        self.rows = docs.select(*narrow, ROW) if ROW in docs.columns else numbered(docs.select(*narrow))
        self.docs = self.rows.select(F.col(ROW).alias("at"), "doc_id", "text")
        self.sketches = sketches(self.docs, words)
        full = self.sketches.filter("n_shingles > 0")
        # a class is named by its least row
        least = F.min(F.struct("row", "at")).alias("least")
        self.classes = written(full.groupBy("d1", "d2").agg(least, F.min("doc_id").alias("first")).select("d1", "d2", F.col("least.row").alias("node"), F.col("least.at").alias("at"), "first"), "classes")
        self.own = written(full.join(self.classes.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "n_shingles", "bands", "sig"), "signatures")
        self.sets: DataFrame | None = None
        self.links: list[DataFrame] = []
        self.labels: DataFrame | None = None

    def close(self) -> None:
        drop(self.rows, self.sketches, self.classes, self.own, self.sets, self.labels, *self.links)

    # ---- candidates ----

    def buckets(self) -> DataFrame:
        """bucket, n, node: buckets of two classes or more, one of those with equal members."""
        rows = self.own.select("node", F.explode("bands").alias("bucket"))
        sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("n > 1")
        kept = written(sums.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "kept")
        out = written(rows.join(kept, "bucket"), "buckets")
        drop(kept)
        return out

    def _hub_pairs(self, rows: DataFrame, hubs: DataFrame) -> DataFrame:
        pairs = rows.select("bucket", "node").join(hubs, "bucket").filter("node <> hub")
        return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    def run(self) -> None:
        rows = self.buckets()
        self._take_sets(rows.select("node").distinct())
        meets = rows.groupBy("node").agg(F.sum("n").alias("met"))
        met = rows.select("bucket", "node").join(meets, "node")
        hubs = written(met.groupBy("bucket").agg(F.max_by("node", F.struct("met", F.xxhash64("node"))).alias("hub")), "hubs")
        # at most one pair a member, so all are verified at once
        likely = written(self._likely(self._hub_pairs(rows, hubs)), "likely")
        self._add(self._exact(likely.select("a", "b")))
        left = self._left(rows, hubs)
        drop(rows, hubs, likely)
        if left.limit(1).count():
            self._verify(self._blocks(left))
        drop(left)

    def _left(self, rows: DataFrame, hubs: DataFrame) -> DataFrame:
        """bucket, n, node, label: members that were no hubs, of buckets in which they are of several components."""
        rest = rows.select("bucket", "node").join(hubs, "bucket").filter("node <> hub").drop("hub")
        rest = written(_labelled(rest, self.labels, "node", "label"), "left")
        open_ = rest.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low < high")
        out = written(rest.join(open_.select("bucket", "n"), "bucket"), "open")
        drop(rest)
        return out

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """a, b, matches: likely pairs across components, from comparing a bucket's members block by block."""
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        at = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
        dealt = rows.select("bucket", "node", "label", at.alias("at"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        dealt = dealt.select("bucket", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"), "at", "node", "label")
        sides = self.own.select("node", "sig", "n_shingles").join(self.sets.select("node", "odd"), "node")
        dealt = dealt.join(sides, "node").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "at")
        least, hundredths = least_matches(self.threshold, self.miss), round(self.threshold * 100)

        def compared(rows: list[tuple]) -> list[tuple[int, int, int]]:
            node, label = (np.array([r[k] for r in rows]) for k in (4, 5))
            sig = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1)
            n, odd = np.array([r[7] for r in rows]), [np.frombuffer(r[8], np.uint8) for r in rows]
            side = np.zeros(len(rows), bool) if rows[0][1] == rows[0][2] else np.array([r[3] != rows[0][1] for r in rows])
            # pairs inside the largest component are not looked at: one side is always outside it
            names, counts = np.unique(label, return_counts=True)
            inside = label == names[counts.argmax()]
            x, y = np.flatnonzero(~inside), np.arange(len(rows))
            one = not side.any()
            # the first batch of all, a strip of rows at a time; later ones of what is still likely
            found = []
            for i in range(0, len(x), 64):
                part = x[i : i + 64]
                m = (sig[part, None, :BATCH] == sig[None, y, :BATCH]).sum(axis=2, dtype=np.int64)
                p, q = np.nonzero((m >= least[0]) & (label[part][:, None] != label[y][None, :]) & (one | (side[part][:, None] != side[y][None, :])) & (inside[y][None, :] | (part[:, None] < y[None, :])))
                p, q, m = part[p], y[q], m[p, q]
                for k, need in enumerate(least[1:], 1):
                    cut = slice(k * BATCH, (k + 1) * BATCH)
                    m = m + (sig[p, cut] == sig[q, cut]).sum(axis=1)
                    p, q, m = p[m >= need], q[m >= need], m[m >= need]
                ok = near_enough(odd, n, p, q, hundredths)
                p, q, m = p[ok], q[ok], m[ok]
                found += zip(np.minimum(node[p], node[q]).tolist(), np.maximum(node[p], node[q]).tolist(), m.tolist(), strict=True)
            return found

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
                if rows and (found := compared(rows)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b", "matches"])

            for batch in slices(batches):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and held[0][:3] != row[:3]:
                        yield from out(held)
                        held = []
                    held.append(row)
            yield from out(held)

        return dealt.select("bucket", "low", "high", "at", "node", "label", "sig", "n_shingles", "odd").mapInArrow(run, "a long, b long, matches long").distinct()

    # ---- verification ----

    def _crossing(self, pairs: DataFrame) -> DataFrame:
        if self.labels is None:
            return pairs
        return _labelled(_labelled(pairs, self.labels, "a", "la"), self.labels, "b", "lb").filter("la <> lb").drop("la", "lb")

    def _verify(self, likely: DataFrame) -> None:
        likely = written(self._crossing(likely), "likely")
        if likely.limit(1).count():
            ends = likely.select(F.col("a").alias("node"), F.col("b").alias("other"), "matches").unionByName(likely.select(F.col("b").alias("node"), F.col("a").alias("other"), "matches"))
            best = ends.groupBy("node").agg(F.max(F.struct("matches", F.col("other").alias("other"))).alias("x")).select(F.least("node", "x.other").alias("a"), F.greatest("node", "x.other").alias("b")).distinct()
            best = written(best, "best")
            self._add(self._exact(best))
            rest = written(self._crossing(likely.join(best, ["a", "b"], "left_anti")), "likely")
            drop(likely, best)
            likely = rest
        if likely.limit(1).count():
            self._add(self._exact(likely.select("a", "b")))
        drop(likely)

    def _add(self, links: DataFrame) -> None:
        links = written(links, "links")
        if not links.limit(1).count():
            return drop(links)
        self.links.append(links)
        whole = self.links[0]
        for more in self.links[1:]:
            whole = whole.unionByName(more)
        old, self.labels = self.labels, components(whole)
        drop(old)

    def _likely(self, pairs: DataFrame) -> DataFrame:
        """a, b, matches of the pairs that no batch of their signatures rules out."""
        least, threshold = least_matches(self.threshold, self.miss), self.threshold
        for side in ("a", "b"):
            own = self.own.select(F.col("node").alias(side), F.col("sig").alias(f"s{side}"), F.col("n_shingles").alias(f"n{side}"))
            pairs = pairs.join(own, side)
        # sizes bound the similarity
        pairs = pairs.filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9).select("a", "b", "sa", "sb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                if not batch.num_rows:
                    continue
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in batch.columns[2:])
                alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
                for k, low in enumerate(least):
                    part = slice(k * BATCH, (k + 1) * BATCH)
                    matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                    alive = alive[matches[alive] >= low]
                if len(alive):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)), pa.array(matches[alive])], ["a", "b", "matches"])

        return pairs.mapInArrow(run, "a long, b long, matches long")

    def _take_sets(self, nodes: DataFrame) -> None:
        """The full sets of the classes that meet any other: their texts move once, by their row."""
        words = self.words
        asked = self.classes.join(nodes, "node").select("node", F.col("at").alias("asked"))
        texts = self.docs.join(asked, F.col("at") == F.col("asked")).select("node", "text")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Hashes()
            for batch in slices(batches):
                own = [shingles(text, words, known) for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([parity(x).tobytes() for x in own], pa.binary())], ["node", "hashes", "odd"])

        self.sets = written(texts.mapInArrow(sets, "node long, hashes binary, odd binary"), "sets")

    def _exact(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold."""
        hundredths = round(self.threshold * 100)
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        full = self.sets.select("node", "hashes").join(nodes, "node", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                out = []
                for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= hundredths * (len(x) + len(y) - both):
                        out.append((a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

        for side in ("a", "b"):
            pairs = pairs.join(full.select(F.col("node").alias(side), F.col("hashes").alias(f"h{side}")), side)
        return pairs.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    component_id is the least doc_id that links reach.  A row is kept if it has that id."""
    return _marked(docs, words, threshold, miss).select("doc_id", "n_shingles", "component_id", "kept")


def _marked(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``near_duplicates`` with at (the row) and label, the component's least node (null for rows without words); a table."""
    f = Finder(docs, words, threshold, miss)
    f.run()
    classes = written(_labelled(f.classes, f.labels, "node", "label").select("d1", "d2", "first", "label"), "labelled")
    ids = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    told = classes.join(ids, "label").select("d1", "d2", "label", "component_id")
    rows = f.sketches.select("at", "doc_id", "n_shingles", "d1", "d2").join(told, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = written(rows.select("at", "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "label"), "marked")
    drop(classes)
    f.close()
    return out


def representatives(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: the first with its least id; rows without words stay."""
    rows = numbered(docs)
    names = rows.columns
    # the operator sees the rows' own numbers, so it stores no texts
    marks = _marked(rows, **options)
    # by the label, as components of null ids or of one repeated id share their component_id
    first = marks.filter("kept and n_shingles > 0").groupBy("label").agg(F.min("at").alias("first")).select("first")
    # told apart by the row, which is no frequent key as a large component's label is
    gone = marks.filter("n_shingles > 0").join(first, F.col("at") == F.col("first"), "left_anti").select(F.col("at").alias(free(docs, "gone")))
    gone = written(gone, "gone")
    drop(marks)
    return rows.join(gone, F.col(ROW) == F.col(free(docs, "gone")), "left_anti").select(*(F.col(f"`{c}`") for c in names if c != ROW))
