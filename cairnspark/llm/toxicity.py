"""Toxicity by gradient-boosted trees over dense features, calibrated (operator 6).

Features of a whole text: densities of a fixed word list and of a lexicon learned from the
training rows (words and word beginnings with high log odds), how often such words stand
near a second-person word, and rates of capitals, punctuation and obfuscated spellings.
Neither id, source, language tag nor label enters a score.

Learning: labelled rows whose crc32(doc_id as text) mod 5 is not 0, one text an id and at
most ``ROWS`` of them by a hash of the id (the documented bound; all rows are scored).  The
lexicon, learned from those rows only, holds terms of ``SUPPORT`` toxic texts or more, whole
words and beginnings of ``PREFIXES`` letters, at most ``TERMS`` of them by their log odds; a
weight is below ``UNIT``.  These bound the model, not the texts that are scored.  Term
counts are summed by Spark.  Each training row's lexicon features come from the other
folds' counts, as a row's own words would flatter it.  The trees are fitted on the driver;
isotonic regression on out-of-fold margins turns margins into probabilities.

Defined cases: null or empty text has all features zero and is scored like any; a document
with labels that differ counts as toxic; a null label or id isn't learned from; with no
labelled rows or one class only, the score is that class's share (0 without rows); repeated
rows get equal scores; very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import below, drop, free, slices, written

ROWS = 12_000
FOLDS = 3
#: A lexicon term stands in so many toxic training texts at least, and has this log odds.
SUPPORT, LOG_ODDS, TERMS = 5, 2.0, 5000
PREFIXES = range(3, 9)
NEAR = 6
REMEMBERED = 300_000

# Insults, threats and slurs of a mild kind in four languages.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass loser losers pathetic worthless trash garbage scum "
    "clown clowns disgusting fool fools foolish imbecile cretin jerk jerks ugly filthy vermin parasite liar coward "
    "retard retarded bastard bitch crap shit asshole fuck fucking fucker hate hateful kill die shut "
    "idiote imbécile crétin débile abruti connard salaud merde pourri nul ordure minable "
    "dumm dummkopf trottel vollidiot arschloch scheisse scheiße abschaum wertlos ekelhaft versager depp "
    "estúpido imbécil tonto basura asqueroso inútil mierda cabrón pendejo perdedor payaso".split()
)
#: Words that address somebody.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr sie tú ti usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

_EDGE = re.compile(r"^[^\w@$]+|[\W_]+$")
_REPEAT = re.compile(r"(.)\1{2,}")
_MIXED = re.compile(r"[A-Za-z][0-9@$!*#|+]+[A-Za-z]")
_MARKS = re.compile(r"[!?]{2,}")
UPPER = np.zeros(256, dtype=bool)
UPPER[[*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] = True
LOWER = np.zeros(256, dtype=bool)
LOWER[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = True

NAMES = (
    "words fixed_density fixed_distinct learned_density learned_distinct learned_max learned_sum learned_top3 second_near second_distance "
    "capitals caps_words exclaims questions mark_runs punctuation digits obfuscated spaced hidden_hits mean_word"
).split()


def plain(word: str) -> str:
    """Lower case, without marks at its ends, look-alike signs and runs of a letter undone."""
    w = _EDGE.sub("", word.lower())
    if w and not w.isalpha() and not w.isdigit():
        w = "".join(c for c in w.translate(LEET) if c.isalpha())
    return _REPEAT.sub(r"\1", w)


def terms(word: str) -> list[str]:
    """What the lexicon may hold of a plain word: itself, and beginnings (marked by a star)."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if n < len(word))] if len(word) > 1 else []


#: What a word is: on the fixed list, second person, found by undoing its spelling, one letter,
#: letters around signs, a run of marks, all capitals.
FIXED, PERSON, UNDONE, SINGLE, MIXED, RUN, CAPS = (1 << k for k in range(7))
#: A word's code is its kinds times this, and the learned weight, which is below it.
UNIT = 16


class Words(dict):
    """The codes of words met so far."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.words = {t: w for t, w in lexicon.items() if t[-1] != "*"}
        self.starts = {t[:-1]: w for t, w in lexicon.items() if t[-1] == "*"}
        self.lengths = sorted({len(t) for t in self.starts})

    def __missing__(self, word: str) -> float:
        low = word.lower()
        simple = low.isalpha()
        w = _REPEAT.sub(r"\1", low) if simple else plain(word)
        learned, size = self.words.get(w, 0.0), len(w)
        for n in self.lengths:
            if n >= size:
                break
            learned = max(learned, self.starts.get(w[:n], 0.0))
        kinds = FIXED * (w in INSULTS) | PERSON * (w in SECOND) | SINGLE * (size == 1) | CAPS * word.isupper()
        if (kinds & FIXED or learned) and w not in low:
            kinds |= UNDONE
        if not simple:
            kinds |= MIXED * bool(_MIXED.search(word)) | RUN * bool(_MARKS.search(word))
        self[word] = out = kinds * UNIT + min(learned, UNIT - 1.0)
        return out


def features(text: str | None, known: Words) -> np.ndarray:
    out = np.zeros(len(NAMES))
    words = text.split() if text else []
    if not words:
        return out
    if len(known) > REMEMBERED:
        known.clear()
    n = len(words)
    codes = np.fromiter(map(known.__getitem__, words), np.float64, n)
    hot = np.flatnonzero(codes)
    kinds = (codes[hot] // UNIT).astype(np.int64)
    spaced = 0
    single = hot[kinds & SINGLE > 0]
    if len(single) > 3:  # letters set apart: four or more one-letter words in a row
        for run in np.split(single, np.flatnonzero(np.diff(single) > 1) + 1):
            if len(run) > 3:
                code = known["".join(words[i] for i in run)]
                if code % UNIT or int(code // UNIT) & FIXED:
                    spaced += 1
                    hot, kinds, codes = np.append(hot, run[0]), np.append(kinds, int(code // UNIT) | UNDONE), np.append(codes, code)
                    codes[run[0]] = code
    weight = codes[hot] % UNIT
    fixed, second, learned = hot[kinds & FIXED > 0], np.sort(hot[kinds & PERSON > 0]), hot[weight > 0]
    w = np.sort(weight[weight > 0])[::-1]
    bad = np.unique(np.concatenate([fixed, learned]))
    near, distance = 0.0, 99.0
    if len(bad) and len(second):
        at = np.searchsorted(second, bad)
        gaps = np.minimum(np.abs(bad - second[np.minimum(at, len(second) - 1)]), np.abs(bad - second[np.maximum(at - 1, 0)]))
        near, distance = float((gaps <= NEAR).sum()) / n, float(gaps.min())
    chars = np.bincount(np.frombuffer(text.encode("latin-1", "replace"), np.uint8), minlength=256)
    letters, size = max(chars[UPPER].sum() + chars[LOWER].sum(), 1), len(text)
    share = lambda kind: float((kinds & kind > 0).sum()) / n
    out[:] = (
        np.log1p(n), len(fixed) / n, len({words[i].lower() for i in fixed}), len(learned) / n, len({words[i].lower() for i in learned}), w[0] if len(w) else 0.0, w.sum() / n, w[:3].sum(), near, distance,
        chars[UPPER].sum() / letters, share(CAPS), chars[33] / size, chars[63] / size, share(RUN), (chars[33:48].sum() + chars[58:65].sum()) / size, chars[48:58].sum() / size,
        share(MIXED), spaced / n, share(UNDONE) * n, size / n,
    )
    return out


# ---- trees ----


class Boosted:
    """Gradient-boosted trees for a logistic loss, on quantile-binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 5.0, l2: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            tree, node = [], np.zeros(len(y), dtype=int)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = np.flatnonzero(node == k)
                    tree.append(split := self._split(b[own], g[own], h[own]))
                    right = b[own, split[0]] > split[1] if len(own) else np.zeros(0, dtype=bool)
                    node[own] = 2 * k + 1 + right
            first = 2**self.depth - 1
            leaves = [g[node == k].sum() / (h[node == k].sum() + self.l2) * self.rate for k in range(first, 2 * first + 1)]
            margin += np.array(leaves)[node - first]
            self.trees.append((np.array([s[0] for s in tree]), np.array([s[1] for s in tree]), np.array(leaves)))
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best, at = 1e-9, (0, 1 << 30)
        if len(g) < 2:
            return at
        total_g, total_h = g.sum(), h.sum()
        for j in range(b.shape[1]):
            n = len(self.edges[j]) + 1
            if n < 2:
                continue
            gl = np.cumsum(np.bincount(b[:, j], weights=g, minlength=n))[:-1]
            hl = np.cumsum(np.bincount(b[:, j], weights=h, minlength=n))[:-1]
            count = np.cumsum(np.bincount(b[:, j], minlength=n))[:-1]
            gain = gl**2 / (hl + self.l2) + (total_g - gl) ** 2 / (total_h - hl + self.l2) - total_g**2 / (total_h + self.l2)
            gain[(count < self.least) | (len(g) - count < self.least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-12:
                best, at = gain[k], (j, k)
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        out, rows, first = np.full(len(x), self.start), np.arange(len(x)), 2**self.depth - 1
        for feature, cut, leaves in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaves[node - first]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Pooled adjacent violators: the steps' first x and their values, shrunk a little to (0, 1)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([float(b), 1.0, float(a)])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][2] == blocks[-1][2]):
            s, n, _ = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
    return [b[2] for b in blocks], [(b[0] + 0.01) / (b[1] + 0.02) for b in blocks]


class Model:
    """Lexicon, trees and calibration; small, so it travels with the tasks."""

    def __init__(self, lexicon: dict[str, float], trees: Boosted | None, steps: tuple[list[float], list[float]], share: float):
        self.lexicon, self.trees, self.steps, self.share = lexicon, trees, steps, share

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.share)
        xs, ys = self.steps
        # between two steps' starts the value rises evenly, which keeps the order of the margins
        return np.clip(np.interp(self.trees.margin(x), xs, ys), 0.0, 1.0)


def _lexicon(counts: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, float]:
    """counts: term -> (clean, toxic) texts; rows: all (clean, toxic) texts."""
    out = {}
    for t, (clean, toxic) in counts.items():
        if toxic >= SUPPORT:
            odds = float(np.log((toxic + 0.5) / (rows[1] + 1)) - np.log((clean + 0.5) / (rows[0] + 1)))
            if odds >= LOG_ODDS:
                out[t] = odds
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:TERMS])


def fit(docs: DataFrame, labels: DataFrame, bound: int = ROWS) -> Model:
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    total = known.count()
    order = F.xxhash64(F.lit(17), "doc_id")
    if total > bound:  # the ids with the smallest hashes: first about so many by a bound on the whole 64 bits, then exactly
        share = min(1.0, (1.2 * bound + 1000) / total)
        known = known.filter(below(order, share)).orderBy(order, "doc_id").limit(bound)
    fold = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(FOLDS)).cast("int")
    # one text of each id, so that repeated rows don't raise the number of rows beyond the bound
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("own"))
    rows = texts.join(F.broadcast(known), "doc_id")  # ``bound`` rows at most
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("own").alias("own"))
    rows = written(rows.select(fold.alias("fold"), (F.col("toxic") > 0).cast("int").alias("toxic"), "own.text"), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Counter] = {}
        schema = pa.schema([("fold", pa.int32()), ("toxic", pa.int32()), ("term", pa.string()), ("n", pa.int64())])

        def out() -> Iterator[pa.RecordBatch]:
            for (f, y), c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(c), pa.int32()), pa.array([y] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], schema=schema)
            held.clear()

        for batch in slices(batches):
            for f, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((f, y), Counter()).update({t for w in {plain(w) for w in set((text or "").split())} for t in terms(w)})
            if sum(map(len, held.values())) > 400_000:
                yield from out()
        yield from out()

    sums = rows.mapInArrow(counted, "fold int, toxic int, term string, n long").groupBy("term").agg(*(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)))
    sizes = np.zeros((FOLDS, 2))
    for f, y, n in rows.groupBy("fold", "toxic").count().collect():
        sizes[f, y] = n
    if not sizes[:, 0].sum() or not sizes[:, 1].sum():
        drop(rows)
        return Model({}, None, ([], []), float(sizes[:, 1].sum() / max(sizes.sum(), 1)))
    clean, toxic = (sum(F.col(f"n{f}{y}") for f in range(FOLDS)) for y in (0, 1))
    odds = F.log((toxic + 0.5) / (sizes[:, 1].sum() + 1)) - F.log((clean + 0.5) / (sizes[:, 0].sum() + 1))
    # terms that any fold's lexicon may hold; the sample's bound and the support bound their number
    top = sums.filter((toxic >= SUPPORT) & (odds >= LOG_ODDS - 0.5)).orderBy(odds.desc(), "term").limit(4 * TERMS).collect()
    counts = {r.term: np.array([[r[f"n{f}0"], r[f"n{f}1"]] for f in range(FOLDS)], dtype=float) for r in top}
    lexicons = [_lexicon({t: c.sum(0) - c[f] for t, c in counts.items()}, sizes.sum(0) - sizes[f]) for f in range(FOLDS)]
    whole = _lexicon({t: c.sum(0) for t, c in counts.items()}, sizes.sum(0))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Words(x) for x in lexicons]
        for batch in slices(batches):
            x = [features(t, own[f]).tolist() for f, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["fold", "toxic", "x"])

    got = rows.mapInArrow(dense, "fold int, toxic int, x array<double>").collect()  # ``bound`` rows at most
    drop(rows)
    got.sort(key=lambda r: (r.fold, r.toxic, r.x))  # the order of rows must not matter
    x, y, f = np.array([r.x for r in got]), np.array([r.toxic for r in got], dtype=float), np.array([r.fold for r in got])
    margins = np.zeros(len(y))
    for k in range(FOLDS):
        if (f != k).any() and 0 < y[f != k].mean() < 1:
            margins[f == k] = Boosted().fit(x[f != k], y[f != k]).margin(x[f == k])
    return Model(whole, Boosted().fit(x, y), isotonic(margins, y), float(y.mean()))


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns and the score, called ``name``; every row of ``docs``."""
    kept = docs.select(*keep)
    rows = docs.select(F.col("text").cast("string").alias(free(docs, "text")), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(model.lexicon)
        for batch in slices(batches):
            x = np.array([features(t, known) for t in batch.column(0).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.scores(x), pa.float64())], [*batch.schema.names[1:], name])

    schema = kept.schema.add(name, "double")
    return rows.mapInArrow(run, schema)
