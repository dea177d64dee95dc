"""Mixing sources to target weights by Pareto order sampling (operator 7).

Targets: sources in code-point order (null last) have the weights 5, 2, 1, repeating, and
share all words; a target stops at ``most`` times its source's words, and the excess is
shared out again by weight until none is above.  The rounds run on a table with one row a
source; only sums come to the driver.

Odds: within a source a longer document is somewhat likelier: its expected copies are
k * 2^(SLANT * class), class the whole logarithm of its words, and ``most`` at most; k is solved
so that the expected words are the target.  The whole part of that is certain: so many whole
copies of the document.  The rest is its inclusion probability p, which differs by document.

Sampling: a document's rank is its random odds u/(1-u) divided by its inclusion odds p/(1-p)
(Pareto order sampling), and the smallest ranks are taken until the source's remaining words are
reached.  u comes from a hash of id, text and seed, so reruns agree; rows that share it, as
repeated rows do, are told apart by their place, below the digits of the rank, so a tie is no
unit.  The sample's size is fixed in words: where the next document in rank would overshoot, it
is passed over and those after it that still fit are taken, and so on, until what is left is at
most ``NEAR`` of the target or nothing fits; then one document that overshoots is taken if that
comes nearer.  No document is left out of this search.

No source is gathered: words are summed by (source, digits of the rank) before the shuffle, and
the digits at which a source's quota ends are refined by further digits until one document or
little enough is left there.

Defined cases: null or blank text has size 0 and no words to take; a null source is a
source; repeated rows are documents each; a null doc_id is kept; very long texts are counted
whole, and the last may be passed over where it would overshoot; an empty table gives no rows;
extra columns are ignored by ``mixed`` and kept by ``mix``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm.shared import ROW, drop, free, numbered, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: A document twice as long is expected 2^SLANT times as often.
SLANT = 0.25
#: What a source's words may differ from its target, as a part of it, where its documents allow.
NEAR = 1e-3
#: Bits of a rank, of the digits below it that tell ties apart, and of a digit.
RANK, TIE, DIGIT = 40, 22, 10
#: Documents of a source that one task walks through in rank; more are cut by their digits first.
WALK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of words in ``text``."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, weight, target, from rows (source, size)."""
    spark = sizes.sparkSession
    per = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    # a source's place: sources before it, counted by ranges, so that no single task orders all;
    # strings compare by their UTF-8 bytes, which is code-point order
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = per.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    placed = written(placed, "placed")
    drop(per)
    parts = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    stored, placed = placed, placed.withColumn("own", own).join(F.broadcast(parts.select("part", "before")), "part")
    turn = (F.col("before") + F.col("own") - 1) % len(weights)
    weighted = written(placed.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).alias("weight")), "weighted")
    drop(stored)
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words a unit of weight
    while True:
        capped = F.col("weight") * level > most * F.col("source_size")
        full, open_weight = weighted.agg(F.sum(F.when(capped, most * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        new = (total - (full or 0.0)) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return weighted.withColumn("target", F.least(F.col("weight") * level, most * F.col("source_size")))


def _class(size: F.Column) -> F.Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)) + 0.5)).cast("int")


def chances(sizes: DataFrame, goal: DataFrame, most: float = MOST, slant: float = SLANT) -> DataFrame:
    """source, class, source_size, target, certain (whole copies), p, from rows (source, size)."""
    per = sizes.groupBy(F.col("source").alias("s"), _class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    per = per.join(goal, per.s.eqNullSafe(goal.source)).withColumn("w", F.pow(F.lit(2.0), F.col("class") * slant))
    # at most 64 classes a source; those with the largest weights stop at ``most`` first
    down = Window.partitionBy("s").orderBy(F.col("class").desc())
    full = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("w")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("k", F.try_divide(F.col("target") - most * full, rest))
    fits = F.when(F.col("k") * F.col("w") <= most * (1 + 1e-12), F.struct("class", "k"))
    per = per.withColumn("k", F.coalesce(F.max(fits).over(Window.partitionBy("s"))["k"], F.lit(0.0)))
    per = per.withColumn("expected", F.least(F.col("k") * F.col("w"), F.lit(most)))
    per = per.withColumn("certain", F.floor(F.col("expected") + 1e-9).cast("long"))
    rest = F.col("expected") - F.col("certain")
    return per.select("source", "class", "words", "source_size", "target", "certain", F.when(rest > 1e-9, rest).otherwise(0.0).alias("p"))


def _key(u: F.Column, p: F.Column, tie: F.Column) -> F.Column:
    """Random odds by inclusion odds, brought to RANK whole bits, and the tie's bits below them."""
    odds = u / (1 - u) / (p / (1 - p))
    rank = F.floor(odds / (1 + odds) * float(1 << RANK)).cast("long")
    return F.shiftleft(F.least(rank, F.lit((1 << RANK) - 1)), TIE) + tie


def _cut(ranked: DataFrame, open_: DataFrame) -> DataFrame:
    """s, left, target, lo, hi, words: what [lo, hi) of the keys takes of documents that fit; hi at the first that doesn't.

    ``ranked``: s, size, key; ``open_``: s, left, target, lo."""
    bits = RANK + TIE
    at = open_.select(F.col("s").alias("of"), "left", "target", "lo", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"))
    rows = ranked
    while bits > 0:
        step = min(DIGIT, bits)
        width, bits = 1 << bits, bits - step
        inside = rows.join(at, rows.s.eqNullSafe(at.of)).filter((F.col("size") <= F.col("left")) & (F.col("key") >= F.greatest("lo", "low")) & (F.col("key") < F.col("low") + width))
        digit = F.shiftright(F.col("key") - F.col("low"), bits)
        sums = inside.groupBy("of", "left", "target", "lo", "low", "before", digit.alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        by = Window.partitionBy("of").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(by))
        # the first digit that doesn't fit; none: all are taken
        over = F.min(F.when(F.col("upto") > F.col("left"), F.struct("digit", (F.col("upto") - F.col("words")).alias("before"), "words", "n"))).alias("over")
        found = sums.groupBy("of", "left", "target", "lo", "low").agg(over, F.max("upto").alias("all"))
        ends = F.coalesce(F.col("low") + F.col("over.digit") * (1 << bits), F.col("low") + width)
        found = found.select("of", "left", "target", "lo", ends.alias("low"), F.coalesce("over.before", "all").alias("before"), F.coalesce("over.words", F.lit(0)).alias("words"), F.coalesce("over.n", F.lit(0)).alias("n"))
        new = written(found, "cut")
        drop(at)
        at = new
        more = at.filter((F.col("n") > 1) & (F.col("words") > NEAR * F.col("target")))
        if not more.limit(1).count():
            break
        if rows is ranked:  # what lies there from now on
            narrow = ranked.join(at, ranked.s.eqNullSafe(at.of)).filter((F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + (1 << bits))).select(ranked.s, "size", "key")
            rows = written(narrow, "near")
    out = written(at.select(F.col("of").alias("s"), "left", "target", "lo", F.col("low").alias("hi"), F.col("before").alias("words"), F.lit(1 << bits).cast("long").alias("width"), "n"), "cuts")
    drop(at)
    if rows is not ranked:
        drop(rows)
    return out


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents of one source in rank, each taken if it fits: the runs of keys that are taken, and what is left."""
    rows = rows.sort_values("key")
    left, near = rows["left"].iloc[0], max(1.0, rows["near"].iloc[0])
    keys, sizes = rows["key"].tolist(), rows["size"].tolist()
    least = rows["size"][::-1].cummin()[::-1].tolist()  # of what is still to come
    runs, start, most, held = [], rows["lo"].iloc[0], left, False
    for key, size, low in zip(keys, sizes, least, strict=True):
        if left < near or left < low:
            break
        if size <= left:
            left, held, end = left - size, True, key + 1
        else:
            if held:
                runs.append((start, key, most))
            start, most, held = key + 1, left, False
    if held:
        runs.append((start, end, most))
    runs.append((-1, -1, 0.0))  # no key; says what is left
    return pd.DataFrame([(rows["s"].iloc[0], *r, left) for r in runs], columns=["s", "lo", "hi", "most", "left"])


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7, near: float = NEAR) -> DataFrame:
    """at (the row), doc_id, source, size, source_size, target, copies: how many whole copies the mix takes."""
    text = F.col("text").cast("string")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text")]
    rows = docs.select(*columns, ROW) if ROW in docs.columns else numbered(docs.select(*columns))
    narrow = sized(rows.withColumn("hash", F.xxhash64("text"))).select(F.col(ROW).alias("at"), "doc_id", "source", "size", "hash")
    narrow = written(narrow, "sizes")
    drop(rows)
    goal = targets(narrow.select("source", "size"), weights, most)
    odds = written(chances(narrow, goal, most), "odds")
    drop(goal)
    told = odds.select(F.col("source").alias("s"), F.col("class").alias("c"), "source_size", "target", "certain", "p")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "hash"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = F.when((F.col("p") > 0) & (F.col("size") > 0), _key(u, F.col("p"), F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(1 << TIE))))
    ranked = narrow.join(told, narrow.source.eqNullSafe(told.s) & (_class(F.col("size")) == told.c)).select("at", "doc_id", "source", "size", "source_size", "target", "certain", key.alias("key"))
    ranked = written(ranked, "ranked")
    drop(narrow)

    drawn = ranked.filter("key is not null").select(F.col("source").alias("s"), "size", "key")
    quota = F.sum(F.col("p") * F.col("words"))
    open_ = odds.groupBy(F.col("source").alias("s"), "target").agg(quota.alias("left")).select("s", "left", "target", F.lit(0).cast("long").alias("lo"))
    # words are whole, so less than one is nothing to take
    open_ = written(open_.filter(F.col("left") >= 1), "open")
    drop(odds)
    spans: list[DataFrame] = []
    ended: list[DataFrame] = []
    while True:
        at = open_.withColumnRenamed("s", "of")
        fits = drawn.join(at, drawn.s.eqNullSafe(at.of)).filter((F.col("key") >= F.col("lo")) & (F.col("size") <= F.col("left"))).drop("of")
        counts = written(fits.groupBy("s").agg(F.count("*").alias("n")), "counts")
        n = counts.agg(F.max("n")).first()[0]
        # a source without documents that fit ends here
        got = counts.select(F.col("s").alias("got"))
        ended.append(written(open_.join(got, F.col("s").eqNullSafe(F.col("got")), "left_anti").select("s", "left"), "ended"))
        drop(counts)
        if not n:
            break
        if n <= WALK:
            one = F.coalesce(F.concat(F.lit("="), "s"), F.lit(""))
            walked = fits.select("s", "size", "key", "left", "lo", (near * F.col("target")).alias("near")).groupBy(one).applyInPandas(_walk, "s string, lo long, hi long, most double, left double")
            walked = written(walked, "walked")
            spans.append(walked.filter("lo >= 0").select("s", "lo", "hi", "most"))
            ended.append(walked.filter("lo < 0").select("s", "left"))
            break
        cut = _cut(drawn, open_)
        spans.append(cut.select("s", "lo", "hi", F.col("left").alias("most")))
        after = cut.select("s", (F.col("left") - F.col("words")).alias("left"), "target", (F.col("hi") + F.col("width")).alias("lo"), "n")
        ended.append(after.filter("n = 0").select("s", "left"))
        new = written(after.filter((F.col("n") > 0) & (F.col("left") > near * F.col("target")) & (F.col("left") >= 1)).drop("n"), "open")
        drop(open_)
        open_ = new
    drop(open_)

    def union(frames: list[DataFrame], empty: str) -> DataFrame:
        out = ranked.sparkSession.createDataFrame([], empty)
        for x in frames:
            out = out.unionByName(x)
        return out

    def listed(frames: list[DataFrame]) -> DataFrame:
        return union(frames, "s string, lo long, hi long, most double").groupBy("s").agg(F.collect_list(F.struct("lo", "hi", "most")).alias("spans"))

    def taken(spans_: F.Column) -> F.Column:
        return F.coalesce(F.exists(spans_, lambda x: (F.col("key") >= x["lo"]) & (F.col("key") < x["hi"]) & (F.col("size") <= x["most"])), F.lit(False))

    # nothing fits any more: the shortest document, if it comes nearer
    short = union(ended, "s string, left double").filter("left > 0").groupBy("s").agg(F.min("left").alias("left"))
    lists = listed(spans)
    rest = drawn.join(short.withColumnRenamed("s", "of"), drawn.s.eqNullSafe(F.col("of"))).drop("of")
    rest = rest.join(lists.withColumnRenamed("s", "of"), drawn.s.eqNullSafe(F.col("of")), "left").filter(~taken(F.col("spans")))
    one = rest.groupBy("s", "left").agg(F.min(F.struct("size", "key")).alias("x")).filter(F.col("x.size") < 2 * F.col("left"))
    one = one.select("s", F.col("x.key").alias("lo"), (F.col("x.key") + 1).alias("hi"), F.col("x.size").cast("double").alias("most"))
    final = written(listed([*spans, written(one, "one")]), "spans")
    drop(*ended)
    done = ranked.join(final, ranked.source.eqNullSafe(final.s), "left")
    return done.select("at", "doc_id", "source", "size", "source_size", "target", (F.col("certain") + F.when(F.col("key").isNotNull() & taken(F.col("spans")), 1).otherwise(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    rows = numbered(docs)
    at, copies, nth = (free(docs, c) for c in ("taken", "copies", "nth"))
    plan = mixed(rows, **options).filter("copies > 0").select(F.col("at").alias(at), F.col("copies").alias(copies))
    many = rows.join(plan, F.col(ROW) == F.col(at)).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return many.select(*(F.col(f"`{c}`") for c in docs.columns))
