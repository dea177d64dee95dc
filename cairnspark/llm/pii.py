"""Personal data and information-theoretic sanitisation (operator 2).

Protected entities are e-mail addresses, IP addresses, card and phone numbers, found by
fixed patterns in whole texts.  How strongly a term reveals an entity is estimated from the
corpus: of all texts that hold the term, the share that hold the entity, wherever in the text.
Counts of pairs are smoothed by absolute discounting (``DISCOUNT`` off each count goes to the
entity's share of all texts), so entities and terms that stand in a single text are rated too,
the more strictly the larger the corpus.  With I(e) = -log2 p(e) and the pointwise information
I(t;e) = log2 p(e|t) / p(e), a term discloses the part I(t;e) / I(e) of the entity.  Terms that
disclose ``DISCLOSE`` of any entity are removed wherever they stand, in texts without the entity
too; those from ``GENERALISE`` on are generalised to a word class.

Text counts of terms are taken over all documents, summed in each task before the shuffle;
what is shuffled are hashes of terms.  Entities that stand in the same texts are rated as one, and
pairs (entity, term) are counted before they are joined, so a frequent entity or term is one row.
Texts are searched for the terms beside entities, and later for the disclosing ones, with a bitmap of
their hashes of ``BITS`` bits at most; what passes it is joined with the terms themselves, so the
bitmap decides nothing.  Rows of a
Parquet table are known by file and place in each scan; other frames are stored first.

Defined cases: null or empty text holds nothing; repeated rows are texts each; overlapping
kinds are each reported; a null doc_id is kept; extra columns are kept by ``sanitised`` and
ignored by ``found``; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import ROW, drop, free, numbered, slices, written

DISCOUNT, DISCLOSE, GENERALISE = 0.75, 0.9, 0.7
BITS = 1 << 22
# The kinds' patterns, in the order in which spans are listed.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term", "wide")
#: The same leftmost matches, written so that a failed start is soon given up.
_FAST = {
    "email": re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(PATTERNS["phone"]),
}
_LONG_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_TERM = re.compile(r"[^\W\d_]{3,}")
_TERM_LETTER = re.compile(r"[^\W\d_]")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _valid(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in match.split("."))
    digits = re.sub(r"[^0-9]", "", match)
    return 14 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of personal data, by start, then by kind as listed."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in _emails(text)]
    for kind in ("ip", "card", "phone"):
        if kind == "phone" and "+" not in text:
            continue
        if kind == "card" and not _LONG_CARD.search(text):
            continue  # no run of enough digits, so no card
        out += [(kind, *m.span()) for m in _FAST[kind].finditer(text) if _valid(kind, m[0])]
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


def _emails(text: str) -> Iterator[re.Match]:
    """The pattern's leftmost matches: each starts at the first letter of the run before an @."""
    at = 0
    while (sign := text.find("@", at)) >= 0:
        start = sign
        while start > at and text[start - 1] in _LOCAL:
            start -= 1
        m = _FAST["email"].match(text, start) if start < sign else None
        if m:
            yield m
            at = m.end()
        else:
            at = sign + 1


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Latin letters stand for themselves, all other bytes are blanks.
_LATIN = bytes(c if _TERM_LETTER.match(chr(c)) else 32 for c in range(256))
_OTHER_LETTER = re.compile(r"[^\W\d_\x00-\xff]")


def latin(text: str) -> bytes | None:
    """The text in lower case, a byte a code point, with blanks for what is no letter; None if it has other letters than Latin-1's."""
    low = text.lower()
    try:
        out = low.encode("latin-1")
    except UnicodeEncodeError:
        if len(low) != len(text) or _OTHER_LETTER.search(text):
            return None
        out = low.encode("latin-1", "replace")
    return out.translate(_LATIN)


def terms(text: str) -> set[bytes] | set[str]:
    """The distinct words of three letters or more, in lower case (as bytes where ``latin`` reads the text)."""
    if (plain := latin(text)) is None:
        return {t.lower() for t in set(_TERM.findall(text))}
    return {w for w in set(plain.split()) if len(w) > 2}


def places(text: str, wanted: set) -> Iterator[tuple]:
    """(term, start, end) of the wanted terms (as ``terms`` gives them), wherever they stand."""
    if (plain := latin(text)) is None:
        yield from ((m[0].lower(), *m.span()) for m in _TERM.finditer(text) if m[0].lower() in wanted)
        return
    plain = b" " + plain + b" "
    for t in wanted:
        at, word = -1, b" " + t + b" "
        while (at := plain.find(word, at + 1)) >= 0:
            yield t, at, at + len(t)


def term_hash(term: bytes | str) -> int:
    return xxhash.xxh64_intdigest(term.decode("latin-1") if isinstance(term, bytes) else term) - (1 << 63)


class _Hashes:
    """Hashes of terms, with those of frequent terms at hand."""

    def __init__(self) -> None:
        self.known: dict[bytes | str, int] = {}

    def __call__(self, term: bytes | str) -> int:
        if (h := self.known.get(term)) is None:
            if len(self.known) > 300_000:
                self.known.clear()
            h = self.known[term] = term_hash(term)
        return h


def _outside(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with blanks for the entities' letters and for words they cut: those are not terms."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        while a > at and _TERM_LETTER.match(text, a - 1):
            a -= 1
        while b < len(text) and _TERM_LETTER.match(text, b):
            b += 1
        out += [text[at : max(a, at)], " "]
        at = max(at, b)
    return "".join([*out, text[at:]])


_AT = "struct<file:long,place:long>"
_FOUND = f"row {_AT}, doc_id long, base array<struct<kind:string,start:int,end:int>>, entities array<long>, terms array<long>"


def _scan(rows: DataFrame) -> DataFrame:
    """row, doc_id, base spans, the distinct entities and the distinct terms beside them; one row per text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches):
            base, entities, beside = [], [], []
            for text in batch.column(2).to_pylist():
                spans = base_spans(text) if text else []
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                entities.append(list({xxhash.xxh64_intdigest(f"{k}:{text[a:b].lower()}") - (1 << 63) for k, a, b in spans}))
                beside.append([hashes(t) for t in terms(_outside(text, spans))] if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, kind), pa.array(entities, pa.list_(pa.int64())), pa.array(beside, pa.list_(pa.int64()))], ["row", "doc_id", "base", "entities", "terms"])

    return rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _FOUND)


class Bitmap:
    """Bits of a table's terms: what has none is not in the table.  ``BITS`` bits at most."""

    def __init__(self, told: DataFrame):
        self.size = min(BITS, 1 << max(10, (16 * told.count()).bit_length()))
        slots = told.select(F.expr(f"shiftright(term & {self.size - 1}L, 6)").alias("slot"), F.expr("shiftleft(1L, cast(term & 63L as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
        self.bits = np.zeros(self.size >> 6, dtype=np.int64)
        for r in slots.collect():  # BITS / 64 rows at most
            self.bits[r.slot] = r.bits
        self.known: dict[bytes | str, int | None] = {}

    def __call__(self, term: bytes | str) -> int | None:
        """The term's hash, or None if the table surely lacks it."""
        if term in self.known:
            return self.known[term]
        if len(self.known) > 300_000:
            self.known.clear()
        h = term_hash(term)
        self.known[term] = out = h if int(self.bits[(h & (self.size - 1)) >> 6]) >> (h & 63) & 1 else None
        return out


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """term (hash), texts: in how many texts, of all, each term stands; of ``wanted`` terms, and some more."""
    bitmap = Bitmap(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.update(h for h in map(bitmap, terms(text)) if h is not None) if text else None
            if len(held) > 600_000:
                yield out()
                held.clear()
        yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("texts"))


def disclosing(scan: DataFrame, docs: DataFrame, generalise: float = GENERALISE, disclose: float = DISCLOSE, discount: float = DISCOUNT) -> DataFrame:
    """term, kind (term: to remove, wide: to generalise), from corpus co-occurrence."""
    n = float(max(scan.count(), 1))
    held = scan.filter(F.size("entities") > 0)
    own = held.select("row", F.explode("entities").alias("entity"))
    # entities of the same texts have the same pairs: one of them stands for all
    entities = own.groupBy("entity").agg(F.count("*").alias("entity_texts"), F.bit_xor(F.xxhash64("row")).alias("where"))
    one = entities.groupBy("entity_texts", "where").agg(F.min("entity").alias("entity")).select("entity", "entity_texts")
    pairs = held.select("row", "terms").join(own.join(one, "entity"), "row").select("entity", "entity_texts", F.explode("terms").alias("term"))
    joint = pairs.groupBy("entity", "entity_texts", "term").agg(F.count("*").alias("both"))
    # a term's strictest rating needs each pair of counts once
    joint = written(joint.select("term", "entity_texts", "both").distinct(), "joint")
    rated = joint.join(term_counts(docs, joint.select("term").distinct()), "term")
    p = F.col("entity_texts") / n
    given = (F.col("both") - discount + discount * p) / F.col("texts")
    part = F.when(p < 1, F.log2(given / p) / -F.log2(p)).otherwise(0.0)
    return rated.groupBy("term").agg(F.max(part).alias("part")).filter(F.col("part") >= generalise).select("term", F.when(F.col("part") >= disclose, "term").otherwise("wide").alias("kind"))


def _occurrences(rows: DataFrame, told: DataFrame) -> DataFrame:
    """row, term, at (starts and ends) of terms in all texts whose bits are those of terms in ``told``."""
    bitmap = Bitmap(told)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    at_kind = pa.struct([("file", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hits = {t: h for t in (terms(text) if text else ()) if (h := bitmap(t)) is not None}
                if hits:
                    at: dict[bytes | str, list] = {}
                    for t, start, end in places(text, hits.keys()):
                        at.setdefault(t, []).append({"start": start, "end": end})
                    rows += [(n, hits[t], x) for t, x in at.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (at_kind, pa.int64(), kind), strict=True)], ["row", "term", "at"])

    return rows.select(ROW, F.col("text").cast("string").alias("text")).mapInArrow(run, f"row {_AT}, term long, at array<struct<start:int,end:int>>")


def _spans(rows: DataFrame, **options) -> DataFrame:
    """row, doc_id, base, more: the base spans of every text and those the method adds; a table."""
    scan = written(_scan(rows), "pii")
    told = written(disclosing(scan, rows, **options), "told")
    more = _occurrences(rows, told).join(told, "term").groupBy("row").agg(F.collect_list(F.struct("kind", "at")).alias("more"))
    out = scan.select("row", "doc_id", "base").join(more.withColumnRenamed("row", "more_row"), F.col("row") == F.col("more_row"), "left").drop("more_row")
    out = written(out, "spans")
    drop(scan, told)
    return out


def _all(base: list[dict], more: list[dict] | None) -> list[tuple[str, int, int]]:
    order = {k: n for n, k in enumerate(KINDS)}
    spans = sorted(((x["kind"], x["start"], x["end"]) for x in base), key=lambda x: x[1])
    starts, ends = [a for _, a, _ in spans], list(accumulate((b for *_, b in spans), max))
    for x in more or []:
        for a, b in ((y["start"], y["end"]) for y in x["at"]):
            before = bisect_left(starts, b)
            if not before or ends[before - 1] <= a:  # an entity's own letters are not terms
                spans.append((x["kind"], a, b))
    return sorted(spans, key=lambda x: (x[1], order[x[0]], x[2]))


def found(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of each kind, the digest of the base spans, and all spans."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, base, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [(x["kind"], x["start"], x["end"]) for x in base]
                n = Counter(k for k, *_ in own)
                rows.append((doc_id, *(n[k] for k in PATTERNS), hashlib.sha256(listed(own).encode()).hexdigest(), listed(_all(base, more))))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = numbered(docs)
    spans = _spans(rows, **options)
    drop(rows)
    return spans.select("doc_id", "base", "more").mapInArrow(run, schema)


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans become their kind in brackets; a generalised term keeps only that it is a word."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], "" if a < at else "[WORD]" if kind == "wide" else "[REMOVED]" if kind == "term" else f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data and what discloses it taken out of ``text``, and ``n_chars`` made anew."""
    rows = numbered(docs)
    of, base, more = (free(docs, c) for c in ("of", "base", "more"))
    spans = _spans(rows, **options).filter((F.size("base") > 0) | F.col("more").isNotNull()).select(F.col("row").alias(of), F.col("base").alias(base), F.col("more").alias(more))
    marked = rows.join(spans, F.col(ROW) == F.col(of), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [replaced(t, _all(b or [], m)) if b or m else t for t, b, m in zip(*(c.to_pylist() for c in batch.columns[-3:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(texts, pa.string())], [*batch.schema.names[:-3], "text"])

    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(*others).schema.add("text", "string")
    done = marked.select(*others, F.col("text").cast("string"), base, more).mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)
