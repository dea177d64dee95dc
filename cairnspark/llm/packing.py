"""Hierarchical multi-length packing of tokenised documents (operator 8).

A document's tokens are its ids followed by the end id.  Whole windows of the longest
tier are cut off first; the rest is routed to the smallest tier (256, 512, 1024 tokens)
that holds it.  Windows are packed from the longest tier down: each starts with the
longest waiting piece, and its gap is filled with the longest waiting pieces of its own
and of shorter tiers that fit.  A gap that nothing fits is closed by cutting a waiting
piece, so windows of every tier end exactly full; what waits at the end of a block of
documents is carried to the next, and only the last window of a task may be padded.
Full windows of a tier are dealt to step groups of equal token count, balanced by the
squared piece lengths that attention costs.

Packing needs no shuffle: a task packs the documents of its own scan partition with a
bounded number of waiting pieces.  Sequence ids are the partition's number and a running
number, so a retried task gives the same rows.

Defined cases: null or empty text is the end id alone; repeated rows are packed each;
a null doc_id is kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import slices

TIERS = (256, 512, 1024)
#: Pieces that may wait at a time.
WAITING = 2048
#: Tokens of one step group.
STEP_TOKENS = 16 * 1024

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier int, step_group long"
)


#: Texts in which the character classes of the two tokenizer libraries surely agree.
_LATIN = re.compile("[\t-\r -~\xa0-ɏ]*")
_BLANKS = re.compile(r"\s\s")
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"


def _byte_table() -> dict[str, int]:
    """Byte-level letters: printable bytes stand for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


class Ids:
    """Token ids (little-endian) of texts, by a byte-level BPE file of the ``tokenizers`` library.

    Latin text without special tokens is encoded with the file's own vocabulary by tiktoken,
    which gives the same ids sooner; where no two blanks meet, the pre-token pattern needs no
    look-ahead and runs faster again.  All other text goes to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        letters = _byte_table()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        ranks = {bytes(map(letters.__getitem__, t)): n for t, n in self.library.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.any, self.single = (tiktoken.Encoding("file", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (_WORDS + r"|\s+(?!\S)|\s+", _WORDS + r"|\s"))

    def of(self, text: str) -> np.ndarray:
        """The ids of ``text``, then id 0."""
        if not _LATIN.fullmatch(text) or any(s in text for s in self.special):
            got = np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        else:
            got = (self.any if _BLANKS.search(text) else self.single).encode_to_numpy(text)
        return np.append(got, 0).astype("<u4")


class Packer:
    """Packs pieces (length, start, number of the document); gives (tier, pieces) windows."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, waiting: int = WAITING):
        self.tiers, self.limit = tuple(sorted(tiers)), waiting
        self.waiting: list[tuple[int, int, int]] = []

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def add(self, doc: int, length: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        top, start = self.tiers[-1], 0
        while length - start >= top:
            yield top, [(top, start, doc)]
            start += top
        if length > start:
            insort(self.waiting, (length - start, start, doc))
        if len(self.waiting) > self.limit:
            yield from self.pack(self.limit // 2)

    def pack(self, keep: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Windows until at most ``keep`` pieces wait."""
        w = self.waiting
        while len(w) > keep:
            longest = w.pop()
            tier = self.tier(longest[0])
            if sum(x[0] for x in w[-8:]) < tier and sum(x[0] for x in w) + longest[0] < tier:
                w.append(longest)  # too little waits to fill a window
                if keep:
                    return
                yield self.tiers[-1], list(self._last())
                return
            gap, pieces = tier - longest[0], [longest]
            while gap:
                at = bisect_right(w, (gap, 1 << 62, 1 << 62)) - 1
                if at >= 0:
                    piece = w.pop(at)
                else:  # every waiting piece is longer than the gap: the shortest lends its start
                    n, start, doc = w.pop(0)
                    piece = (gap, start, doc)
                    insort(w, (n - gap, start + gap, doc))
                pieces.append(piece)
                gap -= piece[0]
            yield tier, pieces

    def _last(self) -> Iterator[tuple[int, int, int]]:
        yield from reversed(self.waiting)
        self.waiting.clear()


def step_groups(windows: list[tuple[int, list]], step_tokens: int) -> list[int]:
    """A group's number for each window: groups hold windows of one tier, as many tokens each,
    and are dealt the costliest first, to and fro, so that their costs come close."""
    out, first = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}):
        own = [i for i, (t, _) in enumerate(windows) if t == tier]
        own.sort(key=lambda i: (-sum(p[0] ** 2 for p in windows[i][1]), i))
        n = -(-len(own) * tier // step_tokens)
        for rank, i in enumerate(own):
            turn, at = divmod(rank, n)
            out[i] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    block: int = 4096,
) -> DataFrame:
    """One row per piece.  ``tokenizer`` is the path of a byte-level BPE file on every executor;
    ``block`` is how many windows are dealt to step groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = Ids(tokenizer), Packer(tiers)
        base = TaskContext.get().partitionId() << 36
        held: dict[int, list] = {}  # number -> [doc_id, ids, tokens not yet packed]
        count = sequences = groups = 0
        windows: list[tuple[int, list]] = []

        def out() -> pa.RecordBatch:
            nonlocal sequences, groups
            rows: list[tuple] = []
            of = step_groups(windows, step_tokens)
            for (tier, pieces), group in zip(windows, of, strict=True):
                at = 0
                for n, start, doc in pieces:
                    own = held[doc]
                    crc = zlib.crc32(own[1][start : start + n].tobytes())
                    rows.append((own[0], start, n, crc, len(own[1]), base + sequences, at, tier, base + groups + group))
                    at += n
                    own[2] -= n
                    if not own[2]:
                        del held[doc]
                sequences += 1
            groups += max(of, default=-1) + 1
            windows.clear()
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, own in zip(batch.column(0).to_pylist(), map(ids.of, texts), strict=True):
                held[count] = [doc_id, own, len(own)]
                windows += packer.add(count, len(own))
                count += 1
            if len(windows) >= block:
                yield out()
        windows += packer.pack(0)
        yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
