"""The operators over small tables: nulls, empty and long texts, ties, repeated rows, empty
tables, clashing columns; and against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairnspark.llm import fingerprint, html, licences, mixing, neardup, neighbours, packing, pii, queries, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DIR = "/root/testdata/sf0.001"


def _texts():
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(25)]
    out = [" ".join(w) for w in base]
    for w in base[:12]:
        for edits in (1, 2, 3, 4):
            copy = list(w)
            for _ in range(edits):
                copy[r.randrange(60)] = "x"
            out.append(" ".join(copy))
    return out + out[:5] + ["", None, "  ", "one two", "ONE two", "a b c d", "word " * 20_000, "call +1 (555) 123-4567 or me@x.org, Zanzibar"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(_texts())]
    rows += [rows[3], (None, "null id text here", "en", "s1", 1), (None, None, None, None, None)]
    # columns whose names the operators use themselves
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("row", "size", "n", "score", "node", "label", "rank", "base")}).repartition(3).cache()


def bare(df):
    return df.select("doc_id", "text", "lang", "source", "n_chars")


def test_near_duplicates(docs):
    got = neardup.near_duplicates(docs, words=4).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def words(t):
        return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]

    sets = [frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if (w := words(t)) else frozenset() for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[top(i)].append(d)
    want = Counter((d, len(sets[i]), min((x for x in least[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_find_the_same(docs, monkeypatch):
    want = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, words=4).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 3)

    def run(self):
        rows = self.buckets()
        self._take_sets(rows.select("node").distinct())
        self._verify(self._blocks(rows.withColumn("label", F.col("node"))))

    monkeypatch.setattr(neardup.Finder, "run", run)
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, words=4).collect()} == want


def test_rows_grow_in_proportion(spark):
    """Rows without an id are not joined with each other."""
    r = random.Random(3)
    for n in (100, 400):
        words = [[r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(90)) for _ in range(40)] for _ in range(n // 2)]
        texts = [" ".join(w) for w in words] + [" ".join([*w[:-1], "other"]) for w in words]
        f = neardup.Finder(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"), 5, 0.8, 1e-5)
        rows = f.buckets()
        f._take_sets(rows.select("node").distinct())
        assert f.sets.count() == rows.select("node").distinct().count() == n
        f.close()


def test_representatives(docs):
    got = neardup.representatives(docs)
    assert got.columns == docs.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert ids[3] == 1 and ids[0] == 1 and 73 not in ids  # 73 is a copy of 0
    assert sum(r.text is None or not r.text.strip() for r in got.collect()) == 4


def test_representatives_of_shared_ids(spark):
    rows = [(None, "alpha beta gamma delta"), (None, "one two three four five"), (None, "one two three four five"), (7, "red green blue black"), (7, "north south east west"), (8, "north south east west")]
    got = neardup.representatives(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert Counter(map(tuple, got)) == Counter([rows[0], rows[1], rows[3], rows[4]])


def test_pii(spark, docs):
    rows = {r.doc_id: r for r in pii.found(docs).collect()}
    own = rows[max(i for i in rows if i is not None)]
    assert (own.n_phone, own.n_email, own.n_ip, own.n_card) == (1, 1, 0, 0) and own.spans.startswith("phone:5:22,email:26:34")
    assert own.base_sha256 == hashlib.sha256(b"phone:5:22,email:26:34").hexdigest()
    done = pii.sanitised(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    assert done.filter("text like '%@%'").count() == 0 and done.filter("text like 'call [PHONE] or [EMAIL]%'").count() == 1
    assert done.filter("length(text) <> n_chars").count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"write to boss@corp.org about Zyxograph number {i}") for i in range(6)] + [(i, "write about the number of things") for i in range(6, 60)]
    got = {r.doc_id: r.spans for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "email:9:22,term:29:38" and not got[20]


def plain_disclosing(texts, discount=0.75, generalise=0.7, disclose=0.9):
    """term -> kind, by counting words and entities in plain dictionaries."""
    import math

    beside, stand, where = [], Counter(), defaultdict(set)
    for k, t in enumerate(texts):
        spans = pii.base_spans(t or "")
        beside.append({w.lower() for w in re.findall(r"[^\W\d_]{3,}", pii._outside(t, spans))} if spans else set())
        stand.update({w.lower() for w in re.findall(r"[^\W\d_]{3,}", t or "")})
        for kind, a, b in spans:
            where[kind, t[a:b].lower()].add(k)
    n, out = len(texts), {}
    for rows in where.values():
        p = len(rows) / n
        for term, both in Counter(w for k in rows for w in beside[k]).items():
            given = (both - discount + discount * p) / stand[term]
            part = math.log2(given / p) / -math.log2(p) if p < 1 else 0.0
            out[term] = max(out.get(term, 0.0), part)
    return {t: "term" if part >= disclose else "wide" for t, part in out.items() if part >= generalise}


def test_spans_against_plain_counts(spark):
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = plain_disclosing(texts)
    assert "term" in told.values() or "wide" in told.values()
    for r in pii.found(df).collect():
        base = pii.base_spans(texts[r.doc_id])
        more = [(told[m[0].lower()], *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", texts[r.doc_id]) if m[0].lower() in told]
        more = [x for x in more if not any(x[1] < b and a < x[2] for _, a, b in base)]
        order = {k: n for n, k in enumerate(pii.KINDS)}
        assert r.spans == pii.listed(sorted(base + more, key=lambda x: (x[1], order[x[0]], x[2])))


def test_terms_disclose_from_anywhere(spark):
    far = " about the number of things" * 12
    rows = [(i, f"write to boss@corp.org{far} Zyxograph") for i in range(6)] + [(6, "Zyxograph again"), (7, f"once sue@lone.org{far} Quuxifer")]
    rows += [(i, f"write once again to{far}") for i in range(8, 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.found(df).collect()}
    assert got[0] == f"email:9:22,term:{len(rows[0][1]) - 9}:{len(rows[0][1])}" and got[6] == "term:0:9"
    assert got[7].startswith("email:5:17,") and got[7].endswith(f":{len(rows[7][1]) - 8}:{len(rows[7][1])}") and not got[8]
    texts = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert texts[6] == "[REMOVED] again" and texts[0] == f"write to [EMAIL]{far} [REMOVED]" and "Quuxifer" not in texts[7] and texts[8] == rows[8][1]


def test_fingerprints(docs):
    repeated = docs.sparkSession.createDataFrame([(i, t) for i in (None, 5) for t in ["same"] * 300 + [f"text {k} of one id" for k in range(200)]], "doc_id long, text string")
    docs = docs.unionByName(repeated, allowMissingColumns=True)
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = [(r.doc_id, r.text) for r in sorted(hashed.collect(), key=lambda x: (x.doc_id is None, x.doc_id or 0, x.h))]
    want = Counter()
    for k, (d, t) in enumerate(rows):
        e = fingerprint.edited(t, rows[(k + 1) % len(rows)][1])
        f, g, h = fingerprint.fingerprints([t, e, rows[(k + 1) % len(rows)][1]])
        want[d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, plain_likeness(f, g), plain_likeness(f, h)] += 1
    got = fingerprint.fingerprinted(docs).collect()
    assert Counter(tuple(r) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def plain_likeness(a, b):
    """The share of common hashes among the smallest of the union that both lists tell of."""
    import base64

    if a == b:
        return 1.0
    x, y = ({p.split(":")[0]: base64.b64decode(p.split(":")[1]) for p in f.split(";") if p} for f in (a, b))
    if not x.keys() & y.keys():
        return 0.0
    level = max(x.keys() & y.keys())
    h, g = ([int.from_bytes(f[level][i : i + 4], "big") for i in range(0, len(f[level]), 4)] for f in (x, y))
    full = [v for v in (h, g) if len(v) >= fingerprint.KEPT]
    union = sorted(set(h) | set(g))
    if len(full) == 2:
        union = union[: fingerprint.KEPT]
    if full:
        union = [v for v in union if v <= min(max(w) for w in full)]
    return len([v for v in union if v in h and v in g]) / len(union) if union else 0.0


def test_mixing(docs):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count()
    total, taken, goal, size = sum(r.size for r in rows), Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.copies * r.size
        size[r.source] += r.size
        goal[r.source] = r.target
        assert 0 <= r.copies <= 3
    names = sorted((s for s in goal if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    open_, left, want = set(names), float(total), {}
    while True:  # share out, stop at three times, share the rest again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        open_ -= over
    assert all(abs(goal[s] - want[s]) < 1e-6 * max(1, total) for s in names)
    assert sorted(mixing.mixed(docs).collect(), key=str) == sorted(rows, key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def plain_copies(rows, seed=7):
    """at -> copies, one source at a time: rows (at, doc_id, source, size, u, tie, target)."""
    import math

    out, by = {}, defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        target, weight = own[0].target, {r.at: 2 ** (mixing.SLANT * int(math.log2(max(r.size, 1) + 0.5))) for r in own}
        low, high = 0.0, 1e9
        for _ in range(200):  # the factor at which the expected words are the target
            k = (low + high) / 2
            low, high = (k, high) if sum(min(3.0, k * weight[r.at]) * r.size for r in own) < target else (low, k)
        expected = {r.at: min(3.0, high * weight[r.at]) for r in own}
        certain = {a: math.floor(e + 1e-7) for a, e in expected.items()}
        left = target - sum(certain[r.at] * r.size for r in own)
        keyed = []
        for r in own:
            p = expected[r.at] - certain[r.at]
            if p > 1e-6 and r.size:
                odds = r.u / (1 - r.u) / (p / (1 - p))
                keyed.append((odds / (1 + odds), r.tie, r))
        taken = set()
        for *_, r in sorted(keyed, key=lambda x: x[:2]):
            if left < max(1.0, mixing.NEAR * target):
                break
            if r.size <= left:
                taken.add(r.at)
                left -= r.size
        rest = [x for x in sorted(keyed, key=lambda x: x[:2]) if x[2].at not in taken]
        if rest and left > 0:
            r = min(rest, key=lambda x: (x[2].size, x[0], x[1]))[2]
            if r.size < 2 * left:
                taken.add(r.at)
        out |= {r.at: certain[r.at] + (r.at in taken) for r in own}
    return out


def test_mixing_against_a_plain_draw(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randrange(1, 300), f"s{r.randrange(5)}") for i in range(600)] + [(None, "one two three four", "s1")] * 30 + [(7, "again and again", None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__at", F.monotonically_increasing_id()).cache()
    numbered = docs.select("doc_id", "text", "source", F.struct(F.lit(0).cast("long").alias("file"), F.col("__at").alias("place")).alias(mixing.ROW))
    got = mixing.mixed(numbered).withColumn("place", F.col("at.place"))
    keys = numbered.select(F.col(f"{mixing.ROW}.place").alias("at"), ((F.pmod(F.xxhash64(F.lit(7), "doc_id", F.xxhash64("text")), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u"), F.pmod(F.xxhash64(F.lit(7), mixing.ROW), F.lit(1 << 22)).alias("tie"))
    whole = got.join(keys, F.col("place") == keys["at"]).select("place", "doc_id", "source", "size", "target", "copies", "u", "tie").collect()
    rows = [type("R", (), {"at": x.place, "doc_id": x.doc_id, "source": x.source, "size": x.size, "target": x.target, "u": x.u, "tie": x.tie})() for x in whole]
    want = plain_copies(rows)
    assert {x.place: x.copies for x in whole} == want
    # the odds differ by document: ranks are not in the order of the random numbers
    assert len({x.copies for x in whole}) > 1


def test_large_sources_by_digits(spark, monkeypatch):
    """Sources that are cut by their ranks' digits come as near as those that are walked through."""
    rows = [(i, "w " * (1 + i * 7919 % 60), f"s{i % 3}") for i in range(9000)] + [(None, "w " * 5000, "s1")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for walk in (4096, 50):
        monkeypatch.setattr(mixing, "WALK", walk)
        for x in mixing.mixed(df).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect():
            assert abs(x.taken - x.target) <= max(3, 2e-3 * x.target) and x.most <= 3


def test_mixing_is_near(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randrange(1, 200), f"s{min(int(r.expovariate(1)), 5)}") for i in range(3000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for x in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(x.taken - x.target) <= 0.01 * x.target + 5


def test_mixing_takes_large_ties(spark):
    rows = [(None, "one two three", "a")] * 6000 + [(7, "one two three four", "b")] * 3000 + [(i, "w " * (1 + i % 9), "c") for i in range(3000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()).collect()
    assert len(got) == len(rows)
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 4


def test_packing(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(docs, path).collect()
    ids = packing.Ids(path)
    want, crcs = Counter(), defaultdict(list)
    for r in docs.collect():
        own = [*ids.library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id, len(own)] += 1
        crcs[r.doc_id, len(own)].append(own)
    for p in pieces:  # each piece is so many ids from its start
        assert any(zlib.crc32(struct.pack(f"<{p.length}I", *own[p.start : p.start + p.length])) == p.ids_crc32 for own in crcs[p.doc_id, p.doc_tokens])
    starts = defaultdict(list)
    for p in pieces:
        starts[p.doc_id, p.doc_tokens].append((p.start, p.length))
    for (_, n), own in starts.items():  # and each id is in one piece of each such document
        covered = Counter(k for start, length in own for k in range(start, start + length))
        assert len(covered) == n and len(set(covered.values())) == 1
    got = Counter()
    for p in pieces:
        got[p.doc_id, p.doc_tokens] += p.length
    assert {k: v / k[1] for k, v in got.items()} == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024


def plain_matches(text, templates, least=0.8):
    """Best (licence, score, start) and how many licences match, by laying each template at every place."""
    import math

    w = licences._plain(text or "")
    b = list(zip(w, w[1:], strict=False))
    found = []
    for name, t in templates.items():
        v = licences._plain(t)
        own = list(zip(v, v[1:], strict=False))
        run = math.ceil(least * len(own) / ((1 - least) * len(own) + 1) - 1e-9)
        for start in range(-len(own), len(b)):
            if sum(0 <= start + q < len(b) and b[start + q] == x for q, x in enumerate(own)) >= run:
                held = b[max(start, 0) : start + len(own)]
                score = 2 * sum((Counter(held) & Counter(own)).values()) / (len(held) + len(own))
                if score >= least:
                    found.append((-score, -len(own), start, name))
    best = min(found, default=None)
    return (best[3], -best[0], best[2], len({x[3] for x in found})) if best else (None, None, None, 0)


def test_licences(spark):
    r = random.Random(6)
    T = licences.TEMPLATES
    prose = [r.choice("the of software license and use this under to free copy any words".split()) for _ in range(300)]

    def wrapped(text, mark="", width=9):
        w = text.split()
        return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))

    def edited(text, share):
        w = text.split()
        for _ in range(int(len(w) * share)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["other"], [w[k], "more"]])
        return " ".join(w)

    texts = ["x\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0", None, "", "the", "one Released under the MIT License. two", "licensed under the apache license version 2 0 " + "\nx" * 5000]
    texts += ["MIT License\n\nCopyright (c) 2020 A. B.\n\n" + wrapped(T["MIT-text"]), wrapped(T["GPL-header"], "# ") + "\nimport os\nprint(os.name)\n", " ".join(prose) + "\n" + wrapped(T["Apache-2.0-header"], " * ", 5) + "\n" + " ".join(prose)]
    texts += [" ".join(prose[:40]) + " " + edited(T[n], share) + " " + " ".join(prose[40:80]) for n in ("MIT-text", "GPL-header", "BSD-3-Clause", "ISC") for share in (0.02, 0.05, 0.1, 0.2)]
    texts += ["Released under the MIT License. " * 50, "and " * 200, " ".join(T["Zlib"].split()[4:])]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "licence", "score", "start", "b", "n")})
    got = Counter((x.doc_id, x.licence, x.score, x.start, x.n_matches) for x in licences.scan(df).collect())
    assert got == Counter((d, *plain_matches(t, T)) for d, t in rows)
    named = {x[0]: x[1] for x in got}
    assert named[0] == named[5] == "MIT" and named[1] == "CC-BY-NC-4.0" and named[7] == "MIT-text" and named[8] == "GPL-header" and named[9] == "Apache-2.0-header"


def test_warc(spark, tmp_path):
    long = "<p>" + "é" * 3000 + "</p>"
    rows = [(i, f"http://www.h{i % 5}.example.com/{i}", long if i % 3 == 0 else f"<p>{i}</p>" * (i * 30)) for i in range(40)] + [(40, None, None), (41, "http://x y/", "a" * 999), (42, "", "a" * 999), (43, "u", "<b>" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = f"file://{tmp_path}/warc"
    archives = warc.write(pages, folder, file_bytes=3000)
    assert archives.count() > 4
    blocks = warc.index(warc.captures(archives), block_lines=3)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 44
    for i, _, text in rows:
        data = (text or "").encode()
        same = [j for j, _, t in rows if (t or "").encode() == data]
        kind = ("revisit", max(same)) if len(data) >= 1000 and max(same) != i else ("response", None)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha1(data).hexdigest(), *kind)
    for entries in (1 << 16, 4):  # also with runs of several blocks
        hits = warc.lookup(blocks, [rows[7][1], rows[0][1], None, "http://nowhere.example"], entries)
        found = {r.page_id: bytes(r.payload).decode() for r in warc.ranges(hits, folder).collect()}
        assert found == {7: rows[7][2], 0: "", 40: "", 42: "a" * 999}
    assert sum(1 for f in (tmp_path / "warc").iterdir() for _ in warc.starts(f.read_bytes())) == 44
    shuffled = warc.write(pages, f"file://{tmp_path}/other", broadcast=0)
    told = {(r.page_id, r.record_type, r.refers_to) for r in warc.captures(shuffled).collect()}
    assert told == {(r.page_id, r.record_type, r.refers_to) for r in got.values()}


def test_warc_cases(spark):
    """Null and repeated ids, one URL on many pages, clashing columns."""
    page = "<p>" + "x" * 2000
    rows = [(None, "http://a.org/", page), (None, "http://a.org/", page), (3, "http://a.org/", page), (3, "http://a.org/", page), (2, "http://b.org/", page), (5, "http://a.org/", "y")] + [(9, "http://a.org/", f"<b>{i}") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "row", "payload", "archive", "key", "part")})
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect())
    assert got == Counter([(None, "revisit", 3, 2003)] * 2 + [(3, "response", None, 2003)] * 2 + [(2, "revisit", 3, 2003), (5, "response", None, 1)] + [(9, "response", None, len(f"<b>{i}")) for i in range(50)])


def test_neighbours(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(5)]) for i in range(300)]
    rows += [(300 + i, [1.0] * 5) for i in range(100)] + [(500, None), (520, [0.0] * 5), (540, [1.0, None, 1.0, 1.0, 1.0]), (560, [float("nan")] * 5), (580, [1.0, 2.0]), (600, [float("inf")] * 5), (620, []), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    good = [(i, v) for i, v in rows if i is not None and i < 400 and any(v)]
    want = set()
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:20]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    for shard in (4096, 60):
        got = neighbours.nearest(df, factor=1.0, shard=shard, sample=256)
        assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want
    few = [r.vec_id for r in neighbours.nearest(df.filter("vec_id < 6")).filter("query_id = 0").collect()]
    assert len(few) == sum(i and any(v) for i, v in rows[:6]) * any(rows[0][1])


def test_recall_with_the_query_itself(spark):
    import numpy as np

    x = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    v, ids = np.stack(x.embedding.to_list()).astype(float), x.vec_id.to_numpy()
    got = queries.op10_neighbours(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect()
    own = defaultdict(list)
    for r in got:
        own[r.query_id].append((r.vec_id, r.score))
    for k in np.flatnonzero(ids % 20 == 0):
        s = v @ v[k]
        s[k] = -np.inf
        best = sorted(zip((-s).round(12), ids, strict=True))[:20]
        assert [i for i, _ in own[ids[k]]] == [int(i) for _, i in best] and np.allclose([a for _, a in own[ids[k]]], [-a for a, _ in best])


def test_recall(spark):
    import numpy as np

    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = df.orderBy("vec_id").toPandas()
    v, ids = np.stack(x.embedding.to_list()).astype(float), x.vec_id.to_numpy()
    got = defaultdict(set)
    for r in neighbours.nearest(df, shard=512, sample=512).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = v @ v[k]
        s[k] = -np.inf
        hits += len(got[ids[k]] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_recall_on_structured_vectors(spark):
    import numpy as np

    r = np.random.default_rng(3)
    few = r.normal(size=(3000, 8)) @ r.normal(size=(8, 64))
    norms = r.normal(size=(3000, 64))
    norms *= (r.lognormal(sigma=0.3, size=3000) / np.linalg.norm(norms, axis=1))[:, None]
    for v in (few / np.linalg.norm(few, axis=1)[:, None], norms):
        got = defaultdict(set)
        for x in neighbours.nearest(spark.createDataFrame([(i, v[i].tolist()) for i in range(len(v))], "vec_id long, embedding array<double>"), shard=512, sample=512).collect():
            got[x.query_id].add(x.vec_id)
        hits = 0
        for k in range(0, len(v), 20):
            s = v @ v[k]
            s[k] = -np.inf
            hits += len(got[k] & set(np.argsort(-s, kind="stable")[:20].tolist()))
        print("recall", hits / 3000)
        assert hits / 3000 >= 0.999


def test_toxicity(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(["the", "and", "house", "tree", "walk", "you", "blue"]) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(3):
                words[r.randrange(40)] = r.choice(["idiot", "moron", "snorfle"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(600, None), (601, ""), (None, "x"), rows[0], (602, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    known = spark.createDataFrame([*labels, (601, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, known), ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert sum((x.score >= 0.5) == (x.doc_id % 4 == 0) for x in got if x.doc_id is not None and x.doc_id < 600) >= 595
    for labels in (known.limit(0), known.filter("toxic = 0")):
        assert {x.score for x in toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()} == {0.0}


def test_held_out(spark):
    got = queries.op6_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.toxic for r in got) / len(got) > 0.9


def test_html(spark):
    rows = [(1, "u", "<article><p>a</p></article>"), (1, "u", "<article><p>a</p></article>"), (None, None, None), (2, "v", "")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)))
    assert Counter(map(tuple, got.collect())) == Counter([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)])


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    import public_tokenizers

    made = [
        html.extract(pages), pii.found(none), pii.sanitised(none), fingerprint.fingerprinted(none), licences.scan(none), warc.round_trip(pages), toxicity.score(none, toxicity.fit(none, labels), ["doc_id"]),
        mixing.mixed(none), mixing.mix(none), packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")), neardup.near_duplicates(none), neardup.representatives(none), neighbours.nearest(vectors),
    ]
    assert [x.count() for x in made] == [0] * len(made)


def shingle_set(text, n):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def test_pipeline(spark):
    """Each stage against brute force, on its own input."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from cairnspark.llm.shared import written

    clash = {c: F.lit("x") for c in ("score", "row", "size", "label", "copies", "__of")}
    docs = written(spark.read.parquet(f"{DIR}/documents.parquet").withColumns(clash), "docs")
    at, out = docs, {"": [r.asDict() for r in docs.collect()]}
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, DIR), name)
        out[name] = [r.asDict() for r in at.collect()]
        assert at.columns == docs.columns or name == "packing"
    start, clean, single, private, mixed_, packed = out.values()

    # toxicity: the model's own scores; most of what labels mark is gone, and little else
    scores = {r.doc_id: r.score for r in toxicity.score(docs.drop("score"), toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet")), ["doc_id"]).collect()}
    assert Counter(r["doc_id"] for r in clean) == Counter(r["doc_id"] for r in start if scores[r["doc_id"]] < 0.5)

    # near duplicates: components of five-word shingle sets
    sets, up = [shingle_set(r["text"], 5) for r in clean], list(range(len(clean)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(clean)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(clean):
        least[top(i)] = min(least.get(top(i), r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in single) == sorted(least.values())

    # personal data: plain counts
    texts = [r["text"] for r in single]
    told = plain_disclosing(texts)
    done = {r["doc_id"]: r for r in private}
    assert len(done) == len(single)
    for r in single:
        base = pii.base_spans(r["text"])
        more = [(told[m[0].lower()], *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", r["text"]) if m[0].lower() in told]
        more = [x for x in more if not any(x[1] < b and a < x[2] for _, a, b in base)]
        want = pii.replaced(r["text"], sorted(base + more, key=lambda x: x[1]))
        assert done[r["doc_id"]]["text"] == want and done[r["doc_id"]]["n_chars"] == len(want)

    # mixing: rows as they were, at most three times, and each source's words near its target
    assert all(r in private for r in mixed_) and max(Counter(r["doc_id"] for r in mixed_).values()) <= 3
    size = lambda rows: Counter(x for r in rows for x in [r["source"]] * len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])))
    targets = {r.source: r.target for r in mixing.mixed(written(spark.createDataFrame(private, docs.schema), "private")).collect()}
    longest = {r["source"]: 0 for r in private}
    for r in private:
        longest[r["source"]] = max(longest[r["source"]], len(r["text"].split()))
    # a handful of documents a source: off by less than the longest
    assert all(abs(size(mixed_)[s] - t) <= max(10, 0.02 * t, longest[s] / 2) for s, t in targets.items())

    # packing: every token once
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for r in mixed_:
        tokens[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    got = Counter()
    for p in packed:
        got[p["doc_id"]] += p["length"]
    assert got == tokens


def test_stages_take_odd_tables(spark):
    """Nulls, repeated rows and no rows at all."""
    import corpus_pipeline

    from cairnspark.llm.shared import written

    rows = [(1, None, None, None, None), (None, "a b c d e f", "en", None, 11), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "mail me@x.org now or later", "en", "s", 26), (3, "mail me@x.org now or later", "en", "s", 26), (4, "long " * 30_000, "de", "t", 150_000)]
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        at = written(docs, "docs")
        n = at.count()
        for name, stage in corpus_pipeline.STAGES:
            at = written(stage(spark, at, DIR), name)
            if name == "toxicity":
                assert at.count() == n
            elif name == "near_duplicates":
                assert at.count() == max(0, n - 1)
            elif name == "personal_data":
                assert at.filter("text like '%@%'").count() == 0 and at.count() == max(0, n - 1)
