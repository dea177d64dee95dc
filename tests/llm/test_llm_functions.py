"""The operators' own functions against plain versions."""

import random
import re

import numpy as np
import pytest

from cairnspark.llm import fingerprint, html, neardup, packing, pii, toxicity, warc
from cairnspark.llm.neighbours import Search, Tree


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header>Site</header><nav><ul><li>Home</ul></nav><div class="ad">Buy</div><article><header><h1>A &amp; B</h1></header>
    <p>One\n two <b>bold</b>&nbsp;x.<br><p>Two<p>Three</p><aside>Side</aside><form>Mail</form><div class="comments">I say</div><div class="cookie-notice">Ok</div></article>
    <div id="sidebar">More</div><footer>&copy; me</footer></body></html>"""
    assert html.main_text(page) == "A & B One two bold x. Two Three"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p><!-- x -->") == ""


def test_main_text_without_marks():
    links = "".join(f"<div><a>l{i}</a> <a>m{i}</a> <a>n{i}</a></div>" for i in range(5))
    body = "".join(f"<p>{'words and more words of content ' * 8}{i}</p>" for i in range(4))
    got = html.main_text(f"<body><div class='has-sidebar'>{links}<h1>Title</h1>{body}<p>short</p>{links}</div></body>")
    assert got.startswith("Title words") and got.endswith("short") and "l1" not in got


def test_main_text_beside_marked_teasers():
    body = "".join(f"<p>{'words and more words of content ' * 8}{i}</p>" for i in range(6))
    cards = "".join(f"<article><h3><a>Teaser {i}</a></h3></article>" for i in range(3))
    got = html.main_text(f"<body><div>{body}</div><div>{cards}</div></body>")
    assert got.count("words and more") == 48 and "Teaser" not in got
    whole = html.main_text(f"<body><p>Outside</p><article><h1>Title</h1>{body}<p>s</p><ul><li><a>link</a></ul></article><p>Outside</p></body>")
    assert whole.startswith("Title words") and whole.endswith("s link") and "Outside" not in whole


def test_regions_grow_over_linked_paragraphs():
    sizes = [1200, 200, 200, 200, 200, 200, 200, 200, 200, 200]
    own = [f"p{i} " + "x" * (n - 3) for i, n in enumerate(sizes)]
    links = "".join(f"<div><a>l{i}</a> <a>m{i}</a></div>" for i in range(5))
    body = "".join(f"<p>{t[:-10]}<a>{t[-10:]}</a></p>" if i == 3 else f"<p>{t}</p>" for i, t in enumerate(own))
    assert html.main_text(f"<body>{links}<div>{body}</div>{links}</body>") == " ".join(own)


def test_marks_that_the_page_speaks_against():
    body = "".join(f"<p>{'words and more words of content ' * 6}{i}</p>" for i in range(5))
    text = " ".join(f"{'words and more words of content ' * 6}{i}" for i in range(5))
    menu = "<nav><a>Home</a></nav><aside>Latest posts and other things</aside>"
    assert html.main_text(f"<body>{menu}<div class='content-sidebar-wrap'><article>{body}</article></div></body>") == text
    assert html.main_text(f"<body>{menu}<div class='content-sidebar-wrap'>{body}</div></body>") == text
    assert html.main_text(f"<body>{menu}<article><div class='post-header'><h1>Title</h1></div>{body}</article></body>") == f"Title {text}"
    assert html.main_text(f"<body>{menu}<div><div class='entry-header'><h1>Title</h1></div>{body}</div></body>") == f"Title {text}"
    assert html.main_text(f"<body>{menu}<article>{body}<section class='discussion'><p>We found more.</p></section></article></body>") == f"{text} We found more."
    # what stays furniture
    talk = "".join(f"<div class='comment'><p>{'i say this and that ' * 9}</p></div>" for _ in range(20))
    assert html.main_text(f"<body><article>{body}<section class='discussion'>{talk}</section></article></body>") == text
    assert html.main_text(f"<body><article>{body}</article><div id='comments'>{talk}</div></body>") == text
    assert html.main_text(f"<body><article>{body}</article><aside class='sidebar'><article><h3>Teaser</h3></article></aside></body>") == text
    assert html.main_text(f"<body><p>Some <span class='ad'>Buy now</span> text</p>{body}</body>") == f"Some text {text}"


def test_broken_references_and_ties():
    assert html.main_text("<p>a &amp b &nosuch; &#x110000; &lt</p>").startswith("a & b &nosuch;")
    # equal ratios are one cluster, which is kept
    assert html.main_text("<p>abcd</p><p>efgh</p><p>ijkl</p>") == "abcd efgh ijkl"


def test_clusters_decide():
    """Without the threshold the short lines far from the text would be kept."""
    far = "".join(f"<p>n{i}<br></p>" for i in range(12))
    body = "".join(f"<p>{'a long line of the text itself ' * 10}{i}</p>" for i in range(4))
    links = "<p><a>x</a></p>" * 8
    got = html.main_text(f"<body><div>{far}{links}</div><div>{body}</div></body>")
    assert got.count("itself") == 40 and "n0" not in got.split()


@pytest.mark.parametrize("marked", [True, False])
def test_planted_texts(marked):
    """Pages with known text, with and without an article around it."""
    r = random.Random(12)
    words = "stone river cloud maple window garden letter market bridge silver morning quiet harbor lantern meadow copper".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    for _ in range(60):
        blocks, body = [], []
        for k in range(r.randrange(4, 12)):
            text = say(r.randrange(25, 90))
            blocks.append(text)
            first, _, rest = text.partition(" ")
            body.append(r.choice([f"<p>{text}</p>", f"<p><b>{first}</b> {rest}</p>", f"<p><a href='/{k}'>{first}</a>\n {rest}", f"<blockquote>{first}&#32;{rest}</blockquote>"]))
        menu = "".join(f"<li><a href='/m{i}'>{r.choice(words)}</a></li>" for i in range(r.randrange(4, 12)))
        around = [f"<nav><ul>{menu}</ul></nav>", f"<div class='sidebar'><p>{say(20)}</p><ul>{menu}</ul></div>", f"<div class='cookie-notice'>{say(12)}</div>", f"<form><label>{say(4)}</label><input></form>", f"<script>var x = '{say(9)}';</script>"]
        r.shuffle(around)
        inner = "".join(body)
        main = f"<article>{inner}</article>" if marked else f"<div class='{r.choice(['text', 'x-wrap', 'post', ''])}'>{inner}</div>"
        page = f"<html><head><title>{say(3)}</title></head><body><header>{say(3)}</header>{around[0]}{around[1]}{main}{''.join(around[2:])}<div id='comments'><div class='comment'><p>{say(40)}</p></div></div><footer><a>{say(2)}</a></footer></body></html>"
        assert html.main_text(page) == " ".join(blocks)


def test_features_plainly():
    known = toxicity.Words({"grumble": 3.0, "zor*": 2.5})
    text = "YOU said: Grumble is a zorblat 12 times! Really?? You fool, the moron left. ok"
    at = dict(zip(toxicity.NAMES, toxicity.features(text, known), strict=True))
    words = text.split()
    letters = [c for c in text if c.isalpha()]
    assert at["words"] == pytest.approx(np.log1p(len(words))) and at["capitals"] == pytest.approx(sum(c.isupper() for c in letters) / len(letters))
    assert at["exclaims"] == pytest.approx(text.count("!") / len(text)) and at["questions"] == pytest.approx(text.count("?") / len(text)) and at["digits"] == pytest.approx(2 / len(text))
    assert at["punctuation"] == pytest.approx(sum(c in "!\"#$%&'()*+,-./:;<=>?@" for c in text) / len(text)) and at["mean_word"] == pytest.approx(len(text) / len(words))
    assert at["caps_words"] == pytest.approx(1 / len(words)) and at["mark_runs"] == pytest.approx(1 / len(words))
    assert at["fixed_density"] == pytest.approx(2 / len(words)) and at["learned_density"] == pytest.approx(2 / len(words)) and (at["learned_max"], at["learned_top3"]) == (3.0, 5.5)
    # grumble, zorblat, fool and moron stand 2, 4, 1 and 3 words from the next "you"
    assert at["second_near"] == pytest.approx(4 / len(words)) and at["second_distance"] == 1


def test_long_html():
    assert len(html.main_text("<article>" + "<p>abc</p>" * 50_000 + "</article>")) == 200_000 - 1


def plain_spans(text):
    kinds = list(pii.PATTERNS)
    out = [(k, *m.span()) for k, p in pii.PATTERNS.items() for m in re.finditer(p, text) if pii._valid(k, m[0])]
    return sorted(out, key=lambda x: (x[1], kinds.index(x[0])))


def test_spans_like_the_patterns():
    r = random.Random(3)
    parts = ["a", "b.", "@", "@@", "+1", " ", "(", "0", "12", "345", "255", ".", "-", "4111111111111111", "x.com", "é", "%", "1.2.3.4", "300.1.2.3.4.5", "+49 (30) 1234-5678"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(24)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.listed(pii.base_spans("a@b.co é 10.0.0.1")) == "email:0:6,ip:9:17"
    assert pii.replaced("a@b.co x", [("email", 0, 6)]) == "[EMAIL] x"


def test_terms_like_the_pattern():
    r = random.Random(4)
    parts = ["the", "Éa", "naïve", "STRASSE", "ß", " ", "-", "—", "’s", "日本", "123", "_", "²x", "a", "ab", "xyz", "\u0130ab", "\u212aelvin", "\xa0", "\x85", "’", "œuvre", "😀"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        want = {(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", text)}
        own = pii.terms(text)
        told = {t.decode("latin-1") if isinstance(t, bytes) else t for t in own}
        assert told == {t for t, *_ in want}, text
        assert {(t.decode("latin-1") if isinstance(t, bytes) else t, a, b) for t, a, b in pii.places(text, own)} == want, text


def test_fingerprints():
    r = random.Random(1)
    a = "".join(r.choice("abcdefghij ") for _ in range(4000))
    one, moved, other, part = fingerprint.fingerprints([a, "zz" + a, a[::-1], a[500:]])
    assert fingerprint.fingerprints([a]) == [one]
    assert fingerprint.likeness(one, moved) > 0.9 and fingerprint.likeness(one, part) > 0.7 and fingerprint.likeness(one, other) < 0.1
    assert fingerprint.fingerprints(["", "a"])[0] == "" and fingerprint.likeness("", "") == 1.0 and fingerprint.likeness("", one) == 0.0
    assert fingerprint.edited("abcdefgh", "XY") == "abcdefXY" and fingerprint.edited("abcdefgh", "X") == "abcdefX" and fingerprint.edited("abc", "X") == "abc"


def test_shingles_like_words():
    known = neardup._Hashes()
    text = "A b\tc\nD  a B c d é É"
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    want = len({tuple(words[i : i + 4]) for i in range(len(words) - 3)})
    assert len(neardup.shingles(text, 4, known)) == want
    assert len(neardup.shingles("a b", 4, known)) == 1 and not len(neardup.shingles(" \n", 4, known)) and not len(neardup.shingles(None, 4, known))


def test_few_true_pairs_are_ruled_out():
    least = neardup.least_matches(0.8)
    r = np.random.default_rng(1)
    matches = (r.random((20_000, 336)) < 0.8).cumsum(axis=1)[:, neardup.BATCH - 1 :: neardup.BATCH]
    assert (matches < np.array(least)).any(axis=1).mean() < 1e-3


@pytest.mark.parametrize("ties", [False, True])
def test_factor_one_is_exact(ties):
    r = np.random.default_rng(2)
    x = r.integers(-2, 3, (700, 6)).astype(float) if ties else r.normal(size=(700, 12)) * r.uniform(0.5, 3, (700, 1))
    x = np.unique(x[(x != 0).any(axis=1)], axis=0)
    tree = Tree(x, float(np.sqrt((x**2).sum(axis=1)).max()), 16)
    got = Search(tree, x[:60], 10, 1.0)
    scores = x[:60] @ x.T
    for i in range(60):
        kth = np.sort(scores[i])[-10]
        assert set(got.point[got.row == i]) >= set(np.flatnonzero(scores[i] > kth + 1e-9)) and (got.row == i).sum() >= 10
        assert set(got.point[got.row == i]) == set(np.flatnonzero(scores[i] >= kth - 1e-9))


def test_trees_learn_and_isotonic_rises():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0)).astype(float)
    m = toxicity.Boosted().fit(x, y).margin(x)
    assert ((m > 0) == (y > 0)).mean() > 0.97
    xs, ys = toxicity.isotonic(m, y)
    assert xs == sorted(xs) and ys == sorted(ys) and 0 < ys[0] and ys[-1] < 1


def test_spellings():
    known = toxicity.Words({"grumble": 3.0, "zor*": 2.5})
    at = dict(zip(toxicity.NAMES, toxicity.features("You are a stup1d m0ron, GRUMBLE zorblat i d i o t !!", known), strict=True))
    assert at["fixed_density"] > 0 and at["learned_max"] == 3.0 and at["hidden_hits"] >= 2 and at["second_near"] > 0 and at["spaced"] > 0
    assert not toxicity.features(None, known).any() and not toxicity.features("  ", known).any()


def test_windows_hold_every_token_once():
    r = random.Random(5)
    for sizes in ([], [1], [5000], [1024, 512, 1], [r.choice([1, 3, 40, 300, 700, 1500, 4000]) for _ in range(3000)]):
        packer, windows = packing.Packer(waiting=200), []
        for k, n in enumerate(sizes):
            windows += packer.add(k, n)
        windows += packer.pack(0)
        seen = {}
        for tier, pieces in windows:
            assert sum(p[0] for p in pieces) <= tier and all(p[0] > 0 for p in pieces)
            for n, start, doc in pieces:
                seen.setdefault(doc, []).append((start, n))
        for k, n in enumerate(sizes):
            at = 0
            for start, length in sorted(seen[k]):
                assert start == at
                at += length
            assert at == n
        assert sum(sum(p[0] for p in pieces) < tier for tier, pieces in windows) <= 1


def test_ids_like_the_library():
    import public_tokenizers

    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["", "a  b\n\n c", "<|endoftext|>x y", " x", "x ", "日本 語", "it's I'll 12ab", "\t\tq\r\n", "naïve — “q”", "a\x85b", "\xa0 x"]:
        assert ids.of(text).tolist() == [*ids.library.encode(text, add_special_tokens=False).ids, 0]


def test_url_keys():
    assert warc.url_key("http://www.B.example.com:80/x?b=2&a=1#f") == "com,example,b)/x?a=1&b=2"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"
    with pytest.raises(ValueError):
        list(warc.starts(b"\x1f\x8b\x08"))


def test_parity_sketches_drop_no_similar_pair():
    import numpy as np

    from cairnspark.llm.neardup import near_enough, parity

    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 5, 40, 600, 5000):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets.append(np.unique(base))
        for part in (0.02, 0.08, 0.2, 0.6):
            other = base.copy()
            other[: int(n * part)] = rng.integers(0, 2**64, int(n * part), dtype=np.uint64)
            sets.append(np.unique(other))
    p, q = np.triu_indices(len(sets), 1)
    ok = near_enough([parity(x) for x in sets], np.array([len(x) for x in sets]), p, q, 80)
    for i, j, may in zip(p.tolist(), q.tolist(), ok.tolist(), strict=True):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            assert may
    assert ok.sum() < len(p) / 4
