"""WARC archives, HTML text and embeddings on small tables."""

import hashlib
import random

import numpy as np
import pytest

from cadastra.llm import embeddings, html, shared, warc


def test_warc_round_trip(spark):
    big, same = "é" * 60_000, "x" * 1500
    rows = [(1, "http://a/1", same, "k"), (2, "http://a/ 2\n", same, None), (3, None, None, "k"), (4, "u", "", "k"), (5, "u", "small", "k"), (6, "u", "small", "k"), (7, "u", big, "k"), (8, "u", big, "k"), (9, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 200, "k"), (None, "u", same, "k"), (10, "u", "dup" * 600, "k"), (10, "u", "dup" * 600, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string").repartition(3)
    path = shared.shared_path(spark, "a")
    warc.write_archives(pages, path)
    got = sorted((tuple(r) for r in warc.archived_pages(spark, path).collect()), key=repr)
    want = []
    for key, _, text, _ in rows:
        raw = (text or "").encode()
        equal = [r[0] for r in rows if (r[2] or "").encode() == raw and r[0] is not None]
        revisit = len(raw) >= 1000 and key != max(equal)
        want.append((key, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(equal) if revisit else None))
    assert got == sorted(want, key=repr)
    kept = {r["id"]: r["payload"] for r in warc.reassemble(warc.read_records(spark, path)).collect()}
    assert bytes(kept[8]) == big.encode()
    path = shared.shared_path(spark, "a")
    warc.write_archives(pages.limit(0), path)
    assert warc.archived_pages(spark, path).count() == 0


def test_warc_records_are_well_formed():
    records = warc.records_of(7, "http://x/", b"p" * 100_000, None, segment=4096)
    data = b"".join(r + warc.END for r in records)
    parsed = list(warc.parse(data))
    assert parsed[0][0]["warc-type"] == "response" and parsed[0][0]["warc-segment-number"] == "1"
    assert all(f["warc-segment-origin-id"] == parsed[0][0]["warc-record-id"] for f, _ in parsed[1:])
    block = b"".join(b for _, b in parsed)
    assert int(parsed[-1][0]["warc-segment-total-length"]) == len(block) and warc.payload_of(block) == b"p" * 100_000
    with pytest.raises(ValueError):
        list(warc.parse(data[:-3]))
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab")


def test_lost_segment_is_an_error(spark):
    rows = [("response", "o", 1, "u", None, None, 1, None, None, None, b"a"), ("continuation", "o", None, None, None, None, 3, 3, None, None, b"c")]
    with pytest.raises(Exception, match="missing"):
        warc.reassemble(spark.createDataFrame(rows, warc.RECORDS)).collect()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, please agree to all of them now.</div>
<!-- ad --><div class="ad">Buy this thing today, it is very good and cheap.</div>%s
<aside class="sidebar"><p>Other stories that you may like to read some day.</p></aside><div id="comments"><p>Reader: what a great article, thank you for writing it!</p></div>
<form><p>Subscribe with your address here please.</p></form><footer>&copy; site</footer></body></html>"""


def test_main_text_of_templates():
    body = "<h1>Title &amp; more</h1><p><b>First   paragraph with\n enough words to be found.<br><p>Er.</p><ul><li>One</li><li>Two</li></ul><p>Last&nbsp;one, caf&eacute;.</p>"
    want = "Title & more\nFirst paragraph with enough words to be found.\nEr.\nOne\nTwo\nLast one, café."
    for template in ("<article>%s</article>", '<div class="post-body">%s</div>', "<main>%s</main>"):
        assert html.extract(PAGE % (template % body)) == want
    assert html.extract(PAGE % "<article>%s" % body).startswith("Title & more\nFirst")
    assert html.extract("only text") == "only text" and html.extract(None) == "" == html.extract("<nav>menu</nav>")


def test_main_text_table(spark):
    rows = [(1, "u", PAGE % "<article><p>Text of the page.</p></article>", "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<p>" * 3000 + "deep", "x"), (3, "u", "<div>" * 3000 + "deep", "x")]
    got = sorted(((r["id"], r["text"], r["n_chars"]) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()), key=repr)
    assert got == sorted([(1, "Text of the page.", 17), (2, "", 0), (None, "", 0), (3, "deep", 4), (3, "deep", 4)], key=repr)


def test_main_text_of_an_empty_table_and_of_equal_lines(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.main_text(pages).count() == 0
    line = "<p>The same line of words stands here every time.</p>"
    assert html.extract(f"<article>{line * 4}</article>").split("\n") == ["The same line of words stands here every time."] * 4


def test_two_means_splits():
    assert 10 < html.two_means([1, 2, 1, 40, 50, 45]) < 40


def brute(rows):
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, dtype=np.float32).astype(float)
        return v / np.linalg.norm(v)

    units = [unit(r[1]) for r in rows]
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a[2] is None or a[2] != b[2] or units[i] is None or units[j] is None or len(units[i]) != len(units[j]) or None in (a[0], b[0]):
                continue
            if units[i] @ units[j] >= 0.98:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(x for x in (low.get(find(i)), r[0]) if x is not None) if (low.get(find(i)), r[0]) != (None, None) else None
    return sorted(((r[0], n[i], low[find(i)], r[0] is not None and r[0] == low[find(i)]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("hot", [64, 5])
def test_embedding_components(spark, monkeypatch, hot):
    monkeypatch.setattr(embeddings, "HOT_CELL", hot)
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(0)
    rows, key = [], 0
    for group in range(12):
        base = rng.normal(size=64)
        for _ in range(30 if group == 0 else int(rng.integers(1, 6))):
            v = (base + rng.normal(size=64) * rng.choice([0.0, 0.1, 0.15])).astype(np.float32)
            rows.append((key, [float(x) for x in v], int(group % 3) if key % 9 else None, "n"))
            key += 1
    one = [float(x) for x in rng.normal(size=64)]
    rows += [(900, None, 1, ""), (901, [], 1, ""), (902, [0.0] * 64, 1, ""), (903, [float("nan")] + one[1:], 1, ""), (904, [None] + one[1:], 1, ""), (905, one[:7], 1, ""), (906, one[:7], 1, ""), (907, [x * 1e30 for x in one], 2, ""), (908, [x * 1e-30 for x in one], 2, ""), (None, one, 2, ""), (909, one, 2, ""), (909, one, 2, ""), (910, [float("inf")] + one[1:], 2, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    got = sorted((tuple(r) for r in embeddings.neardup_components(df).collect()), key=repr)
    assert got == brute(rows)
    assert embeddings.neardup_components(df.limit(0)).count() == 0


def test_e8_decoder_finds_nearest_points():
    rng = np.random.default_rng(2)
    near = embeddings.roots()
    assert len(near) == 240 and len({tuple(v) for v in near}) == 240 and set((near**2).sum(axis=1)) == {8}
    x = rng.normal(size=(500, 8)) * 3
    point = embeddings.e8(x) / 2
    d = ((x - point) ** 2).sum(axis=1)
    assert d.max() <= 1 + 1e-9  # covering radius one
    assert (d[:, None] <= ((x[:, None] - point[:, None] - near[None] / 2) ** 2).sum(axis=2) + 1e-9).all()


def test_recall_of_random_pairs_at_the_threshold():
    rng = np.random.default_rng(random.Random(4).randrange(1 << 30))
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.98, 1.0, size=(4000, 1))
    b = cos * a + np.sqrt(1 - cos**2) * noise
    labels = np.ones(4000, dtype=np.int64)
    (own_a, probe_a), (own_b, probe_b) = embeddings.cells(a, labels), embeddings.cells(b, labels)

    def meets(x, y):
        return (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))

    found = meets(own_a, own_b) | meets(probe_a, own_b) | meets(probe_b, own_a)
    assert found.mean() >= 0.97


PROSE = "Words of a paragraph that is long enough to say something about the matter at hand. " * 3


def page_text(*parts):
    return "\n".join(p.strip() for p in parts)


@pytest.mark.parametrize(("page", "want"), [
    ("<body><form id='aspnetForm'><h1>Title</h1><p>{a}</p><p>{b}</p></form></body>", "Title|a|b"),
    ("<main><div class='search-algorithms'><p>{a}</p><p>{b}</p></div></main>", "a|b"),
    ("<article><h1>T</h1><p>{a}</p><section class='related-work'><h2>Related work</h2><p>{b}</p></section></article>", "T|a|Related work|b"),
    ("<article><div class='entry-header'><h1>Title</h1></div><p>{a}</p></article>", "Title|a"),
    ("<body><article><p>{a}</p></article><article><p>{b}</p><p>more</p></article></body>", "a|b|more"),
    ("<body><h1>Title</h1><div><p>{a}</p></div><div><p>{b}</p></div></body>", "Title|a|b"),
    ("<body><h1>Title</h1><div>{a}</div></body>", "Title|a"),
    ("<article><h1>H</h1><p>{a}</p><div class='comments'><article class='comment'><p>{a}{b}</p></article></div></article>", "H|a"),
    ("<article><p>{a}</p><div class='ad'><p>{b}</p></div><form><p>Your name</p></form></article>", "a"),
    ("<div class='modal-open'><nav><a href=x>menu</a></nav><div id='content-sidebar-wrap'><article><p>{a}</p></article></div></div><aside>{b}</aside>", "a"),
    ("<ul><li><a href=x>Home</a></li></ul><div><p>{a}</p><p>short</p></div><footer>{b}</footer>", "a|short"),
    ("<article><p>a &amp; b&nbsp;c<br>d</p>\n x  y <script>var a='<p>'</script></article>", "a & b c d|x y"),
    ("<p>{a}<style>p</style>", "a"), ("", ""), (None, ""), ("<nav>{a}</nav>", ""),
])
def test_content_lines_choose_the_region(page, want):
    a, b = PROSE, PROSE.replace("matter", "other matter")
    said = {"a": a, "b": b}
    assert html.extract(page and page.replace("{a}", a).replace("{b}", b)) == page_text(*[said.get(w, w) for w in want.split("|")])


def test_planted_articles_come_back():
    """Random articles in random frames of furniture, whatever nests around them."""
    import random

    rng = random.Random(8)

    def prose(n):
        return " ".join("".join(rng.choice("abdeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    for _ in range(150):
        blocks = [prose(4)] + [prose(rng.choice((3, 25, 60, 120))) for _ in range(rng.randrange(2, 9))]
        inner = f"<h1>{blocks[0]}</h1>" + "".join(rng.choice(("<p>{}</p>", "<div><p><b>{}</b></p></div>", "<blockquote>{}</blockquote>")).format(b) for b in blocks[1:])
        furniture = ["<nav>" + "<li><a href=x>menu entry</a></li>" * 6 + "</nav>", f"<footer>{prose(20)}</footer>", f"<div class='cookie-notice'>{prose(15)}</div>", f"<aside>{prose(30)}</aside>", f"<form>{prose(5)}<input></form>", "<div class='menu'><a href=y>one</a> <a href=z>two</a></div>", "<script>x()</script>"]
        rng.shuffle(furniture)
        k = rng.randrange(len(furniture))
        body = "".join(furniture[:k]) + f"<article>{inner}<section id='comments'>{prose(40)}</section></article>" + "".join(furniture[k:])
        for wrap in rng.choice(([], ["<div class='page header-fixed'>"], ["<form id='all'>", "<div class='sidebar-left'>"])):
            body = wrap + body
        assert html.extract(f"<html><head><title>t</title></head><body>{body}</body></html>") == "\n".join(blocks)


def test_deep_pages_take_time_in_proportion():
    import time

    for deep in ("<div>x" * 50_000, "<b>" * 50_000 + "x" + "</b>" * 50_000, "<div>x</p></span>" * 50_000):
        began = time.process_time()
        html.extract(deep)
        assert time.process_time() - began < 10


LONG = "The first paragraph of this article is long enough to be counted as content, and certainly it is."
ROUND = f'<html><body><nav><a href="/">Home</a></nav><article><h1>A title</h1><p>{LONG}</p>%s<p>{LONG}</p></article></body></html>'


@pytest.mark.parametrize(
    "inner, kept",
    [
        (f"<p>{LONG} <button>Share</button></p>", [LONG]), ("<svg><text>AXIS</text></svg>", []), ("<iframe>frame</iframe>", []), ("<video>none</video>", []), ("<textarea>area</textarea>", []),
        (f'<p>{LONG} <span class="advert">Buy now</span></p>', [LONG]), (f'<p><span style="display:none">HIDDEN</span>{LONG}</p>', [LONG]), (f'<p class="ad-hoc">{LONG}</p>', [LONG]),
        (f'<p class="comment-on-results">{LONG}</p>', [LONG]), (f'<div class="social-history"><p>{LONG}</p></div>', [LONG]), (f'<p id="promotion">{LONG}</p>', [LONG]), ('<div class="ad-slot">Buy a car</div>', []),
        ('<div class="ad">Buy this thing today, it is very good and cheap.</div>', []), ('<div class="share-buttons"><a href="x">Tweet</a></div>', []), (f'<p>{LONG} <em class="note">noted</em></p>', [LONG + " noted"]),
        ("<button>open <b>still</b>", []), (f"<p>{LONG} <button>never closed</p><p>{LONG}</p>", [LONG, LONG]),
    ],
)
def test_inline_furniture_goes_and_names_only_weigh(inner, kept):
    got = html.extract(ROUND % inner).split("\n")
    assert got == ["A title", LONG, *kept, LONG] if "open <b>" not in inner else got[:2] == ["A title", LONG] and "open" not in " ".join(got)


def test_every_article_is_kept():
    page = f"<article><p>Short one.</p></article><article><p>{LONG} {LONG} {LONG}</p></article><article><p><a href='/x'>More to read elsewhere</a></p></article>"
    assert html.extract(page).split("\n") == ["Short one.", f"{LONG} {LONG} {LONG}"]
