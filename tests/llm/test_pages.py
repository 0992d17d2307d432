"""Page text against pages whose article is known, and archives against brute force."""

import hashlib
import random
import re
import time
from html.parser import HTMLParser

import pytest
import zstandard
from pyarrow import fs

from tradewind.llm import html_text, warc
from tradewind.llm.common import scratch

LOREM = "The river rose in the night, and the people of the town went up the hill. Nobody had seen such water before! They waited, talked and slept until the sun came back."


def page(body: str) -> str:
    return f'<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>{body}</body></html>'


NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/x">News, sport and more of the same. Read on.</a></li></ul></nav>'
CASES = {
    "article": (page(f"<header><h1>Site</h1></header>{NAV}<article><h1>Head</h1><p>One <b>two</b>three<br>four<p>Five &lt;6&gt; &eacute;&nbsp;x</article><aside>Side.</aside><footer>&copy; foot</footer>"), "Head One twothree four Five <6> é x"),
    "article with extras": (page(f'<main><article><h2>Head</h2><div class="share-bar">Share</div><p>{LOREM}</p><form><input name=a><button>Go</button></form><ul><li>a</li><li>b</ul><section id="comments"><p>{LOREM} I disagree!</p></section></article></main>'), f"Head {LOREM} a b"),
    "divs": (page(f'<div id="header"><a href="/">Logo</a></div>{NAV}<div class="cookie-notice"><p>We use cookies. {LOREM}</p></div><div class="content"><h1>Head</h1><p>{LOREM}</p><p>{LOREM}</p></div><div class="sidebar"><p>{LOREM}</p></div><div id="footer">Imprint</div>'), f"Head {LOREM} {LOREM}"),
    "cut off": ("<html><body><article><p>Some text here</p><p>and more <b cla", "Some text here and more"),
    "comment and cdata": ("<article>a<!-- <p>no</p> -->b<p hidden>no</p><p style='display: none'>no</p></article>", "ab"),
    "unclosed": ("<article><h1>H</h1><p><b>x.<br><p>y<p>z</article><footer>f</footer>", "H x. y z"),
    "empty article": ("<nav>menu</nav><article></article>", ""),
    "plain": ("just text &amp; more", "just text & more"),
    "nothing": ("", ""),
    "attributes": ("<article><p title=\"a > b\" data-x='<i>'>kept</p></article>", "kept"),
    "stray quote in a value": ("<article><p title=don't>Kept text</p><p>More text</p></article>", "Kept text More text"),
    "stray quote after a value": ('<article><p class="a"">Kept</p><p>More</p></article>', "Kept More"),
    "stray quote as a name": ("<article><p ' \" class=a>Kept</p><p title = 'x>y' lang=x/>More</p></article>", "Kept More"),
    "values without quotes": ("<article><a href=/a/b?c='d>One</a> <p class=>Two</p><p =x>Three</p></article>", "One Two Three"),
    "marks inside other values": ("<article><p title='class=ad hidden' data-class=ad>Kept</p><!--> <p>More</p><!-- x --!><p>End</p></article>", "Kept More End"),
    "inline spaces": ("<article><p>a <i> b </i>\n\t c</p><div>d</div>e</article>", "a b c d e"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, want = CASES[name]
    assert html_text.main_text(html) == want


def test_extract(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(CASES.values())] + [(None, None, None), (0, "u0", CASES["divs"][0]), (99, "long", f"<article><p>{'w ' * 60_000}</p></article>")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(pages).collect()), key=repr)
    want = [html_text.main_text(h or "") for _, _, h in rows]
    assert got == sorted(((i, u, t, len(t)) for (i, u, _), t in zip(rows, want, strict=True)), key=repr)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_without_an_article_the_paths_decide():
    r = random.Random(1)
    words = LOREM.split()
    for _ in range(30):
        paras = [" ".join(r.choice(words) for _ in range(r.randrange(15, 60))) + "." for _ in range(r.randrange(2, 8))]
        menu = "".join(f"<li><a href='/{i}'>{r.choice(words)}</a></li>" for i in range(9))
        html = page(f"<div class=x1><ul>{menu}</ul></div><div class=x2>{''.join(f'<p>{p}</p>' for p in paras)}</div><div class=x3><span>{r.choice(words)}</span></div>")
        assert html_text.main_text(html) == " ".join(paras)


DIVS = f'<div class="x1"><h1>Head</h1><p>{LOREM}</p><p>{LOREM}</p></div><div class="x2"><span>Imprint</span></div>'


@pytest.mark.parametrize("extra", [
    "<!-- <article> -->", "<script>var t = '<main >';</script>", "<article></article>", f'<section class="comments"><article><p>{LOREM} I disagree!</p></article></section>',
])
def test_an_article_without_main_text_is_no_container(extra):
    assert html_text.main_text(page(DIVS + extra)) == f"Head {LOREM} {LOREM}"


def test_paths_are_scored_on_pages_with_an_article():
    teaser = "<article><h3>Teaser</h3></article>"
    assert html_text.main_text(page(f"{DIVS}<div class='x9'>{teaser * 3}</div>")) == f"Head {LOREM} {LOREM}"
    assert html_text.main_text(page(f"<article><h1>Head</h1><p>{LOREM}</p></article><div><span>Imprint</span></div>")) == f"Head {LOREM}"


@pytest.mark.parametrize("part", [
    f'<section id="discussion"><h2>Talk</h2><p>{LOREM}</p><p>{LOREM}</p></section>', f'<div class="related-work"><h2 id="search-form">Talk</h2><p>{LOREM}</p><p>{LOREM}</p></div>',
    f'<div class="alert notice"><h2 class="social">Talk</h2><p>{LOREM}</p><p>{LOREM}</p></div>', f'<h2 id="search-form">Talk</h2><div id="cookie-law"><p>{LOREM}</p><p>{LOREM}</p></div>',
])
def test_hint_words_inside_an_article_keep_long_text(part):
    menu = '<div class="related"><a href="/x">More of this</a></div><div class="social-bar">Share</div>'
    rest = f'<div class="ad"><p>{LOREM}</p></div><div class="nav"><p>{LOREM}</p></div><div role="complementary"><p>{LOREM}</p></div>'
    assert html_text.main_text(page(f"{NAV}<article><h1>Head</h1><p>{LOREM}</p>{part}{menu}{rest}</article>")) == f"Head {LOREM} Talk {LOREM} {LOREM}"


@pytest.mark.parametrize("body, want", [
    (f"<div class=post><h1>Head</h1><p>{LOREM}</p><p>{LOREM}</p></div><aside><article><p>Other story.</p></article></aside>", f"Head {LOREM} {LOREM}"),
    (f"<div class=post><h1>Head</h1><p>{LOREM}</p><p>{LOREM}</p></div><article><h3>Other story</h3></article>", f"Head {LOREM} {LOREM}"),
    (f'<div class="content search-page"><h1>Head</h1><p>{LOREM}</p></div><footer>f</footer>', f"Head {LOREM}"),
    (f'<article><div class="product-notice"><p>{LOREM}</p></div></article>', LOREM),
    (f"<form action=/><div class=x><h1>Head</h1><p>{LOREM}</p></div><input name=a></form>", f"Head {LOREM}"),
    (f"<div class=x><h1>Head</h1><p>{LOREM}</p></div><div class='comments-area'><p>{LOREM} {LOREM} {LOREM}</p></div>", f"Head {LOREM}"),
    (f"<div class=x><h1>Head</h1><p>{LOREM}</p><form><p>Mail us. Or not, as you like.</p></form></div>", f"Head {LOREM}"),
])
def test_pages_without_a_plain_article(body, want):
    assert html_text.main_text(page(body)) == want


def test_paths_give_the_same_without_articles():
    for html, want in CASES.values():
        if want and "</article>" in html and want.count(".") > 5:
            assert html_text.main_text(re.sub("(</?)(article|main)", r"\1div", html)) == want


class Plain(HTMLParser):
    """(path, text) of the text nodes of a well-formed page."""

    def __init__(self):
        super().__init__()
        self.path, self.nodes = [], []

    def handle_starttag(self, tag, attrs):
        self.path.append(tag + "".join(f".{v}" for _, v in attrs))

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        self.nodes.append(("/".join(self.path), " ".join(data.split())))


def test_path_scores_by_brute_force():
    r = random.Random(8)
    for _ in range(40):
        text = lambda: " ".join(r.choice(LOREM.split()) for _ in range(r.randrange(1, 40)))

        def tree(depth):
            tag = r.choice(["div", "section", "ul", "blockquote"])
            return f"<{tag} class=c{r.randrange(3)}>" + "".join(tree(depth - 1) if depth and r.random() < 0.5 else f"<p>{text()}</p>" for _ in range(r.randrange(1, 5))) + f"</{tag}>"

        html = f"<body>{tree(4)}</body>"
        plain = Plain()
        plain.feed(html)
        sums = {}
        for path, s in plain.nodes:
            n, length, marks = sums.get(path, (0, 0, 0))
            sums[path] = (n + 1, length + len(s), marks + sum(s.count(c) for c in ".,;:!?"))
        paths = [*sums]
        at = lambda k, of: sums[paths[min(max(k, 0), len(paths) - 1)]][of] / sums[paths[min(max(k, 0), len(paths) - 1)]][0]  # noqa: B023, E731
        smooth = lambda k, of: 0.1 * at(k - 1, of) + 0.8 * at(k, of) + 0.1 * at(k + 1, of)  # noqa: B023, E731
        want = [smooth(k, 1) * (1 + smooth(k, 2)) for k in range(len(paths))]
        parsed = html_text.parse(html)
        got = html_text.path_scores(parsed.blocks, [False] * len(parsed.blocks))
        assert [b.text for b in parsed.blocks] == [s for _, s in plain.nodes]
        assert list(got.values()) == pytest.approx(want)


def test_deep_and_broken_pages_take_linear_time():
    makers = [lambda n: "<div>" * n + "x", lambda n: "<div><p>w</p>" * n, lambda n: "<div>" * n + "x" + "</span></b></p>" * n, lambda n: "<ul><li>" * n + "t", lambda n: "<article>" * n + "</b>t" * n, lambda n: "<p class=ad>x" * n]
    for make in makers:
        took = []
        for n in (2_000, 20_000):
            began = time.process_time()
            html_text.main_text(make(n))
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.01)  # ten times as long, not a hundred times


def payloads():
    big = "<p>" + "x" * 200 + "</p>"
    return [(5, "http://a/?q=1 2", big), (3, None, big), (9, "http://b", big), (4, "http://c", "short"), (2, "http://d", "short"), (7, "http://e", None), (8, "http://f", ""), (1, "http://g", "é" * 50), (6, "http://h", "é" * 50), (10, "http://i\r\nX: y", "r\r\n\r\nWARC/1.1 \r\n\r\n" * 20), (11, "u", "L" * 900_000), (12, "u", "é" * 49), (13, "u", "é" * 49), (None, "n", big), (5, "http://a/?q=1 2", big)]


def brute(rows):
    first = {}
    for d, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and d is not None:
            first[b] = min(first.get(b, d), d)
    out = []
    for d, _, h in rows:
        b = (h or "").encode()
        w = first.get(b) if len(b) >= 100 else None
        out.append((d, len(b), hashlib.sha256(b).hexdigest(), "revisit" if w is not None and w != d else "response", w if w is not None and w != d else None))
    return sorted(out, key=repr)


def test_archive(spark):
    rows = payloads()
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, first int").repartition(4)
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in warc.archive(pages).collect()), key=repr) == brute(rows)
    assert warc.archive(pages.limit(0)).count() == 0


def test_reading_is_dealt_by_frames(spark):
    pages = spark.range(70).selectExpr("id as page_id", "concat('u', id) as url", "repeat(concat(id, ' '), 90000) as html").coalesce(1)
    manifest = warc.write_warc(pages, scratch(spark, "warc"))
    frames = [r.n_frames for r in manifest.collect()]
    assert warc.read_warc(manifest).rdd.getNumPartitions() == sum(-(-n // warc.READ_FRAMES) for n in frames) > 1
    assert warc.read_warc(manifest).count() == 70


def test_bundles_are_seekable(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 50 + 1)) for i in range(400)]
    monkeypatch.setattr(warc, "FRAME_BYTES", 4096)
    w = warc.BundleWriter(_folder(spark))
    for i, u, h in rows:
        w.add(warc.record_id(i), warc.record(i, u, h.encode(), hashlib.sha256(h.encode()).hexdigest(), None, False))
    info = w.close()
    reader = warc.BundleReader(info["bundle"])
    assert len(reader.frames) == info["n_frames"] > 10 and len(reader.index()) == 400
    for i in (0, 17, 399):
        data = reader.record(warc.record_id(i))
        header, start, end = warc.parse(data)
        assert header["warc-target-uri"] == f"http://x/{i}" and data[start:end].endswith(rows[i][2].encode())
    assert reader.record("urn:page:nobody") is None
    where_fs, where = fs.FileSystem.from_uri(info["bundle"])
    with where_fs.open_input_stream(where, compression=None) as f:  # any reader unpacks it from end to end
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 400


def _folder(spark):
    base = scratch(spark, "bundle")
    warc._make_folder(base)
    return base
