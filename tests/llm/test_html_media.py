"""op1 and op4: main text, interleaved sequences, the media store."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter
from html import unescape

import pytest
from conftest_llm import save

from standex.llm import extract, media, queries
from standex.llm.html import parse, text_of

P = "<p>" + "Real words of the article go on and on, as many as it takes to be dense. " * 3 + "</p>"
PLAIN = ("Real words of the article go on and on, as many as it takes to be dense. " * 3).strip()


def inside_article(html):
    inner = re.search("<article>(.*?)</article>", html, re.S)[1].replace("<b>", "")
    return " ".join(unescape(re.sub("</?(?:p|h1|br)>", " ", inner)).split())


def test_pages_give_their_articles(spark, small):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op1_html_text(spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        want = inside_article(p.html)
        assert got[p.page_id] == (want, len(want))


def test_density_decides_on_given_pages(spark, monkeypatch):
    """All words of the articles and hardly another; with any node as good as any other, most texts are wrong."""
    pages = [p.html for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    texts = [extract.main_text(h) for h in pages]
    wanted = [Counter(inside_article(h).split()) for h in pages]
    shared = sum((w & Counter(t.split())).total() for w, t in zip(wanted, texts, strict=True))
    assert shared >= 0.999 * sum(w.total() for w in wanted) and shared >= 0.999 * sum(len(t.split()) for t in texts)
    monkeypatch.setattr(extract, "_density", lambda c, t, lc, lt, share: 1.0 if c else 0.0)
    assert sum(extract.main_text(h) != t for h, t in zip(pages, texts, strict=True)) >= 0.9 * len(pages)


def long(name):
    return " ".join(f"{name}{i}" for i in range(40))


def page(inside="", behind="", tag="article"):
    menu = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul></nav>"
    return f"<body>{menu}<{tag}><h1>T</h1><p>{long('a')}</p>{inside}<p>{long('z')}</p></{tag}>{behind}<footer>all rights</footer></body>"


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("name", ["id=discussion", "id=responses", "class=related-work", "class=share-prices", "class=social-history", "id=feedback", "id=consent", "id=cookies", "class=methods"])
def test_sections_stay_whatever_their_name(tag, name):
    section = f"<section {name}><h2>H</h2><p>{long('s')}</p><p>{long('t')}</p></section>"
    assert extract.main_text(page(section, tag=tag)) == f"T {long('a')} H {long('s')} {long('t')} {long('z')}"


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("name", ["class=thread", "class=user-opinions", "class=comments", "id=disqus_thread", "id=responses"])
def test_comment_threads_go_whatever_their_name(tag, name):
    entries = "".join(f"<div class=c><b>User {i}</b> <time>12:0{i}</time><p>{long('c')}</p></div>" for i in range(6))
    want = f"T {long('a')} {long('z')}"
    assert extract.main_text(page(behind=f"<div {name}>{entries}</div>", tag=tag)) == want
    assert extract.main_text(page(inside=f"<div {name}>{entries}</div>", tag=tag)) == want


@pytest.mark.parametrize("tag", ["article", "div"])
def test_formulas_and_quotes_stay_and_what_is_not_text_goes(tag):
    inside = f"<p>So <math><mi>E</mi><mo>=</mo><mi>m</mi></math> it is.</p><blockquote><p>{long('q')}</p><footer>An Author</footer></blockquote>"
    inside += "<div class=share>Share this</div><div class=related><h3>Related</h3><ul><li><a href=1>Other one</a><li><a href=2>Other two</a></ul></div>"
    behind = f"<div class=cookie-banner><p>{long('k')[:90]}</p></div><div class=ad>Buy this now</div>"
    assert extract.main_text(page(inside, behind, tag)) == f"T {long('a')} So E=m it is. {long('q')} An Author {long('z')}"


def plain_heaviest(html):
    """The text of the node whose blocks' densities add up to most, each sum taken over the node's whole subtree."""
    root = parse(html)
    extract._mark(root)
    body = next(n for n in root.walk() if n.tag == "body")
    density = plain_densities(body)

    def blocks(node):
        for x in node.children:
            if not isinstance(x, str) and not x.marks[0] and x.marks[2] < 2:
                yield from blocks(x) if x.tag in extract.INLINE else [density[id(x)]]

    usable = [n for n in body.walk() if id(n) in density and n.tag not in extract.INLINE and n.marks[2] < 2]
    totals = [sum(blocks(n)) for n in usable]
    return text_of(usable[totals.index(max(totals))], lambda x: x.marks[0])


def test_the_heaviest_node_is_in_the_text(spark, small):
    for p in spark.read.parquet(f"{small}/pages.parquet").collect():
        heaviest = plain_heaviest(p.html)
        assert heaviest and heaviest in extract.main_text(p.html)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>" * 3000 + "deep", "deep"), ("<a href='x", "<a href='x"),
        (f"<body><nav>menu</nav><article><h1>T</h1>{P}</article><footer>foot</footer></body>", f"T {PLAIN}"),
        (f"<body><header><a href=/>Site</a></header><div class='post has-sidebar'><h2>T</h2>{P}<p>Short.</p>{P}<aside>side</aside></div></body>", f"T {PLAIN} Short. {PLAIN}"),
        (f"<body><article>{P}</article><div id='comments'><article><p>{'Reader says. ' * 200}</p></article></div></body>", PLAIN),
        (f"<body><div class='cookie-notice'>We use cookies</div><main>{P}<form>Name <input></form></main><div role=complementary>x</div></body>", PLAIN),
        (f"<article>{P}<script>var a = '<p>no</p>'</script><style>p{{}}</style><!-- no --><p>1 &lt; 2&nbsp;&nbsp;3</p></article>", f"{PLAIN} 1 < 2 3"),
        (f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div>{P}{P}</div><div>{P}</div></body>", f"{PLAIN} {PLAIN} {PLAIN}"),
        (f"<body style='display:none'><article>{P}<p hidden>x</p></article><div class='side-bar'>y</div></body>", PLAIN),
        ("<article><p>un<b>bro</b>ken<br>line</p><p>next</article>", "unbroken line next"),
    ],
)
def test_main_text(html, text):
    assert extract.main_text(html) == text


#: The densest node of a page is this one's parent.
BLOCKS, FOUR = f"<div>{P}{P}</div>" * 2, " ".join([PLAIN] * 4)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><article>{P}</article><article><p>Second one.</p></article></body>", f"{PLAIN} Second one."),
        (f"<body><main><h1>T</h1><p>Lead.</p><article><p>First one.</p></article><div><article>{BLOCKS}</article></div></main></body>", f"T Lead. First one. {FOUR}"),
        (f"<body><div><h2>T</h2><article>{P}</article><article>{P}</article></div></body>", f"T {PLAIN} {PLAIN}"),
        (f"<body><main><article>{BLOCKS}</article><section class='related'><h2>More</h2><article><p>Card.</p></article></section><p><a href=1>Next</a></p></main></body>", FOUR),
        (f"<body><main><article>{BLOCKS}</article><div class='comments'><article><p>{'Reader says. ' * 200}</p></article></div></main></body>", FOUR),
    ],
)
def test_articles_beside_each_other(html, text):
    assert extract.main_text(html) == text


def test_no_element_name_picks_the_text(spark):
    """Without article and main, all pages together give the same words but for a thousandth."""
    shared = mine = theirs = 0
    for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        without = Counter(extract.main_text(re.sub(r"(</?)(article|main)\b", r"\1div", p.html)).split())
        words = Counter(extract.main_text(p.html).split())
        shared, mine, theirs = shared + (without & words).total(), mine + words.total(), theirs + without.total()
    assert shared >= 0.999 * mine and shared >= 0.999 * theirs


#: A dense text in a div, beside blocks that only their density tells from it.
TAGGY = "<div><span>Some</span> <span>words</span> <i>in</i> <b>many</b> <u>tags</u> <em>each</em> <i>of</i> <b>one</b> <u>word</u></div>"
SPARSE = f"<body><div>{TAGGY}{TAGGY}{TAGGY}{TAGGY}</div><div><p>{PLAIN}</p><p>{PLAIN}</p><p>{PLAIN}</p></div><div>{TAGGY}</div></body>"


def test_density_picks_the_text(monkeypatch):
    assert extract.main_text(SPARSE) == " ".join([PLAIN] * 3)
    monkeypatch.setattr(extract, "_density", lambda c, t, lc, lt, share: 1.0)
    assert extract.main_text(SPARSE) != " ".join([PLAIN] * 3)


def plain_densities(body):
    """Node by node, each from its whole subtree."""
    squeeze = lambda x: len(" ".join(x.split()))

    def below(node, link, dropped):
        for x in node.children:
            if isinstance(x, str):
                yield squeeze(x), 0, squeeze(x) * link, 0
            elif dropped or not x.marks[0]:
                yield 0, 1, 0, int(x.tag == "a")
                yield from below(x, link or x.tag == "a", dropped)

    every = [x for x in below(body, False, True) if x]
    share = sum(x[2] for x in every) / max(sum(x[0] for x in every), 1)
    out = {}

    def visit(node):
        rows = list(below(node, node.tag == "a", False))
        c, t, lc, lt = (sum(x[k] for x in rows) for k in range(4))
        lt += node.tag == "a"
        one = lambda x: max(x, 1)
        x = c / one(lc) * one(t) / one(lt)
        base = max(math.e, math.log(c / one(c - lc) * lc + share * c + math.e))
        out[id(node)] = c / one(t) * math.log(x, base) if c and x > 1 else 0.0
        for y in node.children:
            if not isinstance(y, str) and not y.marks[0]:
                visit(y)

    visit(body)
    return out


def test_densities_node_by_node(spark, small):
    pages = [p.html for p in spark.read.parquet(f"{small}/pages.parquet").collect()]
    for html in [*pages, SPARSE, "<body><p>one <a href=1>two</a> three</p><nav><a>x y</a></nav><div><a>only</a></div><form>q</form></body>"]:
        root = parse(html)
        extract._mark(root)
        body = next(n for n in root.walk() if n.tag == "body")
        got, want = extract.densities(body)[2], plain_densities(body)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><form action=x><div>{P}{P}</div><select><option>o</select><input></form></body>", f"{PLAIN} {PLAIN}"),
        (f"<body><div>{P}<form>Your name <input><button>Send</button></form>{P}</div></body>", f"{PLAIN} {PLAIN}"),
        (f"<body><div><article>{P}{P}</article><article>{P}</article></div></body>", f"{PLAIN} {PLAIN} {PLAIN}"),
        (f"<body><div class='page'><h1>T</h1><div class='text'>{P}{P}</div><ul><li><a href=1>a</a><li><a href=2>b</a></ul></div></body>", f"T {PLAIN} {PLAIN}"),
        (f"<body>un<b>bro</b>ken<p>{PLAIN}</p></body>", f"unbroken {PLAIN}"),
        ("<body>loose words <i>only</i></body>", "loose words only"),
    ],
)
def test_forms_articles_and_loose_text(html, text):
    assert extract.main_text(html) == text


@pytest.mark.parametrize(
    "html",
    ["<a " * 300_000, "<a " * 300_000 + ">", "<h1>" * 250_000, "<b></i>" * 140_000, "<p><object>" + "<b>" * 160_000 + "<div>" * 100_000, "<a \"" * 250_000 + ">",
     "<article><p>word " * 60_000, "<div class=comments><article>hi " * 30_000, "<li>x" * 200_000, "<!-- x " * 140_000 + ">", "<" * 1_000_000 + ">"],
    ids=lambda x: x[:12],
)
def test_hostile_pages_take_linear_time(html):
    began = time.process_time()
    extract.main_text(html)
    assert time.process_time() - began < 20  # 1 to 2 s here; minutes if it were quadratic


def test_all_boilerplate_is_empty():
    assert extract.main_text("<body><nav>a</nav><footer>b</footer></body>") == ""


def test_parser_closes_what_html_closes():
    root = parse("<ul><li>a<li>b</ul><p>c<div>d</div><table><tr><td>e<td>f<tr><td>g</table>")
    assert [n.tag for n in root.walk()] == ["#root", "ul", "li", "li", "p", "div", "table", "tr", "td", "td", "tr", "td"]
    assert text_of(root, lambda n: False) == "a b c d e f g"


def test_edges(spark, tmp_path):
    rows = [(1, "u", f"<article>{P}</article>"), (None, None, None), (1, "u", f"<article>{P}</article>"), (2, "u", "")]
    sf = save(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars"), tmp_path, "pages")
    got = sorted((r.page_id or 0, r.text) for r in queries.op1_html_text(spark, sf).collect())
    assert got == [(0, ""), (1, PLAIN), (1, PLAIN), (2, "")]
    save(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path, "pages")
    assert queries.op1_html_text(spark, sf).count() == 0


# ---- media


@pytest.mark.parametrize("text", [None, b"", b"a", b"x" * 576, b"y" * 577, "é漢😀".encode() * 999])
def test_exact_round_trip(text):
    payload = media.payload_of(text)
    assert len(payload) % 576 == 0 and payload.startswith(text or b"") and set(payload[len(text or b"") :]) <= {255}
    stored = media.encode(payload)
    assert media.decode(stored) == (payload, len(payload) // 24, 24) and stored == media.encode(payload)


def test_damage_is_noticed():
    stored = bytearray(media.encode(media.payload_of(b"abc")))
    stored[50] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(stored))


def plain_feature(payload):
    """rows x columns, 64 bits of segments above the mean, mean, entropy."""
    n = len(payload)
    edges = [int(n * k / 64) for k in range(65)]
    bits = "".join("1" if sum(payload[a:b]) * n > sum(payload) * (b - a) else "0" for a, b in zip(edges, edges[1:], strict=False))
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(payload).values())
    return f"{n // 24}x24", f"{int(bits, 2):016x}", sum(payload) / n, abs(entropy)


def plain_png(media):
    """(samples, rows, columns) of an 8-bit grey image without filters."""
    assert media[:8] == b"\x89PNG\r\n\x1a\n" and media[12:16] == b"IHDR" and media[24:26] == b"\x08\x00"
    columns, rows = int.from_bytes(media[16:20], "big"), int.from_bytes(media[20:24], "big")
    data = zlib.decompress(media[41 : 41 + int.from_bytes(media[33:37], "big")])
    return b"".join(data[k + 1 : k + 1 + columns] for k in range(0, len(data), columns + 1)), rows, columns


def check_media(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = queries.op4_media(spark, sf).collect()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "position", "caption", "n_items", "n_media"]
    want, by_digest = [], {}
    for r in docs:
        text = (r.text or "").encode()
        payload = text + b"\xff" * (-len(text) % 576 or 576 * (not text))
        first, last = (bool((r.text or "").split("\n")[k].strip()) for k in (0, -1))
        digest = hashlib.sha256(payload).hexdigest()
        by_digest[digest] = payload
        want.append((str(r.doc_id), len(text), len(payload), digest, zlib.crc32(payload[-32:]), int(first), f"Text of {(r.text or '').count(chr(10)) + 1} lines", 2 + first + last, 2))
    assert sorted((str(r.doc_id), *[r[n] for n in names]) for r in got) == sorted(want)
    for r in got:
        payload = by_digest[r.payload_sha256]
        stored = media.encode(payload)
        assert plain_png(stored) == (payload, len(payload) // 24, 24)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        size, bits, mean, entropy = r.feature.split(":")
        a, b, c, d = plain_feature(payload)
        assert (size, bits) == (a, b) and float(mean) == pytest.approx(c, abs=1e-4) and float(entropy) == pytest.approx(d, abs=1e-4)


def test_op4_many_copies_of_a_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "HOT", 10)
    rows = [(i, "the very same text\nof two lines" if i % 3 else f"its own {i}\n<b>&amp;") for i in range(200)]
    check_media(spark, save(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path))


def test_a_lost_payload_is_an_error_if_asked(spark):
    seqs = media.sequences(spark.createDataFrame([(1, "<img src='sha256:aa'>")], "doc_id long, html string"))
    store = spark.createDataFrame([("bb", 10)], "payload_sha256 string, payload_bytes long")
    assert media.resolve(seqs, store, ["doc_id"]).first().sequence[0].fact is None
    with pytest.raises(Exception, match="no payload of aa"):
        media.resolve(seqs, store, ["doc_id"], strict=True).collect()


def test_op4_against_plain_python(spark, small):
    check_media(spark, small)


def test_op4_edges(spark, edge, empty, tmp_path):
    check_media(spark, save(edge, tmp_path))
    assert queries.op4_media(spark, save(empty, tmp_path)).count() == 0


def test_sequences_stay_aligned(spark):
    html = (
        "<p>before</p><figure><img src='sha256:aa' alt='x'><figcaption>first &amp; best</figcaption></figure>mid <img src=bb alt=' second  one '>"
        "<img><p>after <figcaption>lonely</figcaption></p><script>no</script><img src='sha256:zz'>"
    )
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>only text</p>")], "doc_id long, html string")
    seqs = media.sequences(df)
    got = {r.doc_id: [(i.position, i.kind, i.text, i.media, i.caption) for i in r.sequence] for r in seqs.collect()}
    assert got[1] == [
        (0, "text", "before", None, None), (1, "media", None, "aa", "first & best"), (2, "text", "mid", None, None),
        (3, "media", None, "bb", "second one"), (4, "text", "after lonely", None, None), (5, "media", None, "zz", None),
    ]
    assert got[2] == [] and got[3] == [(0, "text", "only text", None, None)]
    store = spark.createDataFrame([("aa", 10), ("bb", 20)], "payload_sha256 string, payload_bytes long")
    back = {r.doc_id: r.sequence for r in media.resolve(seqs, store, ["doc_id"]).collect()}
    assert [(i.position, i.fact.payload_bytes if i.fact else None) for i in back[1]] == [(0, None), (1, 10), (2, None), (3, 20), (4, None), (5, None)]
    assert back[2] == []
