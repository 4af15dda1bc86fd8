import hashlib
import math
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from tidemark.llm import markup, op6_html, op9_media

DATA = "/root/testdata/sf0.001"


def page(i, article, extra=""):
    return f"""<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>Site header</header><nav><ul><li><a href=x>Menu {i}</a></li></ul></nav><!-- c --><div class="ad">Buy {i}</div><div class="strap">Our daily strap</div>
<article><h1>Title&nbsp;{i} &amp; more</h1>{article}<div class="comments"><p>bad comment {i}</p></div><div>Read also this</div></article>
<form><input><p>Form text</p></form><aside>Side {i}</aside><footer>&copy; {i}</footer>{extra}</body></html>"""


def test_extract_rules():
    assert op6_html.extract(page(1, "<p><b>One\n two<br>three<p>Four &lt;x&gt;</p><ul><li>a<li>b</ul>")) == "Title 1 & more\n\nOne two three\n\nFour <x>\n\na\n\nb\n\nRead also this"
    assert op6_html.extract(None) == op6_html.extract("") == op6_html.extract("<html><body></body>") == ""
    assert op6_html.extract("just text < 5 &eacute;") == "just text < 5 é"
    assert op6_html.extract("<div><p>kept</p><!-- open") == "kept"
    assert op6_html.extract("<p>" * 3000 + "deep" + "<div>" * 3000 + "end") == "deep\n\nend"


def test_templates_are_removed_and_copies_kept(spark):
    rows = [(i, f"http://a.example.com/{i}", page(i, f"<p>Article {i} text</p><p>Shared passage in all articles</p>")) for i in range(12)]
    rows += [(100 + i, "http://a.example.com/c", page(77, "<p>Copied article</p><div>Only in the copies</div>")) for i in range(9)]
    rows += [(200 + i, "http://b.example.com/", f"<body><div>Plain {i}</div><div>Recurring strap</div></body>") for i in range(8)]
    rows += [(300, None, "<p>no host</p>"), (301, "http://c/", None), (None, "http://c/", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op6_html.main_text(pages).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i] == f"Title {i} & more\n\nArticle {i} text\n\nShared passage in all articles"
    for i in range(9):
        assert got[100 + i] == "Title 77 & more\n\nCopied article\n\nOnly in the copies"
    for i in range(8):
        assert got[200 + i] == f"Plain {i}"
    assert got[300] == "no host" and got[301] == "" and got[None] == "x"


def test_html_empty(spark):
    assert op6_html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sequence_and_resolve(spark):
    html = '<p>Before<figure><img src="sha256:AA" alt="alt"><figcaption>Cap &amp; tion</figcaption></figure>mid <img src="sha256:bb" alt="two"> after</p><script>x</script><img src="sha256:cc"><img src="http://no">'
    assert op9_media.sequence(html) == [(0, "text", "Before", None, None), (1, "media", None, "aa", "Cap & tion"), (2, "text", "mid", None, None), (3, "media", None, "bb", "two"), (4, "text", "after", None, None), (5, "media", None, "cc", None)]
    pages = spark.createDataFrame([(1, html, "z"), (2, None, "z"), (3, '<img src="sha256:aa">', "z")], "page_id long, html string, digest string")
    media = spark.createDataFrame([("aa", b"1"), ("bb", b"2")], "digest string, media binary")
    rows = sorted((r.k, r.position, r.kind, r.digest, r.caption, bytes(r.media) if r.media else None) for r in op9_media.resolve(op9_media.sequences(pages, "page_id", "html"), media).collect() if r.kind == "media")
    assert rows == [(1, 1, "media", "aa", "Cap & tion", b"1"), (1, 3, "media", "bb", "two", b"2"), (1, 5, "media", "cc", None, None), (3, 0, "media", "aa", None, b"1")]


def test_media_round_trip(spark):
    texts = [None, "", "é" * 32, "a" * 64, "b" * 65, "\n\n", "x" * 200_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(None, "nul", None)], "doc_id long, text string, feature string")
    got = {r.k: r for r in op9_media.document_media(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert op9_media.from_image(op9_media.to_image(payload)) == payload
        assert (r.media_bytes, r.media_sha256) == (len(op9_media.to_image(payload)), hashlib.sha256(op9_media.to_image(payload)).hexdigest())
    assert got[7].feature == got[8].feature


def test_media_empty(spark):
    assert op9_media.document_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_media_are_stored_once(spark, monkeypatch):
    texts = [None, "", "alone", "same", "same", "same", "twice" * 50, "twice" * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    tables, resolved = {}, []
    write, resolve = op9_media.written, op9_media.resolve
    monkeypatch.setattr(op9_media, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    monkeypatch.setattr(op9_media, "resolve", lambda *a: resolved.append(a) or resolve(*a))
    got = op9_media.document_media(docs).collect()
    media = [(r.digest, bytes(r.media)) for r in tables["media"].collect()]
    assert len(media) == len(dict(media)) == 4 and len(got) == len(texts) and resolved
    for r in got:
        assert op9_media.from_image(dict(media)[r.digest])[: r.n_bytes] == (texts[r.k] or "").encode()


def test_names_count_as_whole_words_and_hidden_text_stays():
    html = '<article><section class="related-work"><p>rw</p></section><p class="social-history">sh</p><p hidden>h</p><p style="display:none">d</p><svg>v</svg><p class="NOTICE x">no</p><p>end</p></article>'
    assert op6_html.extract(html) == "rw\n\nsh\n\nh\n\nd\n\nv\n\nend"


@pytest.mark.parametrize("html", ["<b>" * 16_000 + "</i>" * 16_000, "<b>" * 16_000 + "<h1></h1>" * 16_000, "<ul>" + "<b>" * 16_000 + "<li>" * 16_000, '<div class="ad">' * 16_000, '<div class="nav">' * 4000 + "<article>x" * 4000])
def test_broken_pages_take_linear_time(html):
    start = time.perf_counter()
    markup.parse(html)
    assert time.perf_counter() - start < 1
    op6_html.extract(html)
    assert time.perf_counter() - start < 3


class Subtrees(HTMLParser):
    """The serialised subtrees of a well-formed page by the standard library's parser: a brute-force view of what recurs."""

    def __init__(self):
        super().__init__()
        self.open, self.found = [["", []]], []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        self.open.append([f"<{tag} {own.get('class') or ''} {own.get('id') or ''}>", []])
        if tag in markup.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        name, parts = self.open.pop()
        whole = name + "|".join(parts) + "/"
        self.found.append(whole)
        self.open[-1][1].append(whole)

    def handle_data(self, text):
        if text.split():
            self.open[-1][1].append(" ".join(text.split()))


def test_templates_by_brute_force(spark):
    rows = []
    for i in range(400):
        host = "hot" if i % 3 else f"h{i % 7}"
        strap = f'<div id="s"><span>strap {i % 90}</span><img></div>'  # on a few pages of the hot host each
        rows.append((i, f"http://{host}/x", f"<body><div>menu {host}</div>{strap}<article><p>text {i % 350}</p><div>also {i % 40}</div></article></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen, of = defaultdict(set), {}
    for i, url, html in rows:
        view = Subtrees()
        view.feed(html)
        article = html.split("<p>")[1].split("</p>")[0], html.split("<article>")[1]
        of[i] = [x for x in view.found if not x.startswith(("<body", "<article", "<p"))]
        for x in of[i]:
            seen[url, x].add(article)
    want = {i: len({x for x in of[i] if len(seen[url, x]) >= op6_html.RECURS}) for i, url, _ in rows}
    found = op6_html.subtrees(pages)
    number = {r.page: r.page_id for r in pages.select("page_id", op6_html.F.xxhash64("page_id", "url", "html").alias("page")).collect()}
    got = {number[r.page]: len(r.templates) for r in op6_html.page_templates(found).collect()}
    assert got == {i: n for i, n in want.items() if n} and len(got) == 400
    texts = {r.page_id: r.text for r in op6_html.main_text(pages).collect()}
    for i, url, _ in rows:
        also = f"<div  >also {i % 40}/"
        assert texts[i] == f"text {i % 350}" + ("" if len(seen[url, also]) >= op6_html.RECURS else f"\n\nalso {i % 40}")


def test_pages_of_documents_against_a_plain_reading(spark):
    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.line, self.out = False, [], []

        def flush(self):
            text = " ".join("".join(self.line).split())
            self.line.clear()
            self.out += [text] if text else []

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if tag in markup.BLOCK:
                self.flush()
            elif tag == "br":
                self.line.append(" ")

        def handle_endtag(self, tag):
            if tag in markup.BLOCK:
                self.flush()
            self.inside = self.inside and tag != "article"

        def handle_data(self, text):
            if self.inside:
                self.line.append(text)

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in op6_html.op6_html(spark, DATA).collect()}
    for r in pages.collect():
        view = Article()
        view.feed(r.html)
        view.flush()
        assert got[r.page_id] == "\n\n".join(view.out)


def test_a_corrupted_medium_is_seen(spark):
    good = op9_media.to_image(op9_media.padded(b"some bytes"))
    for media, fine in ((good, True), (good[:-1] + b"x", False)):
        table = spark.createDataFrame([(hashlib.sha256(good).hexdigest(), media)], "digest string, media binary")
        if fine:
            assert op9_media.read_back(table).count() == 1
        else:
            with pytest.raises(Exception, match="read back as"):
                op9_media.read_back(table).collect()


def test_feature_by_brute_force():
    for data in (b"", b"a", bytes(range(256)) * 3, "é text".encode() * 50):
        samples = op9_media.padded(data)
        n, counts = len(samples), Counter(samples)
        mean = sum(samples) / n
        std = math.sqrt(max(0.0, sum(x * x for x in samples) / n - mean * mean))
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) + 0.0
        bands = [sum(c for x, c in counts.items() if x // 32 == b) / n for b in range(8)]
        head, _, tail = op9_media.feature(samples).partition(";bands=")
        got = [float(x.split("=")[1]) for x in head.split(";")] + [float(x) for x in tail.split(",")]
        assert got == pytest.approx([mean, std, entropy, *bands], abs=6e-5)
