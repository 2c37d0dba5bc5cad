import html
import math
import random

from conftest import SMALL
from pyspark.sql import functions as F

from pairloom.llm import html_extract
from pairloom.llm.queries import QUERIES


def _text(page):
    return "\n".join(b.text for b in html_extract.blocks(page) if not b.outside)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
    <!-- <p>no</p> --><header><h1>Site</h1><nav><a href="/">Home</a></nav></header><div id="cookie-notice">We use cookies</div>
    <main><article><h1>A &amp; B&nbsp;&lt;c&gt;</h1><p>One<br>two <b>bo</b>ld   <i>x
    y</i><p>Three<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><form><input name=q><label>Search</label></form>
    <div class="ad-slot">Buy</div><aside>Side</aside></article><section id="comments"><article class="comment"><p>Nice</p></article></section></main>
    <footer>&copy; us</footer><noscript>Enable</noscript></body></html>"""
    assert _text(page) == "A & B <c>\nOne two bold x y\nThree\na\nb\nc\nd"


def test_broken_markup():
    assert _text("") == "" and _text("no tags at all") == "no tags at all"
    assert _text("<p>a<b>b<p>c</b>d</p>") == "ab\ncd"
    assert _text("<p>1 < 2 and <p title='x>y'>z") == "1 < 2 and\nz"
    assert _text("<div><p>open<script>x") == "open"
    assert _text("<p>a<!-- never closed <p>b") == "a"
    assert _text("</div></p>x</body>y") == "x\ny"
    assert _text("<form><main><p>in a form</p></main><p>out</p></form>") == "in a form"
    assert _text("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>") == "yes"
    assert _text("<p>" + "<b>" * 3000 + "deep") == "deep"


def test_site_style_tree(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    rows, wanted = [], {}
    for k in range(40):
        paragraphs = [" ".join(word() for _ in range(20)) for _ in range(rng.randint(1, 5))]
        page = f"<body><div class='top'>Great site of news</div><div class='text'>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div class='end'>All rights with us</div></body>"
        rows.append((k, "http://User@News.example.org:80/x", page))
        wanted[k] = "\n".join(paragraphs)
    for k in range(40, 80):  # copies of one page on the same host do not make its article noise
        rows.append((k, "https://news.example.org", rows[0][2]))
        wanted[k] = wanted[0]
    rows += [(80, "http://lone.example.org/", rows[0][2]), (81, None, None), (82, "", ""), (None, "mailto:x", "<p>x")]
    wanted |= {80: f"Great site of news\n{wanted[0]}\nAll rights with us", 81: "", 82: "", None: "x"}
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = html_extract.extract(frame).collect()
    assert {r.page_id: r.text for r in got} == wanted and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(frame.where("false")).count() == 0
    tree = {(r.pages, r.content < html_extract.LEAST) for r in html_extract.style_tree(frame).where("host = 'news.example.org' AND content IS NOT NULL").collect()}
    assert tree == {(40, True), (40, False)}


def _neutral(rng, k):
    """A page whose classes say nothing: what is not the article only the site's other pages tell."""
    word = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    paragraphs = [word(20) for _ in range(rng.randint(1, 4))]
    links = "".join(f"<li>Topic {x}</li>" for x in range(8))
    side = f"<div class='c4'><p>Latest</p>{'<p>One of the same old lines</p>' * 3}<ul>{links}</ul><p>No. {k}</p></div>"
    page = f"<body><div class='c1'><div class='c2'>Our site</div><ul>{links}</ul></div>{side}<div class='c3'><h2>{word(3)}</h2>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div class='c5'>All rights with us</div></body>"
    return page, [p for p in page.split("<h2>")[1].split("</h2>")[:1]] + paragraphs


def test_neutral_markup_goes_by_the_tree(spark):
    rng = random.Random(7)
    made = [_neutral(rng, k) for k in range(250)]
    frame = spark.createDataFrame([(k, f"http://h{k % 5}.example.org/{k}", page) for k, (page, _) in enumerate(made)], "page_id long, url string, html string")
    wanted = {k: "\n".join(text) for k, (_, text) in enumerate(made)}
    assert {r.page_id: r.text for r in html_extract.extract(frame).collect()} == wanted
    off = {r.page_id: r.text for r in html_extract.extract(frame, 10**9).collect()}
    assert all("Topic 3" in off[k] and wanted[k] in off[k] for k in wanted)


def test_importances_against_plain_formulas(spark):
    rng = random.Random(8)
    pages = [_neutral(rng, k)[0] for k in range(12)]
    frame = spark.createDataFrame([(k, "http://x.example.org", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    texts, styles, around = {}, {}, {}
    for page in pages:
        shown = {}
        found = html_extract.blocks(page, shown)
        for node, text in {(b.node.id, b.text) for b in found}:
            texts.setdefault(node, {}).setdefault(text, 0)
            texts[node][text] += 1
        for node in {x for b in found for x in b.node.up()}:
            style = tuple(shown[node])
            styles.setdefault(node, {}).setdefault(style, 0)
            styles[node][style] += 1
        for b in found:
            around[b.node.id] = b.node.up()
    entropy = lambda counts, base: -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts) / math.log(base)
    pages_of = {n: sum(s.values()) for n, s in styles.items()}
    content = {n: 1 - sum(k * entropy([1] * k, max(2, pages_of[n])) for k in t.values()) / sum(t.values()) for n, t in texts.items()}
    got = {r.node: r for r in html_extract.style_tree(frame).collect()}
    assert set(got) == set(styles)
    for n, r in got.items():
        inside = [x for x in texts if n in around[x]]
        below = sum(content[x] * sum(texts[x].values()) for x in inside) / sum(sum(texts[x].values()) for x in inside)
        presentation = entropy([*styles[n].values()], max(2, pages_of[n]))
        assert abs(r.below - below) < 1e-9 and abs(r.presentation - presentation) < 1e-9 and abs(r.most - max(content[x] for x in inside)) < 1e-9
        assert abs(r.importance - 0.9 * below - 0.1 * presentation) < 1e-9 and r.pages == pages_of[n]


def test_deep_and_very_long_pages(spark):
    deep = "<div>" * 3000 + "down here" + "</div>" * 3000
    long = "<article>" + "<p>word</p>" * 100_000 + "</article>"
    rows = [(k, "http://a.example.org", f"<p class='x'>n{k}</p>{p}", "t") for k, p in enumerate([deep, long, deep, long, deep])]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, node string")).collect()}
    assert got[0] == "n0\ndown here" and got[1] == "n1\n" + "\n".join(["word"] * 100_000) and len(got) == 5


def test_shuffle_join_of_verdicts(spark, monkeypatch):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    wanted = html_extract.extract(pages).collect()
    monkeypatch.setattr(html_extract, "BROADCAST_NODES", -1)
    assert sorted(html_extract.extract(pages).collect(), key=str) == sorted(wanted, key=str)


def test_query_keeps_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = QUERIES["op5_html"](spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.text.split() == html.unescape(article.replace("<br>", " ").replace("<p>", " ").replace("</p>", " ").replace("<h1>", " ").replace("</h1>", " ").replace("<b>", "")).split()
    assert QUERIES["op5_html"](spark, SMALL).where(F.col("text").contains("<p>")).count() == 0
