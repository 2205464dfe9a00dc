import html
import random
from collections import Counter

import pytest

from strandloom.llm import html_extract

SCHEMA = "page_id long, url string, html string, text string, path string, host int, votes string"


def sentence(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(n)).capitalize() + "."


def page(r, template, number, paragraphs=None, junk=12):
    """(html, wanted text) of a page in one of four templates, with everything that is no article around and within it."""
    blocks = [sentence(r, 5), *(sentence(r, r.randint(15, 60)) for _ in range(paragraphs or r.randint(2, 6)))]
    title, *rest = (html.escape(b) for b in blocks)
    menu = "<ul>" + "".join(f'<li><a href="/{k}">{sentence(r, 2)}</a>' for k in range(6)) + "</ul>"
    around = f"<div class='cookie-notice'>{sentence(r, 20)}</div><form action=/s><label>{sentence(r, 3)}</label><input name=q></form>"
    text = "".join(f"<p>{x}" + "</p>\n" * (k % 2) for k, x in enumerate(rest))
    advert, share = f'<div class="ad ad-{number}">{sentence(r, 8)}</div>', f"<div class=share-bar><a href=#>{sentence(r, 2)}</a></div>"
    comments = f"<section id=comments><h2>Comments</h2><article class=comment><p>{sentence(r, 60)}</p></article></section>"
    side = f"<div>{sentence(r, junk)}</div>"
    body = {
        "article": f"<header><h2>{sentence(r, 4)}</h2></header>{menu}<article class='post-{number} x'><header><h1>{title}</h1><span>{sentence(r, 4)}</span></header>{text}{advert}{share}{comments}</article>{side}",
        "div": f"<div id=top class=site-header>{sentence(r, 6)}</div><div class='wrap'><div class='page-{number} one' id='story-{number}'><h1>{title}</h1>{text}{advert}</div><div class=sidebar>{menu}{sentence(r, 40)}</div></div>{comments}{side}",
        "table": f"<table><tr><td class=left>{menu}<td class=mid><h1>{title}</h1>{text}<td>{side}</table>",
        "bare": f"{menu}<h1>{title}</h1>{text}<hr>",
    }[template]
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>if (a<b) x='</p>'</script><style>p{{}}</style></head><body class=has-sidebar><nav>{menu}</nav>{around}{body}<footer>&copy; {sentence(r, 6)}</footer><!-- {sentence(r, 9)} -->", "\n".join(blocks)


@pytest.mark.parametrize("template", ["article", "div", "table", "bare"])
def test_articles_come_out_whole_and_alone(spark, template):
    r = random.Random(template)
    pages = [(i, f"http://{template}{i % 3}.example.org/{i}", *page(r, template, i)) for i in range(60)]
    got = html_extract.extracted(spark.createDataFrame([(i, u, h, "x", None, 1, "y") for i, u, h, _ in pages], SCHEMA).repartition(4)).collect()
    wanted = {i: text for i, _, _, text in pages}
    assert {r["page_id"]: r["text"] for r in got} == wanted and all(r["n_chars"] == len(r["text"]) for r in got) and len({r["path"] for r in got}) == 1


def test_a_page_with_little_prose_follows_its_host(spark):
    r = random.Random(5)
    pages = [(i, "http://a.example.org/", *page(r, "div", i)) for i in range(20)]
    odd = (99, "http://a.example.org/odd", *page(r, "div", 99, paragraphs=1, junk=400))
    alone = (98, "http://b.example.org/odd", odd[2], odd[3])
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(spark.createDataFrame([(i, u, h, None, None, None, None) for i, u, h, _ in [*pages, odd, alone]], SCHEMA)).collect()}
    assert got[99] == odd[3] and got[98] != odd[3] and all(got[i] == t for i, _, _, t in pages)


def test_two_templates_of_a_host_both_win(spark):
    r = random.Random(6)
    pages = [(i, "http://a.example.org/", *page(r, ["div", "article"][i % 2], i)) for i in range(30)]
    rows = spark.createDataFrame([(i, u, h, None, None, None, None) for i, u, h, _ in pages], SCHEMA)
    assert {r["page_id"]: r["text"] for r in html_extract.extracted(rows).collect()} == {i: t for i, _, _, t in pages}
    [won] = html_extract.winners(html_extract.votes(rows)).collect()
    assert won["host"] == "a.example.org" and [(p["path"], p["share"]) for p in won["paths"]] == [("body/article", 0.5), ("body/div.wrap/div.page-#story-", 0.5)]


def test_votes_and_winners_match_a_count_by_hand(spark):
    r = random.Random(7)
    pages = [(i, f"http://h{min(i % 7, 2)}.org/", page(r, r.choice(["div", "article", "table"]), i)[0]) for i in range(60)]
    wanted = Counter()
    for _, url, source in pages:
        scores = html_extract.parsed(source).scores()
        wanted[url[7:-1], max(scores, key=scores.get)] += 1
    counted = html_extract.votes(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6))
    assert {(r["host"], r["path"]): r["votes"] for r in counted.collect()} == wanted
    for row in html_extract.winners(counted, 0.4).collect():
        own = {p: n for (h, p), n in wanted.items() if h == row["host"]}
        best = max(own, key=lambda p: (own[p], p))
        assert {p["path"] for p in row["paths"]} == {p for p, n in own.items() if p == best or n >= 0.4 * sum(own.values())}


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), (" \n", ""), ("plain &lt;words&gt;", "plain <words>"), ("<p>a<br>b\n\t c&nbsp;d", "a b c d"), ("<p>&amp;amp; &#233;&#x1F600; &AMP &am</p>", "&amp; é\U0001f600 & &am"),
        ("<article><p>One</p>two<div>three</div>four</article>", "One\ntwo\nthree\nfour"), ("<article>a <b>b</b>c<i> d</article>", "a bc d"), ("<p>x < y and <3</p>", "x < y and <3"),
        ("<article><p title='a>b' class=\"c\">q</p><p class=>r</p>", "q\nr"), ("<article><p>one<!-- <p>two --></p><![CDATA[three]]><p>four", "one\nfour"), ("<article><p>one</p><p>two <a", "one\ntwo"),
        ("<article><ul><li>a<li>b <ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<article><ul><li><a href=1>a</a><li><a href=2>b</a><li><a>c</a></ul><p>d</p>", "d"), ("<article><p><a href=x>All of it a link</a></p>", "All of it a link"),
        ("<form id=aspnet><div><p>Within a form.</p></div></form>", "Within a form."), ("<article><p>a<span class=ad>b <span>c</span> d</span>e</p><p hidden>f</p><div style='display: none'>g</div>", "ae"),
        ("<article><script>x<p>y</script><p>z</p><SCRIPT>", "z"), ("<article><h1 class=post-header>t</h1><table><tr><td>a<td>b<tr><th>c</table>", "t\na\nb\nc"), ("</p></div><main><p>m</main>", "m"),
        ("<div class=content><div class='post has-comments no-sidebar'><p>Kept.</p></div></div>", "Kept."), ("<p>😀 é</p>".encode("utf-16", "surrogatepass").decode("utf-16"), "\U0001f600 é"),
    ],
)
def test_markup(source, text):
    page = html_extract.parsed(source)
    assert page.text(html_extract.chosen(page.scores(), {})) == text


def test_deep_and_long_pages_stay_linear(spark):
    deep = "<div class=a>" * 20_000 + "<p>Deep down.</p>" + "</div>" * 20_000
    long = "<article>" + "<p>Long text here, and more of it.</p>" * 100_000 + "</article>"
    odd = "<a \"" * 20_000 + "<p>end" + "&" * 20_000
    rows = [(1, "http://a.org", deep), (2, None, long), (3, "no url", odd), (None, None, None), (4, "http://a.org", ""), (4, "http://a.org", "")]
    got = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got)[:1] == [(0, 0)] and len(got) == 6
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == "Deep down." and text[2].count("\n") == 99_999 and text[4] == ""
    assert max(len(r["path"]) for r in got) <= html_extract.PATH
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_joined_by_host_gives_the_same_rows(spark, monkeypatch):
    r = random.Random(8)
    rows = spark.createDataFrame([(i, f"http://h{i % 3}.org/", page(r, r.choice(["div", "article"]), i)[0]) for i in range(40)], "page_id long, url string, html string")
    one = sorted(map(tuple, html_extract.extracted(rows).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, html_extract.extracted(rows).collect())) == one
