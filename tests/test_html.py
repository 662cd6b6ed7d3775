import pytest

from millrace.html import capture, content, election, pages
from millrace.html.markdown import html_to_markdown
from millrace.html.prepare import prepare_html
from millrace.html.tree import parse


def test_tree_mends_what_is_malformed():
    root = parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>x<p>y<table><tr><td>1<td>2<tr><td>3</table></i><b>z")
    assert [n.text() for n in root.all("li")] == ["a", "b c", "c", "d"] and [n.text() for n in root.all("p")] == ["x", "y"]
    assert [len(r.all("td")) for r in root.all("tr")] == [2, 1] and root.all("b")[0].text() == "z"
    assert parse("<script>var t='</p>';</script><p>ok").all("p")[0].text() == "ok"
    assert parse(None).text() == ""


@pytest.mark.parametrize("selector,found", [
    ("p", 3), ("div p", 2), ("div > p", 1), (".a", 1), ("#i", 1), ("[data-x]", 1), ("[data-x=v]", 1), ("[class*=b-]", 1), ("p.a, #i", 2), ("div .a p", 0), ("p:not(.a)", 2), ("[class^=a]", 1), ("*", 5),
])
def test_selectors(selector, found):
    root = parse('<div><p class="a b-c">1</p><section><p id=i data-x=v>2</p></section></div><p>3</p>')
    assert len(root.select(selector)) == found


def test_unknown_selector_is_an_error():
    with pytest.raises(ValueError):
        parse("<p>").select("p::before")


def test_preparation():
    page = """<div class="sr-only">skip</div><div class="not-sr-only">kept</div><p data-nosnippet>no</p><button>Copy</button><button aria-expanded=false>Why does this matter here</button>
    <div><p>Was this helpful?</p><div><button>Yes</button><button>No</button></div></div><div style="display: none">hid</div><div hidden id="S:1">streamed</div><main><div role=tabpanel hidden>tab</div></main>
    <svg><text>v</text></svg><span> </span><h2><div>Big</div> <p>title</p></h2><a href=/u><div><h3>Card</h3><p>text</p></div></a><span>ab</span><span>cd</span><pre class="language-py"><code>x</code></pre>"""
    html = prepare_html(page)
    for gone in ("skip", ">no<", "Copy", "helpful", "hid<", ">v<"):
        assert gone not in html, gone
    for kept in ("kept", "Why does this matter here", "streamed", "tab", 'data-language="py"', '<h3><a href="/u">Card</a></h3>', "<span>ab</span> <span>cd</span>"):
        assert kept in html, kept
    assert "<h2>Big title</h2>" in html.replace("  ", " ")
    assert "skip" in prepare_html(page, chrome=False)


def test_main_content_and_guard():
    words = "word " * 60
    page = f"<nav>menu one two</nav><header>site</header><main><header><p>Eyebrow</p><h1>T</h1></header><p>{words}</p></main><aside>ad</aside><footer>f</footer>"
    found = content.main_content(page)
    assert not found.aborted and "menu" not in found.root.text() and "T" in found.root.text() and "Eyebrow" not in found.root.text()
    stub = f'<div class="newsletter"><p>{words}</p></div><p>x</p>'
    assert content.main_content(stub).aborted and "word" in content.main_content(stub).root.text()
    assert content.main_region(page).name == "main" and content.main_region("<main>few words</main>") is None
    assert "menu" not in content.guard_baseline(page).text()


def test_link_farms():
    links = "".join(f'<a href="https://site{i}.com/">s {i}</a> ' for i in range(7))
    page = parse(f"<div>{links}</div><p>{'word ' * 100}</p>")
    assert content.is_link_farm(page.all("div")[0], 114) and not content.is_link_farm(page.all("div")[0], 20)
    same = parse("<div>" + "".join(f'<a href="https://a.com/{i}">s</a>' for i in range(9)) + "</div>")
    assert not content.is_link_farm(same.all("div")[0], 1000)


def test_markdown_writer():
    md = html_to_markdown("<h1><b>T</b></h1><p>a <b>b</b>\n<i>c</i> <a href='/x' title=t>l</a> <code>`k`</code><br>d</p><ol start=3><li>one<ul><li>in</ul><li>two</ol><hr><blockquote>q</blockquote><img src='data:x' alt=al><img src=/i.png><a href='#f'>frag</a>", "http://h/p/")
    assert md == "# T\n\na **b** *c* [l](http://h/x \"t\") `` `k` ``  \nd\n\n3. one\n   - in\n4. two\n\n---\n\n> q\n\nal![](http://h/i.png)frag\n"
    assert html_to_markdown("<pre>a\n```\nb</pre>") == "````\na\n```\nb\n````\n" and html_to_markdown("  ") == "" and html_to_markdown(None) == ""
    table = html_to_markdown("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>")
    assert table == "| a | b |\n| --- | --- |\n| 1 |  |\n"


def test_election():
    prose = "\n".join(f"Sentence number {w} talks about several interesting matters." for w in "alpha bravo charlie delta echoes foxtrot golfing hotel indigo juliet kilogram limousine mikes november oscars papaya quebec romeo sierra tango".split())
    nav = "\n".join(f"[Link {i}](u{i})" for i in range(10))
    full = nav + "\n# Title\n" + prose
    assert election.elect([("structural", "# Title\n" + prose), ("readability", "# Title\n" + prose[:200])], full).source == "structural"
    assert election.elect([("readability", prose)], full).source == "full_page"  # the page title is lost: an orphan of weight two
    assert election.elect([("readability", "# Title\n" + prose), ("structural", "# Title\n" + prose)], full).source == "readability"
    assert election.elect([("structural", "short")], "tiny page").source == "structural" and election.elect([], "tiny page").fell_back
    code = full + "\n```\nimport something useful here\n```"
    assert election.elect([("structural", "# Title\n" + prose)], code).fell_back
    assert election.is_nav("- [a](b)") and not election.is_nav("[a](b) and much more") and election.nav_ratio(["[a](b)", "x"]) == 0.5


def test_page_conversion(spark):
    rows = [(1, "http://x/", "<html><head><title>T</title></head><body><nav>m</nav><article><h1>T</h1><p>" + "word " * 50 + "</p></article></body></html>"), (2, "http://x/b", None), (3, "http://x/c", "<p>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.to_markdown(df).collect()}
    assert got[1].markdown.startswith("# T\n") and got[2].markdown_source in ("raw", "full_page") and got[3].markdown.strip()
    assert pages.body_markdown('{"a":1}', "json", "u")[0] == '```json\n{\n  "a": 1\n}\n```\n' and pages.body_markdown("x\ny", "text", "u")[0] == "x\ny"


def test_captures(spark):
    html = """<html lang=en><head><title>T</title><meta name=description content=d><script type="application/ld+json">[{"@type":"X"}, 3]</script><script type="application/ld+json">{bad</script></head>
    <body><a href=/a>in</a><a href=https://other.org/>out</a><figure><img src=i.png alt=x><figcaption>cap</figcaption></figure><table><thead><tr><th>a<th>b</thead><tr><td>1 one<td>2 two</table><p>text</p></body></html>"""
    c = capture.capture(html, "https://x.com/p")
    s = c["structured"]
    assert s["metadata"]["title"] == "T" and s["metadata"]["language"] == "en" and s["structured_data"] == [{"@type": "X"}]
    assert s["links"]["internal"][0]["href"] == "https://x.com/a" and s["links"]["external"][0]["base_domain"] == "other.org"
    assert s["tables"][0]["headers"] == ["a", "b"] and capture.images(parse(html), "https://x.com/p")[0]["desc"] == "cap"
    assert capture.bundle(html, "https://x.com/p", ["title", "headings", "nonsense"]) == {"title": "T", "headings": []}
    assert capture.capture("plain", "u", "text")["text"] == "plain"
    assert capture.tracked_terms({"a": ["b ", ""], "c": 1}) == ["a", "b", "c"] and capture.tracked_terms([]) is None
    df = spark.createDataFrame([(1, "https://x.com/p", html)], "page_id long, url string, html string")
    assert capture.captures(df).first().content_hash == capture.capture_hash(c)
    d = spark.createDataFrame([("a", "a"), ("a", "b")], "x string, y string").select(capture.diff("x", "y").alias("d")).collect()
    assert [(r.d.has_changes, r.d.similarity, len(r.d.changes)) for r in d] == [(False, 1.0, 0), (True, 0.0, 1)]
