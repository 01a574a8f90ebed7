"""Main text extraction: planted articles among page furniture, consensus of hosts, malformed markup, odd rows."""

import html
import random
from html.parser import HTMLParser

import pytest

SCHEMA = "page_id long, url string, html string"


def extracted(spark, rows):
    from rolefinch.llm.html_extract import extract_main

    return extract_main(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()


def one(source):
    from rolefinch.llm.html_extract import main_text

    return main_text(source, ())


class Plain(HTMLParser):
    """The blocks of well-formed markup, one for each element that holds text of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
        elif tag not in ("b", "a", "em", "span"):
            self.cut()

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "em", "span"):
            self.cut()

    def handle_data(self, data):
        self.now.append(data)

    def cut(self):
        if text := " ".join("".join(self.now).split()):
            self.out.append(text)
        self.now = []


def planted(rng, n):
    """(markup, text) of an article of ``n`` blocks."""
    word = lambda: rng.choice(["lorem", "ipsum", "dolor", "a & b", "x < y", "naïve", "“so”", "漢字"])
    said = lambda k: html.escape(" ".join(word() for _ in range(k)))
    parts = [f"<h1>{said(3)}</h1>"]
    for i in range(n):
        kind = rng.randrange(6)
        parts.append([f"<p>{said(20)}</p>", f"<p>{said(4)}\n  <b>{said(2)}</b><br>{said(3)}</p>", f"<ul><li>{said(2)}</li><li><a href='/x'>{said(1)}</a></li></ul>", f"<h2>{said(2)}</h2>", f"<table><tr><td>{said(2)}</td><td>{said(1)}</td></tr></table>", f"<blockquote><p>{said(9)}</p></blockquote>"][kind])
    p = Plain()
    p.feed("".join(parts))
    p.close()
    p.cut()
    return "".join(parts), "\n".join(p.out)


def page(rng, body, shell):
    n = rng.randrange(10**6)
    return f"""<!DOCTYPE html><html><head><title>{n} site</title><style>p{{x:0}}</style><script>if (a</b) t="<p>no</p>";</script></head><body class="p{n}">
    <header><h1>Site {n}</h1><nav><ul><li><a href="/">Home</a></li></ul></nav></header><div class="cookie-notice">We use cookies on this site, please read this very long notice about them and accept it at once.</div>
    <div id="menu-{n}" class="menu"><a href="/a">A</a></div><div class="sidebar"><p>Sidebar text that is rather long and holds no links at all, as some sidebars do.</p></div>
    {shell.format(n=n, body=body)}
    <div class="ad-slot">Buy this</div><form action="/s"><label>Search</label><input name=q><select><option>one</select><textarea>t</textarea></form><section id="comments"><article class="comment"><p>First! A very long reader comment that goes on and on and on, and on, longer than the article it stands under, as such remarks at times are. {"More. " * 80}</p></article></section>
    <footer>&copy; {n}</footer><!-- <article>not this</article> --></body></html>"""


SHELLS = {
    "article": "<main><article class='post-{n}'>{body}</article></main>", "class": "<div class='wrap'><div class='entry-content e{n}'>{body}</div></div>",
    "table": "<table><tr><td class=left><a href=x>link</a></td><td class=text>{body}</td></tr></table>", "form": "<form id=f{n}><main>{body}</main></form>",
}


@pytest.mark.parametrize("shell", SHELLS)
def test_planted_articles_among_furniture(spark, shell):
    rng = random.Random(shell)
    rows, want = [], {}
    for i in range(60):
        body, want[i] = planted(rng, rng.choice([1, 3, 12]))
        rows.append((i, f"https://user@{['A', 'b'][i % 2]}.example.org:80/{i}", page(rng, body, SHELLS[shell])))
    got = extracted(spark, rows)
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_the_host_decides_where_a_page_alone_errs(spark):
    """Unmarked furniture longer than a short article: the page alone takes the wrong container, its host the right one."""
    box = lambda side, text: f"<body><div class=x>{side}</div><div class=y><p>{text}</p></div></body>"
    long, side = "word " * 200, "<p>unmarked furniture of a page</p>" * 3
    rows = [(i, f"http://h.example/{i}", box(side, long)) for i in range(20)] + [(99, "http://h.example/s", box(side, "Short.")), (100, "http://other.example/s", box(side, "Short."))]
    got = {r["page_id"]: r["text"] for r in extracted(spark, rows)}
    assert got[99] == "Short." and got[0] == long.strip() and got[100] != "Short."


def test_hosts_with_several_templates_and_a_rare_one(spark):
    rows = [(i, "http://h.example/", f"<body><article><p>{'one ' * 30}</p></article><p>rest</p></body>") for i in range(30)]
    rows += [(100 + i, "http://h.example/", f"<body><div class=doc><p>{'two ' * 30}</p></div><p>rest</p></body>") for i in range(20)]
    rows += [(200, "http://h.example/", f"<body><section><p>{'three ' * 30}</p></section><p>rest</p></body>")]
    got = {r["page_id"]: r["text"].split()[0] for r in extracted(spark, rows)}
    assert got[0] == "one" and got[100] == "two" and got[200] == "three"


def test_winners_against_plain_votes(spark):
    from rolefinch.llm.html_extract import winners

    rng = random.Random(4)
    votes = {(f"h{rng.randrange(5)}", f"p{k}"): (rng.choice([1, 2, 9, 40]), rng.randrange(100)) for k in range(60)}
    got = {r["host"]: r["paths"] for r in winners(spark.createDataFrame([(*k, *v) for k, v in votes.items()], "host string, path string, votes long, score long")).collect()}
    for h in {h for h, _ in votes}:
        own = {p: v for (x, p), v in votes.items() if x == h}
        assert got[h] == [p for p in sorted(own, key=lambda p: (-own[p][0], -own[p][1], p)) if 10 * own[p][0] >= sum(v for v, _ in own.values())] and len(got[h]) <= 10


@pytest.mark.parametrize(
    "source, want",
    [
        ("<article><p><b>a<br><p>b</p></article><footer>f", "a\nb"), ("plain &amp text &#8217;&eacute;&nbsp;x", "plain & text ’é x"), ("<p>a<!-- b --><script>c</script>d</p>", "ad"), ("<body><p title='a>b'>c", "c"),
        ("<div>x<p>y</div>z", "x\ny\nz"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<p>a</b></i></div>b</p>", "ab"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<script>never closed <p>a", ""), ("<p>a < b <", "a < b <"),
        ("<p>a<button>no</button>b<p hidden>no<p style='display: none'>no", "ab"), ("<article><header><h1>T</h1><p>by me</p></header><p>x</p><footer>f</footer></article>", "T\nx"), ("<p>a\t\n b", "a b"), ("<a", ""), ("", ""), ("<article><h1 class='entry-header'>T</h1><p>x</p></article>", "T\nx"), ("<body><div class='site menu-open'><div class=menu><p>m</p></div><h1>T</h1><p>text of the page</p></div><div class=ad><p>buy this now</p></div>", "T\ntext of the page"),
        ("<div class=cookie-notice><p>A notice that is longer than the page itself.</p></div><p>x</p>", "x"), ("<p>x</p><div id=comments><h1>1</h1><p>a very long remark</p><p>another one</p><p>yet another</p></div>", "x"), ("<div class=post><div class=post-header><h1>T</h1><p>by me</p></div><p>x</p></div>", "T\nx"), ("<body></body>after", "after"),
    ],
)
def test_malformed_pages(source, want):
    assert one(source) == want


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [(1, None, "<p>a</p>"), (2, "", "<p>b</p>"), (3, "no address", None), (None, "http://h.example", ""), (4, "http://h.example", "<p>" + "long " * 300_000), (5, "http://h.example/", deep), (6, "http://h.example/", "<p>r</p>"), (6, "http://h.example/", "<p>r</p>")]
    got = sorted(extracted(spark, rows), key=lambda r: (r["page_id"] or 0))
    assert [(r["page_id"], r["text"][:4], r["n_chars"]) for r in got] == [(None, "", 0), (1, "a", 1), (2, "b", 1), (3, "", 0), (4, "long", 1_499_999), (5, "deep", 4), (6, "r", 1), (6, "r", 1)]
    from rolefinch.llm.html_extract import extract_main

    df = spark.createDataFrame(rows, SCHEMA)
    assert extract_main(df.where("false")).collect() == []
    clash = extract_main(df.selectExpr("*", *(f"'z' as {c}" for c in "id host paths salt text n_chars path votes score".split())))
    assert sorted(map(str, clash.collect())) == sorted(map(str, extract_main(df).collect()))


def test_many_hosts_are_joined(spark, monkeypatch):
    from rolefinch.llm import html_extract as m

    rows = [(i, f"http://h{i % 3}.example/", f"<body><div class=a><p>{'w ' * 50}{i}</p></div><p>x</p></body>") for i in range(30)] + [(50, None, "<p>y</p>")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, m.extract_main(df).collect()))
    monkeypatch.setattr(m, "BROADCAST_HOSTS", 1)
    assert sorted(map(str, m.extract_main(df).collect())) == want
