import json
import random

import pytest

from assayer.llm import urlfilter, wrappers

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1><ul class="menu"><li>a</ul></header>
<div class="cookie-notice">We use cookies</div><main><article class="post"><header><h1>T &amp; U</h1><p>by X</p></header><p>One <b>two</b>three&nbsp;four<p>Six <em>seven
   eight</em></p><div class="ad">Buy</div><blockquote>quote &lt;b&gt;</blockquote><form><p>Subscribe</p></form><ul><li>i1<li>i2</ul>
<section id="comments"><article><p>great</p></article></section></article><aside>rel</aside></main><footer>f</footer><script>var x="<p>no</p>"</script></body></html>"""
PLAIN = '<html><body><div id="top"><a href="/">Home</a> <a href="/b">B</a></div><div class="wrap"><div id="x"><p>%s</p><p>%s</p></div><div class="sidebar">links</div><p>All rights reserved</p></div></body></html>'


def test_one_page():
    assert wrappers.extract(PAGE, None) == "One twothree four\nSix seven eight\nquote <b>\ni1\ni2"


@pytest.mark.parametrize("text, expected", [(None, ""), ("", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("<p>a<p>b", "a\nb"), ("<div class=ad>x<article>hello<p>y", "hello\ny"), ("<article><p>a</article", "a"), ("<article>" + "<div>" * 3000 + "deep", "deep"), ("<article><!-- x <p>y --><p title='a>b'>z</p></article>", "z"), ("<article><script>1", ""), ('<article class="story related-work"><p>x', "x"), ('<article><p class="alert">y</p><div class="comment-free story">z</div><div class="cookie-notice">n', "y\nz"), ("a < b <i>c", "a < b c"), ("<article><noscript>n</noscript><object><p>o</object>a<b", "n\no\na"), ("<article><header><h2>k</h2></header><p>x<textarea>t", "x")])
def test_odd_pages(text, expected):
    assert wrappers.extract(text, None) == expected


def test_alignment_finds_slots_optionals_and_repeats():
    w = None
    for html in ("<h1>A</h1><p>x</p><p>y</p><i>c</i>", "<h1>B</h1><p>x</p><div>more</div>", "<h1>C</h1><h2>k</h2><p>v</p><h2>k</h2><p>v</p>"):
        page = wrappers.of_page(wrappers.parse(html))
        w = page if w is None else wrappers.merged(w, page)
    kinds = {c.key: c for c in w.children}
    assert kinds["h1."].text == -1 and kinds["p."].repeated and kinds["div."].optional and w.pages == 3
    assert wrappers.load(w.dump()).dump() == w.dump()


def test_constant_texts_of_a_host_go(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(30))
    bodies = [(text(), text()) for _ in range(12)]
    rows = [(i, f"http://H.example/{i}", PLAIN % b, "x") for i, b in enumerate(bodies)] + [(90, None, PAGE, "x"), (91, "http://h.example/x", None, "x"), (90, None, PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in wrappers.extract_articles(pages).collect()}
    assert all(got[i]["text"] == "\n".join(b) and got[i]["n_chars"] == len(got[i]["text"]) for i, b in enumerate(bodies))
    assert got[91]["text"] == "" and got[90]["text"].startswith("One two") and wrappers.extract_articles(pages).count() == 15
    assert wrappers.extract_articles(pages.limit(0)).count() == 0


def wrapper_of(pages):
    shapes = {}
    for html in pages:
        page = wrappers.of_page(wrappers.parse(html))
        key = wrappers.shape_of(page)
        if key in shapes:
            wrappers.add_to(shapes[key], page)
        else:
            shapes[key] = page
    w = None
    for key in sorted(shapes):
        w = shapes[key] if w is None else wrappers.merged(w, shapes[key])
    return wrappers.load(w.dump())


def host_texts(pages):
    part = wrappers.part_of(wrapper_of(pages))
    return [wrappers.extract(html, part) for html in pages]


def scrambled(rng, n):
    """Pages of a host whose classes say nothing and that name no article, with their articles' blocks and the other blocks."""
    name = ["".join(rng.choice("bcdfgklmnpt") for _ in range(6)) for _ in range(8)]
    text = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 999)) for _ in range(k))
    rows = []
    for _ in range(n):
        menu, teaser = [text(2) for _ in range(6)], [text(3) for _ in range(4)]
        own = [text(4)] + [text(rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]
        parts = "".join(f"<p>{x}</p>" if rng.random() < 0.8 else f"<blockquote>{x}</blockquote>" for x in own[1:])
        links = lambda xs: "".join(f'<li><a href="/">{x}</a></li>' for x in xs)
        extra = f'<div class="{name[5]}"><p>{text(2)}</p></div>' if rng.random() < 0.3 else ""
        rows.append((f'<div class="{name[0]}"><ul>{links(menu)}</ul></div><div class="{name[1]}"><div class="{name[2]}"><h1>{own[0]}</h1>{parts}<ul class="{name[3]}">{links(teaser)}</ul><p class="{name[6]}">All rights are with us</p></div></div>{extra}<div class="{name[4]}">Made with care in {name[7]}</div>', own))
    return rows


def test_wrappers_do_without_names():
    rng = random.Random(4)
    hit = got = wanted = 0
    for _ in range(6):
        rows = scrambled(rng, 24)
        for text, (_, own) in zip(host_texts([r[0] for r in rows]), rows, strict=True):
            found = text.split("\n")
            hit, got, wanted = hit + sum(b in own for b in found), got + len(found), wanted + len(own)
    assert hit >= 0.97 * got and hit >= 0.97 * wanted


def test_any_partitions_give_the_same(spark):
    rng = random.Random(5)
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i % 9}'}.example/{i}", html) for i, (html, _) in enumerate(scrambled(rng, 90))]
    rows += [(100 + i, "http://hot.example/x", "".join(rng.choice(["<p>a</p>", "<div>b</div>", "<h2>c</h2>", "<pre>d</pre>"]) for _ in range(40))) for i in range(40)]
    results = []
    for n in (1, 16):
        rng.shuffle(rows)
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        assert wrappers.wrappers_of(pages).count() == len({r[1].split("/")[2] for r in rows})
        results.append((sorted(wrappers.wrappers_of(pages).collect()), sorted(wrappers.extract_articles(pages).collect())))
    assert results[0] == results[1]


@pytest.mark.parametrize("in_one_round", [wrappers.SHAPES, 4])
def test_all_shapes_of_a_host_are_aligned(spark, monkeypatch, in_one_round):
    monkeypatch.setattr(wrappers, "SHAPES", in_one_round)
    block = lambda i: "".join(f"<div class={c}>{c} {i}</div>" for k, c in enumerate("abcdefghi") if i >> k & 1)
    rows = [(i, "http://many.example/x", f"<section>{block(i)}</section>") for i in range(1, 301)] + [(999, "http://few.example/x", "<p>one")]
    found = []
    for n in (1, 7):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        found.append({r["host"]: wrappers.load(json.loads(r["wrapper"])) for r in wrappers.wrappers_of(pages).collect()})
    assert found[0]["many.example"].pages == 300 and found[0]["few.example"].pages == 1
    assert {c.key for c in found[0]["many.example"].children[0].children} == {f"div.{c}" for c in "abcdefghi"}
    assert {h: w.dump() for h, w in found[0].items()} == {h: w.dump() for h, w in found[1].items()}


def test_large_hosts_join_alike(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "http://hot.example/x", html) for i, (html, _) in enumerate(scrambled(random.Random(6), 30))], "page_id long, url string, html string")
    expected = sorted(wrappers.extract_articles(pages).collect())
    monkeypatch.setattr(wrappers, "BROADCAST_HOSTS", 0)
    assert sorted(wrappers.extract_articles(pages).collect()) == expected


def test_ends_of_nothing_are_read_in_linear_time():
    import time

    began = time.process_time()
    wrappers.parse("<div>" * 100_000 + "</i>" * 100_000 + "</div>" * 100_000)
    assert time.process_time() - began < 10


def test_wrappers_are_bounded():
    rng = random.Random(8)
    tags = [f"<{t} class={rng.choice('abcdefgh')}{rng.choice('abcdefgh')}>" for t in ("p", "div", "h2", "pre", "ul", "table") for _ in range(40)]
    w = wrapper_of(["<main>" + "".join(rng.choice(tags) + f"text {rng.random()}</div>" for _ in range(400)) + "</main>" for _ in range(6)])

    def widest(p):
        return max([len(p.children), *map(widest, p.children)])

    assert widest(w) <= wrappers.ROW


def wide(rng, n):
    """Pages of one block a class, n of them, and a constant one; the pages' own blocks."""
    names = ["".join("abcdefghij"[int(d)] for d in f"{i:04}") for i in range(n)]
    rows = []
    for k in range(12):
        own = [f"{rng.choice(['alpha', 'beta'])} {k} {rng.randint(0, 99)} {c}" for c in names]
        rows.append(("<div class=wrap>" + "".join(f"<p class={c}>{x}</p>" for c, x in zip(names, own, strict=True)) + "<h5 class=legal>All rights</h5><p class=made>By us</p></div>", own))
    return rows


@pytest.mark.parametrize("n", [150, 450])
def test_levels_of_any_width_are_kept(spark, monkeypatch, n):
    rows = wide(random.Random(n), n)
    w = wrapper_of([html for html, _ in rows])
    assert len(wrappers.level(w.children[0])) == n + 2 and wrappers.nodes(w) >= n + 4 and w.children[0].size == 0
    assert wrappers.load(w.dump()).dump() == w.dump()
    expected = ["\n".join([*own, "All rights"]) for _, own in rows]  # a heading stays, constant or not
    assert host_texts([html for html, _ in rows]) == expected
    pages = spark.createDataFrame([(i, "http://w.example/x", html) for i, (html, _) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    for held, passed, part in ((wrappers.HELD_NODES, wrappers.PASSED, 1 << 30), (1, 1, 0)):
        monkeypatch.setattr(wrappers, "PART_BYTES", part)
        monkeypatch.setattr(wrappers, "HELD_NODES", held)
        monkeypatch.setattr(wrappers, "PASSED", passed)
        assert [r["text"] for r in wrappers.extract_articles(pages).orderBy("page_id").collect()] == expected


@pytest.mark.parametrize("kinds", [2, 30, 5000])
def test_long_streams_are_aligned_as_short_ones(monkeypatch, kinds):
    monkeypatch.setattr(wrappers, "CELLS", 9)
    rng = random.Random(kinds)
    for n, m in ((0, 5), (5, 0), (1, 70), (70, 1), (60, 90), (90, 60), (80, 80)):
        x, y = ([f"k{rng.randrange(kinds)}" for _ in range(k)] for k in (n, m))
        y[: n // 3] = x[: n // 3][: len(y)]
        found = wrappers._by_halves(x, y)
        assert [i for i, _ in found if i is not None] == list(range(len(x))) and [j for _, j in found if j is not None] == list(range(len(y)))
        both = [(i, j) for i, j in found if i is not None and j is not None]
        assert all(x[i] == y[j] for i, j in both)
        assert len(both) == sum(i is not None and j is not None for i, j in wrappers._by_table(x, y))


@pytest.mark.parametrize("unit", ["<a ", '<a "', '<a b="', "</", "<!", "<x/", "<a b='\"", "<!--", "&#", "<div>", "<p>x", "<foo>", "<a-b><c-d>", "<p><foo>"])
def test_pages_are_read_in_linear_time(unit):
    import time

    began = time.process_time()
    wrappers.extract(unit * 100_000, None)
    assert time.process_time() - began < 10


def test_constant_texts_go_by_aligned_node():
    bodies = [(f"alpha {i} " * 9, f"head {i}", f"beta {i} " * 9) for i in range(6)]
    page = "<div class=wrap><p>%s</p><h2>%s</h2><p>%s</p><div class=ad>buy</div><p>All rights reserved</p></div>"
    assert host_texts([page % b for b in bodies]) == ["\n".join(x.strip() for x in b) for b in bodies]
    # a constant text of an element does not take along the blocks inside it
    page = "<div class=wrap><div class=by>Written by <p>%s</p></div><h2>%s</h2><p>%s</p></div>"
    assert host_texts([page % b for b in bodies]) == ["\n".join(x.strip() for x in b) for b in bodies]


def test_blocks_of_a_few_copies_stay():
    page = "<div class=wrap><p>%s</p>%s</div>"
    copies = [page % ("same " * 20, "<h2>k</h2><blockquote>only here</blockquote>")] * 5
    texts = host_texts(copies + [page % (f"other {i} " * 20, "") for i in range(9)])
    assert all(x.endswith("k\nonly here") for x in texts[:5])
    assert all(host_texts(copies))  # one distinct page has no constant texts


RULED = [
    ("http://a.example.com/en/700?x", "example.com/en/7", "allow"),
    ("https://EXAMPLE.com/en/6", "com/en/", "block"),
    ("http://x.net/de/8", "net/de/", "allow"),
    ("http://www.example.net/de/81#a", "example.net/de/8", "block"),
    ("http://org/es/1", "org/es/", "block"),
    ("http://xorg/es/", None, None),
    ("http://com?x=/en/", None, None),
    ("http://a.com/EN/", None, None),
    ("no url", None, None),
    (None, None, None),
]


@pytest.mark.parametrize("url, rule, verdict", RULED)
def test_rules(url, rule, verdict):
    assert urlfilter.Rules(urlfilter.RULES).find(*urlfilter.split_url(url)) == (rule, verdict)


def labelled(rng, n):
    rows = []
    for _ in range(n):
        bad = rng.random() < 0.4
        host = ("".join(rng.choice("0123456789xz-") for _ in range(18)) if bad else rng.choice(["news", "blog", "wiki"]) + str(rng.randint(1, 9))) + rng.choice([".example.info", ".example.edu"])
        rows.append((f"http://{host}/" + "/".join(rng.choice(["a", "bb", "ccc"]) for _ in range(rng.randint(1, 4))), int(bad)))
    return rows


def test_trees_on_held_out_urls(spark):
    rng = random.Random(2)
    test = labelled(rng, 500)
    pages = spark.createDataFrame([(i, u, "x") for i, (u, _) in enumerate(test)] + [(1000 + i, u, "x") for i, (u, _, _) in enumerate(RULED)], "page_id long, url string, verdict string")
    fit = spark.createDataFrame(labelled(rng, 2000), "url string, bad int")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(pages, fit).collect()}
    assert sum((got[i]["verdict"] == "block") == bool(y) for i, (_, y) in enumerate(test)) >= 0.97 * len(test)
    assert all(got[1000 + i]["rule"] == rule and (verdict is None or got[1000 + i]["verdict"] == verdict) for i, (_, rule, verdict) in enumerate(RULED))
    assert got[1009]["host"] == "" and got[1009]["path"] == ""
    assert urlfilter.filter_urls(pages, fit.limit(0)).where("rule IS NULL AND verdict = 'block'").count() == 0
    assert urlfilter.filter_urls(pages.limit(0), fit).count() == 0
