import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridprint.llm import exact_dedup, html_extract, mixing, near_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# mixing

def soft(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, p_a double, p_b double")


def brute_rates(rows, b):
    """Projected gradient in numpy, with many small steps, on the same least squares."""
    t, p = np.array([r[1] for r in rows], float), np.array([r[2:] for r in rows])
    scale = np.linalg.pinv((p * t[:, None]).T @ p)
    r = np.ones(len(rows))
    for _ in range(20_000):
        r = np.maximum(0, r - 0.2 * p @ (scale @ (p.T @ (t * r) - b)))
    return p.T @ (t * r)


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(1, 500)), float(x), float(1 - x)) for i, x in enumerate(rng.beta(0.5, 0.5, 200))]
    steps, residuals = mixing.fit_rates(soft(spark, rows), ["a", "b"], {"a": 0.3, "b": 0.7})
    assert residuals[-1] < 1e-6 and len(steps) == len(residuals) - 1


def test_rates_stay_nonnegative_when_targets_are_out_of_reach(spark):
    rows = [(i, 100, 0.6, 0.4) for i in range(10)] + [(i, 50, 0.5, 0.5) for i in range(10, 20)]
    df = soft(spark, rows)
    steps, residuals = mixing.fit_rates(df, ["a", "b"], {"a": 0.01, "b": 0.99})
    rate = mixing._rate([F.col("p_a"), F.col("p_b")], steps)
    got = df.withColumn("r", rate).agg(F.min("r"), F.sum(F.col("n_tokens") * F.col("p_a") * F.col("r")), F.sum(F.col("n_tokens") * F.col("p_b") * F.col("r"))).first()
    total = sum(r[1] for r in rows)
    want = brute_rates(rows, np.array([0.01, 0.99]) * total)
    assert got[0] >= 0 and np.abs(np.array(got[1:]) - want).max() < 0.02 * total


def test_mixing_tells_domains_apart_and_counts_copies(spark, docs):
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == docs.count() and all(abs(r["p_clean"] + sum(r[k] for k in r.asDict() if k.startswith("p_") and k != "p_clean") - 1) < 1e-9 for r in rows)
    assert all(abs(r["n_copies"] - r["rate"]) < 1 and r["rate"] >= 0 for r in rows)
    out = mixing.mixed(docs, labels)
    assert out.columns == docs.columns and out.count() == sum(r["n_copies"] for r in rows)


def test_mixing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (2, "", 1.0), (None, "idiot " * 80, 2.0), (4, "word " * 30_000, 3.0)], "doc_id long, text string, rate double")
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {(r["rate"], r["n_copies"]) for r in mixing.mix(df, none).collect()} == {(1.0, 1)}
    some = spark.createDataFrame([(1, "x"), (4, "y"), (4, "x"), (77, "y")], "doc_id long, domain string")
    assert mixing.mix(df, some).count() == 5
    assert mixing.mix(df.limit(0), some).count() == 0 and mixing.mixed(df.limit(0), none).count() == 0


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>no";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home<li><a href="/b">News</ul></nav><div class="cookie-notice">We use cookies</div>
{body}<aside>Side</aside><div id="comments"><p>First!</p></div><form><input><p>Sign up</p></form><footer>&copy; site</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, rid int")


def texts(spark, rows):
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(pages(spark, rows)).collect()}


def test_article_without_boilerplate(spark):
    body = "<article><h1>A &amp; B&#8217;s</h1><p>one\n  two<br>three <b>bold</b><p>four &lt;x&gt; é<ul><li>i<li>j</ul><div class='ad'>buy</div><div class='share-bar'>tweet</div><!-- <p>x</p> --></article>"
    got = texts(spark, [("http://h/1", PAGE.format(body=body))])
    want = "A & B’s\n\none two three bold\n\nfour <x> é\n\ni\n\nj"
    assert got[0] == (want, len(want))


def test_template_is_what_stays_the_same(spark):
    def page(i):
        return f"<html><body><div><p>Welcome to our site</p><div><p>Story {i} about {i * 7}</p><p>more of {i}</p></div><p>All rights reserved</p></div></body></html>"

    got = texts(spark, [(f"https://h.example/{i}", page(i)) for i in range(6)] + [("https://other/1", page(9))])
    assert all(got[i][0] == f"Story {i} about {i * 7}\n\nmore of {i}" for i in range(6))
    assert got[6][0].startswith("Welcome")  # one page has no template


def test_template_goes_inside_an_article_too(spark):
    def page(i, tag):
        return f"<body><{tag}><p>Read our new terms</p><h1>Title {i}</h1><p>Story {i * 7}</p><p>Written by the staff</p></{tag}></body>"

    got = texts(spark, [(f"http://{tag}/{i}", page(i, tag)) for tag in ("article", "main") for i in range(6)])
    assert [got[i][0] for i in range(12)] == [f"Title {i}\n\nStory {i * 7}" for i in [*range(6)] * 2]


def test_template_of_a_host_whose_first_page_is_unusual(spark):
    def page(i):
        notice = "<p>Our office is closed on Monday</p>" if i % 4 else ""
        return f"<body><div>{notice}{''.join(f'<p>Story {i} part {k}</p>' for k in range(1 + i % 3))}</div></body>"

    odd = {"empty": "", "blank": " \n", "error": "<center>502 Bad Gateway</center>", "bare": "<body><div><p>An old page</p><p>of two parts</p></div></body>"}
    rows = [(f"http://{h}/{i}", odd[h] if i == 0 else page(i)) for h in odd for i in range(24)]
    for i, (text, _) in texts(spark, rows).items():
        if i % 24:
            assert text == "\n\n".join(f"Story {i % 24} part {k}" for k in range(1 + i % 24 % 3))


def test_reference_grows_by_what_it_lacks():
    trees = [html_extract.read(h)[0] for h in ("<div><p>a</p></div>", "<div><h1>t</h1><p>b</p></div><ul><li>x</ul>")]
    tree = html_extract.loaded(None)
    for t in trees:
        html_extract.grow(tree, t)
    again = html_extract.loaded(html_extract.dumped(tree))
    assert [n.label for n in html_extract.number(again)] == ["#root", "div", "h1", "p", "ul", "li"]
    assert [len(n.texts) for n in html_extract.number(again)] == [0, 0, 1, 2, 0, 1]


def test_copies_of_an_article_under_other_menus_are_no_template(spark):
    got = texts(spark, [(f"http://h/{i}", f"<body><nav>Menu {i}</nav><article><p>The same long story</p><p>and its end</p></article></body>") for i in range(5)])
    assert all(t == "The same long story\n\nand its end" for t, _ in got.values())


def test_copies_of_a_page_are_no_template(spark):
    body = "<div><p>The same long story</p><p>and its end</p></div>"
    got = texts(spark, [(f"http://h/{i}", f"<body>{body}</body>") for i in range(5)])
    assert all(t == "The same long story\n\nand its end" for t, _ in got.values())


def test_pages_odd_rows(spark):
    rows = [(None, None), ("http://h/", ""), ("not a url", "plain < text & more"), ("http://h/", "<p>unclosed <b>bold"), ("http://h/", "</div></p>x</span>"), ("http://h", "<div>" * 3000 + "deep"), ("http://h", "<p>" + "long " * 50_000)]
    got = texts(spark, rows)
    assert [got[i][0] for i in range(6)] == ["", "", "plain < text & more", "unclosed bold", "x", "deep"] and got[6][1] == 249_999
    assert html_extract.extract(pages(spark, [])).count() == 0


def test_tree_matching():
    a, b = html_extract.parse("<div><p>x</p><ul><li>1<li>2</ul></div>"), html_extract.parse("<div><h1>t</h1><p>y</p><ul><li>3</ul></div>")
    html_extract.number(a)
    html_extract.number(b)
    # root, div, p, ul and one li match
    assert len(html_extract.align(a, b)) == 5 and html_extract.align(a, b)[2] == 3


def test_tree_matching_is_the_heaviest():
    """Against a plain recursion over all pairs of children, on small random trees without a text."""
    import random

    rng = random.Random(4)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rng.choices(("div", "section", "ul"), k=rng.randint(0, 4))) if depth else ""

    def plain(a, b):
        xs, ys = html_extract.elements(a), html_extract.elements(b)
        rows = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + (plain(x, y) if x.tag == y.tag else 0))
        return 1 + rows[-1][-1]

    for _ in range(60):
        a, b = html_extract.parse(tree(3)), html_extract.parse(tree(3))
        html_extract.number(a)
        html_extract.number(b)
        assert len(html_extract.align(a, b)) == plain(a, b)


def test_long_lists_of_like_items():
    import time

    pages = [html_extract.read("<div>" + "".join(f"<p>item {i * k} <b>bold</b><a>read more</a></p>" for i in range(10_000)) + "</div>")[0] for k in (1, 3)]
    began = time.process_time()
    assert len(html_extract.align(*pages)) > 10_000 and len(html_extract.align(pages[0], pages[0])) == 30_002
    assert time.process_time() - began < 60


def test_article_is_found_without_names(monkeypatch):
    """On hosts with enough pages the template alone tells content from what stands around it."""
    for name in ("DROP", "ROLES", "WHOLE", "PART"):
        monkeypatch.setattr(html_extract, name, set())

    def page(i):
        rows = "".join(f"<p>Paragraph {k} of story {i}</p>" for k in range(2 + i % 4))
        return f"<body><div>Daily News</div><div><div>Home</div><div>Sport</div></div><div><h1>Story {i}</h1><div>Subscribe now</div>{rows}</div><div>Most read</div><div>All rights reserved</div></body>"

    tree = html_extract.loaded(None)
    for i in range(8):
        html_extract.grow(tree, html_extract.read(page(i))[0])
    counts, seen = {}, []
    for i in range(40):
        root, _, found = html_extract.read(page(i))
        matched = html_extract.align(root, tree)
        seen.append([(matched.get(node), text) for node, _, _, _, text in found])
        for x in set(seen[-1]):
            counts[x] = counts.get(x, 0) + 1
    for i, own in enumerate(seen):
        assert [t for x in own for t in [x[1]] if counts[x] < 24] == [f"Story {i}", *[f"Paragraph {k} of story {i}" for k in range(2 + i % 4)]]


def test_whole_pages_table(spark):
    import re
    from html import unescape

    df = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_extract.extract(df).join(df.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = [" ".join(unescape(re.sub(r"<(?!br)[^>]*>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(filter(None, want)) and r["n_chars"] == len(r["text"])


# the stages together

def test_pipeline_stages(spark, docs, tmp_path):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert kept.columns == docs.columns
            assert kept.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "language":
            assert kept.count() == before.where("text rlike '\\\\p{L}'").count()
        if name == "exact_dedup":
            assert kept.count() == before.select(exact_dedup.normalised()).distinct().count()
        if name == "near_dedup":
            assert kept.count() == near_dedup.linked(before).select("component_id").distinct().count()
        if name == "mixing":
            assert kept.count() > 0
        if name == "bpe":
            assert kept.count() == before.count()
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_runs_as_a_whole(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
