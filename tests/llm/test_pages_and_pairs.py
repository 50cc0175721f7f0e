import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexforge.llm import html, jaccard


# --- html -------------------------------------------------------------------------

BODY = "<p>Some long text, with commas and stops. More of it, here.</p><p>Short.</p><p>Another &amp; longer one; it has <b>bold</b> words, too.</p>"
TEXT = "Some long text, with commas and stops. More of it, here.\nShort.\nAnother & longer one; it has bold words, too."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Head</h1>{BODY}</article><footer>&copy; x</footer></body></html>", "Head\n" + TEXT),
        (f"<body><div id=main><h1>Head</h1><div class=cookie-notice>We use cookies, ok.</div>{BODY}<div class='comments'><p>I think, so. Really.</p></div></div><aside>x, y. z</aside></body>", "Head\n" + TEXT),
        (f"<body><header>Site</header>{BODY}<form>Name: <input> <button>Go</button></form><div class='ad'>Buy, now.</div></body>", TEXT),
        ("<article><p><b>One, two. three<br><p>Four, five. six.<p>Seven</article>", "One, two. three\nFour, five. six.\nSeven"),
        ("<article><p>a\n\t b&nbsp;c</p><script>var x = '</p>';</script><style>p{}</style><!-- no --><p>d</p>", "a b c\nd"),
        ("", ""),
        (None, ""),
        ("plain words, no tags.", "plain words, no tags."),
        ("<article><ul><li>one, a.<li>two, b.</ul><table><tr><td>c1<td>c2</table>", "one, a.\ntwo, b.\nc1\nc2"),
        ("<p>x < y, and a > b. so</p>", "x < y, and a > b. so"),
        ("<nav>only menus</nav>", ""),
        ("<article><header class='entry-header'><h1>Head</h1></header><div class='commentary'><p>One, two. three, four.</p></div><div class='comment-list'><p>No, no. no</p></div></article>", "Head\nOne, two. three, four."),
        ("<body><div class='site-header'>Site</div><main><div class='article-header'><h1>Head</h1></div><p>One, two. three, four.</p></main></body>", "Head\nOne, two. three, four."),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_scripts_do_not_open_tags():
    assert html.main_text("<body><script>if (a<b) '<article>'</script><article><p>Real, text. here</p></article>") == "Real, text. here"


def test_extract(spark, sf_dir):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, "v", "<p>A, b. c", "t"), (2, "v", "<p>A, b. c", "t")], "page_id long, url string, html string, TEXT string")
    rows = html.extract(df).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in rows] == [("", 0), ("A, b. c", 7), ("A, b. c", 7)]
    assert html.extract(df.limit(0)).count() == 0
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert html.extract(pages).count() == pages.count()


def test_extract_equals_articles(spark, sf_dir):
    import html as entities

    for r in html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumnRenamed("url", "u").selectExpr("page_id", "html AS raw", "html")).collect():
        article = re.search(r"<article>(.*?)</article>", r.raw, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


# --- n-gram Jaccard ---------------------------------------------------------------


def brute(rows, n=5, threshold=0.8):
    """doc_id -> (class_id, n_links, n_copies) by all pairs that share a shingle."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[tuple(re.findall(r"\w+", (t or "").lower()))].append(i)
    keys = [k for k in texts if k]
    sets = [{k[j : j + min(n, len(k))] for j in range(len(k) - min(n, len(k)) + 1)} for k in keys]
    posting, common = defaultdict(list), Counter()
    for a, s in enumerate(sets):
        for g in s:
            common.update((b, a) for b in posting[g])
            posting[g].append(a)
    root, links = list(range(len(keys))), Counter()

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (a, b), c in common.items():
        if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for a, k in enumerate(keys):
        least[find(a)] = min(least.get(find(a), 1 << 60), *texts[k])
    out = {i: (least[find(a)], links[a], len(texts[k])) for a, k in enumerate(keys) for i in texts[k]}
    return out | {i: (i, 0, 1) for i in texts[()]}


def near_copies(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_against_all_pairs(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 120, 300]))]
        for k in range(rng.choice([1, 2, 5, 40])):
            rows.append((i, near_copies(rng, words, k % 3)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "...!"), (i + 3, "two words"), (i + 4, "Two, WORDS"), (i + 5, "a b c d e"), (i + 6, "x " * 20000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, node string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.similar(df, block=8).collect()}
    assert got == brute(rows)
    kept = sorted(r.doc_id for r in jaccard.keep_one(df).collect())
    assert kept == sorted({c for c, *_ in brute(rows).values()})


def test_large_groups_of_near_copies_cost_rows_in_proportion(spark, monkeypatch):
    n, counted, stage = 20_000, {}, jaccard.stage_table

    def watched(df, label, rows=None):
        out = stage(df, label, rows)
        counted[label] = counted.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stage_table", watched)
    words = F.array(*(F.lit(f"w{k}") for k in range(120)))
    text = F.array_join(F.transform(words, lambda w, k: F.when(k == F.col("id") % 110 + 5, F.concat(F.lit("own"), F.col("id"))).otherwise(w)), " ")
    df = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = jaccard.similar(df)
    assert got.filter(f"class_id = 0 AND n_links = {n - 1} AND n_copies = 1").count() == n
    assert counted["members"] + counted["balls"] + counted["verified"] <= 2 * n


def test_loose_groups_against_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(150)]
    rows = [(i, near_copies(rng, words, rng.randrange(5))) for i in range(300)]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert [(r.n_copies, r.n_links) for r in jaccard.similar(df).collect()] == [(3, 0)] * 3
    assert jaccard.similar(df.limit(0)).count() == 0


def test_prefixes_shorten_to_the_recall():
    lengths = jaccard.depths()
    assert lengths == list(range(jaccard.MAX_DEPTH, lengths[-1] - 1, -1))
    assert 1 - jaccard.missed(0.8, lengths[-1], jaccard.TREES) >= jaccard.RECALL > 1 - jaccard.missed(0.8, lengths[-1] + 1, jaccard.TREES)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in jaccard.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


def test_query(spark, sf_dir):
    from lexforge.llm import entries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in entries.op10_ngram_jaccard(spark, sf_dir).collect()}
    assert got == brute(rows)


PROSE = [f"This is sentence {k}, which is long enough, and has marks; it counts as prose." for k in range(20)]


def paragraphs(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def test_content_beside_the_container_stays():
    page = f'<html><body><div class="content"><div class="lead">{paragraphs(PROSE[:3])}</div><div class="text">{paragraphs(PROSE[3:])}</div></div><div class="x"><a href="/">Home</a></div></body></html>'
    assert html.main_text(page).split("\n") == PROSE
    listed = "".join(f"<li>{x}</li>" for x in PROSE[3:])
    page = f'<html><body><div class="text">{paragraphs(PROSE[:3])}<ul>{listed}</ul></div><p><a href="/">Home</a></p></body></html>'
    assert html.main_text(page).split("\n") == PROSE


@pytest.mark.parametrize("name", ["has-sidebar", "with-sidebar", "page no-sidebar", "layout sidebar", "with_right-sidebar"])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_a_name_on_the_wrapper_does_not_empty_the_page(name, tag):
    page = f'<html><body><div class="{name}"><{tag} class="text">{paragraphs(PROSE)}</{tag}><div class="sidebar"><p>Some words, beside it.</p></div></div></body></html>'
    assert html.main_text(page).split("\n") == PROSE


def test_comments_as_articles_stay_outside():
    page = f'<html><body><article>{paragraphs(PROSE[:5])}</article><div class="comments"><article>{paragraphs(PROSE[5:])}</article></div></body></html>'
    assert html.main_text(page).split("\n") == PROSE[:5]


SPLIT = "".join(f"<p>{x}</p>" for x in PROSE[:6])


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ("<section class='related-work'><h2>Related work</h2><p>{x}</p></section>", True),
        ("<div id='notice-of-intent'><p>{x}</p></div>", True),
        ("<div class='notification'><p>{x}</p></div>", False),
        ("<div class='teaser'><h3>{x}</h3></div>", False),
        ("<div class='cookieBanner'><p>{x}</p></div>", False),
        ("<div class='post-comments'><p>{x}</p></div>", False),
        ("<ul><li><a href=1>One thing</a><li><a href=2>Other thing</a><li><a href=3>Third thing</a></ul>", False),
        ("<ul><li>One thing<li>Other thing</ul>", True),
        ("<div hidden><p>{x}</p></div>", False),
        ("<aside><p>{x}</p></aside>", False),
    ],
)
@pytest.mark.parametrize("wrapper", ["article", "main", "div class=story"])
def test_scores_decide_about_parts_of_the_article(wrapper, part, kept):
    said = part.format(x=PROSE[9])
    page = f"<html><body><div class='top-menu'><a href=/>Home</a></div><{wrapper}><h1>Head</h1>{SPLIT}{said}</{wrapper.split()[0]}></body></html>"
    blocks = [b for b in re.sub("<[^>]*>", "\n", said).split("\n") if b]
    assert html.main_text(page).split("\n") == ["Head", *PROSE[:6], *(blocks if kept else [])]


TINY = "<h1>Head</h1><p>Short article text, really.</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # A form round the page is no part of it; its controls are.
        (f"<form id=aspnetForm><select><option>One<option>Two</select><input name=x><label>Name</label><div class=content><h1>Head</h1>{SPLIT}</div><button>Go</button></form>", ["Head", *PROSE[:6]]),
        (f"<form><nav><a href=/>Home</a></nav><article>{TINY}</article></form>", ["Head", "Short article text, really."]),
        (f"<div class=main><h1>Head</h1>{SPLIT}<form><p>Leave your words here, please.</p><label>Name</label></form></div>", ["Head", *PROSE[:6]]),
        (f"<article>{TINY}<form><p>Tell us more, and more, and more.</p></form></article>", ["Head", "Short article text, really."]),
        # More comments than article.
        (f"<div class=post>{TINY}</div><div class=comments>{SPLIT}</div>", ["Head", "Short article text, really."]),
        (f"<div id=main><div class=story><p>Short article text, really.</p></div><div id=disqus_thread>{SPLIT}</div></div>", ["Short article text, really."]),
        # Names that mark round all there is.
        (f"<div class=sidebar-layout-widget>{SPLIT}</div><div><p>© 2024 Some. All rights reserved.</p></div>", PROSE[:6]),
        # Lists of references.
        (f"<article>{SPLIT}<h2>References</h2><ul><li><a href=1>Smith 2001</a><li><a href=2>Jones 2002</a><li><a href=3>Miller 2003</a></ul></article>", [*PROSE[:6], "References", "Smith 2001", "Jones 2002", "Miller 2003"]),
        (f"<article>{SPLIT}<ol><li><a href=1>Smith, J. (2001). One.</a><li><a href=2>Jones, K.: Two.</a><li><a href=3>Miller, A. Three.</a></ol></article>", [*PROSE[:6], "Smith, J. (2001). One.", "Jones, K.: Two.", "Miller, A. Three."]),
        # What is not displayed.
        (f"<article>{SPLIT}<p style='color: red; DISPLAY : none'>Hidden words, here.</p><div style=\"display:none\"><p>Also, hidden.</p></div><p style='display: block'>Seen, though.</p></article>", [*PROSE[:6], "Seen, though."]),
    ],
)
def test_common_layouts(page, text):
    found = html.main_text(f"<html><body>{page}</body></html>").split("\n")
    assert [x for x in found if not x.startswith("©")] == text


def test_columns_with_dots(spark):
    got = html.extract(spark.createDataFrame([(1, f"<article>{TINY}</article>")], "page_id long, html string").selectExpr("*", "2 AS `a.b`")).collect()
    assert got[0]["a.b"] == 2 and got[0]["text"] == "Head\nShort article text, really."


def test_tiny_articles_beside_prose_that_is_marked():
    for body in ("x", "two words"):
        page = f"<body><nav><a href=a>Menu</a></nav><div class='ad'>{' '.join(PROSE[:3])}</div><article><h1>{body}</h1><p>{body}</p></article><footer>No, no.</footer></body>"
        assert html.main_text(page) == f"{body}\n{body}"
    assert html.main_text(f"<body><div class='ad'>{PROSE[0]}</div><article></article></body>") == ""


@pytest.mark.parametrize("unit", ["<b>x, y. ", "<font>x, y. ", "<a ", "<a '\"", "<!x", "<i><div></b>", "<p><i></div></i>", "<div class='ad'>x", "<script></script", "</i>", "<li>a", "&amp;,"])
def test_broken_markup_takes_linear_time(unit):
    import time

    def seconds(size):
        began = time.process_time()
        html.main_text(unit * (size // len(unit)))
        return time.process_time() - began

    seconds(1000)
    assert seconds(1_000_000) < 20 * max(seconds(125_000), 0.05)
    assert seconds(1_000_000) < 15


def test_long_pages(spark):
    page = "<article>" + "".join(f"<p>Paragraph {k}, which says: words.</p>" for k in range(40_000)) + "</article>"
    got = html.extract(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert got[0].text.count("\n") == 39_999 and got[1].text == ""
