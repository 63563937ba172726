import math
import random
import re
from collections import Counter

import pytest
import regex

from ledgerwatch.llm import quality_votes as Q, tag_paths as T


def plain_measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(repeated),
            sum(text.count(c) for c in ".!?"), len(re.findall("[A-Z]", text)),
            len(regex.findall(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]", text)))


def plain_verdicts(measured, votes):
    """Expectation-maximisation by plain loops over texts."""
    m, (share, against) = len(Q.RULES), Q.starting_rates()
    begun, failed = against, [n[0] < 10 or 100 * n[5] > 20 * n[0] for n in measured]
    used = [v for v, f in zip(votes, failed) if not f]

    def posterior(v):
        chances = [s * math.prod(1 if x == 0 else a if x == -1 else 1 - a for x, a in zip(v, rates)) for s, rates in zip(share, against)]
        return [c / sum(chances) for c in chances]

    for _ in range(Q.ROUNDS):
        p = [posterior(v) for v in used]
        new_share, new_against = [], []
        for c in range(len(share)):
            new_share.append(min(Q.MOST, max(Q.LEAST, (sum(q[c] for q in p) + 0.5) / (len(p) + 1))))
            top = Q.MOST_ON_GOOD if c == 0 else Q.MOST
            new_against.append([min(top, max(Q.LEAST, (sum(q[c] for v, q in zip(used, p) if v[j] == -1) + 2 * begun[c][j])
                                             / (sum(q[c] for v, q in zip(used, p) if v[j]) + 2))) for j in range(m)])
        share, against = new_share, new_against
    return [not f and posterior(v)[0] >= 0.5 for f, v in zip(failed, votes)]


def some_texts(seed=1):
    rnd = random.Random(seed)
    words = "the of and a report shows that in spring many people walked along river banks".split()
    texts = []
    for i in range(200):
        body = " ".join(rnd.choice(words) + rnd.choice([""] * 10 + [".", ","]) for _ in range(rnd.randrange(0, 120)))
        kind = i % 8
        if kind == 1:
            body = " ".join(w + "###" for w in body.split())
        if kind == 2:
            body = "\n".join(["same line here"] * rnd.randrange(1, 30))
        if kind == 3:
            body = body.upper() + "!!"
        if kind == 4:
            body = "\n".join([body, body])
        texts.append(body)
    return texts + ["", None, " \n\t ", "aaaa " * 3000, "x\x0by\x0cz\r\n é ü 🙂|", "a b c d e a b c d e", "a b c d e f a b c d", "w " * 9]


def test_measures(spark):
    texts = some_texts()
    df = spark.createDataFrame([(i, t, 7, "w") for i, t in enumerate(texts)] + [(None, "alone", 1, "")], "doc_id long, text string, n_words int, words string")
    got = {r.id: r for r in Q.measures(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.n_ends, r.n_upper, r.n_marks) == plain_measures(t), repr(t)[:80]
    assert len(got) == len(texts) + 1


def test_verdicts(spark):
    texts = some_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(Q.judged(df, "doc_id", "text").collect(), key=lambda r: r.id)
    want = plain_verdicts([plain_measures(t) for t in texts], [r.votes for r in rows])
    assert [r.kept for r in rows] == want
    assert not any(r.kept for r in rows if r.base_failed)
    junk = [r.kept for r in rows if r.id < 200 and r.id % 8 in (1, 2) and r.n_words >= 15]
    clean = [r.kept for r in rows if r.id < 200 and r.id % 8 in (0, 5, 6, 7) and r.n_words >= 40 and not r.base_failed]
    assert sum(junk) / len(junk) < 0.1 and sum(clean) / len(clean) > 0.95


def test_rule_accuracies_are_found(spark):
    """Votes drawn with known rates: the estimates come near."""
    rnd, rows = random.Random(2), []
    share = [0.7, 0.12, 0.1, 0.08]
    against = [[0.02, 0.05, 0.03, 0.1, 0.02, 0.05, 0.04, 0.08], [0.1, 0.1, 0.95, 0.05, 0.1, 0.3, 0.9, 0.05],
               [0.1, 0.05, 0.05, 0.85, 0.95, 0.1, 0.05, 0.1], [0.05, 0.6, 0.1, 0.05, 0.1, 0.5, 0.4, 0.95]]
    for _ in range(40_000):
        rates = rnd.choices(against, share)[0]
        rows.append(([0 if rnd.random() < 0.2 else (-1 if rnd.random() < a else 1) for a in rates],))
    model = Q.accuracies(spark.createDataFrame(rows, "votes array<int>")).collect()[0].model
    assert all(abs(a - b) < 0.02 for a, b in zip(model.share, share))
    assert all(abs(a - b) < 0.05 for got, want in zip(model.against, against) for a, b in zip(got, want))


def test_no_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Q.judged(empty, "doc_id", "text").count() == 0


def test_no_python_in_the_plan(spark, capsys):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    Q.votes(Q.measures(df, "doc_id", "text")).explain("formatted")
    assert "Python" not in capsys.readouterr().out.split("Scan")[0]


# Pages.

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>"; if (a<b) x();</script></head>
<body class="home"><header><h2>Site name</h2></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, and so on, and so forth, for a long text of no use to anyone.</p></div>
<div class="ad">Buy this, now, today.</div>
<form><label>Name</label><input name=x><button>Send</button></form>
%s
<aside><p>Related: other articles, with long titles, and commas.</p></aside>
<section id="comments"><h3>Comments</h3><p>First! A long comment, by a reader, about this and that, with many words.</p></section>
<div style="display: none">Hidden words here.</div>
<footer>&copy; 2024 &middot; All, rights, reserved.</footer></body></html>"""
ARTICLE = """<article><h1>A  headline &amp; more</h1><p>First   paragraph, with <b>bold</b> and <a href=x>a link</a>, and
more words.</p><!-- a comment <p>no</p> --><p>Second paragraph &lt;here&gt;; it has commas, too.<p>Third, unclosed one.
<ul><li>An item, short<li>Another item</ul><blockquote>Quoted words, said by someone.</blockquote></article>"""
WANT = ["A headline & more", "First paragraph, with bold and a link, and more words.", "Second paragraph <here>; it has commas, too.",
        "Third, unclosed one.", "An item, short", "Another item", "Quoted words, said by someone."]


def test_article_of_a_page():
    assert T.main_text(PAGE % ARTICLE).split("\n\n") == WANT


def test_without_an_article_tag():
    text = T.main_text(PAGE % ARTICLE.replace("article>", "div>"))
    assert text.split("\n\n")[:4] == WANT[:4]


LONG = "Words of a long paragraph, with marks; more of them, and so on. " * 8
ITEMS = "".join(f"<li>a short item of forty characters no {i:02}</li>" for i in range(10))


@pytest.mark.parametrize("tag", ["article", "div", "main"])
@pytest.mark.parametrize("part", [
    f"<ul>{ITEMS}</ul>", "<table><caption>A caption</caption>" + "<tr><th>name<td>12" * 12 + "</table>",
    "<figure><img src=x><figcaption>Where it was</figcaption></figure>", "<pre>x = 1</pre><div class=code><pre>y = 2</pre></div>",
    "<dl><dt>term<dd>what it means</dl>", "<div class=table-wrap><table>" + "<tr><td>cell</td></tr>" * 30 + "</table></div>",
])
def test_short_blocks_of_an_article_stay(tag, part):
    page = PAGE % f"<{tag}><h1>Title</h1>{f'<p>{LONG}</p>' * 4}{part}{f'<p>{LONG}</p>' * 4}</{tag}>"
    blocks = [b.text for b in T.blocks_of(page) if not b.barred]
    assert T.main_text(page).split("\n\n") == blocks and len(blocks) >= 10


def test_unnamed_menu_beside_the_article():
    links = "".join(f"<li><a href=/{i}>Another page {i}</a></li>" for i in range(9))
    page = f"<body><div class=top><ul>{links}</ul></div><div class=text><p>{LONG}</p><ul>{ITEMS}</ul><p>{LONG}</p></div></body>"
    assert T.main_text(page).split("\n\n") == [LONG.strip(), *re.findall("<li>(.*?)</li>", ITEMS), LONG.strip()]


@pytest.mark.parametrize("start", ["<div class='content has-sidebar'>", "<div class='site-content no-sidebar'>", "<div class='elementor-widget-container'>",
                                   "<div class='post comments-open'>", "<div id=widget>", "<div class='header-fixed'><div class='with-nav page'>"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_of_wrappers_bar_no_article(start, tag):
    text = T.main_text(PAGE % f"{start}{ARTICLE.replace('article>', tag + '>')}<div class=share>Share, this, with, all.</div></div></div>")
    assert text.split("\n\n")[:7] == WANT and "Share" not in text


def test_comments_longer_than_the_article():
    comments = f"<section id=comments><div class=comment-body>{f'<p>{LONG}</p>' * 9}</div></section>"
    for start in ("<div>", "<div class='elementor-widget-container'>"):
        assert T.main_text(PAGE % f"{start}{ARTICLE}</div>{comments}").split("\n\n") == WANT


def test_odd_pages():
    assert T.main_text("") == T.main_text("<p></p>") == T.main_text("<script>only") == ""
    assert T.main_text("just words") == "just words"
    assert T.main_text("a < b and <p>c &am</p><p>d") == "a < b and\n\nc &am\n\nd"
    assert T.main_text("<div>" * 3000 + "deep text, here." + "</div>" * 3000) == "deep text, here."
    assert T.main_text("<p>x<br>y  z</p>") == "x y z"
    assert T.main_text("<p>one</i></div></p>two") == "one\n\ntwo"


def test_long_and_broken_pages():
    import time

    begin = time.perf_counter()
    for page in ("<p>word, words. " * 20_000, "<" * 100_000, "<a " * 50_000, "<!--" * 50_000, "&amp;" * 100_000, "<b>" * 20_000 + "x", '<p class="' * 20_000):
        T.main_text(page)
    assert time.perf_counter() - begin < 60


PARAGRAPH = "A paragraph of the article, with several words; it goes on for a while, as they do. " * 4
WORDS = f"<h1>Title of it</h1>{f'<p>{PARAGRAPH}</p>' * 5}<ul><li>an item of it<li>another</ul><p>{PARAGRAPH}</p>"
BEFORE = ["<ul><li>Home</li><li>News</li><li>Contact us</li></ul>", "<p>Site map Contact Press Jobs</p>", "<p>Sign up for our letter…</p>",
          "<table><tr><td>Menu<td>More</table>"]
BEHIND = ["<div><p>Great post! I agree…</p><p>First.</p></div>", "<p>Copyright 2024 Example Ltd.</p>", "<div><div><p>Copyright 2024 Example Ltd.</p></div></div>",
          "<table><tr><td>Imprint<td>Privacy</table>"]


def pages_around(tag):
    """Pages whose other parts have no telling names."""
    article = f"<{tag}>{WORDS}</{tag}>"
    for a in BEFORE:
        for z in BEHIND:
            yield f"<body>{a}{article}{z}</body>"
            yield f"<body><div>{a}</div>{article}<div>{z}</div></body>"
            yield f"<body><div id=x1><div>{a}</div><div class=q7>{article}</div>{z}</div></body>"


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_unnamed_parts_around_the_article(tag):
    want = T.main_text(f"<article>{WORDS}</article>")
    assert want.count("\n\n") == 8
    for page in pages_around(tag):
        assert T.main_text(page) == want, page


def test_long_comments_behind_an_article():
    """An article or main part bounds the result, whatever stands behind it; so does an article within main."""
    comments = f"<div>{f'<p>{PARAGRAPH}</p><p>I agree, all in all.</p>' * 9}</div>"
    want = T.main_text(f"<article>{WORDS}</article>")
    for page in (f"<article>{WORDS}</article>{comments}", f"<main><article>{WORDS}</article>{comments}</main>",
                 f"<div><main><p>Menu</p><article>{WORDS}</article><p>Copyright</p></main></div>"):
        assert T.main_text(page) == want


def test_class_names_do_not_decide(monkeypatch):
    """The same page with all class names changed alike, and without the list of names."""
    page = "<body><div class=aa><ul><li>Home<li>News</ul></div><div class=bb>{}</div><div class=cc><p>Copyright 2024</p></div></body>".format(WORDS)
    want = T.main_text(f"<article>{WORDS}</article>")
    for names in ("aabbcc", "ccaabb", "xxyyzz"):
        changed = page.replace("aa", names[:2].upper()).replace("bb", names[2:4].upper()).replace("cc", names[4:].upper())
        assert T.main_text(changed) == want
    monkeypatch.setattr(T, "NAMES", frozenset())
    for tag in ("article", "main", "div"):
        assert all(T.main_text(p) == want for p in pages_around(tag))


def test_without_the_ratios_the_result_is_another(monkeypatch):
    """Menus and footers come back once the ratios of paths, or of containers too, decide nothing."""
    want = T.main_text(f"<article>{WORDS}</article>")
    bare = [f"<body>{a}{WORDS}{z}</body>" for a in (BEFORE[0], BEFORE[3]) for z in (BEHIND[0], BEHIND[3])]
    boxed = list(pages_around("div"))
    assert all(T.main_text(p) == want for p in bare + boxed)
    monkeypatch.setattr(T, "content_paths", lambda blocks: {b.path for b in blocks if not b.barred})
    assert all(T.main_text(p) != want for p in bare)
    monkeypatch.setattr(T, "NEAR", 0.0)
    assert all(T.main_text(p) != want for p in boxed)


def test_deep_pages_take_linear_time():
    import time

    begin = time.perf_counter()
    for part in ("<div>a", "<b>a", "<p>a", "<ul><li>a", "<table><tr><td>a", "<section><p>x", "<a>x", "<article>y"):
        assert T.main_text(part * 100_000) or part == "<a>x"  # links alone are no article
    assert time.perf_counter() - begin < 120


def test_frame(spark):
    rows = [(1, "u", PAGE % ARTICLE), (1, "u", PAGE % ARTICLE), (None, None, "<p>x</p>"), (3, "v", None), (4, "w", "")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = T.extract(df, "page_id", "url", "html").collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in got) == sorted((str(i), str(u), T.main_text(h or "")) for i, u, h in rows)
    assert T.extract(df.limit(0), "page_id", "url", "html").count() == 0


def test_pages_against_their_articles(spark):
    """On the test pages the article is what stands between the article tags."""
    import html

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        inner = r.html[r.html.find("<article>") + 9 : r.html.find("</article>")].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert T.main_text(r.html) == "\n\n".join(b for b in blocks if b)
