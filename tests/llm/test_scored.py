"""Quality rules, HTML text, SimHash groups and the pipeline against brute force."""

import collections
import html
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.conftest import lowered, space_words

from tamis.llm import html_text, quality, simhash

# -- quality ----------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = space_words(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, inside, seen, dup = collections.Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside.update(range(i, i + 5))
    for line in text.split("\n"):
        if space_words(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts_of_awkward_texts(awkward, empty):
    rows = quality.judge(awkward).collect()
    assert len(rows) == 10
    for r in rows:
        want = brute_counts(r.text)
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0


def test_many_different_words_are_counted_exactly():
    words = [f"w{i % 70_000}" for i in range(140_000)]
    assert quality.measures(" ".join(words))[0][4] == 140_000
    assert quality.measures(" ".join(f"w{i}" for i in range(70_000)))[0][4] == 0


def test_estimates_tell_junk_from_text(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").collect()}
    rows = quality.judge(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), drop_text=True).collect()
    free = [r for r in rows if r.doc_id in labels and not r.base_failed]
    good, bad = [r for r in free if labels[r.doc_id] == 1], [r for r in free if labels[r.doc_id] == 0]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.2


def test_fit_finds_hidden_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.8, 0.9] + [0.85] * (len(quality.RULES) - 3))
    votes = np.where(rng.random((20_000, len(right))) < right, truth[:, None], ~truth[:, None])
    patterns = ["".join("+" if v else "-" for v in row) for row in votes]
    posterior = quality.fit(collections.Counter(patterns))
    assert np.mean([(posterior[p] >= 0.5) == t for p, t in zip(patterns, truth, strict=True)]) > 0.97
    assert quality.fit({}) == {}


def brute_posterior(votes, rounds=200):
    """Expectation-maximisation document by document, in plain loops."""
    p = []
    for v in votes:
        plus, minus = v.count("+"), v.count("-")
        p.append(min(plus / (plus + minus) if plus + minus else 0.5, 1 / (minus + 1)))
    for _ in range(rounds):
        share = (sum(p) + 1) / (len(votes) + 2)
        chance = []
        for r in range(len(quality.RULES)):
            up = [sum(w for v, w in zip(votes, weights, strict=True) if v[r] == "+") for weights in (p, [1 - x for x in p])]
            all_ = [sum(w for v, w in zip(votes, weights, strict=True) if v[r] != "0") for weights in (p, [1 - x for x in p])]
            chance.append([(u + 1) / (a + 2) for u, a in zip(up, all_, strict=True)])
        new = []
        for v in votes:
            good, bad = share, 1 - share
            for r, c in enumerate(v):
                good *= {"+": chance[r][0], "-": 1 - chance[r][0], "0": 1}[c]
                bad *= {"+": chance[r][1], "-": 1 - chance[r][1], "0": 1}[c]
            new.append(good / (good + bad))
        if max(abs(a - b) for a, b in zip(new, p, strict=True)) <= 1e-9:
            return new
        p = new
    return p


def test_query_keeps_what_brute_force_keeps(spark, sf):
    import duckdb

    from tamis.llm.queries import QUERIES

    sf = sf.replace("0.001", "0.01")
    rows = QUERIES["op6_quality_rules"](spark, sf).collect()
    judged = [r for r in rows if not r.base_failed]
    posterior = brute_posterior([r.votes for r in judged])
    assert all(r.kept == (p >= 0.5) and abs(r.p_good - p) < 1e-5 for r, p in zip(judged, posterior, strict=True))
    assert not any(r.kept for r in rows if r.base_failed) and len({r.votes for r in judged}) > 20
    # it is not the same as keeping what no rule is against, and nearer to the labels
    labels = {r.doc_id: r.quality == 1 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [(r.kept == labels[r.doc_id], ("-" not in r.votes) == labels[r.doc_id]) for r in judged if r.doc_id in labels]
    assert any(r.kept and "-" in r.votes for r in judged)
    assert sum(a for a, _ in right) > sum(b for _, b in right) and sum(a for a, _ in right) > 0.99 * len(right)

    space = "[\\x20\\x09-\\x0D]"
    want = duckdb.sql(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w FROM '{sf}/documents.parquet'),
      lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
      dups AS (SELECT doc_id, sum(n - 1) AS n FROM lines GROUP BY doc_id),
      wins AS (SELECT doc_id, i, w[i:i + 4] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
      often AS (SELECT doc_id, win FROM wins GROUP BY ALL HAVING count(*) > 1),
      inside AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i FROM wins JOIN often USING (doc_id, win)), range(5) t(j) GROUP BY doc_id)
      SELECT d.doc_id, len(w), coalesce(list_sum(list_transform(w, lambda x: length(x))), 0), length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), coalesce(dups.n, 0), coalesce(inside.n, 0)
      FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN inside USING (doc_id)""").fetchall()
    assert {r.doc_id: (*(r[c] for c in quality.COUNTS),) for r in rows} == {w[0]: tuple(map(int, w[1:])) for w in want}
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)


def votes_of(text):
    limits = [(good, fair) for _, good, fair in quality.RULES.values()]
    return dict(zip(quality.RULES, ("0+-"[quality.vote(v, *x)] for v, x in zip(quality.measures(text)[1], limits, strict=True)), strict=True))


def test_rules_abstain_where_a_text_gives_nothing_to_go_by():
    assert votes_of("zehn kurze Worte")["stop_words"] == votes_of("\u6f22\u5b57 " * 200)["word_length"] == votes_of("\u6f22\u5b57 " * 200)["stop_words"] == "0"
    polish = "Wszyscy ludzie rodz\u0105 si\u0119 wolni i r\u00f3wni pod wzgl\u0119dem swej godno\u015bci i swych praw. S\u0105 oni obdarzeni rozumem i sumieniem i powinni post\u0119powa\u0107 wobec innych w duchu braterstwa. " * 6
    assert "-" not in {k: v for k, v in votes_of(polish).items() if k not in ("repetition", "vocabulary")}.values()
    assert votes_of("word### junk&&& more%%% " * 20)["symbols"] == "-" and votes_of("a | b | c | d | " * 20)["wordless"] == "-"


def test_one_wrong_vote_is_overruled():
    n = len(quality.RULES)
    clean, junk = "+" * n, "----" + "+" * (n - 4)
    one_off = "+" * (n - 1) + "-"
    posterior = quality.fit({clean: 900, junk: 90, one_off: 10, "-" + "+" * (n - 1): 3, "0" * n: 5})
    assert posterior[clean] > 0.99 and posterior[junk] < 0.01 and posterior[one_off] > 0.9
    assert 0.8 < posterior["0" * n] < 0.95  # no vote: the share of good documents


# -- html -------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1></header>
<div class="cookie-notice">We use cookies</div><div id="content"><h2>Hi &amp; you</h2><p>One<br>two   three <b>bold</b> x<p>Second &lt;tag&gt;
<ul><li>a<li>b</ul><div class="comments"><p>nice!</p></div><form><p>f</p></form><aside>s</aside><pre>x
 y</pre></div><script>if (a < b) "</p>"</script><footer>foot</footer></body></html>"""


def test_structure_and_blocks():
    assert html_text.text_of(html_text.parse(PAGE)) == "Hi & you\n\nOne two three bold x\n\nSecond <tag>\n\na\n\nb\n\nx y"
    nested = '<nav>m</nav><article><header><h1>T</h1></header><p>x</p><article class="comment"><p>c</p></article><div class="share-buttons">S</div>tail</article>out<article><p>2'
    assert html_text.text_of(html_text.parse(nested)) == "T\n\nx\n\ntail\n\n2"
    assert html_text.text_of(html_text.parse("<p>a<p>b<table><tr><td>1<td>2<tr><td>3</table>")) == "a\n\nb\n\n1\n\n2\n\n3"
    for broken in ("", "<", "<p", "</p></div>", "<p title='x", "a<!-- b", "<script>x", "&am &#x41;", "<div>" * 5000 + "x"):
        assert isinstance(html_text.text_of(html_text.parse(broken)), str)


def test_template_of_a_site_goes_and_copied_articles_stay(spark, empty):
    frame = "<html><body><div><p>Our little slogan</p></div>{}</body></html>"
    rows = [(i, "http://a.org/x", frame.format(f"<div><p>Story number {i}</p></div>"), "x") for i in range(8)]
    rows += [(100 + i, "http://b.org/x", f"<article><p>Copied story</p><p>own {i}</p><p>Read more at b</p></article>" if i < 4 else f"<article><p>own {i}</p><p>Read more at b</p></article>", "x") for i in range(10)]
    rows += [(200, None, None, "x"), (201, None, "", "x"), (202, "http://c.org", "<p>lone</p>", "x"), (202, "http://c.org", "<p>lone</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = collections.defaultdict(list)
    for r in html_text.extract(df).collect():
        got[r.page_id].append(r.text)
    assert all(got[i] == [f"Story number {i}"] for i in range(8))
    assert all(got[100 + i] == [f"Copied story\n\nown {i}" if i < 4 else f"own {i}"] for i in range(10))
    assert got[200] == [""] and got[201] == [""] and got[202] == ["lone", "lone"]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("limit", [html_text.BROADCAST_BYTES, 0])
def test_blocks_of_a_section_go_and_parts_and_copies_stay(spark, monkeypatch, limit):
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", limit)
    section = lambda i: "<div><p>Only in the harbour section</p></div>" if i < 8 else ""
    rows = [(i, "http://a.org/x", f"<body>{section(i)}<div><h2>{'Method' if i < 8 else i}</h2><p>Story <b>{'so' if i < 9 else i}</b> number {i}</p></div></body>") for i in range(60)]
    rows += [(100 + i, "http://a.org/x", "<body><div><p>One page kept seven times</p></div></body>") for i in range(7)]
    rows += [(200 + i, "http://a.org/x", f"<body><script>{i}</script><div><p>A copy with another script</p></div></body>") for i in range(6)]
    rows += [(300 + i, "http://a.org/x", f"<body><article><p>Seen in six articles</p><p>own {i}</p></article></body>") for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{'Method' if i < 8 else i}\n\nStory {'so' if i < 9 else i} number {i}" for i in range(60))
    assert all(got[100 + i] == "One page kept seven times" for i in range(7))
    assert all(got[200 + i] == "A copy with another script" for i in range(6))
    assert all(got[300 + i] == f"Seen in six articles\n\nown {i}" for i in range(6))


def test_article_text_with_listed_words_in_its_names_stays():
    page = '<article><section id="discussion"><h2 id="search-results">A</h2><p id="privacy-law">B</p></section><div class="related-work">C</div><div class="ad-slot">D</div><p class="share">E</p><div class="comments">F</div></article>'
    assert html_text.text_of(html_text.parse(page)) == "A\n\nB\n\nC"
    assert html_text.text_of(html_text.parse('<div id="discussion">A</div><p>B</p>')) == "B"


def test_names_are_hints_only():
    outer = ['<div class="content has-sidebar">', '<article class="post comments-open">', '<main class="form-wide">', '<div class="page no-comments">', '<div id="ad-hoc-networks">', '<form id="aspnetForm">', '<div class="main-content form"><h2>The only one</h2>']
    for tag in outer:
        text = html_text.main_text(f"<body><nav>m</nav>{tag}<h1>Title</h1><p>First</p><div class='sidebar'>s</div></body>", *[np.empty(0, np.int64)] * 3)
        assert text.endswith("Title\n\nFirst"), (tag, text)
    for gone in ('<div class="menu">a</div>', '<nav><p>b</p></nav>', '<div id="cookie-notice"><b>c</b></div>', '<footer><p>x</p></footer>'):
        assert html_text.main_text(gone, *[np.empty(0, np.int64)] * 3) == ""
    assert html_text.text_of(html_text.parse("a&<b>lt;</b>b &amp;<i>gt;</i>")) == "a&lt;b &gt;"


def plain_site(n, shift=0):
    """Pages without article tags or telling names: a menu with a link to the page itself, a dated notice, a counted footer."""
    out = []
    for i in range(n):
        links = "".join(f"<td><a href='/{k}'>Part {word}</a></td>" if k != i % 4 else f"<td><b>Part {word}</b></td>" for k, word in enumerate(("north", "south", "east", "west")))
        out.append((shift + i, "http://plain.org/x", f"<html><body><div class='x1'><div>Today is {i % 28 + 1} {('March', 'June', 'August')[i % 3]} 2024, page {i} of 900</div><div><table><tr>{links}</tr></table></div><div class='x2'><h1>Story {'abcdefgh'[i % 8]}{'xyz' * (i + 1)}</h1><p>What happened in place {'no' * (i + 1)}.</p></div><div>All rights kept, {i} readers online</div></div></body></html>"))
    return out


def test_counts_alone_find_the_template_of_a_plain_site(spark):
    rows = plain_site(40)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Story {'abcdefgh'[i % 8]}{'xyz' * (i + 1)}\n\nWhat happened in place {'no' * (i + 1)}." for i, *_ in rows}
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == want
    assert not any(r.text == want[r.page_id] for r in html_text.extract(df, counted=False).collect())


def test_hosts_in_parts_give_the_same_texts(spark, monkeypatch):
    rows = plain_site(300) + [(1000 + i, f"http://h{i}.org/", f"<p>lone {i}</p>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("of", F.lit(1)).withColumn("pages", F.lit("mine"))
    want = {r.page_id: r.text for r in html_text.extract(df).collect()}
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(html_text, "HOT_SHARE", 0.1)
    sizes = html_text.host_parts(spark.createDataFrame([("plain.org", 300), ("h1.org", 1)], "of string, pages long")).collect()
    assert [tuple(r) for r in sizes] == [("plain.org", 10)]
    made = html_text.extract(df)
    assert {r.page_id: r.text for r in made.collect()} == want and set(made.columns) == {"page_id", "url", "html", "of", "pages", "text"}


@pytest.mark.parametrize("page", ["</b>" * 250_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, "<main>" * 120_000 + "x", "<article>x</article>" * 50_000, "<p>a" * 200_000, "<li>" * 200_000, "<script>" * 100_000, "<a '" * 200_000, "<td><tr>" * 100_000, "&#" * 400_000, "<div class='a b c'" * 50_000])
def test_hostile_pages_take_seconds(page):
    began = time.perf_counter()
    html_text.main_text(page, *[np.empty(0, np.int64)] * 3)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(
    "extra",
    [
        '<div id="comments"><h3>2 replies</h3><div><p>Nice read</p></div></div>',
        '<div class="reader-comments"><p>Nice read</p></div>',
        '<section class="comment-thread"><div class="c"><p>Nice read</p></div></section>',
        '<ol class="commentlist"><li id="comment-12"><p>Nice read</p></li></ol>',
        '<div id="respond"><p>Nice read</p></div>',
        '<div id="disqus_thread"><p>Nice read</p></div>',
        '<div class="cookie-law-info-bar"><p>Nice read</p></div>',
        '<div id="cookie-notice"><p>Nice read</p></div>',
        '<div class="gdpr consent-manager"><p>Nice read</p></div>',
    ],
)
@pytest.mark.parametrize("frame", ["<main><h1>T</h1><p>Body text.</p>{}</main>", "<article><h1>T</h1><p>Body text.</p></article>{}", '<article class="post comments-open has-comments"><h1>T</h1><p>Body text.</p>{}</article>'])
def test_comments_and_notices_go_wherever_they_stand(extra, frame):
    none = np.empty(0, np.int64)
    assert html_text.main_text(frame.replace("{}", extra), none, none, none) == "T\n\nBody text."


def test_comments_that_are_articles_go_too():
    none = np.empty(0, np.int64)
    page = '<article><p>Body text.</p></article><article class="comment"><p>Nice read</p></article><article id="comment-7" class="even"><p>So so</p></article>'
    assert html_text.main_text(page, none, none, none) == "Body text."


@pytest.mark.parametrize("kept", ['<section id="discussion"><p>Kept</p></section>', '<h2 id="search-results">Kept</h2>', '<p id="privacy-law">Kept</p>', '<div class="related-work"><p>Kept</p></div>', '<div class="cookie"><p>Kept</p></div>', '<div class="cookie-recipes"><p>Kept</p></div>', '<div class="commentary"><p>Kept</p></div>', '<p class="reader-comments-quoted">Kept</p>', '<h2 id="comments">Kept</h2>', '<div class="comments-closed"><p>Kept</p></div>'])
def test_names_in_articles_do_not_take_text(kept):
    none = np.empty(0, np.int64)
    want = "Body text." if 'class="cookie"' in kept else "Body text.\n\nKept"
    assert html_text.main_text(f"<article><p>Body text.</p>{kept}</article>", none, none, none) == want


def test_html_query(spark, sf):
    from tamis.llm.queries import QUERIES

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op1_html_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", b))).strip() for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(filter(None, blocks)) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


# -- simhash ----------------------------------------------------------------------------------------------


def brute_fingerprint(text, n=3):
    words = space_words(lowered(text))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius):
    label = list(range(len(points)))
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= radius):
            a, b = label[i], label[int(j)]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def clustered_points(rng, centers, per, flips):
    points = []
    for c in rng.integers(0, 1 << 63, centers, dtype=np.uint64):
        for _ in range(per):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
                x ^= 1 << int(b)
            points.append(x)
    return np.unique(np.array(points, np.uint64))


@pytest.mark.parametrize(("centers", "per", "flips"), [(1500, 1, 0), (60, 20, 4), (3, 400, 3), (1, 900, 6)])
def test_forest_loses_no_link(centers, per, flips, monkeypatch):
    monkeypatch.setattr(simhash, "FULL_ROWS", 64)
    points = clustered_points(np.random.default_rng(centers), centers, per, flips)
    label = list(range(len(points)))
    edges = simhash.forest(points.reshape(-1, 1), 3)
    assert len(edges) < len(points)
    for i, j in edges:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    assert label == brute_components(points, 3)


def test_linked_pairs_meet_in_a_shard():
    points = clustered_points(np.random.default_rng(9), 400, 10, 3)
    tree = simhash.Tree(points.reshape(-1, 1)[::2], 16, 3)
    rows, shards = tree.route(points.reshape(-1, 1))
    assert tree.leaves > 4
    where = collections.defaultdict(set)
    for r, s in zip(rows.tolist(), shards.tolist(), strict=True):
        where[r].add(s)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= 3):
            assert where[i] & where[int(j)]


@pytest.mark.parametrize("levels", [0, 4])
def test_large_shards_are_dealt_again_and_lose_no_link(spark, monkeypatch, levels):
    for name, value in {"SHARD_ROWS": 150, "LEAF_ROWS": 40, "SAMPLE_PER_LEAF": 16, "SAMPLE_ROWS": 64, "SHARD_SAMPLE": 128, "LEVELS": levels}.items():
        monkeypatch.setattr(simhash, name, value)
    held, real = [], simhash.shard_edges
    monkeypatch.setattr(simhash, "shard_edges", lambda rows, *more: (held.append(rows.groupBy("shard").count().agg({"count": "max"}).first()[0]), real(rows, *more))[1])
    points = clustered_points(np.random.default_rng(11), 500, 4, 3)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").checkpoint()
    edges = simhash.link_fingerprints(df, 3).collect()
    places = {int(x): i for i, x in enumerate(points.view(np.int64))}
    label = list(range(len(points)))
    for e in edges:
        a, b = label[places[e.u]], label[places[e.v]]
        label = [min(a, b) if x in (a, b) else x for x in label]
    assert label == brute_components(points, 3) and len(edges) < 4 * len(points)
    assert held[0] > 600 if not levels else held[0] < 400


@pytest.mark.parametrize("run", [200_000, 7])
def test_components_of_random_edges(spark, monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN_EDGES", run)
    rng = np.random.default_rng(run)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-500, 500, (400, 2))] + [(2000 + i, 2000 + i // 2) for i in range(60)] + [(3000, i) for i in range(3001, 3100)]
    least = {x: x for p in pairs for x in p}
    for u, v in pairs:
        a, b = sorted((least[u], least[v]))
        least = {k: a if x == b else x for k, x in least.items()} if a != b else least
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "u long, v long").repartition(3)).collect()}
    assert got == {k: x for k, x in least.items() if k != x}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups(spark, awkward, empty, sf):
    rows = simhash.groups(awkward).collect()
    assert len(rows) == 10
    by = {(r.doc_id): r for r in rows}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[2].component_id == 1 and by[5].component_id == 4
    assert simhash.groups(empty).count() == 0
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    from tamis.llm.queries import QUERIES

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash"](spark, sf).collect()}
    points = np.array([brute_fingerprint(t) for _, t in docs], np.uint64)
    label = brute_components(points, 3)
    assert got == {i: (f"{int(p):016x}", docs[c][0]) for (i, _), p, c in zip(docs, points, label, strict=True)}


def edited(words, share, rng):
    return [f"new{rng.integers(1e9)}" if rng.random() < share else w for w in words]


def test_similar_texts_are_found_and_others_left(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for group in range(60):
        base = [f"w{rng.integers(5000)}" for _ in range(300)]
        rows += [(at, " ".join(base)), (at + 1, " ".join(edited(base, 0.012, rng))), (at + 2, " ".join([f"x{rng.integers(5000)}" for _ in range(300)]))]
        at += 3
    rows += [(None, "kept without an id"), (1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(df).collect()}
    shingles = lambda t: set(zip(*[t.split()[i:] for i in range(5)], strict=False))
    pairs = [(shingles(rows[i][1]), shingles(rows[i + 1][1]), i + 1) for i in range(0, at, 3)]
    close = [i for a, b, i in pairs if len(a & b) / len(a | b) >= 0.85]
    assert len(close) > 30 and sum(i not in kept for i in close) >= 0.95 * len(close)
    assert {i for i in range(at) if i % 3 != 1} <= kept and None in kept and 1000 in kept and 1001 not in kept


def overlapping(rng, shared, left, right):
    """Two texts whose sets of five-word shingles share so many, and have so many of their own."""
    words = [f"w{rng.integers(1e9)}" for _ in range(shared + 4)]
    ends = [[f"w{rng.integers(1e9)}" for _ in range(n)] for n in (left, right)]
    return " ".join(words + ends[0]), " ".join(words + ends[1])


def near_duplicates(rows):
    """The ids that go by brute force over all pairs: those whose component has a smaller one."""
    sets = [(i, {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}) for i, t in rows]
    least = {i: i for i, _ in rows}
    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if 5 * len(a & b) >= 4 * len(a | b) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = {k: low if v == high else v for k, v in least.items()}
    return {i for i, low in least.items() if i != low}


def test_no_task_holds_a_hot_band_key(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 50)
    held = []
    real = simhash.runs_edges
    monkeypatch.setattr(simhash, "runs_edges", lambda rows, keys, link: (held.append(rows.groupBy(*keys).count().agg({"count": "max"}).first()[0] or 0), real(rows, keys, link))[1])
    rng = np.random.default_rng(6)
    base = [f"w{rng.integers(1e9)}" for _ in range(300)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(200)] + [(200, " ".join(f"x{i}" for i in range(50)))]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, 200} and held[0] <= 50


@pytest.mark.parametrize("block", [1024, 6])
def test_near_duplicates_are_those_of_the_exact_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block, raising=False)
    rng, rows = np.random.default_rng(5), []
    # just at or above 0.8, and just below
    for shape in [(4, 1, 0), (8, 1, 1), (80, 10, 10), (240, 0, 60), (400, 50, 50), (3, 1, 0), (5, 1, 1), (9, 2, 1), (79, 10, 10), (239, 30, 30), (300, 50, 50)]:
        for _ in range(12):
            rows += [(len(rows) + k, t) for k, t in enumerate(overlapping(rng, *shape))]
    chain = [f"w{rng.integers(1e9)}" for _ in range(400)]
    rows += [(len(rows) + k, " ".join(chain[5 * k : 5 * k + 100])) for k in rng.permutation(60).tolist()]
    rows = [(int(i), t) for i, (_, t) in enumerate(rows)]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = near_duplicates(rows)
    assert 60 + 59 <= len(gone) <= 60 + 59 + 1 and {i for i, _ in rows} - kept == gone


# -- pipeline ---------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        if name != "byte_bpe":
            assert made.columns == docs.columns
        rows = made.collect()
        assert 0 < len(rows) <= seen and len({r.doc_id for r in rows}) == len(rows)
        seen = len(rows)
        docs = spark.createDataFrame(rows, made.schema)
    assert all(r.round_trip for r in docs.collect())
    nothing = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0


STAGE = {name: i for i, name in enumerate(("quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"))}


def stage(name):
    import corpus_pipeline

    return corpus_pipeline.STAGES[STAGE[name]][1]


def test_every_stage_is_brute_force(spark, sf):
    from tests.llm.test_native import brute_benchmark, brute_lines

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    made = stage("quality_rules")(spark, docs, sf).collect()
    limits = [(good, fair) for _, good, fair in quality.RULES.values()]
    votes = {i: "".join("0+-"[quality.vote(v, *x)] for v, x in zip(quality.measures(r.text)[1], limits, strict=True)) for i, r in rows.items()}
    counts = {i: brute_counts(r.text) for i, r in rows.items()}
    judged = [i for i, c in counts.items() if c[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    want = {i for i, p in zip(judged, brute_posterior([votes[i] for i in judged]), strict=True) if p >= 0.5}
    assert {r.doc_id for r in made} == want and all(r == rows[r.doc_id] for r in made)
    docs = spark.createDataFrame(made, docs.schema)

    made = stage("line_dedup")(spark, docs, sf).collect()
    want = {i: text for i, text, *_ in brute_lines([(i, rows[i].text) for i in want])}
    assert {r.doc_id: r.text for r in made} == want and all(r.n_chars == len(r.text) and r.lang == rows[r.doc_id].lang for r in made)
    docs = spark.createDataFrame(made, docs.schema)

    made = stage("simhash_near_dedup")(spark, docs, sf).collect()
    gone = near_duplicates([(i, lowered(t)) for i, t in sorted(want.items())])
    assert {r.doc_id for r in made} == set(want) - gone and gone
    docs = spark.createDataFrame(made, docs.schema)

    made = stage("decontamination")(spark, docs, sf).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, *_, hit in brute_benchmark([(r.doc_id, r.text) for r in docs.collect()], items) if not hit}
    assert {r.doc_id for r in made} == clean and len(clean) < docs.count()
    docs = spark.createDataFrame(made, docs.schema)

    import public_tokenizers
    import tiktoken

    from tamis.llm.byte_bpe import read_ranks

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(file.read()), special_tokens={})
    texts = {r.doc_id: r.text for r in made}
    final = stage("byte_bpe")(spark, docs, sf).collect()
    assert {r.doc_id: r.ids for r in final} == {i: library.encode_ordinary(t) for i, t in texts.items()} and all(r.round_trip and r.n_tokens == len(r.ids) for r in final)


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_take_awkward_rows(spark, awkward, sf, name):
    """Nulls, empty and very long texts, rows that share an id, and columns whose names the operators use."""
    made = stage(name)(spark, awkward, sf)
    rows = made.collect()
    if name == "byte_bpe":
        assert len(rows) == 10 and all(r.round_trip for r in rows)
        return
    assert made.columns == awkward.columns and all(r.kept == "x" and r.n_words == 1 for r in rows)
    ids = collections.Counter(r.doc_id for r in rows)
    if name == "line_dedup":
        assert ids[5] == 2 and len(rows) == 10
    if name == "simhash_near_dedup":  # 1, 2 and 3 have no words, 4 and both rows of 5 the same
        assert ids == {1: 1, 4: 1, 6: 1, 7: 1, 8: 1, None: 1}
    if name == "decontamination":
        assert len(rows) == 10
    if name == "quality_rules":
        assert not {1, 2, 3, 7} & set(ids)


def test_pipeline_finds_planted_near_copies(spark, sf):
    """Recall on pairs at a similarity of 0.8 or more, by brute force over texts of many lengths."""
    rng = np.random.default_rng(12)
    rows, pairs = [], []
    for n in (12, 30, 60, 120, 400, 1500):
        for _ in range(15):
            base = [f"w{rng.integers(3000)}" for _ in range(n)]
            copy = list(base)
            for at in rng.choice(n, max(1, n // 80), replace=False):
                copy[at] = f"new{rng.integers(1e9)}"
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    kept = {r.doc_id for r in stage("simhash_near_dedup")(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()}
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    close = {b for a, b in pairs if 5 * len((x := grams(rows[a][1])) & (y := grams(rows[b][1]))) >= 4 * len(x | y)}
    assert len(close) > 40 and {b for _, b in pairs} - kept == close


def test_pipeline_run(spark, sf):
    import corpus_pipeline

    made = corpus_pipeline.run(spark, sf)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert 0 < made.count() < len(texts)


