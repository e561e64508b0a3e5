"""HTML extraction, WARC and URL filters."""
import glob
import gzip
import hashlib
import html
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacohort.llm import html_extract, queries, url_filter, warc
from stratacohort.llm.common import new_path

PAGES = "page_id long, url string, html string, text string, host string, record_type string, key int"


def pages():
    big = "<p>" + "long text " * 20_000 + "</p>"
    rows = [
        (1, "https://a.example.org/en/12?q=1", "<article><p>One</p></article>" * 10), (2, "https://a.example.org/en/12", "<article><p>One</p></article>" * 10),
        (3, None, None), (4, "", ""), (None, "http://x.com/de/", "<article><p>One</p></article>" * 10), (5, "no scheme", "<p>tiny</p>"), (6, "http://B.COM/de/x y\n", "<p>tiny</p>"),
        (7, "https://example.org", big), (8, "https://example.org/es/", big), (8, "https://example.org/es/", big), (9, "http://sub.example.org/es", "é日本 😀" * 30),
    ]
    return [(*r, "clash", "clash", "clash", 3) for r in rows]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(pages(), PAGES).repartition(3)


# HTML


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_article_text_of_all_pages(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    for r in html_extract.extract(rows).collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split())


def right(pages, root, without=()):
    """The share of blocks that the tree judges as labelled, features in `without` being zero."""
    found = []
    for source in pages:
        page = html_extract.Page(source)
        for text, row in zip(page.texts, page.rows):
            row = [0 if f in without else x for f, x in zip(html_extract.FEATURES, row)]
            found.append(html_extract.is_main(root, row) == (html_extract.LABEL in text))
    return sum(found) / len(found)


def other_pages(n, seed):
    """Pages of another make: tables, sections, spans, other names and words; half of them without telling mark-up."""
    rnd = random.Random(seed)
    words = lambda a, b, mark="": " ".join(mark + "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(a, b)))
    main = lambda a, b: words(a, b, html_extract.LABEL)
    row = lambda k: "<tr>" + "".join(f'<td><a href="?{i}">{words(1, 2)}</a></td>' for i in range(k)) + "</tr>"
    for k in range(n):
        text = [f'<section><h2>{main(2, 5)}</h2><p>{main(25, 90)}<br>{main(14, 60)} <em>{main(2, 4)}</em></p></section>' for _ in range(rnd.randint(2, 5))]
        if k % 2:
            yield f'<body><div role="navigation">{words(1, 3)} <a href="#">{words(1, 2)}</a></div><main><h1>{main(2, 8)}</h1>{"".join(text)}<aside>{words(5, 30)}</aside></main><div class="comment-list"><p>{words(5, 60)}</p></div><footer>{words(3, 9)}</footer></body>'
        else:
            yield f'<body><table class="t9">{row(5)}{row(4)}</table><div id="q"><h1>{main(3, 8)}</h1>{"".join(text)}</div><table>{row(3)}{row(6)}</table></body>'


def test_held_out_blocks():
    """Word counts and link densities carry the tree where mark-up says nothing; names matter little."""
    root = html_extract.train().root
    held = list(html_extract.labelled_pages(400, seed=123))
    assert right(held, root) > 0.98 and right(other_pages(200, 5), root) > 0.97

    def trained_without(names):
        rows, labels = [], []
        for source in html_extract.labelled_pages():
            page = html_extract.Page(source)
            rows += [[0 if f in names else x for f, x in zip(html_extract.FEATURES, row)] for row in page.rows]
            labels += [html_extract.LABEL in x for x in page.texts]
        return html_extract.Tree(np.array(rows, float), np.array(labels, bool), 12).root

    counts = [f for f in html_extract.FEATURES if "words" in f or "link" in f]
    names = ["in_named_content", "in_telling"]
    assert right(held[1::2], trained_without(counts), counts) < 0.75 < 0.97 < right(held[1::2], trained_without(names), names)

    def used(node):
        return set() if isinstance(node, bool) else {html_extract.FEATURES[node[0]]} | used(node[2]) | used(node[3])

    assert {"words", "link_density", "words_before", "words_after", "link_density_before", "link_density_after"} <= used(root)


@pytest.mark.parametrize("inside", [
    '<p title="hidden gems">Real text</p>', '<p data-id="ad">Real text</p>', '<p data-class="header">Real text</p>', '<p id="comment-policy-study">Real text</p>', '<p class=menu-of-the-day>Real text</p>',
    '<p data-x="a" title=\'class="ad"\'>Real text</p>', '<p><a href="?class=ad">Real text</a></p>', "<p hidden-gem>Real text</p>", '<math><mi>Real</mi> <mo>text</mo></math>', '<object data="x">Real text</object>',
])
@pytest.mark.parametrize("around", ["<article>{}</article>", '<article id="post-share-prices">{}</article>', '<article class="tag-news tags">{}</article>', "<main hidden=''></main><main>{}</main>"])
def test_names_that_only_look_telling(around, inside):
    assert html_extract.main_text(html_extract.train().root, around.format(inside)) == "Real text"


@pytest.mark.parametrize(("source", "text"), [
    (None, ""), ("", ""), ("just words", "just words"), ("<p>a<p>b", "a b"), ("<article>x &lt;y&gt; &eacute;&#233;&amp;amp;&nbsp;z</article>", "x <y> éé&amp; z"),
    ("<header>Site</header><nav><a href=x>menu item</a></nav><article><header><h1>Title</h1></header><p>One<b>two</b>\n\n three<br>four</p></article><footer>f</footer>", "Title Onetwo three four"),
    ('<article><p>a</p><script>if (1 < 2) { "</p>" }</script><style>p{}</style><p>b</p><!-- c --></article>', "a b"),
    ('<div class="cookie-notice">we use</div><main><p>text</p></main><div id="comments"><p>a long comment of many words here</p></div>', "text"),
    ('<article><p>a</p><form>name <input name="x"> <button>go</button></form><div class="ad">buy</div><aside>see</aside></article>', "a"),
    ("<article><p>cut off <a href=\"x", "cut off"), ('<article><p title="a > b">c</p></article>', "c"), ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("<head><title>unclosed</head><article>a<script>var x = 1</article><article>b</article>", "a b"), ('<article>a<select><option>x</select><template><p>t</p></template><svg><title>t</title></svg>b</article>', "a b"),
    ('<article><div class="ad-slot">buy this now</div><section id="comments"><p>I like it</p></section><p aria-hidden="true">x</p><p>t</p></article>', "t"),
    ("<SCRIPT>x</Script><ARTICLE><P>up</P></ARTICLE>", "up"), ('<article><p hidden>no</p><p style="display: none">no</p><p>yes</p></article>', "yes"),
])
def test_pages(source, text):
    assert html_extract.main_text(html_extract.train().root, source) == text


ARTICLE = "<h1>Title here</h1><p>" + "word " * 60 + "</p><p>More text of the story follows and it goes on for a while with more to say.</p>"
COMMENTS = "".join(f"<p>I think that this is comment number {k} and it goes on for quite some time as comments do.</p>" for k in range(4))
PLAIN_ARTICLE = "Title here " + "word " * 60 + "More text of the story follows and it goes on for a while with more to say."


@pytest.mark.parametrize("source", [
    f'<article>{ARTICLE}<div class="post-comments">{COMMENTS}</div></article>',
    f'<article>{ARTICLE}</article><div id="reader-comments">{COMMENTS}</div>',
    f'<article>{ARTICLE}<div class="article-footer"><p>Filed by the desk in the evening of that day.</p></div></article>',
    f'<article>{ARTICLE}</article><section class="related-posts"><h2>Related posts</h2><ul><li><a href="/a">Another story</a></li><li><a href="/b">One more</a></li></ul></section>',
    f'<form method="post" action="/page.aspx"><input type="hidden" name="state" value="x"><nav><a href="/">Home</a></nav><div id="content">{ARTICLE}</div><footer>All rights reserved</footer></form>',
    f'<form id="aspnetForm"><article>{ARTICLE}</article><fieldset><label>Your name</label><input></fieldset></form>',
    f'<article>{ARTICLE}</article><form><p>Write to us and tell us what you think of this page today.</p><label>Name</label></form>',
    f'<article>{ARTICLE}</article><div class="userCommentsList2">{COMMENTS}</div>',
])
def test_ordinary_pages(source):
    root = html_extract.train().root
    assert html_extract.main_text(root, f"<html><body>{source}</body></html>") == PLAIN_ARTICLE


def test_headings_that_end_in_a_telling_word():
    """An anchor on a heading says nothing about what it heads."""
    root = html_extract.train().root
    body = f'<article>{ARTICLE}<h2 id="session-cookies">Session cookies</h2><p>They last for a session and no longer than that one.</p></article>'
    assert html_extract.main_text(root, body) == PLAIN_ARTICLE + " Session cookies They last for a session and no longer than that one."


def test_long_and_broken_pages():
    root = html_extract.train().root
    assert html_extract.main_text(root, "<article>" + "<p>w</p>" * 50_000).count("w") == 50_000
    assert html_extract.main_text(root, "<div>" * 20_000 + "deep") == "deep"
    html_extract.main_text(root, "<" * 100_000)
    html_extract.main_text(root, '<a "' * 50_000)


def test_extraction_keeps_rows_and_columns(spark, table):
    out = html_extract.extract(table)
    assert sorted(out.columns) == sorted(table.columns) and out.count() == len(pages())
    assert {r["host"] for r in out.collect()} == {"clash"}
    assert html_extract.extract(table.limit(0)).count() == 0


# WARC


@pytest.mark.parametrize("options", [{}, {"max_bytes": 0}, {"max_bytes": 0, "filter_bits": 7}])
def test_round_trip(spark, table, options):
    """With repeated digests broadcast, and with a bit table of them, one of which lets others pass."""
    path = new_path(spark, "warc-test")
    warc.write(warc.dedup(table, **options), path, max_file_bytes=3000)
    got = {(r["record_id"], r["target_uri"]): r for r in warc.read(spark, path).collect()}
    by_id = {}
    for r in warc.read(spark, path).collect():
        by_id.setdefault(r["record_id"], []).append(r)
    assert sum(map(len, by_id.values())) == len(pages())
    for i, _, source, *_ in pages():
        body = (source or "").encode()
        for r in by_id[f"urn:page:{'null' if i is None else i}"]:
            assert r["http_length"] == len(body) and r["payload_digest"] == hashlib.sha256(body).hexdigest()
            if r["record_type"] == "response":
                assert bytes(r["payload"]) == body and r["refers_to"] is None
    refers = {i: {r["refers_to"] for r in rows} for i, rows in by_id.items() if rows[0]["record_type"] == "revisit"}
    assert refers == {"urn:page:2": {"urn:page:1"}, "urn:page:null": {"urn:page:1"}, "urn:page:8": {"urn:page:7"}}
    assert {u for _, u in got} >= {None, "http://B.COM/de/x%20y%0A"}


def test_payloads_are_not_shuffled(spark, table):
    rows = warc.dedup(table.select("page_id", "url", "html").repartition(2).sortWithinPartitions("page_id"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("BroadcastExchange") == 1  # the test's own repartition(), and the digests


def test_archives_are_readable_by_others(spark, table, tmp_path):
    path = f"{tmp_path}/a"
    warc.write(warc.dedup(table), path)
    files = glob.glob(f"{path}/*.warc.gz")
    raw = b"".join(gzip.open(f).read() for f in files)
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(pages())
    plain, joined, single = (f"{tmp_path}/{n}" for n in ("plain.warc", "joined.warc.gz", "single.warc.gz"))
    open(plain, "wb").write(raw)
    open(joined, "wb").write(b"".join(open(f, "rb").read() for f in files))
    with gzip.open(single, "wb") as f:
        f.write(b"WARC/1.1\r\n" + raw.split(b"WARC/1.1\r\n")[1])
    whole = sorted(map(repr, warc.read(spark, path).collect()))
    assert sorted(map(repr, warc.read(spark, plain).collect())) == whole == sorted(map(repr, warc.read(spark, joined).collect()))
    assert warc.read(spark, single).count() == 1
    for source in (plain, joined):  # payloads stepped over
        assert warc.read(spark, source, ["record_id", "record_type"]).count() == len(pages())


def other_record(kind, content_type, block, n=0):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}{n}>\r\n" + (f"Content-Type: {content_type}\r\n" if content_type else "") + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("form", ["plain", "members", "one member", "one member that tells its length", "pairs"])
def test_records_that_are_no_http(spark, tmp_path, form):
    """Blocks of other records are payloads as a whole, blank lines and all, however the records are packed."""
    import gzip

    text, http = b"first paragraph\r\n\r\nsecond\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\na\r\n\r\nb"
    cases = [
        ("warcinfo", "application/warc-fields", b"software: x\r\nformat: y\r\n", None), ("conversion", "text/plain", text, None), ("resource", "text/html", b"<p>\r\n\r\n</p>", None),
        ("metadata", "application/warc-fields", b"", None), ("response", "application/http; msgtype=response", http, b"a\r\n\r\nb"), ("response", None, http, b"a\r\n\r\nb"), ("resource", None, text, None),
        ("conversion", "text/plain", b"x" * 200_000, None), ("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n", b""),
    ]
    rows = [other_record(kind, content_type, block, n) for n, (kind, content_type, block, _) in enumerate(cases)]
    data = {
        "plain": b"".join(rows), "members": b"".join(gzip.compress(x) for x in rows), "one member": gzip.compress(b"".join(rows)),
        "one member that tells its length": warc.member(b"".join(rows)), "pairs": b"".join(warc.member(b"".join(rows[i : i + 2])) for i in range(0, len(rows), 2)),
    }[form]
    path = tmp_path / ("x.warc" if form == "plain" else "x.warc.gz")
    path.write_bytes(data)
    got = {r["record_id"]: bytes(r["payload"]) for r in warc.read(spark, str(path)).collect()}
    assert got == {f"urn:x:{kind}{n}": block if payload is None else payload for n, (kind, _, block, payload) in enumerate(cases)}
    assert warc.read(spark, str(path), ["record_id"]).count() == len(cases)
    some = warc.read(spark, str(path)).where("record_type = 'conversion'").collect()
    assert sorted(len(r["payload"]) for r in some) == [len(text), 200_000]
    for size in (1, 7, 100):
        records = warc.Records(io.BytesIO(data), size)
        assert [(h["warc-type"], at.block() if i % 2 else None) for i, (h, at) in enumerate(records)] == [(c[0], c[2] if i % 2 else None) for i, c in enumerate(cases)]


def test_a_cut_archive_fails(spark, tmp_path):
    data = warc.member(warc.record({"record_id": "x", "record_type": "response", "target_uri": None, "payload_digest": None, "refers_to": None, "http_length": None, "payload": b"p" * 5000}, "2020-01-01T00:00:00Z"))
    (tmp_path / "cut.warc.gz").write_bytes(data[:-20])
    with pytest.raises(Exception, match="cut off"):
        warc.read(spark, f"{tmp_path}/cut.warc.gz").collect()


def test_predicates_are_pushed_down(spark, table):
    path = new_path(spark, "warc-test")
    warc.write(warc.dedup(table), path)
    read = warc.read(spark, path, ["record_id", "record_type", "target_uri"])
    found = read.where("record_type = 'revisit' AND target_uri LIKE 'https://%'")
    assert " Filter " not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["record_id"] for r in found.collect()) == ["urn:page:2", "urn:page:8", "urn:page:8"]
    assert read.where("target_uri IS NULL").count() == 1 and read.where("record_id IN ('urn:page:4', 'urn:page:5')").count() == 2
    assert read.where("length(target_uri) > 20").count() > 0  # stays with Spark


def test_empty_archive(spark, table):
    path = new_path(spark, "warc-test")
    warc.write(warc.dedup(table.limit(0)), path)
    assert warc.read(spark, path).count() == 0


def test_skipping_does_not_inflate():
    import io

    rows = [{"record_id": str(i), "record_type": "response", "target_uri": None, "payload_digest": None, "refers_to": None, "http_length": None, "payload": bytes([i]) * 10 + hashlib.sha512(bytes([i])).digest() * 5000} for i in range(4)]
    data = b"".join(warc.member(warc.record(r, "")) for r in rows)
    records = warc.Records(io.BytesIO(data))
    seen = []
    for headers, at in records:
        seen.append(headers["warc-record-id"])
        if seen[-1] == "<2>":
            assert at.block().endswith(rows[2]["payload"])
        else:
            assert len(at.text) < 300_000  # one piece, not the record
    assert seen == ["<0>", "<1>", "<2>", "<3>"]


# URL filters

RULES = [(v, *url_filter.parse_rule(r)) for v, r in queries.RULES]


def judged(host, path, rules):
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h) + len(p), len(h), verdict == "block", h + p, verdict))
    return (best[3], best[4]) if best else (None, "allow")


def test_trie_equals_all_rules():
    rules = RULES + [("block", "a.b.com", ""), ("allow", "b.com", "/x/y"), ("block", "b.com", "/x/yz"), ("block", "b.com", "/x/"), ("allow", "com", "/x/y/z/"), ("block", "org", "/en")]
    root = url_filter.trie_of(rules)
    hosts = ["", "com", "b.com", "a.b.com", "xb.com", "c.a.b.com", "org", "example.org", "www.example.org", "notexample.org", "net", "b.com.", "b.com:80"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/yz", "/x/y/z", "/x/y/z/", "//", "/en", "/en/", "/en/1", "/en/12/3", "/es", "/es/", "/es/a", "/de/", "/fr/q", "/fr"]
    for host in hosts:
        for path in paths:
            rule, verdict = url_filter.longest(root, host, path)
            assert (rule, verdict or "allow") == judged(host, path, rules), (host, path)


@pytest.mark.parametrize("by_join", [False, True])
def test_urls(spark, table, by_join):
    out = url_filter.judge(table, RULES, max_rule_bytes=0 if by_join else url_filter.MAX_RULE_BYTES)
    assert sorted(out.columns) == sorted([*table.columns, "path", "rule", "verdict"]) and out.count() == len(pages())
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {
        1: ("a.example.org", "/en/12", "example.org/en/1", "block"), 2: ("a.example.org", "/en/12", "example.org/en/1", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        None: ("x.com", "/de/", "com/de/", "block"), 5: ("", "", None, "allow"), 6: ("b.com", "/de/x y\n", "com/de/", "block"), 7: ("example.org", "", None, "allow"),
        8: ("example.org", "/es/", "example.org/es/", "block"), 9: ("sub.example.org", "/es", "org/", "allow"),
    }
    assert url_filter.judge(table.limit(0), RULES, max_rule_bytes=0 if by_join else 1000).count() == 0


def test_rules_are_checked():
    for bad in (("deny", "a.com", "/"), ("allow", "", "/"), ("allow", "a.com", "x")):
        with pytest.raises(ValueError):
            url_filter.trie_of([bad])


def test_null_url_and_no_rules(spark, table):
    assert {r["verdict"] for r in url_filter.judge(table, [], default="block").select(F.col("verdict")).collect()} == {"block"}
