"""Vector near-duplicates against all pairs, components, and main text of pages."""

import random

import numpy as np
from fathom.llm import graph, html, neardup


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(200, 200), (129, 300)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in [*range(100, 130), 300]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 32))
    rows = []
    for c in centres:
        for _ in range(rng.integers(1, 8)):
            rows.append((c + rng.standard_normal(32) * rng.choice([0.05, 0.2, 0.3]) * np.abs(c).mean()).astype(np.float32).tolist())
    dense = rng.standard_normal(32)
    rows += [(dense + rng.standard_normal(32) * 0.01).tolist() for _ in range(60)]  # no split makes these fewer
    rows += [rows[0]] * 50 + [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [1.0] * 5, [2.0] * 5, [None] + [1.0] * 31]
    table = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)] + [(None, rows[3], "y")], "vec_id long, embedding array<double>, v string")
    s = neardup.Settings(leaf=24, trees=6, sample_rows=2000, least_sample=16)
    got = {r["vec_id"]: r for r in neardup.cluster(table, s).collect()}
    rows.append(rows[3])
    ids = [*range(len(rows) - 1), None]
    valid = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = {i: set() for i in range(len(rows))}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if valid(a) and valid(b) and len(a) == len(b) and np.dot(a, b) >= 0.95 * np.linalg.norm(a) * np.linalg.norm(b):
                links[i].add(j)
                links[j].add(i)
    total = sum(map(len, links.values()))
    found = sum(got[ids[i]]["n_links"] for i in links)
    assert 0.99 * total <= found <= total and total > 3000
    for i in links:
        assert got[ids[i]]["n_links"] <= len(links[i])
    for i in (len(rows) - 8, len(rows) - 7, len(rows) - 6, len(rows) - 5, len(rows) - 2):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[len(rows) - 3]["component_id"] == len(rows) - 4
    assert got[None]["component_id"] <= 3 and not got[None]["kept"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/x">Menu {i}</a></li></ul></nav><div class="ad">Buy {i}</div>
<article><header><h1>Title {i} &amp; more</h1><p>by someone</p></header><p><b>Head.<br><p>First  {i}\n para&nbsp;one, which says more than all that the pages have in common, and then some {i} times over.</p><div>Loose <i>text</i> here<form>no <input></form></div>
<p>Follow us on the usual channels</p><aside>side</aside></article><div id="comments"><p>nice post {i}</p></div><footer>&copy; me</footer></body></html>"""


def test_blocks_of_a_page():
    got = [text for _, text in html.blocks(html.parse(PAGE.replace("{i}", "7")), {})]
    assert got == ["Title 7 & more", "Head.", "First 7 para one, which says more than all that the pages have in common, and then some 7 times over.", "Loose text here", "Follow us on the usual channels"]
    plain = "<div class='menu'>x</div><div><p>a &lt; b<p>c</div><ul><li><a>l1</a><li><a>l2</a></ul><p hidden>h</p>tail"
    assert [text for _, text in html.blocks(html.parse(plain), {})] == ["a < b", "c", "tail"]
    for odd in ("", "<", "<p", "<p>x", "</b></p>x", "<!-- ", "<script>a", "a<b<c>", "<article><p>cut &am"):
        html.blocks(html.parse(odd), {})


def test_tree_matching_counts_nodes():
    a, b = html.parse("<div><p>x</p><ul><li>1</li><li>2</li></ul></div>"), html.parse("<div><h1>t</h1><p>y</p><ul><li>1</li></ul></div>")
    assert html._match(a, b)[0] == 5  # root, div, p, ul, li


def test_template_goes_and_copies_stay(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{i}", str(i))) for i in range(8)]
    copy = "<article><h1>One</h1><p>same long text of an article that is mirrored</p></article><footer>{i}</footer>"
    rows += [(100 + i, f"https://u@mirror.example:80/{i}", copy.replace("{i}", str(i))) for i in range(9)]
    rows += [(200, None, "<p>x</p>"), (201, "http://h.example/n", None), (202, "http://h.example/e", ""), (0, "http://h.example/0", PAGE.replace("{i}", "0"))]
    table = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, hash int, text string")
    for size in (64 << 20, 0):  # references sent to the workers, and joined
        got = html.extract(table, max_reference_bytes=size).collect()
        texts = {r["page_id"]: r["text"] for r in got}
        assert len(got) == len(rows) and texts[3] == "Title 3 & more\n\nFirst 3 para one, which says more than all that the pages have in common, and then some 3 times over."
        assert texts[104] == "One\n\nsame long text of an article that is mirrored"
        assert (texts[200], texts[201], texts[202]) == ("x", "", "") and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(table.limit(0)).count() == 0


def extracted(page, reference=None):
    tree, place = html.parse(page), {}
    if reference is not None:
        other = html.parse(reference)
        place = html.places(tree, other, html.numbered(other))
    return [text for _, text in html.blocks(tree, place)]


def test_nesting_and_rows_of_any_number():
    deep = lambda n, tag: "<body>" + f"<{tag}>" * n + "deep" + f"</{tag}>" * n + "</body>"
    for tag in ("div", "b"):
        assert extracted(deep(10_000, tag), deep(9_000, tag)) == ["deep"]
    rows = lambda k: "<article><table>" + "".join("<tr>" + f"<td>{i}</td>" * (1 + i * k % 3) + "</tr>" for i in range(10_000)) + "</table></article>"
    assert len(extracted(rows(1), rows(2))) == sum(1 + i % 3 for i in range(10_000))


def test_tree_matching_equals_plain_recursion():
    import random

    rng = random.Random(3)

    def tree(depth):
        tag = rng.choice(["p", "b", "i"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(4) if depth else 0)) + f"</{tag}>"

    def plain(a, b):
        if a.tag != b.tag:
            return 0
        x, y = a.elements(), b.elements()
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1][j + 1] = max(best[i][j] + plain(p, q), best[i][j + 1], best[i + 1][j])
        return best[-1][-1] + 1

    for cells in (1_000_000, 4):
        html._CELLS = cells
        html._MATCHED.clear()
        for _ in range(60):
            a, b = html.parse("<div>" + tree(4) + tree(3) + "</div>"), html.parse("<div>" + tree(4) + tree(3) + "</div>")
            assert html._match(a, b)[0] == plain(a, b) == len(html.places(a, b, html.numbered(b)))
    html._CELLS = 1_000_000


def test_names_are_judged_whole():
    assert extracted("<body class='has-sidebar'><div class='content no-comments'><p>one</p></div></body>") == ["one"]
    assert extracted("<article class='post comments-open'><p>one</p><div class='related-work'>two</div><div class='comments-list'>no</div></article>") == ["one", "two"]
    assert extracted("<form><article><p>one</p></article></form>") == ["one"]
    assert extracted("<div class='sidebar'>no</div><p><a href=x>all link</a></p><ul><li><a>menu</a></li></ul>") == ["all link"]
    assert extracted("<article><p>a</p></article><article>b</article><div class='site-footer'>no</div>") == ["a", "b"]
    assert extracted("<div class='cookie-notice-wrapper'>no</div><div class=ad>no</div><p>yes</p>") == ["yes"]


def test_common_direction_and_dense_groups_keep_their_links(spark):
    rng = np.random.default_rng(4)
    common = rng.standard_normal(24)
    x = rng.standard_normal((900, 24)) * 0.8 + 1.2 * common / np.linalg.norm(common) * 5
    x[:250] = x[0] + rng.standard_normal((250, 24)) * 0.15
    x[300:500] = x[500:700] + rng.standard_normal((200, 24)) * 0.2
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, x[0].tolist()), (9001, None), (9002, [0.0] * 24)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int(((u @ u.T >= 0.95).sum() - len(u)) / 2)
    for settings in (neardup.Settings(leaf=128), neardup.Settings(leaf=64, sample_rows=200, broadcast_bytes=50_000)):
        got = {r["vec_id"]: r for r in neardup.cluster(table, settings).collect()}
        assert len(got) == 903 and got[9001]["n_links"] == got[9002]["n_links"] == 0
        degree = (u @ u.T >= 0.95).sum(axis=1) - 1
        copies = (u @ u[0] >= 0.95).astype(int)
        assert all(got[i]["n_links"] <= degree[i] + copies[i] for i in range(900))
        found = (sum(got[i]["n_links"] for i in range(900)) - copies.sum()) / 2
        assert found >= 0.9 * want
    assert neardup.cluster(table.limit(0)).count() == 0


def test_parts_of_an_article_are_not_judged_by_one_word():
    prose = "<p>" + "a long sentence that tells what the story is about " * 3 + "</p>"
    for name in ("ad-hoc", "cookie-recipe", "section-comment", "post-search", "main-widget"):
        assert len(extracted(f"<article><p>one</p><div class='{name}'>{prose}</div></article>")) == 2, name
    for name in ("comments-list", "ad-slot", "cookie-notice", "newsletter-form", "share", "notice", "user-comments", "main-nav"):
        assert extracted(f"<article><p>one</p><div class='{name}'>{prose}</div></article>") == ["one"], name
    assert extracted("<article><p>one</p><div class='post-search'><p>find</p></div></article>") == ["one"]
    assert extracted("<article><p style='DISPLAY: None'>no</p><p>one</p></article>") == ["one"]
    assert extracted("<div class=row><div><article>A</article></div><div><article>B</article></div></div>") == ["A", "B"]
    assert extracted("<main><p>short</p></main><div><main><p>a longer one</p></main></div>") == ["a longer one"]


def plain_extract(rows, references, share=0.6, least=4):
    """Template by counting, page by page: (id, text) of rows (id, host, html) with a reference page a host."""
    seen, counts = {}, {}
    for _, host, page in rows:
        if host and page is not None and page not in seen.setdefault(host, {}):
            found = cut(page, references[host])
            seen[host][page] = found
            for at in set(found):
                if at[0] >= 0:
                    counts[host, at] = counts.get((host, at), 0) + 1
    out = []
    for i, host, page in rows:
        found = cut(page, references.get(host)) if page is not None else []
        pages = len(seen.get(host, ()))
        varying = [b for b in found if not (pages >= least and counts.get((host, b), 0) >= share * pages)]
        out.append((i, "\n\n".join(t for _, t in varying or found)))
    return out


def cut(page, reference):
    tree, place = html.parse(page), {}
    if reference is not None:
        other = html.parse(reference)
        place = html.places(tree, other, html.numbered(other))
    return html.blocks(tree, place)


def with_references(spark, rows):
    """The reference page of each host: of those of some length the one with the least hash."""
    table = spark.createDataFrame([(h, p) for _, h, p in rows if h and p is not None], "host string, html string")
    return {r["host"]: r["m"][2] for r in table.groupBy("host").agg({"html": "count"}).select("host").join(table.selectExpr("host", "struct(length(html) < 200, xxhash64(html), html) as s").groupBy("host").agg({"s": "min"}).withColumnRenamed("min(s)", "m"), "host").collect()}


def test_pages_equal_plain_counting(spark):
    import random

    rng, rows = random.Random(9), []
    words = lambda n: " ".join(rng.choice(["sea", "hill", "road", "lamp", "tree"]) + str(rng.randrange(90)) for _ in range(n))
    for host, n in (("a.org", 12), ("b.org", 3), ("c.org", 9)):
        above, below = words(30), words(40)
        for i in range(n):
            story = "".join(f"<p>{words(rng.randrange(3, 9))}</p>" for _ in range(rng.randrange(1, 4)))
            rows.append((len(rows), host, f"<body><div>{above}</div><div class=x>{story}</div><div>{below}</div></body>"))
    rows += [(len(rows) + j, "a.org", rows[0][2]) for j in range(20)]  # copies of one page count once
    rows += [(100, "a.org", None), (101, "a.org", ""), (102, None, "<p>alone</p>"), (103, "d.org", "<p>one</p>")]
    table = spark.createDataFrame([(i, h and f"https://{h}/p{i}", p, "x") for i, h, p in rows], "page_id long, url string, html string, host string")
    got = sorted((r["page_id"], r["text"]) for r in html.extract(table).collect())
    assert got == sorted(plain_extract(rows, with_references(spark, rows)))
    joined = html.extract(table, max_reference_bytes=0, broadcast_rows=0)
    assert got == sorted((r["page_id"], r["text"]) for r in joined.collect())
    short = [t for i, t in got if rows[i][1] == "a.org"] if len(got) > 50 else [t for _, t in got[:12]]
    assert all(len(t) < 200 for t in short[:12])  # the story alone, though most of the page is template


def test_pages_query_equals_plain_counting(spark):
    import re

    import pyarrow.parquet as pq
    from fathom.llm.queries import QUERIES

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    rows = [(r["page_id"], re.match(r"[a-z]+://([^/:?#]*)", r["url"] or "")[1].lower(), r["html"]) for r in pages]
    got = {r["page_id"]: r["text"] for r in QUERIES["op5_html_extraction"](spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(plain_extract(rows, with_references(spark, rows)))


def test_wide_dense_groups_move_in_proportion(spark, monkeypatch):
    """Groups most of whose pairs link, though few vectors are near the centre: what is dealt for comparison grows with
    the vectors, not with their square, and all links are counted."""
    moved, dealt = [], neardup._dealt

    def counted(*some):
        out = dealt(*some)
        moved.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_dealt", counted)
    rng = np.random.default_rng(6)
    for n in (1000, 2000, 4000):
        x = rng.standard_normal(64) + rng.standard_normal((n, 64)) * 0.17
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {r["vec_id"]: r["n_links"] for r in neardup.cluster(table, neardup.Settings(leaf=64)).collect()}
        degree = (u @ u.T >= 0.95).sum(axis=1) - 1
        assert degree.mean() > 0.9 * n and sum(got.values()) >= 0.99 * degree.sum() and all(got[i] <= degree[i] for i in range(n))
    assert moved[2] <= 4.5 * moved[0] and moved[2] <= 3 * 4000
