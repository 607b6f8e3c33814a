"""Operators on small authored inputs, against sequential models where order matters."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.functions.text import candidate_limit, classify_inline_code, like_pattern, looks_like_identifier, page_fingerprint
from folioflow.functions.url import canonical_page
from folioflow.operators import budget, diff, discovery, jobs, protection, publish
from folioflow.operators.navigation import parse_parent, segment_label
from folioflow.operators.parse import parse_sources
from folioflow.operators.parse_html import parse_html, parse_pages
from folioflow.operators.parse_markdown import code_kind


def test_candidate_limit():
    assert [candidate_limit(n) for n in (20, 1, 0, -1, 100)] == [500, 50, 0, 0, 1000]


def test_search_patterns():
    assert like_pattern("  products_% ") == r"%products\_\%%"
    assert looks_like_identifier("fooBar") and not looks_like_identifier("foo") and not looks_like_identifier("foo bar")


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("https://DOCS.example.com:443/docs/", "https://docs.example.com/docs"), ("https://docs.example.com/docs/a/#x", "https://docs.example.com/docs/a"),
        ("http://docs.example.com/docs", None), ("https://docs.example.com/other", None), ("https://x.example.com/docs", None), ("https://docs.example.com/docs?q=1", None),
        ("https://docs.example.com/docs/a.txt", None), ("https://u:p@docs.example.com/docs", None), ("https://docs.example.com:8443/docs", None), (None, None), ("", None),
    ],
)
def test_canonical_page(spark, url, wanted):
    row = spark.createDataFrame([(url,)], "u string").select(canonical_page(F.col("u")).alias("p")).first().p
    assert row.url == wanted
    assert (row.error is None) == (wanted is not None)


def _b(text, ordinal, kind="paragraph", path=""):
    return {"block_type": kind, "fingerprint": text, "heading_path": path, "translatable": kind != "code", "ordinal": ordinal}


def _blocks(*texts):
    return [_b(t, i) for i, t in enumerate(texts)]


def slow_match(previous, current):
    """Every current block against every previous one of its type."""
    pairs, modified = {}, set()
    near = lambda some, j: min(some, key=lambda i: (abs(i - j), i))
    for j, b in enumerate(current):
        same = [i for i, a in enumerate(previous) if i not in pairs.values() and (a["block_type"], a["fingerprint"]) == (b["block_type"], b["fingerprint"])]
        if same:
            pairs[j] = near(same, j)
    at = lambda rows, i: rows[i]["fingerprint"] if 0 <= i < len(rows) else None
    for j, b in enumerate(current):
        if j in pairs:
            continue
        scores = []
        for i, a in enumerate(previous):
            if i in pairs.values() or a["block_type"] != b["block_type"]:
                continue
            heading = a["heading_path"] == b["heading_path"]
            beside = sum(at(previous, i + s) is not None and at(previous, i + s) == at(current, j + s) for s in (-1, 1))
            if heading or beside:
                scores.append((10.0 * heading + 4.0 * beside - abs(i - j) / 100, -i))
        if scores:
            pairs[j] = -max(scores)[1]
            modified.add(j)
    return pairs, modified


def test_diff_equals_slow_match():
    rng = random.Random(11)
    for _ in range(300):
        page = lambda: [_b(rng.choice("abcdef"), i, rng.choice(["paragraph", "code"]), rng.choice("xyz")) for i in range(rng.randint(0, 14))]
        before, after = page(), page()
        assert diff.match(before, after) == slow_match(before, after)


def test_diff_is_linear():
    """4,000 changed blocks under one heading."""
    before, after = ([_b(f"{v}{i}", i, path="h") for i in range(4000)] for v in "ab")
    assert [c[0] for c in diff.changes(before, after)] == ["modified"] * 4000


def test_diff_kinds():
    assert diff.changes([], [_b("n", 0, "code"), _b("o", 1)]) == [("added", None, 0, False), ("added", None, 1, True)]
    assert diff.changes(_blocks("p", "q", "r"), _blocks("r", "p")) == [("moved", 2, 0, False), ("moved", 0, 1, False), ("deleted", 1, None, False)]
    assert diff.changes(_blocks("p", "q"), _blocks("p", "z"), every=True) == [("same", 0, 0, False), ("modified", 1, 1, True)]


def test_diff_on_spark(spark):
    schema = "page_id long, ordinal int, block_type string, fingerprint string, translatable boolean, note string"
    old = spark.createDataFrame([(1, 0, "paragraph", "a", True, "x"), (1, 1, "paragraph", "b", True, "x"), (2, 0, "code", "z", False, "x"), (None, 0, "code", "z", False, "x")], schema)
    new = spark.createDataFrame([(1, 0, "paragraph", "b", True, "y"), (3, 0, "paragraph", "n", True, "y")], schema)
    found = {(r.page_id, r.kind, r.previous_index, r.current_index) for r in diff.diff_blocks(old, new).collect()}
    assert found == {(1, "moved", 1, 0), (1, "deleted", 0, None), (2, "deleted", 0, None), (3, "added", None, 0)}
    assert diff.diff_blocks(old.limit(0), new.limit(0)).count() == 0


PAGE = """<nav><p>No</p></nav><main><h1>Title</h1><p>Some <a href="/x">link</a> and <code>code</code>.</p><h2>Part</h2><ul><li>One<ul><li>Inner</li></ul></li><li>Two</li></ul>
<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table><aside><p>Warning: hot</p></aside><pre><code>x = 1
y = 2</code></pre><figure><img alt="Alt" src="i.png"><figcaption>Cap</figcaption></figure><form><p>No</p></form></main><footer>No</footer>"""


def test_parse_html():
    found, error = parse_html(PAGE)
    assert error is None
    assert [k for k, *_ in found] == ["heading", "paragraph", "heading", "list", "table", "notice", "code", "image"]
    texts = [t for _, _, t, _ in found]
    assert texts[1] == "Some link and code." and texts[3] == "One\nInner\nTwo" and texts[4] == "A\tB\n1\t2" and texts[6] == "x = 1\ny = 2" and texts[7] == "Alt\nCap"
    assert found[3][3] == ["Title", "Part"]


@pytest.mark.parametrize(("html", "error"), [(None, "empty"), ("  ", "empty"), ("<p>x</p>", "missing_content"), ("<main><p>a</p></main><main><p>b</p></main>", "ambiguous_content"), ("<article></article>", "empty")])
def test_parse_errors(html, error):
    assert parse_html(html) == ([], error)


def test_parse_pages(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (2, None, "y"), (None, PAGE, "z")], "page_id long, html string, ordinal string")
    assert parse_pages(df).count() == 17
    assert parse_pages(df.limit(0)).count() == 0


def test_budget_equals_sequential(spark):
    rng = random.Random(5)
    requests = [(f"2024-01-0{rng.randint(1, 3)}", datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 500)), i, rng.randint(1, 40)) for i in range(300)]
    used, wanted = {}, {}
    for day, _, i, tokens in sorted(requests):
        wanted[i] = used.get(day, 0) + tokens <= 100
        used[day] = used.get(day, 0) + tokens * wanted[i]
    df = spark.createDataFrame(requests, "usage_date string, at timestamp, reservation_id long, tokens long")
    assert {r.reservation_id: r.admitted for r in budget.admit(df, 100).collect()} == wanted


def test_spaced_starts(spark):
    """Two levels of running maxima against one request after the other."""
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 20_000)) for i in range(400)]
    wanted, last = {}, {}
    for i, host, at in sorted(rows, key=lambda r: (r[2], r[0])):
        wanted[i] = last[host] = max(at, last.get(host, -(10**9)) + 70)
    df = spark.createDataFrame(rows, "request_id long, host string, arrival_ms long")
    for span in (500, 3_600_000):
        assert {r.request_id: r.start_ms for r in jobs.spaced_starts(df, 70, span).collect()} == wanted


def test_scan_carries_no_state_over_keys(spark):
    """A hot key beside small ones; repeated and null rows."""
    rows = [("hot", i, 1) for i in range(5000)] + [("b", 1, 60), ("b", 2, 60), (None, 1, 99), (None, 2, None)]
    df = spark.createDataFrame(rows, "usage_date string, at long, tokens long").withColumn("reservation_id", F.col("at")).withColumn("admitted", F.lit("x"))
    found = budget.admit(df, 100).collect()
    assert sum(r.admitted for r in found if r.usage_date == "hot") == 100
    assert [(r.at, r.admitted, r.used_after) for r in sorted(found, key=lambda r: r.at) if r.usage_date == "b"] == [(1, True, 60), (2, False, 60)]
    assert [(r.at, r.admitted) for r in sorted(found, key=lambda r: r.at) if r.usage_date is None] == [(1, True), (2, False)]
    assert budget.admit(df.limit(0), 100).count() == 0


def test_enqueue(spark):
    events = [("k", 1, "enqueue", 5, 100), ("k", 2, "enqueue", 5, 100), ("k", 3, "enqueue", 9, 200), ("k", 4, "claim", 0, 0), ("k", 5, "enqueue", 99, 0), ("k", 6, "requeue", 0, 300),
              ("k", 7, "enqueue", 1, 200), ("k", 8, "claim", 0, 0), ("k", 9, "finish", 0, 0), ("k", 10, "enqueue", 1, 1), ("z", 1, "finish", 0, 0)]
    df = spark.createDataFrame([(k, at, at, e, p, r) for k, at, e, p, r in events], "dedupe_key string, at_us long, event_id long, event string, priority int, run_at_us long")
    found = [(r.action, r.job_number) for r in jobs.enqueue(df).orderBy("dedupe_key", "at_us").collect()]
    assert found == [("created", 1), ("deduplicated", 1), ("promoted", 1), ("claimed", 1), ("deduplicated", 1), ("requeued", 1), ("promoted", 1), ("claimed", 1), ("finished", 1), ("created", 2), ("ignored", 0)]


def test_publish_pages(spark):
    """States follow a block that moved, a changed one is translated again, a new one is pending."""
    schema = "block_id long, page_id long, ordinal int, block_type string, fingerprint string, translatable boolean"
    old = spark.createDataFrame([(1, 1, 0, "heading", "h", True), (2, 1, 1, "paragraph", "a", True), (3, 1, 2, "paragraph", "b", True), (9, 2, 0, "heading", "s", True)], schema)
    new = spark.createDataFrame([(11, 1, 0, "heading", "h", True), (12, 1, 1, "paragraph", "b", True), (13, 1, 2, "paragraph", "a2", True), (14, 1, 3, "code", "c", False), (19, 2, 0, "heading", "s", True)], schema)
    states = spark.createDataFrame([(1, "manually_corrected", 7), (2, "manually_corrected", 8), (3, "ai_translated", 9)], "block_id long, status string, current_revision_id long")
    prints = {r.page_id: r.p for r in old.groupBy("page_id").agg(page_fingerprint("ordinal", "block_type", "fingerprint").alias("p")).collect()}
    versions = spark.createDataFrame([(p, 1, x, True) for p, x in prints.items()], "page_id long, version int, fingerprint string, current boolean")
    out = publish.publish_pages(new, versions, old, states)
    assert {(r.page_id, r.decision, r.version) for r in out["decisions"].collect()} == {(1, "published", 2), (2, "unchanged", 1)}
    assert {(r.kind, r.previous_index, r.current_index) for r in out["changes"].collect()} == {("moved", 2, 1), ("modified", 1, 2), ("added", None, 3)}
    assert {(r.block_id, r.status, r.current_revision_id) for r in out["states"].collect()} == {(11, "manually_corrected", 7), (12, "ai_translated", 9), (13, "review_required", 8)}
    assert [r.block_id for r in out["jobs"].collect()] == [13]


def test_login_window(spark):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [(1, t(m), m, False) for m in range(7)] + [(1, t(16), 16, False), (2, t(0), 0, False), (2, t(1), 1, True), (2, t(2), 2, False)]
    found = jobs.login_allowed(spark.createDataFrame(rows, "user_id long, at timestamp, attempt_id long, ok boolean")).collect()
    assert {(r.user_id, r.attempt_id) for r in found if not r.allowed} == {(1, 5), (1, 6)}


def test_protection():
    """Terms against a plain search of all places."""
    rng = random.Random(3)
    terms = protection.term_list([" Harbour ", "harbour light", "light", "b-c", ""])
    assert terms == ["b-c", "harbour", "harbour light", "light"]
    pieces = ["harbour", "HARBOUR LIGHT", "light", "lights", "b-c", "xb-c", " ", ", ", "⟦P0001⟧"]
    for _ in range(200):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
        locked = [(a, min(len(text), a + rng.randint(1, 6)))] if text and (a := rng.randrange(len(text))) >= 0 and rng.random() < 0.4 else []
        inner = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")  # noqa: B023, E731
        places = [
            (i, i + len(t)) for t in terms for i in range(len(text)) if text.lower().startswith(t, i) and not (inner(i) and inner(i - 1)) and not (inner(i + len(t) - 1) and inner(i + len(t)))
            and not any(i < b and a < i + len(t) for a, b in locked)
        ]
        wanted = []
        for a, b in sorted(places, key=lambda s: (s[0], -s[1])):
            if not wanted or a >= wanted[-1][1]:
                wanted.append((a, b))
        assert protection.term_spans(text, terms, locked) == wanted
        done = protection.protect(text, locked, terms)
        restored = done["text"]
        for t in reversed(done["tokens"]):
            at = restored.rindex(t["placeholder"])
            restored = restored[:at] + t["value"] + restored[at + len(t["placeholder"]) :]
        assert restored == text and len({t["placeholder"] for t in done["tokens"]}) == len(done["tokens"])
    # a longer term that touches a locked span leaves the shorter one at its place
    assert protection.term_spans("old harbour light", terms, [(12, 17)]) == [(4, 11)]
    assert protection.protect("abcdef", [(0, 4), (2, 6)], [])["error"] == "overlapping_spans"


@pytest.mark.parametrize(
    ("body", "error"),
    [
        ('{"translatedText": "a ⟦P0001⟧ ⟦P0002⟧"}', None), ('{"translatedText": "⟦P0001⟧"}', "missing_placeholder"), ('{"translatedText": "⟦P0001⟧⟦P0001⟧⟦P0002⟧"}', "duplicate_placeholder"),
        ('{"translatedText": "⟦P0002⟧⟦P0001⟧"}', "reordered_placeholder"), ('{"translatedText": "⟦P0001⟧⟦P0002⟧⟦P0003⟧"}', "unknown_placeholder"), ("no", "invalid_json"),
        ('{"translatedText": "x", "more": 1}', "invalid_json"), ('{"translatedText": " "}', "empty_translation"), ('{"translatedText": "' + "x" * 200 + '"}', "response_too_large"),
    ],
)
def test_output_validation(spark, body, error):
    tokens = [("⟦P0001⟧", "A"), ("⟦P0002⟧", "B")]
    df = spark.createDataFrame([(body, tokens)], "body string, tokens array<struct<placeholder:string,value:string>>")
    r = df.select(protection.validate_output(F.col("body"), F.col("tokens"), 150).alias("r")).first().r
    assert r.error == error
    assert error or r.text == "a A B"


def test_discovery(spark):
    site = "https://docs.example.com"
    docs = spark.createDataFrame(
        [
            (f"{site}/sitemap.xml", f"<sitemapindex><sitemap><loc>{site}/a.xml</loc></sitemap><sitemap><loc>https://other.example/x.xml</loc></sitemap></sitemapindex>"),
            (f"{site}/a.xml", f"<urlset><url><loc>{site}/docs/b/</loc><lastmod>2024-01-01</lastmod></url><url><loc>{site}/docs/b</loc><lastmod>2024-02-01</lastmod></url><url><loc>{site}/docs/private/c</loc></url><url><loc>{site}/blog</loc></url></urlset>"),
        ],
        "url string, body string",
    )
    robots = spark.createDataFrame([(site, f"User-agent: *\nDisallow: /docs/private\nAllow: /docs\nSitemap: {site}/sitemap.xml\n")], "origin string, body string")
    roots = [r.sitemap for r in discovery.robots_sitemaps(robots).collect()]
    found = discovery.discover(docs, roots, discovery.robots_rules(robots)).collect()
    assert [(r.canonical_url, r.last_modified) for r in found] == [(f"{site}/docs/b", "2024-02-01")]


def test_mirror(spark):
    site = "https://docs.example.com"
    docs = spark.createDataFrame([("m1", f"<urlset><url><loc>{site}/docs/x</loc></url><url><loc>{site}/blog</loc></url></urlset>"), ("m2", "<urlset></urlset>"), ("m3", None)], "url string, body string")
    found = {(r.url, r.canonical_url, r.error) for r in discovery.mirror_entries(docs).collect()}
    assert found == {("m1", f"{site}/docs/x", None), ("m1", None, "path"), ("m2", None, "invalid_mirror"), ("m3", None, "invalid_mirror")}


def test_discovery_limits(spark):
    """Deeper, more or longer than the limits is an error, not a shorter result."""
    site = "https://docs.example.com"
    index = lambda *to: "<sitemapindex>" + "".join(f"<sitemap><loc>{site}/{x}</loc></sitemap>" for x in to) + "</sitemapindex>"
    docs = spark.createDataFrame([(f"{site}/0", index("1", "0")), (f"{site}/1", index("2")), (f"{site}/2", f"<urlset><url><loc>{site}/docs/a</loc></url><url><loc>{site}/docs/b</loc></url></urlset>")], "url string, body string")
    found = lambda **limits: [r.canonical_url for r in discovery.discover(docs, [f"{site}/0"], **limits).collect()]
    assert found(most_depth=2, most_files=3, most_candidates=2) == [f"{site}/docs/a", f"{site}/docs/b"]
    for limits, error in (({"most_depth": 1}, "depth"), ({"most_files": 2}, "file"), ({"most_candidates": 1}, "candidate")):
        with pytest.raises(ValueError, match=error):
            found(**limits)


def test_parse_sources(spark):
    df = spark.createDataFrame([(1, "text", "# A\n\nb"), (2, "html", "<main><h1>A</h1><p>b</p></main>"), (3, None, "x"), (4, "text", None)], "page_id long, format string, body string")
    found = sorted((r.page_id, r.block_type or "", r.source_text or "", r.error or "") for r in parse_sources(df).collect())
    assert found == [(1, "heading", "A", ""), (1, "paragraph", "b", ""), (2, "heading", "A", ""), (2, "paragraph", "b", ""), (3, "", "", "unknown_format"), (4, "", "", "empty")]


def test_navigation_labels(spark):
    rows = spark.createDataFrame([("api-keys",), ("my_own-page",), ("",)], "s string").select(segment_label(F.col("s")).alias("x")).collect()
    assert [r.x for r in rows] == ["API Keys", "My_own Page", ""]
    values = ["/docs", "/docs/", "", None, "/docs/a/../b", "%2Fdocs%2Fa", "/docs/" + "x" * 500, "/other"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", parse_parent(F.col("v")).alias("p")).orderBy("i").collect()
    assert [r.p for r in rows] == ["/docs", "/docs", None, None, None, "/docs/a", None, None]


def test_inline_code_kinds(spark):
    wanted = {"Ab.Cd": "identifier", "Ab": "identifier", "a\\b": "file_path", "x/y": "file_path", "x.py": "inline_code", "x.YML": "file_path", "a b": "inline_code", "ab": "inline_code", "": "inline_code"}
    rows = spark.createDataFrame([(v,) for v in wanted], "v string").select("v", classify_inline_code("v").alias("k")).collect()
    assert {r.v: r.k for r in rows} == wanted == {v: code_kind(v) for v in wanted}
