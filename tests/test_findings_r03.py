"""What the findings of round 3 named: each of these failed, or was not held, before."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from conftest import DATA
from folioflow.functions import text as T
from folioflow.operators import protection, publish_store, search_index, term_matcher
from folioflow.plans import ORACLE_SQL, QUERIES, stored_queries

TITLES = [
    "<article><h1>a&amp;&amp;&amp; b &amp</h1></article>", "<h1>token = &quot;x&quot;</h1>", "no title", "", None, "<h1>open", "</h1><h1>late</h1>", "<h1>a<h1>b</h1>c</h1>",
    "<nav><h1>in a menu</h1></nav><main><h1>other</h1></main>", "<h1> \t a\n\r\n b\f</h1>", "<h1>\u00a0x\u3000</h1>", "<h1>\x0bx\x0b</h1>", "<h1>&amp;lt;b&lt;i&gt;</h1>", '<h1 class="t">x</h1>', "<H1>x</H1>", "<h1></h1>", "<h1>ü\U0001f600 <b>x</b></h1>",
]


def test_titles_of_odd_pages(spark, tmp_path):
    spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(TITLES)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    wanted = dict(con.execute(ORACLE_SQL["html_titles"]).fetchall())
    assert {r["page_id"]: r["title"] for r in QUERIES["html_titles"](spark, str(tmp_path)).collect()} == wanted


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_posting_lists_leave_tasks_as_lists(monkeypatch):
    rng = random.Random(3)
    pages = np.array([rng.randrange(20) * 7 for _ in range(200)])
    texts = ["".join(rng.choice("ab cß漢\U0001f600") for _ in range(rng.randint(3, 30))) for _ in pages]
    wanted = {}
    for p, t in zip(pages.tolist(), texts, strict=True):
        for i in range(len(t) - 2):
            wanted.setdefault((t[i : i + 3], p // 32), set()).add(p)
    whole = [r for b in search_index._lists_of(pages, texts, 32) for r in b.to_pylist()]
    assert {(r["trigram"], r["run"]): r["ids"] for r in whole} == {k: sorted(v) for k, v in wanted.items()} and len(whole) == len(wanted)
    monkeypatch.setattr(search_index, "BATCH_CHARS", 50)
    parts = {}
    for b in search_index._lists_of(pages, texts, 32):
        for r in b.to_pylist():
            parts.setdefault((r["trigram"], r["run"]), set()).update(r["ids"])
    assert parts == wanted


def test_output_is_checked_once_a_row(spark):
    rows = spark.createDataFrame([('{"translatedText":"a ⟦P0001⟧"}', [("⟦P0001⟧", "x")])], "body string, tokens array<struct<placeholder:string,value:string>>")
    checked = rows.select(protection.validate_output(F.col("body"), F.col("tokens"), 100).alias("r"))
    assert checked.first()["r"]["text"] == "a x"
    assert [plan(checked).count(x) for x in ("regexp_extract_all(", "get_json_object(")] == [1, 1]


def test_order_of_errors(spark):
    tokens = [("⟦P0001⟧", "x"), ("⟦P0002⟧", "y")]
    texts = {"⟦P0001⟧⟦P0002⟧": None, "⟦P0002⟧⟦P0001⟧": "reordered_placeholder", "⟦P0001⟧": "missing_placeholder", "⟦P0001⟧⟦P0002⟧⟦P0002⟧": "duplicate_placeholder", "⟦P0003⟧": "unknown_placeholder", "": "missing_placeholder"}
    rows = spark.createDataFrame([(t, tokens) for t in texts], "t string, tokens array<struct<placeholder:string,value:string>>")
    assert {r["t"]: r["e"] for r in rows.select("t", protection.restore_error(F.col("t"), F.col("tokens")).alias("e")).collect()} == texts
    twice = spark.createDataFrame([("⟦P0001⟧⟦P0001⟧", tokens[:1] * 2)], rows.schema)
    assert twice.select(protection.restore_error(F.col("t"), F.col("tokens")).alias("e")).first()["e"] == "duplicate_placeholder"


def test_prose_is_what_all_patterns_give(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", " ", "  ", "\t", "\n", "\r", "\r\n", " ", "　", "﻿", "\u0085", " ", "é", "\x0b"]) for _ in range(rng.randint(0, 8))) for _ in range(400)] + [None]
    one = F.regexp_replace(F.regexp_replace(T.normalize_line_endings("t"), "[ \\t]+", " "), " *\\n+ *", " ")
    plain = F.regexp_replace(one, f"^{T.ENDS}+|{T.ENDS}+$", "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_prose("t").alias("now"), plain.alias("plain"))
    assert all(r["now"] == r["plain"] for r in rows.collect())


def test_corrections_join_stored_fingerprints(spark):
    assert "sha2(" not in plan(QUERIES["correction_history"](spark, DATA))


def test_commits_share_stored_fingerprints(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(publish_store, "publish", lambda store, rows, *a, **b: plans.append(plan(rows)))
    stored_queries._published(spark, DATA)
    assert plans and not any("sha2(" in p for p in plans)


def test_a_large_glossary_is_joined_and_not_passed_over_again(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(term_matcher, "_broadcast", lambda *a, f=term_matcher._broadcast: passes.append(1) or f(*a))
    rng = random.Random(6)
    pieces = ["Harbour", "light", "b-c", " ", ", ", "Ärger", "STRASSE", "漢字", "İ", "_a", "...", "9"]
    texts = [(i, "paragraph", "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    terms = ["harbour", "harbour light", "light, b-c", "- c", "c ", "9", "ärger", "_a", "漢字", ", harbour", "i̇", "strasse 9"]
    blocks = spark.createDataFrame(texts, "block_id long, block_type string, source_text string")
    for given, most in ((terms, 0), ([*terms, "...", ", "], 2)):
        passes.clear()
        frame = spark.createDataFrame([(t,) for t in given], "term string")
        found = {r["block_id"]: r["protected"].asDict(recursive=True) for r in term_matcher.protect_with_terms(blocks, frame, part_chars=8).collect()}
        assert len(passes) <= most
        assert found == {i: protection.protect(t, [], protection.term_list(given)) for i, _, t in texts}
