"""Markdown pages, payloads, and stored resources."""

import gzip
import json

import pytest

from folioflow.functions.canonical import canonical_json
from folioflow.operators import parse_markdown as M
from folioflow.sources.readers import bounded, text_resource_stream, text_resources, unpacked

PAGE = """---
layout: wide
---
# Boats & *bays*

See `src/hull.ts`, `Mast.Head` and `two words`, or [the **list**](https://a.example/l "L").
Bare https://b.example/x. An \\*escaped\\* mark, snake_case_name.

Fitting out
-----------

1. Sand
2. Paint
   - twice

   and wait
3. Dry

| Part | Size |
|:-----|:----:|
| Keel | `4\\|m` |
| Mast |

> Tip: bring rope
> and a knife.

> A quote that is no notice.

![A boat](b.png "At sea")

~~~py
x = 1

~~~

<div>raw</div>

[ref]: http://c.example
Read [the ref][ref], not [this][one].
"""


def test_markdown_blocks():
    found, error = M.parse_markdown(PAGE)
    assert error is None
    assert [(k, t) for k, t, *_ in found] == [
        ("heading", "Boats & bays"), ("paragraph", "See src/hull.ts, Mast.Head and two words, or the list. Bare https://b.example/x. An *escaped* mark, snake_case_name."),
        ("heading", "Fitting out"), ("list", "Sand\nPaint and wait\ntwice\nDry"), ("table", "Part\tSize\nKeel\t4|m\nMast\t"), ("notice", "bring rope and a knife."), ("image", "A boat\nAt sea"),
        ("code", "x = 1\n"), ("paragraph", "Read the ref, not [this][one]."),
    ]
    assert [x[4] for x in found] == [k != "code" for k, *_ in found] and found[3][2] == ["Boats & bays", "Fitting out"]
    payload = [json.loads(x[3]) for x in found]
    tokens = payload[1]["protectedTokens"]
    assert [(t["kind"], t["value"], found[1][1][t["start"] : t["end"]]) for t in tokens] == [
        ("file_path", "src/hull.ts", "src/hull.ts"), ("identifier", "Mast.Head", "Mast.Head"), ("inline_code", "two words", "two words"), ("url", "https://a.example/l", "the list"),
        ("url", "https://b.example/x", "https://b.example/x"),
    ]
    assert payload[0] == {"depth": 1} and payload[4] == {"headers": ["Part", "Size"], "rows": [["Keel", "4|m"], ["Mast", ""]], "alignments": ["left", "center"]}
    assert payload[5] == {"kind": "tip", "title": "Tip"} and payload[6] == {"src": "b.png", "alt": "A boat", "caption": "At sea"} and payload[7] == {"language": "py"}
    assert payload[3] == {"ordered": True, "items": [{"text": "Sand", "children": []}, {"text": "Paint and wait", "children": [{"ordered": False, "items": [{"text": "twice", "children": []}]}]}, {"text": "Dry", "children": []}]}


@pytest.mark.parametrize(("body", "error"), [(None, "empty"), ("", "empty"), ("\n \n", "empty"), ("- " * 60 + "x", "too_deep"), ("> " * 200 + "x", "too_deep"), ("x" * 50, "block_too_large"), ("a\n\nb\n\nc\n\nd", "too_many_blocks")])
def test_markdown_limits(body, error):
    assert M.parse_markdown(body, M.Limits(blocks=3, block_bytes=40)) == ([], error)


@pytest.mark.parametrize("body", ["`" * 3000, "[" * 3000, "*a " * 3000, "![" * 2000, "- a\n" * 5000, "a|b\n-|-\n" + "1|2\n" * 3000, "\ud800", "\r\r\n#", "```\nopen", "<" * 500])
def test_markdown_of_awkward_pages(body):
    found, error = M.parse_markdown(body)
    assert error in (None, "empty", "too_deep") and all(isinstance(json.loads(x[3]), dict) for x in found)


def test_markdown_pages(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (2, None, "y"), (None, "text", "z"), (1, PAGE, "x")], "page_id long, text string, ordinal string")
    rows = M.parse_pages(df).collect()
    assert len(rows) == 20 and {r.error for r in rows if r.page_id == 2} == {"empty"}
    assert M.parse_pages(df.limit(0)).count() == 0


def test_refill():
    payload = json.loads(M.parse_markdown("- a\n- b\n  - c\n- d")[0][0][3])
    lines = lambda p: [t for _, t in M.list_lines(p)]
    assert lines(M.refill(payload, ["1", "2", "3", "4", "5"])) == ["1", "2", "3", "4"]
    assert lines(M.refill(payload, ["1", "", "3"])) == ["1", "3", "d"] and lines(M.refill(payload, [])) == ["a", "b", "c", "d"]


def test_canonical_json():
    assert canonical_json({"b": " x \t y\r\n z\xa0", "a": [1, None, True, {"d": "ü", "c": ""}]}) == '{"a":[1,null,true,{"c":"","d":"ü"}],"b":"x y z"}'
    assert canonical_json({"b": " x\r\ny "}, fold=False) == '{"b":" x\\ny "}'


def test_resources(spark, tmp_path):
    files = {"plain.xml": b"<a/>", "packed.gz": gzip.compress(b"<b/>") + gzip.compress(b"<c/>"), "bomb.gz": gzip.compress(b"0" * 100_000), "cut.gz": gzip.compress(b"<d/>" * 9)[:-6], "bytes.bin": b"\xff\xfe\xfa", "long.txt": b"x" * 2000, "none": b""}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = {r.path.rsplit("/", 1)[1]: (r.body, r.error) for r in text_resources(spark, str(tmp_path), most_bytes=1000).collect()}
    assert found == {"plain.xml": ("<a/>", None), "packed.gz": ("<b/><c/>", None), "bomb.gz": (None, "body_too_large"), "cut.gz": (None, "invalid_gzip"), "bytes.bin": (None, "not_text"), "long.txt": (None, "body_too_large")}  # Spark's file sources pass over empty files
    assert text_resources(spark, str(tmp_path), gzip=False).where("path like '%packed.gz'").first().error == "not_text"
    assert unpacked(gzip.compress(b"x" * 10), 10) == (b"x" * 10, None)
    rows = bounded(spark.createDataFrame([("ü",), ("abc",), (None,)], "body string"), most_bytes=2).collect()
    assert [(r.body, r.error) for r in rows] == [("ü", None), (None, "body_too_large"), (None, None)]


def test_text_resource_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write = lambda name, body: (folder / name).write_bytes(body)
    write("a.txt", b"alpha"), write("b.txt.gz", gzip.compress(b"beta")), write("big.txt", b"x" * 2000), write("bad.txt", b"\xff\xfe\x00")

    def run():
        stream = text_resource_stream(spark, str(folder), most_bytes=1000, files_at_once=2)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120) and q.exception() is None
        return {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert run() == {tuple(r) for r in text_resources(spark, str(folder), most_bytes=1000).collect()}
    write("later.txt", b"later")
    found = run()
    assert found == {tuple(r) for r in text_resources(spark, str(folder), most_bytes=1000).collect()} and len(found) == 5


@pytest.mark.parametrize(("source", "text"), [
    ("*a **b** c*", "a b c"), ("***both***", "both"), ("**a *b***", "a b"), ("snake_case_word and _it_", "snake_case_word and it"), ("2 * 3 * 4", "2 * 3 * 4"), ("*open", "*open"), ("~~gone~~ now", "gone now"),
    ("**" + "word " * 900 + "end**", "word " * 900 + "end"), ("a\\\nb", "a b"), ("*a `*` b*", "a * b"), ("[*x*](http://e.x) __y__", "x y"), ("\\*no\\*", "*no*"), ("**a*", "*a"), ("", ""), ("*foo**bar**baz*", "foobarbaz"),
])
def test_emphasis(source, text):
    assert M.Rendered(source).text == text


def test_token_places():
    r = M.Rendered("  see  *the* `x y`,\n[two  **words**](http://e.x/a) and `` ` `` <http://b.c> [](http://n.o)")
    assert r.text == "see the x y, two words and ` http://b.c"
    assert [(t["kind"], r.text[t["start"] : t["end"]]) for t in r.tokens] == [("inline_code", "x y"), ("url", "two words"), ("inline_code", "`"), ("url", "http://b.c"), ("url", "")]


def test_many_marks_take_linear_time():
    import time

    def seconds(n):
        start = time.process_time()
        M.Rendered("*a _b **c " * n)
        return time.process_time() - start

    assert seconds(8000) < 12 * seconds(2000) + 0.2


def test_tabs_and_tasks():
    found, _ = M.parse_markdown("```\n\ta\tb\n```\n\n\tcode\n\n- [ ] open\n- [x] done")
    assert [x[1] for x in found] == ["\ta\tb", "code", "open\ndone"]
