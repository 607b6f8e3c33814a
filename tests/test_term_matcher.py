"""The automaton finds what searching for each term finds, whatever the number of terms and parts."""

import random
import time

import pytest

from folioflow.operators import protection, term_matcher

PIECES = ["harbour", "HARBOUR LIGHT", "light", "lights", "b-c", "xb-c", " ", ", ", "⟦P0001⟧", "Ärger", "straße", "STRASSE", "漢字", "İ", "_a"]
TERMS = [" Harbour ", "harbour light", "light", "b-c", "", "ärger", "straße", "漢", "漢字", "our l", "t"]


def texts(n=150):
    rng = random.Random(4)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    return [(i, "code" if i % 17 == 0 else "paragraph", t, [(a, min(len(t), a + rng.randint(0, 5))) for a in rng.sample(range(len(t) + 1), min(len(t), rng.randint(0, 2)))]) for i, t in enumerate(out)] + [(900, "paragraph", None, None), (901, "paragraph", "light " * 3000, [(0, 5)])]


@pytest.mark.parametrize("part_chars", [8, 4_000_000])
def test_protection_is_that_of_the_plain_search(spark, part_chars):
    rows = texts()
    blocks = spark.createDataFrame(rows, "block_id long, block_type string, source_text string, spans array<struct<start:int,end:int>>")
    terms = spark.createDataFrame([(t,) for t in TERMS + TERMS[:2]], "term string")
    found = {r["block_id"]: r["protected"].asDict(recursive=True) for r in term_matcher.protect_with_terms(blocks, terms, blocks["spans"], part_chars=part_chars).collect()}
    known = protection.term_list(TERMS)
    for i, kind, text, spans in rows:
        wanted = protection.not_translatable() if kind == "code" or text is None else protection.protect(text, spans or [], known)
        assert found[i] == wanted


def test_no_terms(spark):
    blocks = spark.createDataFrame([(1, "paragraph", "some text")], "block_id long, block_type string, source_text string")
    assert term_matcher.protect_with_terms(blocks, spark.createDataFrame([], "term string")).first()["protected"]["text"] == "some text"


def test_time_does_not_follow_the_number_of_terms():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    text = " ".join(word() for _ in range(20_000))

    def seconds(n):
        found = term_matcher._loaded(term_matcher.automaton([word() for _ in range(n)]))
        start = time.process_time()
        for _ in range(5):
            term_matcher.places(text, found)
        return time.process_time() - start

    assert seconds(50_000) < 12 * seconds(50) + 0.2  # a search for each term would take a thousand times as long
