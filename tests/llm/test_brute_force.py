"""Operators that SQL can't express, against plain Python over small tables with awkward rows."""

import gzip
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import DATA
from folioflow.llm import html_extraction, license_scan, lm_scoring, queries, simhash, source_mixing, toxicity, warc
from folioflow.llm.decontamination import benchmark_matches, contamination, decontaminate
from folioflow.llm.hilbert_sharding import hilbert_index, shard, write_shards
from folioflow.llm.license_rules import signatures
from folioflow.llm.quality_rules import quality_rules
from folioflow.llm.warc import captures

# extra columns whose names clash with those that the operators make
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, _fp string, score string, _row int, shard int, block int"
WORDS = "the of and licence to apache license in mit cc by gnu general public worthless stone river cloud".split()


def awkward(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(WORDS, rng.integers(1, 40))) for _ in range(n)]
    texts += [None, "", " \t\n", "a", "!!!", "Ünï çödé 漢字 \U0001f600 text", texts[0], texts[0] + " end", texts[1].upper(), "long " * 20000, "x" * 50000, "\x00 nul ퟿"]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, 5, 6, "fp", "score", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "de", "s0", 1, 1, 1, "a", "b", 1, 2, 3), (None, texts[2], None, None, None, 1, 1, "a", "b", 1, 2, 3), (None, None, None, None, None, None, None, None, None, None, None, None)]
    rows += [rows[5]] * 3
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


# SimHash


def slow_fingerprint(text):
    words = plain(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=4):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= radius:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in prints}


def test_fingerprints(docs):
    for r in simhash.near_duplicates(docs).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        assert r.fingerprint == f"{slow_fingerprint(r.text):016x}"


@pytest.mark.parametrize("chunk", [5, 2048])
def test_components(spark, chunk):
    rng = np.random.default_rng(1)
    centres = [int(x) for x in rng.integers(0, 2**63, 12)]
    prints = [c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(12)] + [0, 2**64 - 1, 0]
    ids = rng.permutation(len(prints)).tolist()
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, _fp long")
    label, least = slow_components(prints), {}
    for i, p in zip(ids, prints, strict=True):
        least[label[p]] = min(i, least.get(label[p], i))
    found = {r._fp: r.component_id for r in simhash.components(df, chunk=chunk).collect()}
    assert found == {s: least[label[p]] for s, p in zip(signed, prints, strict=True)}


def test_bit_slices():
    rng = np.random.default_rng(2)
    members = rng.integers(0, 2**63, 150).astype(np.uint64)
    members[75:] = members[:75] ^ np.uint64(0b10110)
    near = simhash._lane_bits(simhash.lanes_within(simhash.bit_planes(members), 4, members), len(members))
    wanted = [[(int(a) ^ int(b)).bit_count() <= 4 for b in members] for a in members]
    assert near.tolist() == wanted


def test_deduplicate(docs, spark):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    label = slow_components([slow_fingerprint(r.text) for r in rows])
    groups = defaultdict(list)
    for r in rows:
        groups[label[slow_fingerprint(r.text)]].append(r.doc_id)
    wanted = sorted(min((i is None, i or 0) for i in g) for g in groups.values())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == wanted
    assert simhash.deduplicate(docs.limit(0)).count() == 0


# licenses


def test_license_scan(docs):
    rules = signatures()
    for r in license_scan.license_scan(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        words = alnum(r.text)
        assert r.n_words == len(words)
        places = sorted((i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert sorted((p.start, p.label) for p in r.places) == places
        padded, found = f" {' '.join(words)} ", []
        if len(words) < 1000:
            for rule in rules:
                if f" {rule.keyword} " in padded:
                    for m in re.finditer(rule.pattern, padded):
                        start = padded[: m.start()].count(" ") - 1
                        found.append((start, -(start + m[0].count(" ")), rule.priority, rule.label))
            reach, kept = -1, []
            for s in sorted(found):
                if -s[1] > reach:
                    kept.append((s[0], -s[1], s[3]))
                    reach = -s[1]
            assert [(d.start, d.last, d.label) for d in r.detections] == kept


def test_license_query_columns(spark):
    """The query's columns on whole documents."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = queries.QUERIES["op5_license_scan"](spark, DATA).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        words = alnum(texts[r.doc_id])
        places = [(i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and {x for _, x in places} <= set(labels) and 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_license_scan_of_many_hits(spark):
    """A text of 600 KB that is all license names: every place is found, and none of the work grows with the square."""
    n = 30_000
    df = spark.createDataFrame([(1, "the mit license, and " * n)], "doc_id long, text string")
    r = license_scan.license_scan(df).select(F.size("places").alias("places"), F.size("detections").alias("detections"), F.element_at("places", -1)["start"].alias("start")).first()
    assert (r.places, r.detections, r.start) == (n, n, 4 * n - 3)


def test_license_labels(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: MIT")], "doc_id long, text string")
    labels = {d.label for d in license_scan.license_scan(df).first().detections}
    assert "apache-2.0" in labels and any("mit" in x for x in labels)


JOINED = {
    "GPL2": "gpl-2.0", "GPL3": "gpl-3.0", "GPLv1": "gpl-1.0", "GPLv2": "gpl-2.0", "GPLv3": "gpl-3.0", "GPL v3": "gpl-3.0", "LGPL2.1": "lgpl-2.1", "LGPLv2.1": "lgpl-2.1",
    "LGPL3": "lgpl-3.0", "LGPLv3": "lgpl-3.0", "AGPL3": "agpl-3.0", "AGPLv3": "agpl-3.0", "MPL2.0": "mpl-2.0", "MPLv2.0": "mpl-2.0", "EUPL1.2": "eupl-1.2", "EUPLv1.2": "eupl-1.2",
}


def test_license_scan_of_joined_forms(spark):
    """Every regex on every text, without the keywords."""
    names = list(JOINED)
    texts = [f"licensed under {n}" for n in names] + [f"{n} or later" for n in names] + ["open source under the MIT license, LGPL2 and GPL-2.0-only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.license_scan(df).collect():
        padded, found = f" {' '.join(alnum(texts[r.doc_id]))} ", []
        for rule in signatures():
            for m in re.finditer(rule.pattern, padded):
                start = padded[: m.start()].count(" ") - 1
                found.append((start, -(start + m[0].count(" ")), rule.priority, rule.label))
        reach, kept = -1, []
        for s in sorted(found):
            if -s[1] > reach:
                kept.append((s[0], -s[1], s[3]))
                reach = -s[1]
        assert [(d.start, d.last, d.label) for d in r.detections] == kept
        if r.doc_id < 2 * len(names):
            assert [d.label for d in r.detections] == [JOINED[names[r.doc_id % len(names)]]]


SPDX = {
    "EPL-2.0": "epl-2.0", "BSL-1.0": "bsl-1.0", "Artistic-2.0": "artistic-2.0", "AFL-3.0": "afl-3.0", "OSL-3.0": "osl-3.0", "GFDL-1.3-or-later": "gfdl-1.3", "PostgreSQL": "postgresql",
    "Python-2.0": "python-2.0", "Elastic-2.0": "elastic-2.0", "BUSL-1.1": "busl-1.1", "MS-PL": "ms-pl", "SSPL-1.0": "sspl-1.0", "UPL-1.0": "upl-1.0", "0BSD": "bsd-0-clause",
    "BSD-3-Clause": "bsd-3-clause", "GPL-2.0-only": "gpl-2.0", "LGPL-2.1+": "lgpl-2.1", "MIT": "mit", "MIT-0": "mit-0", "ISC": "isc", "Zlib": "zlib", "Apache License 2.0": "apache-2.0",
}
BARE = {
    "Creative Commons Attribution License": "cc-by", "Creative Commons Attribution 2.0 Generic license": "cc-by", "Creative Commons Attribution 4.0 International": "cc-by-4.0",
    "Creative Commons Attribution-ShareAlike 3.0 License": "cc-by-sa", "licensed under the GPL.": "gpl", "GNU LGPL": "lgpl", "Apache Software License": "apache",
    "you may not use this file except in compliance with the License": "apache-2.0", "Use of this source code is governed by a BSD-style license": "bsd",
}


def test_license_identifiers_and_bare_names(spark):
    texts = [(f"// SPDX-License-Identifier: {x}\nimport os", {y}, 1.0) for x, y in SPDX.items()] + [(x, {y}, None) for x, y in BARE.items()]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "doc_id long, text string")
    for r in license_scan.license_scan(df).collect():
        text, wanted, weight = texts[r.doc_id]
        assert {d.label for d in r.detections} == wanted, text
        assert weight is None or [d.weight for d in r.detections] == [weight]


# language model


def slow_lm(texts, train, order, d=0.7, k=100.0):
    stream = [[" begin", *plain(lower(t)), " end"] for t in texts]
    count = [Counter(tuple(s[i : i + n]) for s, use in zip(stream, train, strict=True) if use for i in range(len(s) - n + 1)) for n in range(1, order + 1)]
    words = {w: c for (w,), c in count[0].items() if w != " begin"}
    n, v = sum(words.values()), len(words)

    def p(context, w):
        if not context:
            return (words[w] - d) / n if words.get(w) else d * v / n
        c = count[len(context) - 1][context]
        return (count[len(context)][(*context, w)] + k * p(context[1:], w)) / (c + k)

    return [
        (sum(math.log10((words.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in s[1:]), sum(math.log10(p(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s)))) for s in stream
    ]


@pytest.mark.parametrize(("order", "options"), [(1, {}), (2, {}), (3, {}), (4, {}), (3, {"most_parts": 2}), (2, {"most_parts": 3, "block_bytes": 300}), (3, {"block_bytes": 10**9})])
def test_language_model(docs, order, options):
    """All rows, with null ids, null and long texts and repeated rows; with and without merging levels of requests."""
    rows = docs.select("doc_id", "text").collect()
    train = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 != 0 for r in rows]
    wanted = sorted((str(r.doc_id), *map(float, x)) for r, x in zip(rows, slow_lm([r.text for r in rows], train, order), strict=True))
    found = lm_scoring.lm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, order=order, **{"block_bytes": 2000, **options}).collect()
    for r, w in zip(sorted((str(r.doc_id), r.base_score, r.score) for r in found), wanted, strict=True):
        assert r[0] == w[0] and r[1:] == pytest.approx(w[1:], abs=1e-6)


@pytest.mark.parametrize("run", [1, 2, 3, 512])
def test_automaton_in_runs(run):
    """Cutting texts into runs doesn't change where they lead."""
    rng = np.random.default_rng(run)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(0, 30))) for _ in range(12)]
    words, stream, lengths = lm_scoring.read_block(texts, 48)
    block = lm_scoring.Block(words, stream, lengths, np.arange(12) % 3 > 0, 3, 48)
    n = int((lengths - 1)[np.arange(12) % 3 > 0].sum())
    automaton = lm_scoring.Automaton(block, block.seen, n, 5, lm_scoring.Smoothing())
    assert np.allclose(automaton.traverse(block, run), [x[1] for x in slow_lm(texts, list(np.arange(12) % 3 > 0), 3)])


def test_language_model_without_training(docs):
    out = lm_scoring.lm_scores(docs, F.lit(False)).collect()
    assert len(out) == docs.count() and all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in out)


# sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = hilbert_index(cells, bits)
    assert sorted(at.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_shards(docs):
    rows = shard(docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    curve = [r.curve for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]
    assert curve == sorted(curve)
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    wanted = Counter({(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): 0 for i, t in texts})
    for (i, t), n in texts.items():
        wanted[i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())] += n
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == wanted


def test_write_shards(spark, tmp_path):
    docs = spark.range(100).selectExpr("id as doc_id", "concat('t ', id) as text", "'en' as lang", "'s' as source")
    out = spark.read.parquet(write_shards(docs, str(tmp_path / "out")))
    assert out.count() == 100 and out.select("shard").distinct().count() == 8


# mixing


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > cap * sizes[s]]
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing(docs):
    rows = source_mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 2
    wanted = slow_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
    assert all(abs(taken[s] - wanted[s]) <= largest[s] + 1 for s in sizes)
    assert Counter(source_mixing.mix(docs.repartition(2)).collect()) == Counter(rows)
    assert source_mixing.mixed(docs).columns == docs.columns
    assert source_mixing.mixed(docs).count() == sum(r.copies for r in rows)


def test_mixing_base_rates(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 9 as int)) as text", "if(id % 3 = 0, 'a', 'b') as source", "0.2 + (id % 5) / 5 as q")
    rows = source_mixing.mix(docs, base_rate=F.col("q")).collect()
    for s in "ab":
        some = [r for r in rows if r.source == s]
        assert sum(r.rate * r.size for r in some) == pytest.approx(some[0].target, rel=1e-6)
        assert abs(sum(r.copies * r.size for r in some) - some[0].target) <= 9


# decontamination


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = "x " + " ".join(f"w{i}" for i in range(5, 25)) + " y " + " ".join(f"W{i}," for i in range(13)) + " w0 w1"
    docs = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (None, item, "c"), (3, "one two", "d")], "doc_id long, text string, matches string")
    bench = spark.createDataFrame([(7, item), (8, "One TWO"), (9, None), (None, item), (7, item)], "item_id long, text string")
    found = {r.doc_id: r for r in contamination(benchmark_matches(docs, bench)).collect()}
    assert sorted((m.item_word, m.doc_word, m.n_words) for m in found[1].matches if m.item_id == "7") == [(0, 22, 13), (5, 1, 20)]
    assert found[1].n_hit == 33 and found[1]["items"] == ["7"] and found[2].n_words == 0 and not found[2].contaminated
    assert found[3]["items"] == ["8"] and found[3].contaminated
    assert [r.doc_id for r in decontaminate(docs, bench).collect()] == [2]
    assert decontaminate(docs, bench, block_bytes=40).count() == 1
    assert decontaminate(docs, bench.limit(0)).count() == 4 and decontaminate(docs.limit(0), bench).count() == 0


# HTML


def test_minimum_cut():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        odds = rng.normal(0, 1.5, n).tolist()
        edges = {(i, j): float(rng.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda x: sum(abs(o) for o, k in zip(odds, x, strict=True) if (o > 0) != k) + sum(w for (i, j), w in edges.items() if x[i] != x[j])  # noqa: B023, E731
        assert cost(html_extraction.minimum_cut(odds, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_extraction_of_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = html_extraction.extract(pages).collect()
    assert len(found) == pages.count()
    same = 0
    for r in found:
        kept = html_extraction.blocks(re.search(r"<article.*</article>", r.html, re.S)[0])
        same += r._text == " ".join(b.text for b in kept)
    assert same >= 0.95 * len(found)


@pytest.mark.parametrize("html", [None, "", "<script>x</script>", "<p", "a < b & c", "<b>" * 2000 + "x", "<div>" * 3000, "<p>word</p>" * 3000])
def test_extraction_of_awkward_pages(html):
    text = html_extraction.main_text(html)
    assert isinstance(text, str) and (html or text == "")


_ARTICLE = "<article>" + "".join(f"<p>Sentence number {i} of the article tells of rivers and stones.</p>" for i in range(6)) + "</article>"
_TOLD = " ".join(f"Sentence number {i} of the article tells of rivers and stones." for i in range(6))


@pytest.mark.parametrize("before", [
    "<html><head><title>x</title></head><body>", "<html><head><title>x</title><body>", "<html><head><title>x</title><meta charset='utf-8'><script>y</script>",
    "<head><noscript><style>y</style><body>", "<head><head><title>x</title></head>", "<head><link rel='y'><noscript><div>z</div></noscript><body>", "<head><title>x</title><body><head>",
])
def test_extraction_without_end_of_head(before):
    assert html_extraction.main_text(before + _ARTICLE) == _TOLD


@pytest.mark.parametrize("html", ["<head><title>x</title>Some words", "<head><title>x</title><b>Some</b> words", "<head><title>x</title><img src='y'>Some words", "<head>\n<style>y</style>\n<p>Some words"])
def test_text_ends_the_head(html):
    assert [b.text for b in html_extraction.blocks(html)] == ["Some words"]


# toxicity


def _labelled(n=500, seed=1):
    rng = np.random.default_rng(seed)
    syllables = "ba ke lo mi nu ra se ti vo wa".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 4)))
    insults = ["grobulous", "snarfface", "wretchling", "dimbulb"]
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.integers(10, 40))]
        toxic = i % 4 == 0
        if toxic:
            w.insert(int(rng.integers(0, len(w))), insults[i // 4 % 4])
        out.append((int(toxic), " ".join(w)))
    return out


def test_toxicity_learns_and_tolerates_gaps():
    model = toxicity.fit(_labelled())
    score = lambda *t: model.score(toxicity.Scorer(model)(list(t))[0].astype(float))
    held = _labelled(200, 2)
    found = score(*[t for _, t in held]) >= 0.3
    label = np.array([x for x, _ in held]) == 1
    assert (found & label).sum() >= 0.9 * label.sum() and (found & ~label).sum() <= 0.05 * (~label).sum()
    assert (score("bake lomi you snarxfface nura", "ba ke g-r-o-b-u-l-o-u-s", "w r e t c h l i n g") >= 0.3).all()
    assert (score(None, "", "  ", "bake lomi nura", "漢字") < 0.3).all()


@pytest.mark.parametrize("n", [300, 1800])
def test_toxicity_learns_from_all_rows(monkeypatch, n):
    """At every size the logistic fit sees each row once, unknown to its SVM, and the final SVM learns from all rows."""
    learnt, svm = [], toxicity._fit_svm

    def fit_svm(train, vocabulary, **options):
        learnt.append({x.row for x in train})
        return svm(train, vocabulary, **options)

    monkeypatch.setattr(toxicity, "_fit_svm", fit_svm)
    toxicity.fit([(label, f"{text} r{i}") for i, (label, text) in enumerate(_labelled(n))])
    everyone = set(range(n))
    assert len(learnt) == 3 and learnt[-1] == everyone
    apart = [everyone - x for x in learnt[:-1]]
    assert sorted(i for x in apart for i in x) == sorted(everyone)


def slow_word_map(word, order, span, decay):
    """Weights of a word's marked subsequences of `order` characters, by enumeration, over the word's norm."""
    marked = "^" + word + "$"
    found, square = Counter(), 0.0
    for at in itertools.combinations(range(len(marked)), order):
        length = at[-1] - at[0]
        if length < span:
            found["".join(marked[i] for i in at)] += decay**length
            square += decay ** (2 * length)
    return {k: v / (square**0.5 or 1.0) for k, v in found.items()}


def test_toxicity_kernel_and_collapsed_weights():
    """The kernel counts gapped subsequences; a model's score is the sum over its landmarks of kernel values."""
    kernel = toxicity.Kernel(order=3, span=5, decay=0.6)
    some = [b"grobulous", b"grxobulous", b"aaaaaa", b"ab", b"a", b"lomi"]
    numbers = kernel.numbers(some)
    rows = kernel.matrix(some, numbers)
    maps = [slow_word_map(w.decode(), 3, 5, 0.6) for w in some]
    dot = lambda a, b: sum(v * b.get(k, 0.0) for k, v in a.items())
    assert np.allclose(rows @ rows.T, [[dot(a, b) for b in maps] for a in maps], atol=1e-5)
    own = kernel.numbers(some[:2])
    alpha = np.array([1.5, -0.7])
    model = toxicity.Model(kernel, own, (alpha @ kernel.matrix(some[:2], own)).astype(np.float32), 0.25)
    explicit = [0.25 + sum(a * dot(maps[i], m) for i, a in enumerate(alpha)) for m in maps]
    assert np.allclose(model.scorer()(some), explicit, atol=1e-4)


def test_toxicity_picks_one_sentence_of_a_bag():
    """An insult that is rare by itself is learnt from its bag, as it is like those seen often."""
    rows = [(label, f"{text}. ba ke lo. mi nu") for label, text in _labelled(400)]
    rows += [(1, "ba ke. snarfbace ra. mi nu")]
    model = toxicity.fit(rows)
    margins = model.scorer()([b"snarfbace", b"bake", b"lomi"])
    assert margins[0] > 0 > margins[1:].max()


def test_toxicity_held_out_by_language(spark):
    """Precision and recall on labelled documents that the fit hasn't seen, by language."""
    from folioflow.llm.common import remainder

    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    held = remainder(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs.where(~held), labels)
    rows = toxicity.score(docs.where(held).join(labels.where("toxic is not null"), "doc_id").select("lang", "toxic", "text"), model).collect()
    for lang, precision, recall in (("en", 0.95, 0.85), ("de", 0.7, 0.85), ("fr", 0.75, 0.9), ("es", 0.6, 0.3)):
        y, said = (np.array(x) for x in zip(*[(r.toxic == 1, r._score >= 0.3) for r in rows if r.lang == lang], strict=True))
        assert (y & said).sum() >= recall * y.sum() and (y & said).sum() >= precision * said.sum()


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0)], [(1, None)], [(99999, 1)]])
def test_toxicity_with_few_labels(docs, spark, labels):
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score(docs.select("doc_id", "text"), model).collect()
    assert len(out) == docs.count() and all(0 <= r._score < 0.3 for r in out)


# awkward rows and empty tables


def test_quality_rules_on_awkward_rows(docs):
    for r in quality_rules(docs).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        words = plain(r.text)
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        seen = defaultdict(list)
        for i in range(len(words) - 2):
            seen[tuple(words[i : i + 3])].append(i)
        assert r.n_repeat_words == len({i + k for x in seen.values() if len(x) > 1 for i in x for k in range(3)})


def test_captures(spark):
    body = "<p>" + "x" * 200
    pages = spark.createDataFrame([(5, "http://a/b", body, 1), (2, None, body, 1), (9, "http://a\r\nX: y", None, 1), (7, "http://a", "short", 1), (8, "http://a", "short", 1), (2, None, body, 1), (None, None, body, 1)], "page_id long, url string, html string, digest int")
    found = captures(pages.selectExpr("*", "1 as type", "2 as payload", "3 as row", "4 as copy", "5 as revisit")).collect()
    assert sorted((r.page_id or "", r.response.type, r.original_page_id) for r in found) == [
        ("", "revisit", "2"), ("2", "response", None), ("2", "revisit", "2"), ("5", "revisit", "2"), ("7", "response", None), ("8", "response", None), ("9", "response", None)
    ]
    assert all(r.request and r.metadata for r in found) and len({r.response.record_id for r in found}) == 7
    assert {bytes(r.response.payload).decode() for r in found if r.response.type == "response"} == {body, "", "short"}
    assert captures(pages.limit(0)).count() == 0


def test_archives_are_cut_by_bytes(spark, tmp_path):
    """Large payloads go to files of their own; all come back whole."""
    pages = spark.range(40).selectExpr("id as page_id", "'http://a/' || id as url", "repeat('r\r\n\r\n' || id, case when id = 3 then 5000000 when id % 10 = 0 then 60000 else 3 end) as html").repartition(2)
    path = warc.write_archives(pages, str(tmp_path / "warc"), file_bytes=1 << 20)
    found = warc.assemble(warc.read_archives(spark, path)).select("page_id", "response.payload_bytes", "response.payload_digest").collect()
    wanted = {str(r.page_id): (r.n, r.h) for r in pages.selectExpr("page_id", "octet_length(html) as n", "sha2(html, 256) as h").collect()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in found} == wanted and len(found) == 40
    per_file = warc.read_archives(spark, path).groupBy("archive").agg(F.count("*").alias("n"), F.sum("block_bytes").alias("size")).collect()
    assert all(r.size < 2 << 20 or r.n <= 3 for r in per_file)


def test_walk_of_gzip_members():
    """Members of any size, cut anywhere, and a record that ends too soon."""
    record = lambda i, body: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    bodies = ["", "x", "\r\n\r\n", "y" * 3000]
    plain_file = b"".join(record(i, x) for i, x in enumerate(bodies))
    members = b"".join(gzip.compress(record(i, x)) for i, x in enumerate(bodies))
    for content in (plain_file, gzip.compress(plain_file), members):
        for step in (1, 7, 1 << 20):
            assert [r["block"].decode() for r in warc._walk(warc._Stream(content, step))] == bodies
    with pytest.raises(ValueError, match="cut short"):
        list(warc._walk(warc._Stream(plain_file[:-100])))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc._walk(warc._Stream(b"nothing of the kind")))


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    for out in (
        quality_rules(none), simhash.near_duplicates(none), lm_scoring.lm_scores(none, F.lit(True)), license_scan.license_scan(none), shard(none), source_mixing.mix(none),
        toxicity.score(none.select("doc_id", "text"), toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))), html_extraction.extract(none.selectExpr("text as html")),
    ):
        assert out.count() == 0


def test_all_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
