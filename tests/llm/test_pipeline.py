"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import zlib

import numpy as np
import pytest

import corpus_pipeline
from conftest import DATA
from folioflow.llm import toxicity
from folioflow.llm.common import stored
from test_brute_force import alnum, awkward, slow_components, slow_fingerprint, slow_targets


def slow_contaminated(texts, items, window=13, percent=5):
    """Whether each text is contaminated, by looking up all windows of all items."""
    windows = {}
    for item in items:
        words = alnum(item)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if words else 0):
            windows.setdefault(k, set()).add(tuple(words[i : i + k]))
    out = []
    for text in texts:
        words, hit = alnum(text), set()
        for k, known in windows.items():
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in known:
                    hit |= set(range(i, i + k))
        out.append(bool(hit) and 100 * len(hit) >= percent * len(words))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, DATA), f"test-{name}")
        after = docs.collect()
        if name != "hilbert_sharding":
            assert docs.columns == columns
        ids = Counter(r.doc_id for r in after)
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            known = sorted((r for r in before if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and labels.get(r.doc_id) is not None), key=lambda r: (r.doc_id, r.text or ""))
            n = Counter(labels[r.doc_id] for r in known)
            model = toxicity.fit([(int(labels[r.doc_id] > 0), r.text) for r in known], toxic_weight=1.0) if n[0] and n[1] else toxicity.Model(toxicity.Kernel())
            score = model.score(toxicity.Scorer(model)([r.text for r in before])[0].astype(np.float64))
            assert sorted(ids.elements()) == sorted(r.doc_id for r, x in zip(before, score, strict=True) if x < corpus_pipeline.TOXIC_FROM)
        elif name == "simhash_near_dedup":
            prints = {r.doc_id: slow_fingerprint(r.text) for r in before}
            label = slow_components(list(prints.values()))
            least = {}
            for i in sorted(prints, reverse=True):
                least[label[prints[i]]] = i
            assert sorted(ids.elements()) == sorted(least.values())
        elif name == "benchmark_decontamination":
            items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert sorted(ids.elements()) == sorted(r.doc_id for r, x in zip(before, slow_contaminated([r.text for r in before], items), strict=True) if not x)
        elif name == "source_mixing":
            sizes, taken, largest = Counter(), Counter(), Counter()
            for r in before:
                n = len((r.text or "").split())
                sizes[r.source] += n
                largest[r.source] = max(largest[r.source], n)
            for r in after:
                taken[r.source] += len((r.text or "").split())
            wanted = slow_targets(sizes)
            assert max(ids.values()) <= 2 and all(abs(taken[s] - wanted[s]) <= largest[s] + 1 for s in sizes)
        else:
            per = Counter(r.shard for r in after)
            assert sum(per.values()) == len(before) and max(per.values()) - min(per.values()) <= 1


def test_run(spark):
    assert {"doc_id", "shard", "slot"} <= set(corpus_pipeline.run(spark, DATA).columns)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage_on_awkward_rows(spark, stage):
    """Null ids and texts, long and empty texts, repeated rows, columns whose names clash; and no rows."""
    name, run = stage
    docs = awkward(spark)
    rows, out = docs.collect(), run(spark, docs, DATA)
    after = out.collect()
    assert run(spark, docs.limit(0), DATA).count() == 0
    if name == "hilbert_sharding":
        assert len(after) == len(rows) and sorted(r.slot for r in after if r.shard == 0) == list(range(sum(r.shard == 0 for r in after)))
        return
    assert out.columns == docs.columns and {tuple(r) for r in after} <= {tuple(r) for r in rows}
    if name == "benchmark_decontamination":
        items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
        assert len(after) == slow_contaminated([r.text for r in rows], items).count(False)
    if name == "simhash_near_dedup":
        prints = [slow_fingerprint(r.text) for r in rows]
        assert len(after) == len(set(slow_components(sorted(set(prints))).values()))
