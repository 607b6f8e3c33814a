"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel compares words by the character subsequences they share: every subsequence of `order`
characters that lies within `span` characters counts with decay**length, so gaps and inserted
characters cost something but don't hide a word. Words are first folded (A-Z lowered, digits read
as the letters they resemble, punctuation inside words dropped, runs of single letters joined).

Labels belong to documents, so training is on bags of sentences (a latent, multiple-instance SVM). All
sentences of clean documents are clean. Of a toxic document one sentence is taken as toxic, at first
one with a word typical of toxic documents, then in each round the one that the last model scores
highest; in it, the highest word stands for the sentence. A sentence scores as its highest word, a
document as its highest sentence. The SVM (squared hinge) is solved by Newton steps on Nystroem features
of landmark words; hard words of clean sentences join the negatives and the landmarks in each round.
Because the decision is linear in the kernel and the kernel is a sum over subsequences, the trained
model collapses into one weight for each subsequence of the landmarks; scoring a word sums the weights
of its own. A logistic fit on documents kept apart gives the score.

Training takes a bounded sample of labelled documents (at most about `most_toxic` and `most_clean`
documents and `most_bytes` of text, texts over `longest_text` bytes left out), drawn by a hash of id
and text, equal rows once; scoring takes every word of every text. Defined results: null, blank or
letterless texts get the score of a document without evidence; without labels of both kinds all scores
are the prior 0. Repeated rows score alike, other columns of the inputs are ignored. A toxic phrase of
words that clean documents use as well isn't found: the latent unit is a word.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import by_place, small_batches, text_chunks

#: Digits and the letters they resemble.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _fold_tables() -> tuple[bytes, bytes, np.ndarray]:
    """Byte map, bytes to delete, and codes: letters 1-26, folded UTF-8 continuation bytes 27-58."""
    table, delete, code = bytearray(range(256)), bytearray(), np.zeros(256, dtype=np.int32)
    for b in range(256):
        c = chr(b)
        if b < 0x80 and c.isalpha():
            table[b] = ord(c.lower())
        elif c in LOOKALIKES:
            table[b] = ord(LOOKALIKES[c])
        elif b == 0x20 or 0x09 <= b <= 0x0D:
            table[b] = 0x20
        elif 0x80 <= b < 0xC0:
            table[b] = 0x80 | (b & 0x1F)
        else:
            delete.append(b)
    for i, c in enumerate(_LETTERS):
        code[ord(c)] = i + 1
    code[0x80:0xA0] = np.arange(27, 59)
    code[ord("^")], code[ord("$")] = 59, 60
    return bytes(table), bytes(delete), code


_TABLE, _DELETE, _CODE = _fold_tables()
_SYMBOLS = 61
_SPACED = re.compile(rb"(?<![^ ])[^ ](?: [^ ](?= )){2,}")
_SPACED_AT_ALL = re.compile(rb" [^ ] [^ ] [^ ] ")
_SENTENCE = re.compile(r"[.!?\n]+")
_LONGEST = 32
#: Margin of a text without words.
NO_WORDS = -2.0


def words(text: str | None) -> list[bytes]:
    """Folded words of a whole text; a word over 32 bytes is cut into overlapping pieces."""
    folded = (text or "").encode("utf-8", "replace").translate(_TABLE, _DELETE)
    if _SPACED_AT_ALL.search(b" " + folded + b" "):
        folded = _SPACED.sub(lambda m: m[0].replace(b" ", b""), b" ".join(folded.split()) + b" ")
    out = folded.split()
    if any(len(w) > _LONGEST for w in out):
        half = _LONGEST // 2
        out = [p for w in out for p in ([w] if len(w) <= _LONGEST else [w[i : i + _LONGEST] for i in range(0, len(w) - half, half)])]
    return out


@dataclass
class Kernel:
    order: int = 4
    span: int = 7
    decay: float = 0.7

    def __post_init__(self) -> None:
        self.offsets = [(0, *c) for c in combinations(range(1, self.span), self.order - 1)]
        self.factors = [self.decay ** c[-1] for c in self.offsets]

    def norm(self, length: int) -> float:
        """Of a word of this many codes, as if no subsequence occurred twice: a function of the length
        alone, so scaling by it keeps the kernel positive definite."""
        return math.sqrt(sum(max(0, length - c[-1]) * f * f for c, f in zip(self.offsets, self.factors, strict=True))) or 1.0

    def by_length(self, some: list[bytes], most: int = 10_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, codes) of the words of each length, at most so many at once, with marks at both ends."""
        groups: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(some):
            groups[len(w)].append(i)
        for n, whole in groups.items():
            for k in range(0, len(whole), most):
                at = whole[k : k + most]
                raw = np.frombuffer(b"".join(b"^" + some[i] + b"$" for i in at), dtype=np.uint8).reshape(len(at), n + 2)
                yield np.array(at), _CODE[raw]

    def subsequences(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Numbers of the subsequences with each pattern of gaps, [words, places], and their weight."""
        n = codes.shape[1]
        for c, f in zip(self.offsets, self.factors, strict=True):
            m = n - c[-1]
            if m <= 0:
                continue
            number = codes[:, :m].astype(np.int32)
            for o in c[1:]:
                number = number * _SYMBOLS + codes[:, o : o + m]
            yield number, f

    def numbers(self, some: list[bytes]) -> np.ndarray:
        """The distinct subsequences of some words, sorted."""
        found = [np.unique(number) for _, codes in self.by_length(some) for number, _ in self.subsequences(codes)]
        return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int32)

    def matrix(self, some: list[bytes], numbers: np.ndarray) -> np.ndarray:
        """[words, numbers]: the normalised weight of each subsequence in each word."""
        out = np.zeros(len(some) * len(numbers), dtype=np.float32)
        for at, codes in self.by_length(some):
            norm = self.norm(codes.shape[1])
            for number, f in self.subsequences(codes):
                slot = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
                who, where = np.nonzero(numbers[slot] == number)
                np.add.at(out, at[who] * len(numbers) + slot[who, where], f / norm)
        return out.reshape(len(some), len(numbers))


    def times(self, some: list[bytes], numbers: np.ndarray, right: np.ndarray) -> np.ndarray:
        """matrix(some, numbers) @ right, from the few subsequences that each word has."""
        out = np.zeros((len(some), right.shape[1]), dtype=np.float32)
        for at, codes in self.by_length(some):
            norm, who, slots, factors = self.norm(codes.shape[1]), [], [], []
            for number, f in self.subsequences(codes):
                slot = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
                row, place = np.nonzero(numbers[slot] == number)
                who.append(row)
                slots.append(slot[row, place])
                factors.append(np.full(len(row), f / norm, dtype=np.float32))
            row = np.concatenate(who) if who else np.empty(0, dtype=np.int64)
            if len(row):
                order = np.argsort(row, kind="stable")
                row = row[order]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                values = right[np.concatenate(slots)[order]] * np.concatenate(factors)[order][:, None]
                out[at[row[first]]] = np.add.reduceat(values, first, axis=0)
        return out


@dataclass
class Model:
    """A collapsed model: a weight for each subsequence, an offset, and the logistic of a document's margin."""

    kernel: Kernel
    numbers: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.float32))
    offset: float = -1.0
    slope: float = 0.0
    level: float = -50.0
    landmarks: tuple[bytes, ...] = ()

    def scorer(self):
        """Margins of words. A bit for each possible subsequence (1.7 MB at order 4) tells which have a weight;
        only those are looked up."""
        bits = np.zeros((_SYMBOLS**self.kernel.order >> 3) + 1, dtype=np.uint8)
        np.bitwise_or.at(bits, self.numbers >> 3, np.uint8(1) << (self.numbers & 7).astype(np.uint8))

        def margins(some: list[bytes]) -> np.ndarray:
            out = np.empty(len(some), dtype=np.float32)
            for at, codes in self.kernel.by_length(some):
                total = np.zeros(len(at))
                for number, f in self.kernel.subsequences(codes):
                    who, where = np.nonzero((bits[number >> 3] >> (number & 7).astype(np.uint8)) & 1)
                    if len(who):
                        known = np.searchsorted(self.numbers, number[who, where])
                        total += f * np.bincount(who, weights=self.weights[known], minlength=len(at))
                out[at] = total / self.kernel.norm(codes.shape[1]) + self.offset
            return out

        return margins

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.level, -50, 50)))


def _pieces(some: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the contiguous pieces of k characters (the ends count) of each word, and where each
    word's begin. Below 11 characters no two pieces share a number."""
    counts = np.array([max(0, len(w) + 2 - k + 1) for w in some], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(begin[-1], dtype=np.int64)
    for at, codes in Kernel().by_length(some):
        n = codes.shape[1] - k + 1
        if n > 0:
            number = np.zeros((len(at), n), dtype=np.int64)
            for o in range(k):
                number = number * _SYMBOLS + codes[:, o : o + n]
            out[begin[at][:, None] + np.arange(n)] = number
    return out, begin


def _documents_with(docs: list[np.ndarray], pieces: np.ndarray, begin: np.ndarray, n: int, block: int = 100) -> np.ndarray:
    """In how many documents (arrays of word numbers) each of n pieces occurs."""
    out = np.zeros(n, dtype=np.int64)
    for i in range(0, len(docs), block):
        part = docs[i : i + block]
        word, doc = np.concatenate(part), np.repeat(np.arange(len(part)), [len(d) for d in part])
        size = begin[word + 1] - begin[word]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        pairs = np.unique(np.repeat(doc, size) * n + pieces[np.repeat(begin[word], size) + inside])
        out += np.bincount(pairs % n, minlength=n)
    return out


def typical_words(
    vocabulary: list[bytes], toxic: list[np.ndarray], clean: list[np.ndarray], shortest: int = 3, longest: int = 10, most_chance: float = 0.02
) -> dict[int, float]:
    """Words of toxic documents with a piece of 3 to 10 characters (the ends count) that clean documents
    lack, as far as chance can't explain: the piece occurs in a toxic and c clean documents, and the odds
    of so uneven a split, times the number of pieces tried, are below most_chance. Documents are arrays of
    distinct numbers of words; gives the log of those odds by number."""
    none = np.empty(0, dtype=np.int64)
    in_clean = np.bincount(np.concatenate([none, *clean]), minlength=len(vocabulary))
    candidates = np.unique(np.concatenate([none, *toxic]))
    candidates = candidates[in_clean[candidates] <= max(1, len(clean) // 500)]
    others = np.unique(np.concatenate([none, *clean]))
    if not len(candidates):
        return {}
    place = np.full(len(vocabulary), -1, dtype=np.int64)
    place[candidates] = np.arange(len(candidates))
    own = [x[x >= 0] for x in (place[d] for d in toxic)]
    place[:] = -1
    place[others] = np.arange(len(others))
    theirs = [place[d] for d in clean]
    some, other_words = [vocabulary[i] for i in candidates], [vocabulary[i] for i in others]
    share, tried = len(toxic) / (len(toxic) + len(clean)), 0
    best = np.zeros(len(some))
    for k in range(shortest, longest + 1):
        numbers, begin = _pieces(some, k)
        known, piece = np.unique(numbers, return_inverse=True)
        if not len(known):
            continue
        a = _documents_with(own, piece, begin, len(known))
        enough = a >= max(3, len(toxic) // 400)
        tried += int(enough.sum())
        slots, hits = [], []
        for i in range(0, len(other_words), 50_000):
            numbers, their_begin = _pieces(other_words[i : i + 50_000], k)
            slot = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
            hit = (known[slot] == numbers) & enough[slot]
            slots.append(slot[hit])
            hits.append(np.diff(np.concatenate([[0], np.cumsum(hit)])[their_begin]))
        c = _documents_with(theirs, np.concatenate([none, *slots]), np.concatenate([[0], np.cumsum(np.concatenate([none, *hits]))]), len(known))
        rate = a / np.maximum(a + c, 1)
        odds = a * np.log(np.maximum(rate, 1e-9) / share) + c * np.log(np.maximum(1 - rate, 1e-9) / (1 - share)) * (c > 0)
        odds[~enough | (rate <= share) | (c > 0.1 * a)] = 0
        np.maximum.at(best, np.repeat(np.arange(len(some)), np.diff(begin)), odds[piece])
    best[best <= math.log(max(1, tried) / most_chance)] = 0
    return {int(candidates[i]): float(best[i]) for i in np.flatnonzero(best)}


def _newton(x: np.ndarray, y: np.ndarray, s: np.ndarray, c: float, steps: int = 40) -> np.ndarray:
    """Squared-hinge SVM with instance weights s; the last column of x is the offset's."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    before = None
    for _ in range(steps):
        active = y * (x @ w) < 1
        if before is not None and (active == before).all():
            break
        before = active
        hessian, slope = ridge.copy(), np.zeros(x.shape[1])
        for i in range(0, len(x), 2000):  # in blocks, as the driver's memory is small
            part = np.flatnonzero(active[i : i + 2000]) + i
            xa, ra = x[part].astype(np.float64), 2 * c * s[part]
            hessian += xa.T @ (xa * ra[:, None])
            slope += xa.T @ (ra * y[part])
        w = np.linalg.solve(hessian, slope)
    return w


def _platt(margin: np.ndarray, label: np.ndarray, toxic_weight: float = 1.0, steps: int = 100) -> tuple[float, float]:
    """Logistic of the margin with Platt's smoothed targets, by damped Newton steps."""
    r = np.where(label > 0, toxic_weight, 1.0)
    pos, neg = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    loss = lambda v: r @ (np.logaddexp(0, x @ v) - target * (x @ v)) + 1e-3 * v[0] ** 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (r * (p - target)) + np.array([2e-3 * w[0], 0])
        h = x.T @ (x * (r * p * (1 - p))[:, None]) + np.eye(2) * 2e-3
        step, rate = np.linalg.solve(h, g), 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


class Bag(NamedTuple):
    """A labelled document: its place among the rows, its sentences as arrays of distinct word numbers, all of
    its distinct words, and whether it is the first of its copies."""

    row: int
    label: int
    sentences: list[np.ndarray]
    all: np.ndarray
    first: bool


def bags(rows: list[tuple[int, str | None]], window: int = 5, kept: int = 4) -> tuple[list[Bag], list[bytes]]:
    """The rows as bags, and the vocabulary. Of rows of a label that share one of their smallest window hashes
    only the first is `first`: copies would make all of their words look typical."""
    numbering: dict[bytes, int] = {}
    seen: set[tuple[int, int]] = set()
    out = []
    for row, (label, text) in enumerate(rows):
        found = [[numbering.setdefault(w, len(numbering)) for w in words(x)] for x in _SENTENCE.split(text or "")]
        whole = [i for x in found for i in x]
        hashes = {hash(tuple(whole[i : i + window])) for i in range(max(1, len(whole) - window + 1))}
        sketch = {(label, h) for h in sorted(hashes)[:kept]}
        out.append(
            Bag(row, label, [np.array(sorted(set(x)), dtype=np.int32) for x in found if x], np.array(sorted(set(whole)), dtype=np.int32), sketch.isdisjoint(seen))
        )
        seen |= sketch
    return out, list(numbering)


def fit(rows: list[tuple[int, str | None]], *, folds: int = 2, toxic_weight: float = 1.0, seed: int = 7, **options) -> Model:
    """Train on (label, text) rows. The logistic fit uses the margins of all folds in turn, each under an
    SVM that hasn't seen it; the final SVM learns from all rows."""
    order = np.random.default_rng(seed).permutation(len(rows))
    train, vocabulary = bags([rows[i] for i in order])
    margins, labels = [], []
    for k in range(folds):
        apart = train[k::folds]
        model = _fit_svm([x for i, x in enumerate(train) if i % folds != k], vocabulary, seed=seed, **options)
        used = np.unique(np.concatenate([np.empty(0, dtype=np.int32), *[x.all for x in apart]]))
        of = np.full(len(vocabulary), -np.inf, dtype=np.float32)
        of[used] = model.scorer()([vocabulary[i] for i in used])
        margins += [of[x.all].max() if len(x.all) else NO_WORDS for x in apart]
        labels += [x.label for x in apart]
    y = np.array(labels, dtype=float)
    if not 0 < y.sum() < len(y):
        return Model(Kernel())
    model = _fit_svm(train, vocabulary, seed=seed, **options)
    model.slope, model.level = _platt(np.array(margins, dtype=float), y, toxic_weight)
    return model


def _landmarks(kernel: Kernel, some: list[bytes], most: int) -> list[bytes]:
    """The first `most` of some words, each unlike those chosen before as far as that goes."""
    if not some:
        return []
    own = kernel.matrix(some, kernel.numbers(some))
    alike = own @ own.T
    chosen: list[int] = []
    for limit in (0.3, 0.5, 0.7, 0.9):
        for i in range(len(some)):
            if len(chosen) < most and i not in chosen and (not chosen or alike[i, chosen].max() < limit):
                chosen.append(i)
    return [some[i] for i in chosen]


def _fit_svm(
    train: list[Bag], vocabulary: list[bytes], *, kernel: Kernel | None = None, n_landmarks: int = 256, c: float = 1.0, rounds: int = 4,
    negatives: int = 4000, variants: int = 2, most_positive: int = 4000, most_candidates: int = 300, plausible: float = -0.9, seed: int = 7,
) -> Model:
    """A latent SVM over the sentences of labelled documents. It learns from the `most_positive` positive
    words seen most often; landmark insults are chosen among the first `most_candidates` of them, by
    count and shortness; each round adds up to `negatives` hard words of clean sentences. A toxic document
    whose top sentence scores below `plausible` teaches nothing in that round."""
    kernel = kernel or Kernel()
    rng = np.random.default_rng(seed)
    clean_sentences = [x for bag in train if bag.label == 0 for x in bag.sentences]
    toxic_bags = [bag.sentences for bag in train if bag.label == 1 and bag.sentences]
    toxic, clean = ([bag.all for bag in train if bag.label == want] for want in (1, 0))
    if not toxic_bags or not clean_sentences:
        return Model(kernel)
    typical = typical_words(vocabulary, *[[bag.all for bag in train if bag.first and bag.label == want] for want in (1, 0)])
    if not typical:
        return Model(kernel)
    known = set(vocabulary)
    seen = np.bincount(np.concatenate(toxic), minlength=len(vocabulary))
    in_clean = np.bincount(np.concatenate(clean), minlength=len(vocabulary))
    may_be_toxic = in_clean <= max(1, len(clean) // 500)
    own = np.flatnonzero(seen + in_clean)  # the vocabulary may have words of other documents as well
    everyone = np.array([i for i in np.flatnonzero(in_clean) if i not in typical], dtype=np.int64)
    everyone = everyone[np.argsort([vocabulary[i] for i in everyone], kind="stable")]
    letters = np.frombuffer(b"".join(vocabulary[i] for i in everyone), dtype=np.uint8)
    pool = list(everyone[rng.permutation(len(everyone))[:negatives]])
    hard = pool[: n_landmarks // 4]
    latent = set(typical)
    model = Model(kernel)
    for turn in range(rounds):
        chosen = sorted(latent, key=lambda i: (-seen[i], vocabulary[i]))[:most_positive]
        positive = [vocabulary[i] for i in chosen]
        first = sorted(chosen, key=lambda i: (-seen[i] / (len(vocabulary[i]) + 2), vocabulary[i]))[:most_candidates]
        insults = _landmarks(kernel, [vocabulary[i] for i in first], n_landmarks * 3 // 4)
        landmarks = list(dict.fromkeys([*insults, *[vocabulary[i] for i in hard[: n_landmarks - len(insults)]]]))
        numbers = kernel.numbers(landmarks)
        table = kernel.matrix(landmarks, numbers).T
        values, vectors = np.linalg.eigh((table.T @ table).astype(np.float64))
        project = table @ (vectors / np.sqrt(np.maximum(values, 1e-4))).astype(np.float32)  # Nystroem map of kernel rows; tiny directions are damped
        del table

        def mapped(some: list[bytes], numbers: np.ndarray = numbers, project: np.ndarray = project, block: int = 100) -> np.ndarray:
            out = np.ones((len(some), project.shape[1] + 1), dtype=np.float32)
            order = sorted(range(len(some)), key=lambda i: len(some[i]))  # words of a length are handled together
            for i in range(0, len(order), block):
                at = order[i : i + block]
                out[at, :-1] = kernel.times([some[j] for j in at], numbers, project)
            return out

        # virtual examples: a letter inserted inside a landmark insult leaves it an insult
        virtual = {w[:at] + bytes([int(rng.choice(letters))]) + w[at:] for w in insults if len(w) > 3 for at in range(1, len(w)) for _ in range(variants)}
        virtual = sorted(virtual - known)
        s_pos = np.concatenate([np.minimum(seen[chosen], 50) / 5.0, np.full(len(virtual), 0.5)])
        x = mapped([*positive, *virtual, *[vocabulary[i] for i in pool]])
        y = np.concatenate([np.ones(len(s_pos)), -np.ones(len(pool))])
        s = np.concatenate([s_pos, np.full(len(pool), max(1.0, s_pos.sum() / len(pool)))])
        w = _newton(x, y, s, c)
        model = Model(kernel, numbers, (project @ w[:-1]).astype(np.float32), float(w[-1]), landmarks=tuple(landmarks))
        if turn == rounds - 1:
            break
        margins = np.full(len(vocabulary), -np.inf, dtype=np.float32)
        margins[own] = model.scorer()([vocabulary[i] for i in own])
        usable = np.where(in_clean > 0, margins, -np.inf)
        usable[list(latent)] = -np.inf
        hardest = {int(x[usable[x].argmax()]) for x in clean_sentences}
        hard = sorted((i for i in hardest if usable[i] > -np.inf), key=lambda i: (-margins[i], vocabulary[i]))[:negatives]
        pool = list(dict.fromkeys([*pool, *hard]))
        candidate = np.where(may_be_toxic, margins, -np.inf)
        witnesses = set()
        for bag in toxic_bags:
            tops = [int(x[candidate[x].argmax()]) for x in bag]
            best = max(tops, key=lambda i: (candidate[i], vocabulary[i]))
            if candidate[best] >= plausible:
                witnesses.add(best)
        latent = witnesses | {i for i in typical if margins[i] > 0} or latent
        pool = [i for i in pool if i not in latent]
    return model


class Scorer:
    """Margins of texts: that of the highest word; a bounded cache holds the words seen before."""

    def __init__(self, model: Model, most_cached: int = 200_000):
        self.margins, self.most_cached, self.cache = model.scorer(), most_cached, {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        tokens = [words(t) for t in texts]
        new = list(set().union(*tokens) - self.cache.keys()) if tokens else []
        if len(self.cache) + len(new) > self.most_cached:
            self.cache.clear()
            new = list(set().union(*tokens))
        self.cache.update(zip(new, self.margins(new).tolist(), strict=True))
        get = self.cache.__getitem__
        worst = [max(t, key=get) if t else None for t in tokens]
        return np.array([get(w) if w is not None else NO_WORDS for w in worst], dtype=np.float32), [None if w is None else w.decode("latin-1") for w in worst]


def sample(
    docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, most_toxic: int, most_clean: int, most_bytes: int, longest_text: int,
) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """(label, text) of about `most_...` labelled documents of each kind and `most_bytes` of text, all where
    there is less, equal rows once; and how many there are of each kind. Texts over `longest_text` bytes
    aren't drawn."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_label"))
    scale = 1 << 30
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.octet_length(text), F.lit(0)).alias("_size"), F.pmod(F.xxhash64(F.col(id_col), text), F.lit(scale)).alias("_draw"), text.alias("_text"))
    # which rows are drawn is worked out without their texts, which are then fetched for the few that are
    found = rows.drop("_text").where(F.col("_size") <= longest_text).join(known, F.col("_doc") == F.col("_id"))
    kinds = found.groupBy("_label").agg(F.count("*").alias("n"), F.sum("_size").alias("size")).collect()
    n = {r["_label"]: r["n"] for r in kinds}
    limit = F.lit(0)
    for r in kinds:
        share = min(1.0, (most_toxic if r["_label"] else most_clean) / r["n"], most_bytes / 2 / max(1, r["size"] or 0))
        limit = F.when(F.col("_label") == r["_label"], F.lit(int(scale * share))).otherwise(limit)
    drawn = F.broadcast(found.where(F.col("_draw") < limit).select("_label", F.col("_doc").alias("_id"), F.col("_draw").alias("_at")).distinct())  # at most about most_toxic + most_clean
    some = rows.join(drawn, (F.col("_doc") == F.col("_id")) & (F.col("_draw") == F.col("_at"))).select("_label", "_doc", "_text").distinct()
    return [(r["_label"], r["_text"]) for r in sorted(some.collect(), key=lambda r: (r["_doc"], r["_text"] or ""))], n


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 1000,
    most_clean: int = 2500, most_bytes: int = 24_000_000, longest_text: int = 200_000, **options,
) -> Model:
    """Fit on the labelled rows among docs; pass only the documents that may be learnt from. As the sample
    has more toxic documents than the labels have, they weigh less in the logistic fit."""
    rows, n = sample(
        docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, most_toxic=most_toxic, most_clean=most_clean, most_bytes=most_bytes,
        longest_text=longest_text,
    )
    drawn = Counter(label for label, _ in rows)
    gc.collect()
    if not drawn[0] or not drawn[1]:
        return Model(Kernel())
    return fit(rows, toxic_weight=n[1] * drawn[0] / (n[0] * drawn[1]), **options)


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with _score (0 to 1) and _worst (the folded word that scored highest, null without words);
    columns of these names are replaced."""
    docs = docs.drop("_score", "_worst")
    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType()), StructField("_worst", StringType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                margin, worst = scorer(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(model.score(margin.astype(np.float64))), pa.array(worst, pa.string())],
                    names=[*part.schema.names, "_score", "_worst"],
                )

    return small_batches(docs).mapInArrow(add, schema)


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", toxic_from: float = 0.3) -> DataFrame:
    """The documents that score below toxic_from, with all their columns."""
    held, name = by_place(docs)
    return score(held, model, text_col=name[text_col]).where(F.col("_score") < toxic_from).select(*held.columns).toDF(*docs.columns)
