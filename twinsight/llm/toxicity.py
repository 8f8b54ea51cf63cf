"""Toxicity by a learned lexicon: trie, Levenshtein automata and context windows.

Fitting finds words and word beginnings that mark toxic documents. They form
a trie. A word of a text matches if the trie accepts it, or if a Levenshtein
automaton for one edit, run along the trie, accepts it and training saw no
clean document use it. The automaton knows listed words, those that would be
listed, did a beginning not stand for them, and long beginnings, after which
anything may follow. Quotation marks that pair around a match, and reporting
words in the window before it, tell whether it is quoted or reported; a
logistic regression weighs open and quoted matches.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SLICE_BYTES, column_of, map_batches
from .bpe import Memo
from .training import Sample, folds, labelled_sample, logistic, per_worker, sigmoid

THRESHOLD = 0.3
#: Words on each side of a match that its context score looks at.
WINDOW = 6
#: One edit is allowed in words of this many letters and more.
FUZZY_LETTERS = 4
#: One edit is allowed within beginnings of this many letters and more.
FUZZY_STEM = 6
#: Letters of a beginning: shorter ones say too little, longer ones fall under their own beginning.
MIN_STEM, MAX_STEM = 4, 8
#: A lexicon entry is in at least this many toxic sample documents, with at least this log odds ratio.
MIN_DOCUMENTS, MIN_ODDS = 3, 2.0
#: The sample's documents of each class, and of its near copies one.
PER_CLASS = 2000

#: Opening quotation marks with what may close each, and words that report what someone said.
CLOSING = {'"': '"', "`": "`'´", "'": "'’", "’": "’", "‘": "’'", "‚": "‘’'", "‛": "’'", "“": "”\"", "”": "”", "„": "“”\"", "‟": "”", "«": "»", "»": "«", "‹": "›", "›": "‹"}
REPORTING = frozenset(
    "said says say saying wrote writes called calls quoted quote quotes quoting replied according "
    "sagte sagt schrieb zitiert zitat nannte laut dit disait écrit cite citation appelé selon "
    "dijo dice escribió cita llamó según".split()
)

_words = re.compile(r"[^\W_]+").findall
_marks = re.compile("\n[ \t\r]*\n|[" + "".join(sorted(set("".join(CLOSING) + "".join(CLOSING.values())))) + "]").finditer


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of stretches between an opening quotation mark and the next that closes it, of any length.

    A mark opens before a letter, digit or other mark and after none; it
    closes after something other than a space and before no letter. So marks
    between letters (don't, l'ami) are neither. A blank line, or another
    opening of the same mark, ends a quotation that nothing closed: it counts
    as none.
    """
    out: list[tuple[int, int]] = []
    start, closing = -1, ""
    for m in _marks(text):
        c, at = m[0], m.start()
        if len(c) > 1:
            start = -1
            continue
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        if start >= 0 and c in closing and not before.isspace() and not after.isalnum():
            out.append((start, at + 1))
            start = -1
        elif c in CLOSING and not before.isalnum() and after and not after.isspace() and (start < 0 or c == text[start]):
            start, closing = at, CLOSING[c]
    return out


def unquoted(text: str) -> str:
    """The text outside quotations."""
    parts, at = [], 0
    for start, end in quotations(text):
        parts.append(text[at:start])
        at = end
    return " ".join([*parts, text[at:]])


@dataclass
class Trie:
    """Words and word beginnings with weights, in nested maps; '' holds a word's weight, '*' a beginning's, '~' that of a form for the automaton alone."""

    root: dict = field(default_factory=dict)
    heads: set = field(default_factory=set)
    tails: set = field(default_factory=set)
    half: set = field(default_factory=set)
    stems: dict = field(default_factory=lambda: {"heads": set(), "tails": set(), "half": set()})

    def add(self, entry: str, weight: float) -> None:
        stem = entry.endswith("*")
        word = entry.rstrip("*~")
        node = reduce(lambda at, c: at.setdefault(c, {}), word, self.root)
        node[entry[len(word) :]] = weight
        if not stem and len(word) >= FUZZY_LETTERS:
            half = len(word) // 2
            self.heads.add(word[:half])
            self.tails.add(word[half:])
            self.half.update({half, len(word) - half})
        if stem and len(word) >= FUZZY_STEM:
            half = len(word) // 2
            self.stems["heads"].add(word[:half])
            self.stems["tails"].add(word[half:])
            self.stems["half"].add((half, len(word) - half))

    def _near_stem(self, word: str) -> bool:
        heads, tails = self.stems["heads"], self.stems["tails"]
        return any(word[:n] in heads or any(word[n + k : n + k + rest] in tails for k in (-1, 0, 1)) for n, rest in self.stems["half"])

    def exact(self, word: str) -> float:
        """The greatest weight of what accepts the word; 0 if nothing does."""
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            best = max(best, node.get("*", 0.0))
        return max(best, node.get("", 0.0))

    def fuzzy(self, word: str) -> float:
        """The greatest weight of a word, or of a beginning of the word, one edit away.

        One edit leaves one half of what is listed as it is, so words that
        share no half need no automaton. Its states are (letters read, edits
        left), followed along the branches of the trie.
        """
        n = len(word)
        whole = n >= FUZZY_LETTERS - 1 and any(word[:k] in self.heads or word[-k:] in self.tails for k in self.half)
        if not whole and not self._near_stem(word):
            return 0.0
        best, todo = 0.0, [(self.root, ((0, 1),), 0)]
        while todo:
            node, states, depth = todo.pop()
            weight = max(node.get("", 0.0), node.get("~", 0.0))
            if weight and depth >= FUZZY_LETTERS and any(n - at <= left for at, left in states):
                best = max(best, weight)
            if depth >= FUZZY_STEM and states:
                best = max(best, node.get("*", 0.0))
            for c, below in node.items():
                if c in ("", "*", "~"):
                    continue
                reached = set()
                for at, left in states:
                    if at < n and word[at] == c:
                        reached.add((at + 1, left))
                    if left:
                        reached.add((at, 0))  # c is missing from the word
                        if at < n:
                            reached.add((at + 1, 0))  # c is written otherwise
                            if at + 1 < n and word[at + 1] == c:
                                reached.add((at + 2, 0))  # the word has a letter too many
                if reached:
                    todo.append((below, tuple(reached), depth + 1))
        return best


def entries_of(word: str) -> list[str]:
    """What a word can be listed under: itself and its beginnings."""
    return [word, *(word[:k] + "*" for k in range(MIN_STEM, min(len(word), MAX_STEM) + 1))]


def word_set(text: str | None) -> set[str]:
    """Words of a text outside quotations: what is only quoted tells nothing about a word."""
    return set(_words(unquoted((text or "").lower())))


def one_of_copies(sets: list[set[str]], y: np.ndarray) -> np.ndarray:
    """Positions of texts that share no sketch with an earlier one of their class, so that copies count once."""
    seen, keep = set(), []
    for i, words in enumerate(sets):
        hashes = sorted(zlib.crc32(w.encode()) for w in words)
        sketches = [(k, int(y[i]), *part[:2]) for k in range(4) if (part := [h for h in hashes if h & 3 == k])]
        if not sketches or not any(s in seen for s in sketches):
            keep.append(i)
        seen.update(sketches)
    return np.array(keep, np.int64)


def evidence(a: int, b: int, n1: int, n0: int) -> tuple[float, float]:
    """Log odds ratio of a of n1 toxic against b of n0 clean documents, and twice the log likelihood ratio."""
    odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    rate = n1 / (n1 + n0)
    ratio = sum(2 * k * math.log(k / ((a + b) * r)) for k, r in ((a, rate), (b, 1 - rate)) if k)
    return odds, ratio


def build_lexicon(sets: list[set[str]], y: np.ndarray) -> tuple[Trie, set[str], dict[str, float]]:
    """Trie of words and beginnings that mark toxic texts, and clean words that one edit would catch.

    An entry must stand out beyond what the number of candidates tried
    explains. The strongest come first; one that begins another, or that
    another begins, must mark clearly better to be listed beside it. Words
    that stand out but give way to a beginning stay for the automaton.
    """
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    toxic, clean, forms = Counter(), Counter(), Counter()
    for words, label in zip(sets, y, strict=True):
        if label == 1:
            toxic.update({e for w in words for e in entries_of(w)})
    toxic = {e: n for e, n in toxic.items() if n >= MIN_DOCUMENTS}
    for words, label in zip(sets, y, strict=True):
        if label == 0:
            clean.update({e for w in words for e in entries_of(w) if e in toxic})
    for word in {w for words, label in zip(sets, y, strict=True) if label == 1 for w in words}:
        forms.update(e for e in entries_of(word) if e in toxic)
    bar = 2 * math.log(max(2, len(toxic))) - 2
    found = {}
    for e, n in toxic.items():
        odds, ratio = evidence(n, clean[e], n1, n0)
        if odds >= MIN_ODDS and ratio >= bar and (e[-1] != "*" or forms[e] >= 3):
            found[e] = (odds, ratio)
    listed: dict[str, float] = {}
    below: dict[str, float] = {}  # the greatest weight listed below a beginning
    for e, (odds, _) in sorted(found.items(), key=lambda x: (-x[1][1], x[0])):
        above = [k for k in entries_of(e.rstrip("*"))[1:] if k in listed]
        if all(odds > listed[k] + 0.5 for k in above) and odds > below.get(e, -1) + 0.5:
            listed[e] = odds
            for k in entries_of(e.rstrip("*"))[1:]:
                below[k] = max(below.get(k, -1), odds)
    trie = Trie()
    for e, w in listed.items():
        trie.add(e, w)
    words = {w for own, label in zip(sets, y, strict=True) if label == 0 for w in own}
    for w in sorted(found.keys() - listed.keys()):
        if w[-1] != "*" and (weight := trie.exact(w)):
            listed[w + "~"] = weight
            trie.add(w + "~", weight)
    return trie, {w for w in words if trie.fuzzy(w)}, listed


FEATURES = 9


class Matcher:
    """Features of whole texts by one lexicon."""

    def __init__(self, trie: Trie, innocent: set[str]):
        self.trie, self.innocent = trie, innocent
        self.unit = Memo(self._unit, 60_000)

    def _unit(self, unit: str) -> tuple:
        """(words, sum of weights, greatest weight, exact, misspelled, reporting word) of a stretch without spaces."""
        words = _words(unit)
        total = most = 0.0
        exact = fuzzy = 0
        for w in words:
            if weight := self.trie.exact(w):
                exact += 1
            elif w not in self.innocent and (weight := 0.8 * self.trie.fuzzy(w)):
                fuzzy += 1
            total += weight
            most = max(most, weight)
        return len(words), total, most, exact, fuzzy, any(w in REPORTING for w in words)

    @staticmethod
    def _inside(text: str, hits: list[int]) -> list[bool]:
        """Whether each of the stretches, by number and ascending, lies in a quotation of the text."""
        spans = quotations(text)
        if not spans:
            return [False] * len(hits)
        units = text.split(" ")
        starts = np.cumsum([0, *(len(u) + 1 for u in units)])
        first, last = (np.array(x) for x in zip(*spans, strict=True))
        at = np.searchsorted(first, [starts[h] + len(units[h]) for h in hits]) - 1  # the last that begins before the stretch ends
        return [bool(k >= 0 and last[k] > starts[h]) for k, h in zip(at, hits, strict=True)]

    def features(self, texts: pa.Array) -> np.ndarray:
        lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
        lists = pc.split_pattern(lowered, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        table = np.array([self.unit(u) for u in coded.dictionary.to_pylist()], float).reshape(-1, 6)
        starts, counts = offsets[:-1] - offsets[0], np.diff(offsets)
        n = np.bincount(np.repeat(np.arange(len(counts)), counts), table[index, 0], len(counts)) if len(index) else np.zeros(len(counts))
        out = np.zeros((len(counts), FEATURES))
        out[:, 8] = np.log1p(n)
        hits = np.flatnonzero(table[index, 1] > 0) if len(index) else np.zeros(0, np.int64)
        if not len(hits):
            return out
        owner = np.searchsorted(starts, hits, "right") - 1
        first = starts[owner]
        reports = np.concatenate([[0], np.cumsum(table[index, 5])])
        quoted = reports[hits] > reports[np.maximum(first, hits - WINDOW)]
        ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1
        for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            quoted[lo:hi] |= self._inside(lowered[int(owner[lo])].as_py(), (hits[lo:hi] - first[lo]).tolist())
        weight, most, exact, fuzzy = (table[index[hits], k] for k in (1, 2, 3, 4))
        add = lambda v: np.bincount(owner, v, len(counts))
        out[:, 0] = np.log1p(add(weight * ~quoted))
        out[:, 1] = np.log1p(add(weight * quoted))
        out[:, 2] = np.log1p(add(exact * ~quoted))
        out[:, 3] = np.log1p(add(exact * quoted))
        out[:, 4] = np.log1p(add(fuzzy * 1.0))
        best = np.zeros(len(counts))
        np.maximum.at(best, owner, most * np.where(quoted, 0.5, 1))
        out[:, 5] = best
        out[:, 6] = np.log1p(1000 * add(weight * ~quoted) / np.maximum(n, 20))
        pair = np.unique(np.stack([owner, index[hits]]), axis=1)[0]
        out[:, 7] = np.log1p(np.bincount(pair, minlength=len(counts)))
        return out


@dataclass
class Model:
    entries: dict[str, float]
    innocent: set[str]
    beta: np.ndarray

    def matcher(self) -> Matcher:
        trie = Trie()
        for e, w in self.entries.items():
            trie.add(e, w)
        return Matcher(trie, self.innocent)

    def scores(self, matcher: Matcher, texts: pa.Array) -> np.ndarray:
        return sigmoid(np.column_stack([matcher.features(texts), np.ones(len(texts))]) @ self.beta)


def fit(sample: Sample) -> Model:
    """Lexicon of the whole sample; weights from features that each fold gets by the other folds' lexicon.

    Executors work out word sets and features; no text comes to the driver.
    One class alone, or no labels: no lexicon, and the rate of toxic labels is
    every text's score.
    """
    y, w = sample.labels, sample.weights
    if len(set(y.tolist())) < 2:  # nothing to tell apart
        rate = float(np.average(y, weights=w)) if len(y) else 0.0
        beta = np.zeros(FEATURES + 1)
        beta[-1] = math.log((rate + 1e-3) / (1 - rate + 1e-3))
        return Model({}, set(), beta)
    own_words = lambda batch: [pa.array([sorted(word_set(t.as_py())) for t in batch.column(0)], pa.list_(pa.string()))]
    told = sample.collect(own_words, ["text"], "words array<string>", SLICE_BYTES)
    one: dict[str, str] = {}
    sets = [{one.setdefault(x, x) for x in own.as_py()} for own in told["words"]]
    at = told["at"].to_numpy()
    keep = one_of_copies(sets, y)
    if len(set(y[keep].tolist())) < 2:
        keep = np.arange(len(y))
    sets, y, w, at = [sets[i] for i in keep], y[keep], w[keep], at[keep]
    k = 3
    fold = np.zeros(len(y), int)
    for label in (0, 1):
        of_class = np.flatnonzero(y == label)
        fold[of_class] = folds(len(of_class), k)
    parts = [build_lexicon([sets[i] for i in np.flatnonzero(fold != f)], y[fold != f]) for f in range(k)]
    shared = sample.frame.sparkSession.sparkContext.broadcast(([Model(listed, innocent, np.zeros(0)) for _, innocent, listed in parts], at, fold))

    def crossed(batch: pa.RecordBatch) -> list[pa.Array]:
        models, rows, of = shared.value
        matchers = per_worker(shared, lambda value: [m.matcher() for m in value[0]])
        place = np.searchsorted(rows, batch.column(0).to_numpy())
        known = (place < len(rows)) & (rows[np.minimum(place, len(rows) - 1)] == batch.column(0).to_numpy())
        x = np.zeros((batch.num_rows, FEATURES))
        for f, matcher in enumerate(matchers):
            own = np.flatnonzero(known & (of[np.minimum(place, len(rows) - 1)] == f))
            x[own] = matcher.features(batch.column(1).take(pa.array(own)))
        return [pa.array(x.tolist(), pa.list_(pa.float64()))]

    found = sample.collect(crossed, ["at", "text"], "x array<double>", SLICE_BYTES)
    x = np.array(found["x"].to_pylist(), float).reshape(-1, FEATURES)[keep]
    _, innocent, entries = build_lexicon(sets, y)
    return Model(entries, innocent, logistic(x, y, w, ridge=0.3))


def training_rows(doc_id: Column) -> Column:
    """Labels are learned only from these documents; the rest is held out."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(labelled_sample(docs, labels, "toxic", ["text"], training_rows, PER_CLASS))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text, one row per input row.

    A null or empty text has no matches and gets the score of such texts; a
    null doc_id counts as not held out, and repeated rows are scored each for
    itself. Labels, lang, source and doc_id are no inputs of a score. Other
    columns are not read. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of 2 x PER_CLASS documents

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.scores(per_worker(shared, Model.matcher), batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(~training_rows(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are, without a shuffle.

    Null and empty texts have no matches; they stay where such texts score
    below the threshold. Repeated rows, and rows without a doc_id, are rated
    like any other. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rated = column_of(lambda texts: pa.array(shared.value.scores(per_worker(shared, Model.matcher), texts)))
    return docs.where(rated(F.col("text")) < threshold)
