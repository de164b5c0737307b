"""Toxicity by Levenshtein automata over a lexicon trie, and context windows (operator 9).

The lexicon (whole terms, and stems that many words share) is learned from all labelled documents. The Levenshtein
automaton of a word is walked over the lexicon's trie: a state holds the trie's nodes with the fewest edits that lead
there, and states and steps are made as the words read ask for them, so that the cost follows the texts and not the
product of all entries. Around each match a window of the text tells quotation from abuse: matches between quotation
marks or beside words of speech are counted apart. A logistic regression, trained in numpy on the counts, gives the score.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keydrift.llm.common import crc_fold, hashed_sample, if_small, kept_by_worker, mapped, saved, slices, text_digest

#: Labelled documents of each class that the weights are learned from at most, chosen by hash.
SAMPLE = 3000
#: An entry stands in so many toxic documents. From these log-odds on it is strong, below them weak: weak entries
#: also turn up in clean documents, and tell by their density.
SUPPORT, STRONG, WEAK = 4, 3.5, 1.2
#: The size bound of the lexicon, which every task is given; the most telling entries come first.
ENTRIES = 50_000
#: Steps of automata and words with their grades that a worker remembers.
STEPS, WORDS = 500_000, 100_000
#: How much likelier an entry's toxic documents are by its own rate than by chance (logarithm of the ratio).
EVIDENCE = 8.0
#: Letters of a stem; how many times as many documents as its most frequent word it must be in.
STEMS, SHARED = (4, 5, 6, 7), 1.5
#: Characters of context on either side of a match.
CONTEXT = 40
MARKS = "\"“”„«»‹›"
# Words of speech that attribute a quotation.
SPEECH = ("said", "says", "wrote", "quoted", "quote", "called", "dit", "cite", "sagte", "schrieb", "zitat", "dijo", "cita")
KINDS = ("strong", "weak", "fuzzy", "quoted")
FEATURES = (*KINDS, *(f"any_{k}" for k in KINDS), *(f"dense_{k}" for k in KINDS), "length")
#: The score from which a document counts as toxic.
TOXIC = 0.3


def reach(entry: str, strong: bool) -> int:
    """Edits that an entry tolerates: none if it is weak or has up to four letters (a stem: five), two from ten on."""
    length = len(entry.rstrip("*")) - entry.endswith("*")
    return 0 if not strong or length <= 4 else 1 if length < 10 else 2


#: The place behind a stem, where any letters may follow; the grade of a word that matches nothing.
TAIL, NOTHING = -1, 9
EDITS = 16
WORD = re.compile(r"[^\W_]+")


class Automaton:
    """The words within reach of an entry; `x*` matches words that begin with x. entries tells which are strong.

    State 0 is dead, 1 the beginning. Only states that some word came through exist. A state is kept as the bytes
    of numbers, node * EDITS + edits each, and a step under state * letters + letter.
    """

    def __init__(self, entries: dict[str, bool]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, list[tuple[bool, bool, int]]] = {}
        self.limit = {0: 0, TAIL: NOTHING}
        for entry, strong in entries.items():
            node, most = 0, reach(entry, strong)
            self.limit[0] = max(self.limit[0], most)
            for letter in entry.rstrip("*"):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                node = self.children[node][letter]
                self.limit[node] = max(self.limit.get(node, 0), most)
            self.ends.setdefault(node, []).append((entry.endswith("*"), strong, most))
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for e in entries for c in e.rstrip("*")}))}
        self.known: dict[str, int] = {}
        self._begin()

    def _begin(self) -> None:
        self.number: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.grades: list[int] = []
        self.sure: list[bool] = []
        self.steps: dict[int, int] = {}
        self._numbered({})
        self._numbered(self._closed({0: 0}))

    def _graded(self, node: int, edits: int, stem: bool) -> list[int]:
        return [1 + edits if edits else int(not strong) for s, strong, most in self.ends.get(node, ()) if s == stem and edits <= most]

    def _numbered(self, nodes: dict[int, int]) -> int:
        state = array("i", sorted(node * EDITS + edits for node, edits in nodes.items())).tobytes()
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            found = [g for node, edits in nodes.items() for g in ([edits] if node == TAIL else self._graded(node, edits, False))]
            self.grades.append(min(found, default=NOTHING))
            self.sure.append(nodes.get(TAIL) == 0)
        return self.number[state]

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes that deletions of letters of the entry lead to, and the tails of stems that are complete."""
        todo = [x for x in nodes.items() if x[0] != TAIL]
        tail = nodes.pop(TAIL, NOTHING)
        while todo:
            node, edits = todo.pop()
            if node in self.ends:
                tail = min([tail, *self._graded(node, edits, True)])
            for child in self.children[node].values():
                if edits + 1 <= self.limit[child] and nodes.get(child, NOTHING) > edits + 1:
                    nodes[child] = edits + 1
                    todo.append((child, edits + 1))
        if tail < NOTHING:
            nodes[TAIL] = tail
        return nodes

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}
        for packed in array("i", self.states[state]):
            node, edits = divmod(packed, EDITS)
            if node == TAIL:
                after[TAIL] = min(edits, after.get(TAIL, NOTHING))
                continue
            children = self.children[node]
            # The word has a letter more, another one, or (without an edit) the same.
            if edits < self.limit[node] and after.get(node, NOTHING) > edits + 1:
                after[node] = edits + 1
            for child in children.values():
                if edits < self.limit[child] and after.get(child, NOTHING) > edits + 1:
                    after[child] = edits + 1
            child = children.get(letter)
            if child is not None and edits <= self.limit[child] and after.get(child, NOTHING) > edits:
                after[child] = edits
        if len(self.steps) >= STEPS:
            begun = self._closed(after)
            self._begin()
            return self._numbered(begun)
        self.steps[state * (len(self.letters) + 1) + self.letters.get(letter, 0)] = found = self._numbered(self._closed(after))
        return found

    def grade(self, word: str) -> int:
        """What a word matches: 0 a strong entry, 1 a weak one, 1 + n one with n edits, NOTHING."""
        state, letters, steps = 1, self.letters, len(self.letters) + 1
        for letter in word.lower():
            if self.sure[state]:
                break
            after = self.steps.get(state * steps + letters.get(letter, 0))
            state = self._step(state, letter) if after is None else after
            if not state:
                return NOTHING
        return self.grades[state]

    def grade_all(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > WORDS:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            for i, g in enumerate(out):
                if g is None:
                    word = words[i]
                    out[i] = self.grade(word)
                    if len(word) <= 48:
                        known[word] = out[i]
        return out


def automaton(entries: dict[str, bool]) -> Automaton:
    """The lexicon's automaton; a worker keeps it with all that it has met."""
    name = hashlib.sha256(repr(sorted(entries.items())).encode()).hexdigest()
    return kept_by_worker(f"lexicon {name}", lambda: Automaton(entries))


def matches(text: str, found: Automaton) -> tuple[list[tuple[int, int]], int]:
    """Start and grade of every matching word of a text, and its number of words."""
    words = WORD.findall(text)
    grades = found.grade_all(words)
    if min(grades, default=NOTHING) == NOTHING:
        return [], len(words)
    return [(m.start(), g) for m, g in zip(WORD.finditer(text), grades, strict=True) if g < NOTHING], len(words)


def quoted(text: str, start: int) -> bool:
    """Whether the context of a match is one of quotation: an odd number of marks before it and one after it in
    its line, or a word of speech before it."""
    before, after = text[max(0, start - CONTEXT) : start].rpartition("\n")[2], text[start : start + CONTEXT].partition("\n")[0]
    marks = sum(c in MARKS for c in before)
    if marks % 2 and any(c in MARKS for c in after):
        return True
    return any(w.strip(".,:;") in SPEECH for w in before.lower().split()[-4:])


def features(texts: list[str], found: Automaton) -> np.ndarray:
    """For each text and kind of match the logarithm of its count, whether there is one, and the root of its density."""
    counts, words = np.zeros((len(texts), len(KINDS))), np.zeros(len(texts))
    for i, text in enumerate(texts):
        hits, words[i] = matches(text, found)
        for start, grade in hits:
            counts[i, 3 if quoted(text, start) else min(grade, 2)] += 1
    # Texts without any match all have the same features, whatever their length.
    length = (np.log1p(words) * (counts.sum(axis=1) > 0))[:, None]
    return np.hstack([np.log1p(counts), counts > 0, np.sqrt(counts / np.maximum(words, 1)[:, None]), length])


@dataclass
class Model:
    entries: dict[str, bool]
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def _known(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labelled documents of the training folds."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return saved(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "known-labels")


def _sample(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """text, toxic of at most SAMPLE labelled documents of each class, and how many there are of each."""
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [hashed_sample(known.where(F.col("toxic") == c), SAMPLE, "doc_id") for c in (0, 1)]
    picked = saved(picked[0].union(picked[1]), "picked-labels")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(if_small(picked), "doc_id")
    return saved(texts.select("doc_id", "text", "toxic"), "labelled"), counts


def _entries(docs: DataFrame, known: DataFrame, toxic: int) -> DataFrame:
    """entry, once for each labelled document of a class that it stands in: words of three letters and more, and stems."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+")), lambda w: F.length(w) >= 3)
    stems = [F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, F.lit(1), F.lit(n)), F.lit("*"))) for n in STEMS]  # noqa: B023
    some = docs.select("doc_id", "text").join(if_small(known.where(F.col("toxic") == toxic).select("doc_id")), "doc_id")
    return some.select(F.explode(F.array_distinct(F.concat(words, *stems))).alias("entry"))


def lexicon(docs: DataFrame, known: DataFrame) -> dict[str, bool]:
    """Terms and stems (`x*`) that tell toxic documents, and whether they are strong.

    Spark counts documents per word and stem over all that are labelled: in toxic ones first, and in clean ones
    only what has support. At most ENTRIES come back.
    """
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    bad = _entries(docs, known, 1).groupBy("entry").agg(F.count("*").alias("bad")).where(F.col("bad") >= SUPPORT)
    bad = saved(bad, "toxic-entries")
    good = _entries(docs, known, 0).join(if_small(bad.select("entry")), "entry").groupBy("entry").agg(F.count("*").alias("good"))
    rows = bad.join(good, "entry", "left").withColumn("good", F.coalesce("good", F.lit(0)))
    odds = F.log((F.col("bad") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(clean + 1.0))
    chance = (F.col("bad") + F.col("good")) * F.lit(toxic / max(1, toxic + clean))
    evidence = F.col("bad") * F.log(F.col("bad") / chance) - F.col("bad") + chance
    rows = rows.where(evidence >= EVIDENCE).withColumn("odds", odds).where(F.col("odds") >= WEAK)
    rows = {r.entry: r for r in rows.orderBy(F.desc(F.col("odds") * F.col("bad")), "entry").limit(ENTRIES).collect()}
    fullest: dict[str, int] = {}
    for word in (e for e in rows if not e.endswith("*")):
        for n in STEMS:
            fullest[word[:n]] = max(rows[word].bad, fullest.get(word[:n], 0))
    kept: dict[str, bool] = {}

    def covered(entry: str, strong: bool) -> bool:
        """Whether a stem that is kept, as strong at least, begins the entry."""
        found = [kept.get(entry[:n] + "*") for n in STEMS if n < len(entry)]
        return any(k is not None and (k or not strong) for k in found)

    for entry in sorted((e for e in rows if e.endswith("*")), key=lambda e: (len(e), e)):
        strong = rows[entry].odds >= STRONG
        if rows[entry].bad >= SHARED * fullest.get(entry[:-1], 0) and not covered(entry[:-1], strong):
            kept[entry] = strong
    for entry in sorted(e for e in rows if not e.endswith("*")):
        strong = rows[entry].odds >= STRONG
        if not covered(entry + " ", strong):
            kept[entry] = strong
    return kept


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method; `weight` gives the classes their shares of all labelled rows."""
    spread = np.where(x.std(axis=0) > 0, x.std(axis=0), np.inf)
    design = np.hstack([x / spread, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    ridge = decay * len(x) * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        slope = design.T @ (weight * (p - y)) + ridge @ w
        w -= np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge, slope)
    return w[:-1] / spread, float(w[-1])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and weights from the training folds; labels (doc_id, toxic) of 0 and 1 count, null ids don't."""
    known = _known(docs, labels)
    sample, counts = _sample(docs, known)
    entries = lexicon(docs, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(entries)
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text").to_pylist(), found)
                columns = [pa.array(x[:, i]) for i in range(len(FEATURES))]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), *columns], names=["toxic", *FEATURES])

    kinds = ", ".join(f"{f} double" for f in FEATURES)
    rows = sample.select("text", "toxic").transform(mapped, run, f"toxic int, {kinds}").collect()  # at most 2 * SAMPLE rows of numbers
    if len(counts) < 2:
        return Model(entries, np.zeros(len(FEATURES)), 4.0 if counts.get(1) else -4.0)
    rows = np.array(sorted(tuple(r) for r in rows), float)
    y, x = rows[:, 0], rows[:, 1:]
    share = {c: counts[c] / sum(counts.values()) / max(1, (y == c).sum()) * len(y) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    # A misspelled or quoted term is no sign of a clean document: such columns count up or not at all.
    only_up = np.array([f.split("_")[-1] in ("fuzzy", "quoted") for f in FEATURES])
    used = np.ones(len(FEATURES), bool)
    while True:
        weights, bias = _fit(x * used, y, weight)
        down = only_up & (weights < 0)
        if not down.any():
            return Model(entries, weights, bias)
        used &= ~down


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, text_sha256 for every row, from the whole text alone; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(model.entries)
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text").fill_null("").to_pylist(), found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(x)), part.column("text_sha256")], names=["doc_id", "score", "text_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_digest())
    return rows.transform(mapped, run, "doc_id long, score double, text_sha256 string")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn and score: doc_id, held_out, score, predicted, text_sha256 for every row of docs, repeated rows one by one.

    Empty and null texts have the score of a document without matches. A null doc_id counts as the empty text
    for the fold. Where only one class is labelled all rows get its score; without labels all are clean.
    """
    rows = scored(docs, learn(docs, labels))
    return rows.select("doc_id", (crc_fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "text_sha256")
