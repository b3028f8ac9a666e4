"""Toxicity by Levenshtein automata on a lexicon trie (operator 3).

Lexicon
    Learned from a bounded sample of labelled documents: words, and stems
    (word beginnings, for languages that inflect), weighted by the log of how
    much more often toxic documents use them than clean ones.  Terms are
    picked greedily by weight times the toxic documents they add, until every
    one holds ``COVER`` of them or none adds ``SUPPORT`` more, so words that
    merely stand near an insult are not picked.  A candidate needs ``SUPPORT``
    toxic documents, the purity, and evidence: the log-likelihood ratio of its
    counts must be such as chance would give to about one of all candidates
    tried, so a rare term is learned from a large sample as well as from a
    small one.  Words of two and three letters can be terms; like all under five
    letters they match exactly.

Matching
    The lexicon is a trie.  A word is read by the product of that trie with
    the Levenshtein automata of its terms (0 edits under 5 letters, 1 under
    9, 2 beyond): a state is the set of (trie node, edits) pairs, worked out
    when first reached and remembered.  Words that are like no term end in
    the dead state after two or three letters.  A misspelled form that clean
    sample documents use as well is not a match.

Context
    The window of ``WINDOW`` words on both sides of a match tells quotation
    from abuse: between quotation marks, or near a word of reporting.  Summed
    weights of strong, weak, misspelled and quoted matches, and the length of
    the text, become a probability by a logistic regression with prior
    weights, fitted on sample rows that the lexicon was not learned from.

Defined cases: null and empty texts have no match and get the score of a text
without matches; texts are scored whole; without toxic sample rows every
score is 0; repeated rows score alike; other columns are kept, a column of
the name asked for is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bounded_batches
from .logistic import fit_logistic, sigmoid
from .share import share, shared

PER_CLASS = 12_000
COVER = 3
SUPPORT = 2
#: letters of a term at least; of a stem at least and at most
MIN_TERM, MIN_LETTERS, MAX_LETTERS = 2, 4, 14
#: a term is this many times as frequent in toxic as in clean documents; a
#: strong one as many times as the second number
PURITY, STRONG = 4.0, 20.0
#: share of the sample that the lexicon is learned from
LEXICON_SHARE = 0.7
WINDOW = 8
#: constant; strong, weak, misspelled and quoted matches (log(1 + weights));
#: log(1 + words)
PRIOR = [-4.0, 4.0, 1.0, 1.0, 0.3, -0.2]
THRESHOLD = 0.5
#: distinct words a worker remembers as no match
REMEMBERED = 200_000

OPENING, CLOSING = "\"“”„«»‘‹›", "\"“”«»’‹›"
#: words that report what someone else said, in the languages of the corpus
REPORTING = frozenset(
    "said says say quoted quote quotes wrote writes called calls claimed replied word term "
    "sagte sagt schrieb nannte zitiert zitat wort dit disait cité citation mot "
    "dijo dice escribió llamó cita citó palabra".split())
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def bare(token: str) -> str:
    """A lower-cased token without the signs around it."""
    return token if token.isalpha() else _EDGE.sub("", token)


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """Product of the lexicon's trie and Levenshtein automata.

    ``terms`` are (text, is_stem, weight); a stem matches any word it begins.
    """

    def __init__(self, terms: list[tuple[str, bool, float]]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[bool, float]]] = [[]]
        self.edits = [0]  # allowed for the term that ends here
        self.reach = [0]  # most edits that a term from here on allows
        for text, stem, weight in terms:
            node, k = 0, edits_allowed(text)
            for ch in text:
                self.reach[node] = max(self.reach[node], k)
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.edits.append(0)
                    self.reach.append(0)
                node = nxt
            self.reach[node] = max(self.reach[node], k)
            self.edits[node] = k
            self.ends[node].append((stem, weight))
        self.states: dict[frozenset, list] = {}
        self.start = self._state({(0, 0)}) if terms else None

    def _state(self, pairs: set[tuple[int, int]]):
        """[transitions, best stem read so far, best term if the word ends
        here, pairs], or None for the dead state.  Letters of a term that the
        word lacks are skipped here.  Best: (-edits, weight)."""
        todo, least = list(pairs), {}
        while todo:
            node, e = todo.pop()
            if e > self.reach[node] or least.get(node, 9) <= e:
                continue
            least[node] = e
            todo += [(c, e + 1) for c in self.children[node].values()]
        if not least:
            return None
        ends = [(stem, (-e, w)) for n, e in least.items() if e <= self.edits[n] for stem, w in self.ends[n]]
        return [{}, max((v for stem, v in ends if stem), default=None),
                max((v for _, v in ends), default=None), least]

    def _step(self, state: list, ch: str):
        nxt = set()
        for node, e in state[3].items():
            nxt.add((node, e + 1))  # a letter too many
            for c, child in self.children[node].items():
                nxt.add((child, e if c == ch else e + 1))
        key = frozenset(nxt)
        if key not in self.states:
            self.states[key] = self._state(nxt)
        state[0][ch] = found = self.states[key]
        return found

    def match(self, word: str) -> tuple[int, float] | None:
        """(-edits, weight) of the nearest, then heaviest term; None if no
        term is near enough."""
        state, best = self.start, None
        for ch in word:
            if state is None:
                return best
            nxt = state[0].get(ch, 0)
            state = self._step(state, ch) if nxt == 0 else nxt
            if state is not None and state[1] is not None and (best is None or state[1] > best):
                best = state[1]
        if state is not None and state[2] is not None and (best is None or state[2] > best):
            best = state[2]
        return best


@dataclass
class ToxicModel:
    terms: list[tuple[str, bool, float]]
    innocent: frozenset[str]  # near terms, but used in clean documents
    weights: list[float]


class Reader:
    """Matches of texts; remembers words that match nothing."""

    def __init__(self, terms, innocent) -> None:
        self.lexicon, self.innocent = FuzzyLexicon(terms), innocent
        self.clean: set[str] = set()
        self.near: dict[str, tuple[int, float]] = {}

    def words(self, tokens: list[str]) -> set[str]:
        """The distinct tokens that match."""
        hits = set()
        for t in set(tokens):
            if t in self.clean:
                continue
            if t in self.near:
                hits.add(t)
                continue
            word = bare(t)
            found = self.lexicon.match(word) if word else None
            if found is None or found[0] and word in self.innocent:
                if len(self.clean) > REMEMBERED:
                    self.clean.clear()
                self.clean.add(t)
            else:
                self.near[t] = found
                hits.add(t)
        return hits

    def features(self, text: str | None) -> list[float]:
        """log(1 + weight) of strong, weak, misspelled and quoted matches, and
        log(1 + words)."""
        from math import log, log1p

        tokens = (text or "").lower().split()
        hits = self.words(tokens)
        sums = [0.0, 0.0, 0.0, 0.0]
        if hits:
            strong = log(STRONG)
            for i, t in enumerate(tokens):
                if t in hits:
                    e, weight = self.near[t]
                    kind = 3 if self.quoted(tokens, i) else 2 if e else 0 if weight >= strong else 1
                    sums[kind] += weight
        return [log1p(v) for v in sums] + [log1p(len(tokens))]

    @staticmethod
    def quoted(tokens: list[str], i: int) -> bool:
        """Is the match between quotation marks, or near a reporting word?"""
        before, after = tokens[max(0, i - WINDOW):i + 1], tokens[i:i + WINDOW + 1]
        opened = any(t[0] in OPENING for t in before)
        closed = any(t.rstrip(".,;:!?")[-1:] in CLOSING and t.rstrip(".,;:!?") for t in after)
        return opened and closed or any(bare(t) in REPORTING for t in before[-5:-1])


def _candidates(word: str):
    if len(word) >= MIN_TERM:
        yield word, False
    if len(word) >= MIN_LETTERS:
        for n in range(MIN_LETTERS, min(len(word), MAX_LETTERS) + 1):
            yield word[:n], True


def _words_of(text: str | None) -> set[str]:
    return {w for w in map(bare, set((text or "").lower().split())) if w and w[0].isalpha()}


def _document_counts(sample: DataFrame, wanted: frozenset | None) -> DataFrame:
    """(term, stem, n): documents with each candidate; a task adds up its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for t in batch.column("t").to_pylist():
                found = {c for w in _words_of(t) for c in _candidates(w)}
                seen.update(found if wanted is None else found & wanted)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
             pa.array([seen[k] for k in keys], pa.int64())], ["term", "stem", "n"])

    return sample.select("t").mapInArrow(count, "term string, stem boolean, n long") \
                 .groupBy("term", "stem").agg(F.sum("n").alias("n"))


def evidence(n: int, used: int, n_toxic: int, n_clean: int) -> float:
    """Log-likelihood ratio (times two) of a term in ``n`` of the toxic and
    ``used`` of the clean documents against one common rate."""
    from math import log

    def part(k: int, total: int, rate: float) -> float:
        return (k * log(k / (total * rate)) if k else 0.0) + (
            (total - k) * log((total - k) / (total * (1 - rate))) if total > k else 0.0)

    rate = (n + used) / (n_toxic + n_clean)
    return 2 * (part(n, n_toxic, rate) + part(used, n_clean, rate)) if 0 < rate < 1 else 0.0


def learn_lexicon(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int,
                  cover: int = COVER) -> list[tuple[str, bool, float]]:
    from math import log

    tried = materialize(_document_counts(toxic, None).where(F.col("n") >= SUPPORT), "terms")
    least, fewest = 2 * log(max(2, tried.count())), SUPPORT
    # a term in fewer toxic documents lacks the evidence even if no clean one has it
    while n_clean and fewest < n_toxic and evidence(fewest, 0, n_toxic, n_clean) < least:
        fewest += 1
    common = {(r["term"], r["stem"]): r["n"] for r in tried.where(F.col("n") >= fewest).collect()}
    used = {(r["term"], r["stem"]): r["n"] for r in _document_counts(clean, frozenset(common)).collect()}
    weight = {c: log((n + 0.5) / (n_toxic + 1)) - log((used.get(c, 0) + 0.5) / (n_clean + 1))
              for c, n in common.items()}
    pure = frozenset(c for c, w in weight.items() if w >= log(PURITY) and (
        not n_clean or evidence(common[c], used.get(c, 0), n_toxic, n_clean) >= least))

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(w + "*" * s for w, s in {c for w in _words_of(t) for c in _candidates(w)} & pure)
                    for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["c"])

    where: dict[tuple[str, bool], list[int]] = {}
    rows = sorted(toxic.select("t").mapInArrow(holds, "c array<string>").collect(), key=lambda r: r["c"])
    for i, r in enumerate(rows):
        for c in r["c"]:
            where.setdefault((c.rstrip("*"), c.endswith("*")), []).append(i)
    need = [cover] * len(rows)
    chosen = []
    while where:
        gain = {c: sum(need[i] > 0 for i in docs) for c, docs in where.items()}
        best = max(gain, key=lambda c: (gain[c] * weight[c], len(c[0]), not c[1], c[0]))
        if gain[best] < SUPPORT:
            break
        chosen.append((*best, weight[best]))
        for i in where.pop(best):
            need[i] -= 1
        # what the term now covers adds nothing: neither do its own variants
        where = {c: d for c, d in where.items() if gain[c] >= SUPPORT
                 and not (best[1] and c[0].startswith(best[0]) and weight[c] < weight[best] + log(STRONG))
                 and not (c[1] and best[0].startswith(c[0]))}
    return sorted(chosen)


def _lexicon_and_innocents(sample: DataFrame, cover: int):
    """Terms, and the words of clean documents that are misspelled terms;
    None without toxic rows."""
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(1):
        return None
    clean = sample.where("y = 0")
    terms = learn_lexicon(sample.where("y = 1"), clean, n[1], n.get(0, 0), cover)

    def innocents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms, frozenset())
        for batch in batches:
            for t in batch.column("t").to_pylist():
                reader.words((t or "").lower().split())
        found = sorted({bare(t) for t, (e, _) in reader.near.items() if e})
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["w"])

    found = clean.select("t").mapInArrow(innocents, "w string").distinct().collect()
    return terms, frozenset(r["w"] for r in found)


def fit_toxic(sample: DataFrame, cover: int = COVER) -> ToxicModel | None:
    """From ``t``, ``y`` (1: toxic), ``u`` (see :mod:`.labelled`); None without
    toxic rows.  The regression is fitted on rows that a first lexicon has not
    seen; the model's lexicon is then learned from all rows."""
    bounded_batches(sample.sparkSession)
    found = _lexicon_and_innocents(sample, cover)
    if found is None:
        return None
    first = _lexicon_and_innocents(sample.where(F.col("u") < LEXICON_SHARE), cover)
    if first is None:
        return ToxicModel(*found, PRIOR)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*first)
        for batch in batches:
            rows = [reader.features(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    rows = sample.where(F.col("u") >= LEXICON_SHARE).select("t", "y") \
                 .mapInArrow(measure, "x array<double>, y int").collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))
    return ToxicModel(*found, fit_logistic([r["x"] for r in rows], [r["y"] for r in rows], prior=PRIOR))


def with_toxicity(docs: DataFrame, model: ToxicModel | None, text: str = "text",
                  out: str = "score") -> DataFrame:
    """Adds ``out``: the probability (0 to 1) that the text is toxic."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    packed = share(docs.sparkSession, model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared(packed)
        reader, w = Reader(m.terms, m.innocent), m.weights
        for a in batches:
            yield pa.array([sigmoid(w[0] + sum(p * q for p, q in zip(w[1:], reader.features(t))))
                            for t in a.to_pylist()], pa.float64())

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, score(F.col(text)))
