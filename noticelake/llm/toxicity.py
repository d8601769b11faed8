"""Toxicity by Levenshtein automata over a lexicon trie, with context windows that tell quotation from abuse.

Training takes a bounded sample of labelled rows (``SAMPLE_ROWS``, by hash of the id).  It gives the lexicon:
terms that documents labelled toxic have far more often than others (log-odds and a likelihood-ratio test, the harder the more words
are tested).  The lexicon is a trie, and a token is run through the trie's Levenshtein automaton: a depth-first walk that carries the states within
the allowed edits and leaves a branch once none is alive.  Edits allowed: none up to 4 letters, one up to 9, two beyond.
Tokens near a term that clean documents use themselves are no misspellings; training lists them.

Each hit is looked at in its window of tokens: whether it stands between quotation marks, and whether a word of speaking
stands near.  Each such class of context has a weight, learned from hits over a prior that takes quoted
and reported words for mention rather than abuse.  The hits' weights add up to evidence, and a logistic function of
evidence and its density is the score.  Both are fitted on hits of lexicons that have not seen the document: the sample is
cut in ``FOLDS``, and each fold is searched by the lexicon of the others, so no label is lost to either.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from noticelake.llm._shared import lean, partitions, rows_of, written

#: Labelled rows that training reads at most; terms and look-alikes are words of these rows, and so bounded too.
SAMPLE_ROWS = 20_000
#: A term needs so many toxic documents and such log-odds, and a likelihood ratio that chance gives about one of the words that many documents have.
LEAST_DOCS, LEAST_ODDS = 3, 2.0
FOLDS = 4
WINDOW = 8
THRESHOLD = 0.7
#: Weights of tokens that a task remembers, twice over.
MEMO_TOKENS = 100_000

OPENING, CLOSING = "\"'“„‘‚«‹([", "\"'”“’‘»›)]"
QUOTES = "\"“”„‘‚«»‹›"
#: Words of speaking and of mention in the languages of the data (fixed values).
SPEAKING = frozenset(
    "say says said saying tell tells told write writes wrote written call calls called quote quotes quoted quoting word words term terms report reports reported "
    "sagt sagte sagen schrieb nannte wort wörter zitat zitiert dit disait écrit appelé mot mots cite cité terme dijo dice dicho escribió llamó palabra palabras cita citó término".split()
)
#: Context classes by (quoted, reported): prior weight, and the hits that the prior counts for.
PRIOR = {(False, False): 1.0, (True, False): 0.6, (False, True): 0.8, (True, True): 0.15}
PRIOR_HITS = 50.0


def edits_for(length: int) -> int:
    return 0 if length <= 4 else 1 if length <= 9 else 2


@functools.cache
def cuts_of(length: int) -> tuple[int, ...]:
    """Where a term of that length is cut into one part more than it may have edits."""
    parts = edits_for(length) + 1
    return tuple(length * k // parts for k in range(parts + 1))


def bare(token: str) -> str:
    """A lower-case token without the signs around it."""
    if token.isalnum():
        return token
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


class Lexicon:
    """Tries of terms, one for each number of edits, searched by Levenshtein automata.

    Of a term cut into one part more than it may have edits one part at least is unchanged, and shifted by no more than the edits.  So each part has a
    bit, each node of a trie the bits of the terms below, and a token is only run through the branches that have a part of its own: most tokens
    have none, and nothing is lost by that."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.tries: dict[int, dict] = {}
        self.parts: dict[int, tuple[dict[str, int], dict[str, int], dict[str, int]]] = {}
        self.plans: dict[int, list[tuple[dict[str, int], int, int]]] = {}
        bits = 0
        for term in terms:
            edits = edits_for(len(term))
            if not edits:
                continue
            cuts, kinds = cuts_of(len(term)), self.parts.setdefault(len(term), ({}, {}, {}))
            below = 0
            for kind, part in zip(kinds, (term[: cuts[1]], term[cuts[-2] :], *[term[cuts[1] : cuts[2]]] * (edits == 2))):
                if part not in kind:
                    kind[part] = 1 << bits
                    bits += 1
                below |= kind[part]
            node = self.tries.setdefault(edits, {})
            for sign in term:
                entry = node.setdefault(sign, [{}, 0])
                entry[1] |= below
                node = entry[0]
            node[""] = [term, below]

    def lookups(self, n: int) -> list[tuple[dict[str, int], int, int]]:
        """Where tokens of n letters may have parts of terms: bits of the parts, from and to; places that several lengths of terms share once."""
        at: dict[tuple[int, int], dict[str, int]] = {}
        for length, (starts, ends, middles) in self.parts.items():
            edits = edits_for(length)
            if abs(length - n) > edits:
                continue
            cuts = cuts_of(length)
            spots = [(starts, 0, cuts[1]), (ends, n - (length - cuts[-2]), n), *((middles, cuts[1] + k, cuts[2] + k) for k in range(-edits, edits + 1))]
            for parts, start, end in spots:
                if parts:
                    merged = at.setdefault((max(start, 0), end), {})
                    for part, bit in parts.items():
                        merged[part] = merged.get(part, 0) | bit
        return [(parts, start, end) for (start, end), parts in at.items()]

    def may_match(self, token: str) -> int:
        """The bits of the parts that the token has where a term has them."""
        found, n = 0, len(token)
        if n not in self.plans:
            self.plans[n] = self.lookups(n)
        for parts, start, end in self.plans[n]:
            part = token[start:end]
            if part in parts:
                found |= parts[part]
        return found

    def search(self, token: str) -> tuple[str, int] | None:
        """The nearest term within its edits and its distance; of equally near ones the heaviest, then the first.

        The automaton's states are bit sets: bit i of the set for e edits says that i letters of the token may be read by now.
        """
        if token in self.terms:
            return token, 0
        possible = self.may_match(token) if len(token) >= 4 else 0
        if not possible:
            return None
        places: dict[str, int] = {}
        for i, sign in enumerate(token):
            places[sign] = places.get(sign, 0) | 1 << i
        whole, best = 1 << len(token), None
        limit = 2 * whole - 1
        for edits, trie in self.tries.items():
            first = tuple((2 << e) - 1 & limit for e in range(edits + 1))
            stack = [(trie, first)]
            while stack:
                node, states = stack.pop()
                for sign, (child, below) in node.items():
                    if not below & possible:
                        continue
                    if sign == "":
                        distance = next((e for e, x in enumerate(states) if x & whole), None)
                        if distance is not None and (best is None or (distance, -self.terms[child], child) < best):
                            best = (distance, -self.terms[child], child)
                        continue
                    at = places.get(sign, 0)
                    old = states[0]
                    new = [(old & at) << 1]
                    for e in range(1, edits + 1):
                        now = states[e]
                        new.append((((now & at) << 1) | old | (old << 1) | (new[-1] << 1)) & limit)
                        old = now
                    if new[-1]:
                        stack.append((child, new))
        return (best[2], best[0]) if best else None


@dataclass
class Model:
    terms: dict[str, float]
    lookalikes: frozenset[str] = frozenset()
    contexts: dict[tuple[bool, bool], float] = field(default_factory=lambda: dict(PRIOR))
    fit: tuple[float, float, float] = (-4.0, 1.5, 0.5)
    memo_tokens: int = MEMO_TOKENS

    def __post_init__(self):
        self.lexicon = Lexicon(self.terms)  # look-alikes and halved weights guard against chance hits
        self.memo: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def __getstate__(self):
        return {"terms": self.terms, "lookalikes": self.lookalikes, "contexts": self.contexts, "fit": self.fit, "memo_tokens": self.memo_tokens}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def weight(self, token: str) -> float:
        """Of a raw token: its term's weight, halved for each edit; 0 for no hit."""
        got = self.memo.get(token)
        if got is None:
            got = self.older.get(token)
            if got is None:
                word = bare(token)
                hit = self.lexicon.search(word) if word else None
                got = 0.0 if hit is None or (hit[1] and word in self.lookalikes) else self.terms[hit[0]] * 0.5 ** hit[1]
            if len(self.memo) >= self.memo_tokens:  # the one before stays for what is still in use
                self.older, self.memo = self.memo, {}
            self.memo[token] = got
        return got

    def hits(self, text: str | None) -> tuple[list[tuple[float, tuple[bool, bool]]], int]:
        """Each hit's weight and context class, and the number of tokens."""
        tokens = (text or "").lower().split()
        weight = self.weight
        hot = {x for x in set(tokens) if weight(x)}
        if not hot:
            return [], len(tokens)
        return [(weight(x), context(tokens, i)) for i, x in enumerate(tokens) if x in hot], len(tokens)

    def features(self, text: str | None) -> tuple[float, float]:
        hits, n = self.hits(text)
        evidence = sum(w * self.contexts[c] for w, c in hits)
        return math.log1p(evidence), math.log1p(100 * evidence / max(20, n))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.fit[0] + self.fit[1] * a + self.fit[2] * b))))


def context(tokens: list[str], at: int) -> tuple[bool, bool]:
    """Whether the token stands between quotation marks, and whether a word of speaking is in its window."""
    low, high = max(0, at - WINDOW), min(len(tokens), at + WINDOW + 1)
    opened = any(tokens[i][0] in QUOTES and not (i < at and tokens[i].rstrip(".,;:!?")[-1:] in QUOTES and len(tokens[i]) > 1) for i in range(low, at + 1))
    closed = any(tokens[i].rstrip(".,;:!?")[-1:] in QUOTES for i in range(at, high))
    return opened and closed, any(bare(x) in SPEAKING for x in tokens[low:high])


COUNTS = [f"{kind}{f}" for kind in ("toxic", "clean") for f in range(FOLDS)]


def word_counts(sample: DataFrame) -> DataFrame:
    """word, and the toxic and clean documents of each fold of the sample that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = np.array(list(counts.values()), np.int64).reshape(-1, len(COUNTS))
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *map(pa.array, columns.T.copy())], ["word", *COUNTS])
            counts.clear()
            return batch

        for texts, labels, folds in rows_of(batches, ["text", "toxic", "fold"]):
            for text, label, fold in zip(texts, labels, folds):
                for word in set(map(bare, set((text or "").lower().split()))):
                    if word:
                        counts.setdefault(word, [0] * len(COUNTS))[fold + (1 - label) * FOLDS] += 1
                if len(counts) > 200_000:
                    yield out()
        yield out()

    counted = sample.select("text", "toxic", "fold").mapInArrow(lean(run), "word string, " + ", ".join(f"{x} bigint" for x in COUNTS))
    return counted.groupBy("word").agg(*[F.sum(x).alias(x) for x in COUNTS])


def near_terms(words: DataFrame, model: Model) -> DataFrame:
    """Rows of words (column word) that are within edits of a term but none themselves."""
    lexicon = model.lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([x not in lexicon.terms and lexicon.search(x) is not None for x in batch.column("word").to_pylist()], pa.bool_()))

    return words.mapInArrow(lean(run), words.schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit on at most ``rows`` labelled rows of docs, taken by a hash of the id; whatever was left out of labels is not learned from.

    Rows whose label is null or whose id is unknown to docs are passed over; null texts count as empty.  Without
    labels of both kinds there is no lexicon, and every text scores alike.
    """
    known = labels.select(F.col(id_column).alias("__id"), F.col(label_column).cast("int").alias("toxic")).filter("__id is not null and toxic in (0, 1)")
    known = known.groupBy("__id").agg(F.max("toxic").alias("toxic"))
    known = written(known.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(rows), "toxic-labels")  # bounded, so it is broadcast
    sample = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    sample = written(sample.select("doc_id", "text", "toxic", F.pmod(F.xxhash64(F.lit(7), F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold")), "toxic-sample")
    n = np.zeros((2, FOLDS))
    for r in sample.groupBy("toxic", "fold").count().collect():
        n[1 - r.toxic, r.fold] = r["count"]
    if not n.sum(1).all():
        return Model({})
    words = written(word_counts(sample), "toxic-words")
    often = sum((F.col(c) for c in COUNTS), F.lit(0)) >= LEAST_DOCS
    tested = max(2, words.filter(often).count())
    least_ratio = 2 * math.log(tested)
    has_toxic = sum((F.col(f"toxic{f}") for f in range(FOLDS)), F.lit(0)) >= LEAST_DOCS
    # words of enough toxic documents, and more of them than chance puts there: bounded by the sample, and of the words tested few
    share = float(n[0].sum() / n.sum())
    rows = words.filter(has_toxic & (sum((F.col(f"toxic{f}") for f in range(FOLDS)), F.lit(0)) > 2 * share * sum((F.col(c) for c in COUNTS), F.lit(0)))).collect()
    names, table = [r.word for r in rows], np.array([[r[c] for c in COUNTS] for r in rows], float).reshape(-1, 2, FOLDS)

    def lexicon(without: int | None) -> dict[str, float]:
        used = [f for f in range(FOLDS) if f != without]
        (a, b), (toxic, clean) = table[:, :, used].sum(2).T, n[:, used].sum(1)
        if not toxic or not clean:
            return {}
        expected = (a + b) / (toxic + clean)
        part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0.0)
        ratio = 2 * (part(a, expected * toxic) + part(b, expected * clean) + part(toxic - a, (1 - expected) * toxic) + part(clean - b, (1 - expected) * clean))
        odds = np.log((a + 0.5) / (toxic - a + 0.5)) - np.log((b + 0.5) / (clean - b + 0.5))
        ok = (a >= LEAST_DOCS) & (odds >= LEAST_ODDS) & (ratio >= least_ratio)
        # a term that is as rare among clean texts as the sample can tell, counts in full
        return {names[k]: min(1.0, odds[k] / 5.0) * (1 - math.exp(-ratio[k] / 20)) for k in np.flatnonzero(ok)}

    terms = lexicon(None)
    if not terms:
        return Model({})
    others = [lexicon(f) for f in range(FOLDS)]
    every = Model(dict.fromkeys({w for t in (terms, *others) for w in t}, 1.0))
    clean_words = sum((F.col(f"clean{f}") for f in range(FOLDS)), F.lit(0)) >= 1
    near = near_terms(words.filter(clean_words).repartition(partitions(docs.sparkSession)), every).collect()
    clean = lambda r, without: sum(r[f"clean{f}"] for f in range(FOLDS) if f != without)
    toxic = lambda r, without: sum(r[f"toxic{f}"] for f in range(FOLDS) if f != without)
    alike = lambda without: frozenset(r.word for r in near if clean(r, without) >= max(1, toxic(r, without)))
    model = Model(terms, alike(None))
    folds = docs.sparkSession.sparkContext.broadcast([Model(t, alike(f), memo_tokens=MEMO_TOKENS // FOLDS) for f, t in enumerate(others)])  # words of SAMPLE_ROWS rows at most

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["toxic", "n", *[f"{kind}{k}" for k in range(4) for kind in ("w", "h")]]
        for texts, marks, of in rows_of(batches, ["text", "toxic", "fold"]):
            out = []
            for text, mark, fold in zip(texts, marks, of):
                hits, size = folds.value[fold].hits(text)
                out.append([mark, size, *[x for c in PRIOR for x in (sum(w for w, k in hits if k == c), sum(k == c for _, k in hits))]])
            yield pa.RecordBatch.from_arrays([pa.array([float(x) for x in column], pa.float64()) for column in zip(*out)], names) if out else pa.RecordBatch.from_pydict({k: pa.array([], pa.float64()) for k in names})

    schema = ", ".join(f"{x} double" for x in ["toxic", "n", *[f"{kind}{k}" for k in range(4) for kind in ("w", "h")]])
    table = np.array(sample.mapInArrow(lean(evidence), schema).collect(), float).reshape(-1, 10)  # at most ``rows`` rows of numbers
    mark, size = table[:, 0], table[:, 1]
    base = n[1].sum() / n[0].sum()
    for k, c in enumerate(PRIOR):
        a, b = table[mark == 1, 3 + 2 * k].sum(), table[mark == 0, 3 + 2 * k].sum() * min(base, 1.0)
        model.contexts[c] = PRIOR[c] * (a + PRIOR_HITS) / (a + b + PRIOR_HITS)
    total = sum(table[:, 2 + 2 * k] * model.contexts[c] for k, c in enumerate(PRIOR))
    model.fit = logistic(np.log1p(total), np.log1p(100 * total / np.maximum(20, size)), mark)
    return model


def logistic(a: np.ndarray, b: np.ndarray, mark: np.ndarray, penalty: float = 1e-2) -> tuple[float, float, float]:
    """Weights of (1, a, b) by Newton's method with a ridge; a and b never count against toxicity."""
    use = [True, True, True]
    while True:
        x = np.column_stack([np.ones_like(a), a, b])[:, use]
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            hessian = x.T @ (x * (p * (1 - p))[:, None]) + penalty * np.eye(len(w))
            step = np.linalg.solve(hessian, x.T @ (mark - p) - penalty * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        full = np.zeros(3)
        full[np.array(use)] = w
        bad = [k for k in (1, 2) if full[k] < 0]
        if not bad:
            return tuple(full.tolist())
        use[min(bad, key=lambda k: full[k])] = False


def scores(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its text alone; null counts as empty.  No shuffle.

    Repeated rows each have their row; other columns are not read; no rows: no rows.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = to_arrow_type(source.schema["doc_id"].dataType)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of SAMPLE_ROWS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for ids, texts in rows_of(batches, ["doc_id", "text"]):
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([score(x) for x in texts], pa.float64())], ["doc_id", "score"])

    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """docs without the rows that score ``threshold`` or more; columns, whatever they are called, as they were.  No shuffle.

    A null text scores as an empty one; repeated rows share their fate; ids are not looked at; no rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield part.filter(pa.array([score(x) < threshold for x in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
