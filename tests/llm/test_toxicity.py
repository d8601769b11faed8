import random

import pytest
from pyspark.sql import functions as F

from noticelake.llm._shared import crc_mod
from noticelake.llm.toxicity import Lexicon, Model, context, edits_for, reject, scores, train


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automata_against_distances():
    rng = random.Random(6)
    terms = {"".join(rng.choice("abcd") for _ in range(rng.randint(3, 13))): rng.choice([0.85, 0.95, 1.0]) for _ in range(150)}
    lexicon = Lexicon(terms)
    for _ in range(1500):
        token = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
        near = min(((distance(token, t), -w, t) for t, w in terms.items() if 0 < edits_for(len(t)) >= distance(token, t)), default=None)
        expected = (token, 0) if token in terms else (near[2], near[0]) if near and len(token) >= 4 else None
        assert lexicon.search(token) == expected


def test_context():
    tokens = 'he said the word "moron" is rude'.split()
    assert context(tokens, 4) == (True, True)
    assert context("you are a moron".split(), 3) == (False, False)
    assert context('"fine" said moron'.split(), 2) == (False, True)


def corpus(n=900):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "dap") for c in ("", "en", "ig")]
    rows, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(3, 6) * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["moronic", "worthless", "Scumbag!"]))
        rows.append((k, " ".join(text), 0.5))
        labels.append((k, toxic, 1))
    return rows, labels


@pytest.fixture(scope="module")
def data(spark):
    rows, labels = corpus()
    rows += [(5000, None, 0.0), (5001, "", 0.0), (5002, "you morronic wortless thing, wortless and moronicc, you worthles one", 0.0), (5002, "x", 0.0), (5003, 'the report said: "moronic" was the word he called it; others wrote kind words ' + "karen " * 40, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int"), dict((k, t) for k, t, _ in labels)


def test_held_out(data):
    docs, labels, truth = data
    model = train(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    found = scores(docs, model).withColumn("held", crc_mod("doc_id", 3) == 1).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held and r.doc_id in truth]
    assert sum((r.score >= 0.7) == truth[r.doc_id] for r in held) / len(held) > 0.97
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append(r.score)
    assert got[5000][0] < 0.3 and got[5001] == got[5000] and max(got[5002]) >= 0.7 and got[5003][0] < 0.7
    left = reject(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in found if r.score < 0.7}


def test_without_labels_or_rows(spark, data):
    docs, labels, _ = data
    model = train(docs, labels.filter("false"))
    assert model.terms == {} and {r.score for r in scores(docs, model).collect()} == {Model({}).score("")}
    assert train(docs, labels.withColumn("toxic", F.lit(None).cast("int"))).terms == {}
    assert scores(docs.limit(0), model).collect() == [] and reject(docs.limit(0), model).collect() == []


def test_misspellings_of_terms_that_clean_texts_quote():
    """A term that counts for less than 0.9 is sought misspelled like any other, unless the misspelling is a look-alike."""
    for weight in (0.7, 0.8, 0.89):
        model = Model({"dreadful": weight, "abominable": weight}, frozenset({"dreadfuls"}))
        assert model.weight("dreadfol") == weight * 0.5 and model.weight("abominabel") == weight * 0.25
        assert model.weight("dreadfuls") == 0.0 and model.weight("dread") == 0.0
        assert model.score("you dreadfol dreadfol dreadfol one") > Model({}).score("you dreadfol dreadfol dreadfol one")


def test_all_terms_against_distances():
    """Long terms beside short ones."""
    rng = random.Random(8)
    terms = {"".join(rng.choice("abc") for _ in range(rng.choice([5, 7, 9, 10, 12, 30, 31, 40]))): rng.choice([0.72, 0.8, 1.0]) for _ in range(150)}
    lexicon = Lexicon(terms)
    assert set(lexicon.tries) == {1, 2}
    for _ in range(1000):
        token = list(rng.choice(sorted(terms)))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(token))
            token[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "d"])
        token = "".join(token)
        near = min(((distance(token, t), -w, t) for t, w in terms.items() if abs(len(t) - len(token)) <= 2 and edits_for(len(t)) >= distance(token, t)), default=None)
        assert lexicon.search(token) == ((token, 0) if token in terms else (near[2], near[0]) if near and len(token) >= 4 else None)
