import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import toxicity as X
from tallyframe.llm.disguise import tokens


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("You id[b]io[/b]t!", ["you", "idiot"]),
        ("you 1d10t", ["you", "idiot"]),
        ("i-d-i-o-t i.d.i.o.t", ["idiot", "idiot"]),
        ("an іdіоt, id​iot", ["an", "idiot", "idiot"]),
        ("i d i o t", ["idiot"]),
        ("idiooooot", ["idiot"]),
        ("$tup1d @$$", ["stupid", "ass"]),
        ("i***t", ["i*t"]),
        ("wÃ¼rde würde", ["wurde", "wurde"]),
        ("42.4 on 17/9", ["#", "on", "#", "#"]),
        ("it's &nbsp;fine", ["its", "fine"]),
    ],
)
def test_disguises(text, want):
    assert [t for t in tokens(text) if t != "."] == want


def test_tokens_of_odd_texts():
    assert tokens(None) == ["."] and tokens("") == ["."] and tokens("...") == ["."]
    assert len(tokens("a" * 200_000)) == 3
    assert len(tokens("word. " * 50_000)) == 100_001


def brute(values):
    """Recursively: the best segment, then those left and right of it."""
    best = None
    for i in range(len(values)):
        total = 0
        for j in range(i, len(values)):
            total += values[j]
            if total > 0 and (best is None or total > best[0] or total == best[0] and (j + 1 - i) < best[2] - best[1]):
                best = (total, i, j + 1)
    if best is None:
        return []
    left = brute(values[: best[1]])
    right = [(s, a + best[2], b + best[2]) for s, a, b in brute(values[best[2] :])]
    return [*left, best, *right]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-1000, 1000).filter(bool), max_size=25))
def test_all_maximal_segments(values):
    values = [v * 1.0 + i * 1e-4 for i, v in enumerate(values)]
    got = X.maximal_segments(values)
    want = brute(values)
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
    assert all(abs(g[0] - w[0]) < 1e-6 for g, w in zip(got, want))


PLAIN = [
    "The mount is noisy today.", "I cleaned the old kiln in the rain.", "Which oven do you use?",
    "My neighbour keeps the wax behind a heavy wheel.", "Shut up the shed for the night.",
    "That was a stupid mistake of mine.",
]
NASTY = ["Shut up you stupid {}.", "Everybody here knows you are a {}.", "Go home you filthy {}."]
NAMES = ["moron", "clown", "pig", "maggot", "parasite"]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth, labels = [], {}, []
    for i in range(n):
        bad = rng.random() < 0.15
        sentences = [rng.choice(PLAIN) for _ in range(rng.randint(1, 5))]
        if bad:
            name = rng.choice(NAMES)
            name = rng.choice([name, name[0] + "​" + name[1:], name.replace("o", "0"), name.upper()])
            sentences.insert(rng.randint(0, len(sentences)), rng.choice(NASTY).format(name))
        docs.append((i, " ".join(sentences), rng.choice(["s", "t", None])))
        truth[i] = bad
        if rng.random() < 0.6:
            labels += [(i, r, int(bad != (rng.random() < 0.05))) for r in ("r1", "r2")[: rng.randint(1, 2)]]
    return docs, truth, labels


def test_held_out(spark):
    docs, truth, labels = corpus(1500, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    lab = spark.createDataFrame([*labels, (None, "r", 1), (10**9, "r", 1), (0, "r", None), (0, "r", 7)], "doc_id long, rater string, label int")
    model = X.fit(df, lab)
    fresh, actual, _ = corpus(600, 2)
    fresh += [(10_000, None, "s"), (10_001, "", "s")]
    out = X.score_documents(spark.createDataFrame(fresh, "doc_id long, text string, source string"), model, keep=["source"]).cache()
    got = {r.doc_id: r for r in out.collect()}
    hit = sum(got[i].flagged for i, b in actual.items() if b)
    wrong = sum(got[i].flagged for i, b in actual.items() if not b)
    assert hit >= 0.95 * sum(actual.values()) and wrong <= 3
    assert not got[10_000].flagged and got[10_001].score == 0
    rates = {r.source: r for r in X.source_rates(out).collect()}
    assert set(rates) == {"s", "t", None} and sum(r.docs for r in rates.values()) == len(fresh)


def test_no_votes(spark):
    df = spark.createDataFrame([(1, "you moron"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, rater string, label int")
    assert X.score_documents(df, X.fit(df, none)).where("flagged").count() == 0
    assert X.score_documents(df.where("false"), X.fit(df, none)).count() == 0
    with pytest.raises(ValueError):
        X.score_documents(df.withColumnRenamed("doc_id", "score"), X.Model(X.Lookup.of(np.zeros(0, np.uint64), np.zeros(0)), 0.5), ident="score")


def test_unvoted_documents_all_join_in(spark):
    docs, _, labels = corpus(600, 3)
    voted = {i for i, _, _ in labels}
    n = 200
    docs += [(10_000 + i, f"{PLAIN[i % 6]} Shut up you stupid moron. You grobian.", "s") for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, label int")
    s = X.Settings(max_fitted=len(voted))  # leaves no room beside the documents with votes
    read = X.tokenised(df, "doc_id", "text")
    fitted = X.fitting_documents(read, lab, "doc_id", s)
    assert fitted.where("y is null").count() == len(docs) - len(voted)
    assert X.fit(df, lab, settings=s).scores.find(np.array([X.gram_hash("grobian")], np.uint64))[0] > 1
    few = X.fitting_documents(read, lab, "doc_id", X.Settings(max_fitted=50))
    assert few.count() == len(docs) and few.where("y is not null").count() < 100


def test_grams_and_lookup():
    words = "a b c a b".split()
    h = np.array([X.word_hash(w) for w in words + ["x"] + words[:2]], np.uint64)
    (_, one), (at2, two), (at3, three) = X.grams(np.array([0, 5, 6, 8]), h)
    assert at2.tolist() == [1, 2, 3, 4, 7] and at3.tolist() == [2, 3, 4]
    assert two[0] == two[3] == two[4] == X.gram_hash("a b") and three[0] == X.gram_hash("a b c") and len(set(three.tolist())) == 3
    assert one.tolist() == h.tolist()
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 5000, np.uint64))
    table = X.Lookup.of(keys[::2], np.arange(len(keys[::2])) / 7)
    got = table.find(keys)
    assert np.allclose(got[::2], np.arange(len(keys[::2])) / 7, atol=1e-4) and np.isnan(got[1::2]).all()
    assert np.isnan(X.Lookup.of(np.zeros(0, np.uint64), np.zeros(0)).find(keys)).all()


def test_a_toxic_document_without_known_words_is_no_evidence_against():
    h = np.array([X.word_hash(w) for w in "entirely unknown words here".split()], np.uint64)
    none = X.Lookup.of(np.zeros(0, np.uint64), np.zeros(0))
    at, y = np.array([0, 4]), np.array([0.9])
    assert np.allclose(X.token_weights(at, h, y, X.SEGMENTS, none, X.Settings()), 0.9)
    assert np.allclose(X.token_weights(at, h, y, X.SEGMENTS, none, X.Settings(passage=2.0)), 0.45)
    assert np.allclose(X.token_weights(at, h, np.array([0.05]), X.SEGMENTS, none, X.Settings()), 0)
