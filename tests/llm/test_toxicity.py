import time
import zlib

import numpy as np
import pytest

from quarry.llm import toxicity as tox


def said(text):
    classes = tox._Classes({f"={w}": 0.9 for w in tox.INSULTS})
    return dict(zip((*tox.KINDS, "heaviest", "clauses"), tox.counts(text, classes, tox.grammar()), strict=True))


@pytest.mark.parametrize(
    ("text", "kind"),
    [("what an idiot", "insult"), ("You are an idiot", "aimed"), ("you are not an idiot", "negated"), ("They said he is a moron", "told"), ('the sign read "idiot"', "told"), ("I will kill you", "threat"), ("you die, we kill it", "threat")],
)
def test_grammar(text, kind):
    got = said(text)
    assert got[kind] > 0 and sum(got[k] > 0 for k in tox.KINDS) == 1


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("You aren’t an idiot", "negated"), ('A 5" pipe. You are an idiot.', "aimed"), ('A pipe" here. You are an idiot.', "aimed"), ("He said: you are an idiot", "told"),
        ('"a stray mark\nYou idiot', "aimed"), ('"' + "word " * 70 + "you idiot", "aimed"), ("„Du idiot“ rief er", "told"), ("“You idiot”, he went on", "told"), ("«tu idiot» dit-il", "told"),
        ("Du bist kein idiot", "negated"), ("Ich werde dich töten", "threat"), ("te voy a matar", "threat"), ("sin idiot", "negated"),
    ],
)
def test_marks_and_languages(text, kind):
    got = said(text)
    assert got[kind] > 0 and sum(got[k] > 0 for k in tox.KINDS) == 1


def test_long_texts_take_linear_time():
    began = time.perf_counter()
    for piece in ("idiot ", '"', "a'", "you not ", "“", "\n", "killyou", ":"):
        said(piece * (500_000 // len(piece)))
    assert time.perf_counter() - began < 60


def test_scores_against_counting_by_hand(spark):
    """Without usable labels the model is that of the fixed words: each score is the logistic of the counts, row by row, in any order."""
    texts = [None, "", "you idiot", "you are not an idiot", "kill you", "word " * 50, "idiot"] * 2
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, words string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tox.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in tox.toxicity(docs, labels).collect()}
    for i, t in enumerate(texts):
        x = np.log1p(list(said(t or "").values()))
        z = np.append(x, list(said(t or "").values())[-2]) @ model.weights[:-1] + model.weights[-1]
        assert np.isclose(got[i], 1 / (1 + np.exp(-z)))
    kept = tox.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i] < 0.5}


def test_clauses_end_what_reaches():
    assert said("He is not. Idiot")["insult"] > 0
    assert said("They said so. Idiot")["insult"] > 0
    assert said("kill the process")["clauses"] == 0
    assert said("idiot. fool, fool. fine")["clauses"] == 2


def test_held_out_accuracy(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = {r["doc_id"]: r for r in tox.toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    truth = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([p == t for p, t in truth]) >= 0.97
    assert np.mean([p for p, t in truth if t]) >= 0.75


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "you idiot", "b"), (3, "", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = tox.toxicity(docs, labels).collect()
    assert sorted((str(r["doc_id"]), r["predicted"]) for r in rows) == [("1", 0), ("1", 0), ("3", 0), ("None", 1)]
    assert tox.toxicity(docs.filter("false"), labels).count() == 0
    assert sorted(str(r["doc_id"]) for r in tox.without_toxic(docs, labels).collect()) == ["1", "1", "3"]
    assert tox.without_toxic(docs, labels).columns == docs.columns


def test_texts_of_equal_extremes_all_give_evidence(spark):
    # a long shared vocabulary, so that nearly all texts have the smallest and the largest word hash in common
    names = ["".join(chr(97 + int(c)) for c in f"{i:04d}") for i in range(300)]
    base = " ".join(f"w{x}" for x in names)
    rows = [(base + " zorblat " + x, 1) for x in names[:40]] + [(base + " plain " + "q" + x, 0) for x in names]
    rows = [(text.replace("w" + names[i % 300], "x" + names[i % 300]), toxic) for i, (text, toxic) in enumerate(rows)]
    assert tox.learned_words(spark.createDataFrame(rows, "text string, toxic int"))["=zorblat"] > 0.95


def test_a_word_set_is_toxic_if_one_label_says_so(spark):
    for order in ((0, 1), (1, 0)):
        rows = [(f"vile{chr(97 + i)} zorblat", toxic) for i in range(20) for toxic in order] + [(f"fine{chr(97 + i // 26)}{chr(97 + i % 26)}", 0) for i in range(200)]
        assert "=zorblat" in tox.learned_words(spark.createDataFrame(rows, "text string, toxic int").coalesce(1))
