import random
import re

import pytest

from quarry.llm import ngram_join

SCHEMA = "doc_id long, text string, component_id string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, width, percent):
    """doc_id -> (n_shingles, component_id), by all pairs."""
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    head = {i: i for i in sets}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                head[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(spark, rows, width, percent):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    out = ngram_join.similar_groups(df, width=width, percent=percent).collect()
    assert len(out) == len(rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}


def corpus(seed):
    """A cluster of near copies from one to many edits, a shared passage, short texts and repeats."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    origin, passage = [word() for _ in range(80)], [word() for _ in range(50)]
    texts = []
    for _ in range(160):
        copy = list(origin)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            copy[r.randrange(len(copy))] = r.choice([word(), "same"])
        texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(r.randrange(40))] + passage) for _ in range(60)]
    texts += [" ".join(word() for _ in range(r.randrange(1, 6))) for _ in range(20)]
    texts += ["", None, " \t\n", "One two", "one  TWO", "É two", "é two", "one two"]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_against_all_pairs(spark, width, percent):
    rows = corpus(width)
    assert found(spark, rows, width, percent) == brute(rows, width, percent)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(ngram_join, "BLOCK_QUERIES", 7)
    rows = corpus(11)
    assert found(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_driver_rows(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(df, width=3, percent=90).collect()}
    assert out == brute(rows, 3, 90)


def test_nulls_repeats_and_empty_tables(spark):
    same = "a b c d e f g"
    df = spark.createDataFrame([(5, same, "q"), (5, same, "q"), (5, "other words than these ones", "q"), (None, same, "q"), (None, "alone in the world it is", "q"), (2**60 + 1, "", "q")], SCHEMA)
    out = sorted(map(tuple, ngram_join.similar_groups(df).collect()), key=str)
    assert out == sorted([(5, 3, 5), (5, 3, 5), (5, 1, 5), (None, 3, 5), (None, 2, None), (2**60 + 1, 0, 2**60 + 1)], key=str)
    assert ngram_join.similar_groups(df.filter("false")).count() == 0
    assert ngram_join.one_per_group(df.filter("false")).count() == 0


def test_one_per_group_keeps_all_columns(spark):
    rows = [(3, "a b c d e f g h i j k l", "x"), (1, "a b c d e f g h i j k l", "y"), (2, "nothing like it at all here", "z"), (4, None, "n"), (None, "a b c d e f g h i j k l", "m")]
    kept = ngram_join.one_per_group(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "None"]


def test_one_per_group_keeps_different_texts_of_one_id(spark):
    copied, own, third = "a b c d e f g h i j k l", "nothing like it at all here", "some words that are still other ones"
    rows = [(1, copied, "x"), (5, copied, "x"), (5, own, "x"), (5, third, "x"), (5, third, "y"), (5, "", "x"), (5, None, "x"), (5, "short one", "x"), (7, own, "x")]
    for order in (rows, rows[::-1]):
        kept = ngram_join.one_per_group(spark.createDataFrame(order, SCHEMA)).collect()
        assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, copied), (5, ""), (5, own), (5, "short one"), (5, third)]


def test_one_per_group_keeps_one_of_near_copies_of_one_id(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(3, words, "x"), (3, words + " more", "x"), (4, words, "x")]
    assert [r["doc_id"] for r in ngram_join.one_per_group(spark.createDataFrame(rows, SCHEMA)).collect()] == [3]
