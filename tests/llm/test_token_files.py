import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import id_coder
from quarry.llm import token_files as tf


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 50_000])
@pytest.mark.parametrize("kind", ["skewed", "flat", "same", "copies"])
def test_round_trip(n, kind):
    r = np.random.default_rng(n)
    ids = {"skewed": np.minimum(r.zipf(1.3, n), 50_256), "flat": r.integers(0, 50_257, n), "same": np.full(n, 7), "copies": np.tile(r.integers(0, 50_257, 60), n // 60 + 1)[:n]}[kind]
    raw = tf.encode(ids)
    assert (tf.decode(raw, n) == ids).all()
    if n == 50_000 and kind in ("same", "copies"):
        assert len(raw) < n


def test_mixing_learns_from_contexts():
    """Ids that follow from the last two cost far less than their shares say, in every block; blocks are independent."""
    r = np.random.default_rng(5)
    follow = r.permutation(512)
    ids = np.zeros(40_960, np.int64)
    for i in range(2, len(ids)):
        ids[i] = follow[(ids[i - 1] + 7 * ids[i - 2]) % 512] if r.random() < 0.97 else r.integers(0, 512)
    ids = np.resize(ids[:150], len(ids))
    size = len(tf.encode(ids))
    assert size * 8 < 4 * len(ids)
    noise = r.permutation(ids)
    assert 1.05 * len(tf.encode(noise)) > 7 * len(ids) / 8


def test_an_id_takes_one_step(monkeypatch):
    """However many guesses follow it: a block takes as many steps as it has ids, both ways, and surprises beside sure guesses come back."""
    steps, real = [], id_coder._Model.predict
    monkeypatch.setattr(id_coder._Model, "predict", lambda self: (steps.append(1), real(self))[1])
    r = np.random.default_rng(3)
    ids = np.resize([7, 7, 9], 5 * id_coder.BLOCK + 100)
    ids[r.choice(len(ids), 300, replace=False)] = r.integers(0, 50_257, 300)
    raw = tf.encode(ids)
    assert len(steps) == id_coder.BLOCK
    assert (tf.decode(raw, len(ids)) == ids).all()
    assert len(steps) == 2 * id_coder.BLOCK


@pytest.mark.parametrize("counts", [[5], [0, 3, 0, 1], [1, 1, 1], [2**40, 1, 1, 1, 0, 7]])
def test_tree_gives_each_id_its_place(counts):
    tree = id_coder._Tree(np.array(counts))
    seen = [i for i, c in enumerate(counts) if c]
    assert sum(tree.size[i] for i in seen) == 1 << id_coder.ID_BITS
    for i in seen:
        node, path = 0, int(tree.path[i])
        while node >= 0:
            assert tree.start[node] <= tree.begin[i] and tree.begin[i] + tree.size[i] <= tree.start[node] + tree.below[node]
            node, path = int(tree.child[2 * node + (path & 1)]), path >> 1
        assert ~node == i and (tree.slots()[tree.begin[i] % (1 << id_coder.ID_BITS)] == i)


def test_damage_is_found():
    raw = bytearray(tf.pack([1, None], [3, 2], np.array([5, 6, 2, 9, 2])))
    assert tf.unpack(bytes(raw))[0] == [1, None]
    for at in (25, 40, len(raw) - 9):
        bad = bytearray(raw)
        bad[at] ^= 0x40
        with pytest.raises(ValueError):
            tf.unpack(bytes(bad))


def expected(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_driver_rows(spark, data, monkeypatch):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    segments = tf.write_tokens(df)
    assert sorted(map(tuple, tf.read_index(segments).collect())) == expected(rows)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["ids"] for r in tf.read_ids(segments).collect()}
    assert all(got[i] == [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in rows[:20])


def test_nulls_ties_and_empty(spark):
    schema = "doc_id long, text string, part string"
    rows = [(None, "a b", "p"), (3, None, "p"), (3, None, "p"), (1, "", "p"), (2**62 + 1, "é 😀", "p")]
    got = sorted(map(tuple, tf.read_index(tf.write_tokens(spark.createDataFrame(rows, schema))).collect()), key=lambda r: r[1])
    assert got == expected([(None, "a b"), (1, ""), (3, None), (3, None), (2**62 + 1, "é 😀")])
    assert tf.read_index(tf.write_tokens(spark.createDataFrame([], schema))).count() == 0


def test_remembered_pre_tokens_give_the_library_s_ids(monkeypatch):
    """Cut, remembered and told apart by line breaks, or left to the library: the same ids."""
    monkeypatch.setattr(tf, "REMEMBERED", 50)
    r = np.random.default_rng(7)
    pieces = ["a", "thon", "É", "ß", " ", "  ", "\n", "\t", "\r\n", "1", "²", "'s", "'", "%%%", ".", "\u00a0", "\x1c", "\x85", "中", "😀", "<|endoftext|>", "\u2019", "ǆ", "ª"]
    texts = ["".join(r.choice(pieces, r.integers(0, 30))) for _ in range(3000)] + ["", "\n", " a\nb", "\n\n a"]
    ids = tf.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(0, len(texts), 100):
        assert [x.tolist() for x in ids.of(texts[i : i + 100])] == ids.whole(texts[i : i + 100])


def test_slots_double_and_words_met_first_are_given_to_the_model_once(monkeypatch):
    monkeypatch.setattr(tf, "SLOT_BITS", 2)
    r = np.random.default_rng(11)
    texts = [" ".join("".join(r.choice(list("abcßéX"), r.integers(1, 6))) for _ in range(200)) + " 12 %% it's\n" for _ in range(20)]
    ids = tf.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    met = []
    for _ in range(2):
        for i in range(0, len(texts), 4):
            assert [x.tolist() for x in ids.of(texts[i : i + 4])] == ids.whole(texts[i : i + 4])
        met.append(ids.sizes.n)
    known = met[0]
    assert met[1] == known and len(np.unique(ids.hashes.data[:known])) == known
    assert len(ids.slot_at) >= 2 * known == 2 * np.count_nonzero(ids.slot_at >= 0)
