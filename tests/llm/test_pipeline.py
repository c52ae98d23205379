import re

import corpus_pipeline
from quarry.llm import decontam, token_files
from quarry.llm.common import written
from tests.llm.test_ngram_join import brute
from tests.llm.test_token_files import expected


def test_stages(spark, data):
    """Each stage on what the one before kept, held against brute force on its own input."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], data), "test-stage"))
        assert kept[-1].columns == columns
    ids = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept]
    assert names == ["toxicity", "near_copies", "decontamination", "mixing", "tokens"]

    toxic = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").filter("toxic = 1").collect()}
    insult = re.compile(r"\b(idiot|moron|scum|stupid|trash|clown|loser|pathetic|worthless|disgusting)\b", re.I)
    gone = set(ids[0]) - set(ids[1])
    assert {i for i, t in ids[0].items() if insult.search(t or "")} <= gone
    assert len(gone - toxic) <= 0.2 * len(ids[0])

    groups = brute(list(ids[1].items()), 5, 80)
    assert set(ids[2]) == {i for i, (n, c) in groups.items() if i == c}

    bad = {r["doc_id"] for r in decontam.contained_items(kept[2], spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert set(ids[3]) == set(ids[2]) - bad
    assert set(ids[4]) <= set(ids[3])

    rows = sorted((r["doc_id"], r["text"]) for r in kept[4].collect())
    got = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, kept[4], data).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    assert token_files.BLOCK > 0


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
