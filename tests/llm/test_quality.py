import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarry.llm import quality as q


def test_views_teach_each_other():
    """Few labels for one view's features: the other view's surest rows fill the gap."""
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 3000).astype(float)
    a = np.column_stack([y * 2 + r.normal(0, 0.6, 3000), r.normal(0, 1, (3000, 30))])
    b = np.column_stack([y + r.normal(0, 0.7, 3000), r.normal(0, 1, (3000, 30))])
    few = slice(0, 60)
    alone = q.co_train(a[few], b[few], y[few], a[:0], b[:0])
    both = q.co_train(a[few], b[few], y[few], a[60:2000], b[60:2000])
    right = lambda m: np.mean((m.page.raw(b[2000:]) > 0) == y[2000:])
    assert both.exchanged > 100 and alone.exchanged == 0
    assert right(both) > right(alone)


def test_held_out_accuracy(spark, data):
    data = data.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = {r["doc_id"]: r for r in q.quality(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    truth = [(got[r["doc_id"]]["keep"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    bad = [k for k, t in truth if not t]
    print("accuracy", np.mean([k == t for k, t in truth]), "bad kept", np.mean(bad), len(bad))
    assert np.mean([k == t for k, t in truth]) >= 0.95


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 1.0), (2, "a b", "en", "s", 3, 2.0), (None, "", "en", "s", 0, 2.0), (2, "a b", "en", "s", 3, 2.0)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = q.quality(docs, labels).collect()
    assert len(rows) == 4 and all(r["keep"] for r in rows)
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(2, 1, 0)], "doc_id long, quality int, toxic int")
    assert q.quality(docs, both).count() == 4
    assert q.quality(docs.filter("false"), labels).count() == 0
    assert q.good(docs, labels).columns == docs.columns


def quality_rows(spark, n, repeated=0):
    """n unlabelled rows, ids from 1000; ``repeated`` labelled rows of id 0; 200 labelled rows."""
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("A clean line of plain words, no "), F.col("id"), F.lit(".\nAnd a second one."))).otherwise(F.concat(F.lit("BUY!!! $$$ "), F.col("id"), F.lit(" ### WIN WIN")))
    ids = spark.range(200).select("id", F.col("id").alias("doc_id")).union(spark.range(n).select("id", (F.col("id") + 1000).alias("doc_id"))).union(spark.range(repeated).select((F.col("id") * 2).alias("id"), F.lit(0).alias("doc_id")))
    docs = ids.select("doc_id", text.alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("xx").alias("lang"), F.lit("s").alias("source"), (F.col("id") % 97).alias("n_chars"))
    return docs, spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("quality"))


def test_all_unlabelled_rows_are_exchanged(spark):
    model = q.fit(*quality_rows(spark, 60_000))
    # at most a tenth of the rows a round for each view; of a pool of 20,000 it would be 16,000 in all
    assert 30_000 < model.exchanged <= 48_000


def test_repeated_labelled_id_is_sampled(spark, monkeypatch):
    met = []
    fitted = q.View.fitted
    monkeypatch.setattr(q.View, "fitted", staticmethod(lambda x, y: met.append(len(x)) or fitted(x, y)))
    q.fit(*quality_rows(spark, 100, repeated=30_000), limit=2_000)
    assert 0 < max(met) < 2_600


def test_sums_give_the_views_of_local_rows(spark):
    r = np.random.default_rng(5)
    pool = pd.DataFrame({f"a{i}": r.normal(0, 1, 900) for i in range(13)} | {f"b{i}": r.normal(0, 1, 900) for i in range(3)} | {"lang": r.integers(0, 4, 900), "source": r.integers(0, 9, 900), "draw": r.random(900)})
    a, b = q._rows(pool)
    y = (a[:, 0] + b[:, 0] + r.normal(0, 0.3, 900) > 0).astype(float)
    x, views = (a[300:], b[300:]), [q.View.fitted(a[:300], y[:300]), q.View.fitted(b[:300], y[:300])]
    rules = [q.Given(k, views[k], (np.arange(q.BINS) > q.BINS * 0.52) * 1.0, (np.arange(q.BINS) < q.BINS * 0.47) * 0.5) for k in (0, 1)]
    got, given = q._refitted(spark.createDataFrame(pool[300:]), rules, (a[:300], b[:300]), y[:300], views)
    taken = q._taken(x, pool["draw"].to_numpy()[300:], rules)
    assert given == sum((k >= 0).sum() for k in taken) > 200
    for v, own, f, k in zip(got, (a[:300], b[:300]), x, taken, strict=True):
        want = q.View.fitted(np.vstack([own, f[k >= 0]]), np.concatenate([y[:300], k[k >= 0]]))
        assert np.allclose(v.raw(f), want.raw(f), atol=1e-5)


def test_order_and_partitions_do_not_matter(spark, data):
    """The same scores for the same rows, repeated ones too, in whatever order and tasks they come."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    docs = docs.union(docs.filter("doc_id < 20"))
    shown = lambda df: sorted(tuple(r) for r in q.quality(df, labels).select("doc_id", "content_score", "metadata_score", "score").collect())
    one, other = shown(docs.coalesce(1)), shown(docs.orderBy(F.desc("n_chars")).repartition(7, "text"))
    assert len(one) == docs.count() and [r[0] for r in one] == [r[0] for r in other]
    assert np.abs(np.array([r[1:] for r in one]) - np.array([r[1:] for r in other])).max() < 1e-6


def test_sums_in_a_tree(spark, monkeypatch):
    """More tasks than are added up at once."""
    docs, labels = quality_rows(spark, 3_000)
    whole = [r["score"] for r in q.quality(docs.coalesce(1), labels).orderBy("doc_id").collect()]
    monkeypatch.setattr(q, "FAN", 2)
    assert np.allclose([r["score"] for r in q.quality(docs.repartition(11), labels).orderBy("doc_id").collect()], whole, atol=1e-6)


def test_metadata_view_never_reads_the_text(spark):
    docs, labels = quality_rows(spark, 100)
    model = q.fit(docs, labels)
    page = model.page.column(q.metadata(F.col("lang"), F.col("source"), F.col("n_chars")))
    assert docs.drop("text").select(page.alias("x")).count() == docs.count()
