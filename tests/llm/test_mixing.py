import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing


@pytest.fixture(scope="module")
def tables(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")


def test_totals_meet_targets_as_plain_least_squares(tables):
    """The same fit by numpy over all rows: nonnegative rates, domain totals at their targets."""
    docs, labels = tables
    domains, scored, rates = mixing.fitted(docs, labels)
    rows = scored.select("tokens", "p", rates.of().alias("rate")).collect()
    t, p, rate = (np.array([r[k] for r in rows], float) for k in ("tokens", "p", "rate"))
    assert (rate >= 0).all() and np.allclose(p.sum(1), 1)
    for d, name in enumerate(domains.names):
        told = rates.report[name]
        assert np.isclose((t * rate * p[:, d]).sum(), told["fitted"], rtol=1e-6)
        assert abs(told["fitted"] - told["target"]) <= 2e-4 * sum(x["target"] for x in rates.report.values())
    a, x = p * t[:, None] / rates.mean, np.ones(len(t))
    target = np.array([rates.report[n]["target"] for n in domains.names]) / rates.mean
    step = np.linalg.pinv(a.T @ a, rcond=1e-10, hermitian=True)
    for _ in range(len(rates.steps)):
        x = np.maximum(0, x + a @ (step @ (target - a.T @ x)))
    assert np.allclose(x, rate, atol=1e-6)


def test_weights_are_followed(tables):
    docs, labels = tables
    domains, _, even = mixing.fitted(docs, labels)
    weights = {n: 1.0 for n in domains.names}
    _, scored, rates = mixing.fitted(docs, labels, weights=weights)
    totals = np.array([x["fitted"] for x in rates.report.values()])
    assert totals.std() / totals.mean() < 0.02


def test_copies_follow_rates(tables):
    docs, labels = tables
    out = mixing.mixed(docs, labels)
    assert out.columns == docs.columns
    n = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    rate = {r["doc_id"]: r["rate"] for r in mixing.mixed_rates(docs, labels).collect()}
    assert all(np.floor(rate[i]) <= n.get(i, 0) <= np.ceil(rate[i]) for i in rate)
    assert abs(sum(n.values()) - sum(rate.values())) < 0.05 * sum(rate.values())


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "en", 9.0), (1, "", "en", 9.0), (None, "a b", None, 9.0)], "doc_id long, text string, lang string, tokens double")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mixed_rates(docs, labels).collect()
    assert sorted((r["tokens"], r["domain"]) for r in rows) == [(0, "all"), (0, "all"), (2, "all")]
    assert mixing.mixed(docs, labels).count() == 3
    assert mixing.mixed(docs, labels).columns == docs.columns
    assert mixing.mixed_rates(docs.filter("false"), labels).count() == 0
    assert mixing.mixed(docs.filter("false"), labels).count() == 0


def test_posteriors_on_held_out_labels(spark, data):
    """Fitted on four fifths of the labelled rows, the likeliest domain is right for nearly all of the rest, rare poor ones too."""
    data = data.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = mixing.labelled_rows(docs, labels).withColumn("domain", mixing.quality_domain("lang", "__quality"))
    domains = mixing.Domains.fitted(rows.filter("doc_id % 5 <> 0"), F.col("domain"))
    found = domains.scored(rows.filter("doc_id % 5 = 0")).select("domain", "p").collect()
    right = [(r["domain"], domains.names[int(np.argmax(r["p"]))] == r["domain"]) for r in found]
    assert len(right) > 500 and np.mean([x for _, x in right]) >= 0.97
    assert np.mean([x for d, x in right if d.endswith("poor")]) >= 0.9
    assert min(np.mean([x for d, x in right if d == n]) for n in domains.names) >= 0.7
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in found)


def test_order_of_rows_and_ties(spark):
    """Equal texts under two labels are equally likely both; the result does not depend on the order of rows."""
    rows = [(i, t, "en") for i, t in enumerate(["one two three", "%% ## &&", "one two three", "%% ## &&"] * 3)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(8)] + [(8, 0), (8, 1)], "doc_id long, quality int")
    take = lambda r: sorted(map(tuple, mixing.mixed_rates(spark.createDataFrame(r, "doc_id long, text string, lang string"), labels).collect()))
    assert take(rows) == take(rows[::-1])


def test_rates_that_do_not_settle_are_told(tables):
    docs, labels = tables
    domains, scored, _ = mixing.fitted(docs, labels)
    with pytest.warns(UserWarning, match="did not settle"):
        assert not mixing.fit_rates(scored, domains.names, rounds=0).settled
