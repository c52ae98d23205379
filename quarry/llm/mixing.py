"""Mixing sources to target weights with soft membership.

A multinomial regression fitted on the labelled table gives every document a posterior over domains.
Document rates are the nonnegative least-squares fit of expected domain token totals to
their targets: projected gradient steps from equal rates, in the metric that makes the
step length one. A step needs only one number per domain from the whole corpus, so rates
are never stored between steps: a document's rate is the fold of the few step vectors.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, text_of, written

#: How strongly the classifier's weights are held near nought.
DECAY = 0.5


def features(text: Column) -> Column:
    """(tokens, x): the number of words, and shares of a text that tell languages and junk apart, about 0 to 1 each, with their roots.

    The text is cut to words once; the classes of letters are of one byte each in Latin-1, which Java's patterns look up at once.
    """
    size = F.greatest(F.length(text), F.lit(1)).cast("double")

    def of(words: Column) -> Column:
        n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
        share = [
            F.regexp_count(text, F.lit(r"[àâçèêëîïôùû]")) * 5 / size,
            F.regexp_count(text, F.lit(r"[äöüß]")) * 5 / size,
            F.regexp_count(text, F.lit(r"[ñíóá¿¡]")) * 5 / size,
            F.regexp_count(text, F.lit(r"[tws]h")) * 5 / size,
            F.regexp_count(text, F.lit(r"[A-Z]")) / size,
            F.regexp_count(text, F.lit(r"[!-+/:-@\[-`{-~-]")) / size,
            n_words * 4 / size,
            F.size(F.array_distinct(words)) / n_words,
        ]
        share = [F.least(x, F.lit(1.0)) for x in share]
        x = bound(F.array(*share), lambda x: F.concat(x, F.transform(x, F.sqrt), F.array(F.log1p(n_words) / 10)))
        return F.struct(F.size(F.array_remove(words, "")).cast("double").alias("tokens"), x.alias("x"))

    return bound(F.split(text, SPACE), of)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often body names it, and never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 400, tolerance: float = 1e-5) -> np.ndarray:
    """Ridge multinomial regression (features and a constant by classes), by steps in a fixed metric that bounds the curvature."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros((z.shape[1], classes))
    step = np.linalg.inv(z.T @ z / 2 + DECAY * np.eye(z.shape[1]))
    want = np.eye(classes)[y]
    for _ in range(rounds):
        p = np.exp((u := z @ w) - u.max(1, keepdims=True))
        move = step @ (z.T @ (want - p / p.sum(1, keepdims=True)) - DECAY * w)
        w += move
        if np.abs(move).max() < tolerance:
            break
    w[:-1] /= scale[:, None]
    w[-1] -= mean @ w[:-1]
    return w


@dataclass
class Domains:
    """What the labelled table says: domain names in order, and weights over features (the last for the constant), one column a name."""

    names: list[str]
    weights: np.ndarray | None

    @staticmethod
    def fitted(labelled: DataFrame, domain: Column, text_col: str = "text") -> Domains:
        """From a bounded number of labelled rows. Rows whose domain is null teach nothing; one domain alone takes all."""
        rows = labelled.select(domain.alias("domain"), features(text_of(text_col))["x"].alias("x")).filter(F.col("domain").isNotNull()).collect()
        # in an order of their own, so that the sums do not depend on that of the rows
        found = sorted((r["domain"], r["x"]) for r in rows)
        names = sorted({d for d, _ in found})
        if len(names) < 2:
            return Domains(names or ["all"], None)
        return Domains(names, softmax(np.array([x for _, x in found]), np.array([names.index(d) for d, _ in found]), len(names)))

    def scored(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Add tokens (words) and p (the posterior over names) to the rows."""
        share = self._shares if self.weights is not None else lambda x: F.array(F.lit(1.0))
        both = bound(features(text_of(text_col)), lambda f: F.struct(f["tokens"].alias("tokens"), share(f["x"]).alias("p")))
        names = [F.col(f"`{c}`") for c in docs.columns if c not in ("tokens", "p")]
        return docs.select(*names, both.alias("__both")).select(*names, "__both.*")

    def _shares(self, x: Column) -> Column:
        of = lambda k: sum((F.get(x, F.lit(j)) * float(w) for j, w in enumerate(self.weights[:-1, k])), F.lit(float(self.weights[-1, k])))
        logs = F.array(*[of(k) for k in range(len(self.names))])
        likely = lambda v: bound(F.array_max(v), lambda top: F.transform(v, lambda e: F.exp(e - top)))
        scaled = lambda e: bound(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda z: F.transform(e, lambda v: v / z))
        return bound(logs, lambda v: bound(likely(v), scaled))


def _rate(steps: list[np.ndarray], p: Column, t: Column) -> Column:
    """A document's rate after the steps: each moves it along its own row and cuts it at nought."""
    rate = F.lit(1.0)
    for step in steps:
        moved = sum((F.get(p, F.lit(d)) * float(v) for d, v in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate + moved * t)
    return rate


@dataclass
class Rates:
    """Steps that turn (tokens, p) into a rate, and natural, target and fitted totals by domain."""

    mean: float
    steps: list[np.ndarray]
    report: dict[str, dict[str, float]]
    settled: bool

    def of(self, tokens: str = "tokens", p: str = "p") -> Column:
        return bound(F.struct(F.col(p).alias("p"), (F.col(tokens) / self.mean).alias("t")), lambda s: _rate(self.steps, s["p"], s["t"]))


def _unit(total: float) -> float:
    """Sums are of whole multiples of 1 / unit, so that they do not depend on the order of rows: as fine as 16 times ``total`` has room for in 64 bits."""
    return 2.0 ** min(40, 58 - int(total).bit_length())


def _exact(x: Column, unit: float) -> Column:
    return F.sum(F.rint(x * unit).cast("long"))


def fit_rates(scored: DataFrame, names: list[str], weights: dict[str, float] | None = None, rounds: int = 40, tolerance: float = 1e-4) -> Rates:
    """Fit rates to rows (tokens, p).

    ``weights`` are relative target weights per domain; by default the natural shares to
    the power 0.7, which raises rare domains. The total is the least that thins out no
    domain. Steps stop once every total is within ``tolerance`` of its target; if ``rounds``
    of them don't reach that, ``settled`` is false and a warning tells the totals. Rows without tokens keep rate 1: they weigh nothing.
    """
    n = len(names)
    whole = F.col("tokens").cast("long")
    total, squares, n_rows = scored.agg(F.sum(whole), F.sum((whole * whole).cast("decimal(38,0)")), F.count("tokens")).first()
    mean = (total or 0) / max(n_rows, 1) or 1.0
    unit = _unit(float(squares or 0) / mean**2)
    t = F.col("tokens") / mean
    at = lambda d: F.get("p", F.lit(d)) * t
    pairs = list(itertools.combinations_with_replacement(range(n), 2))
    sums = scored.agg(*[_exact(at(d), unit).alias(f"e{d}") for d in range(n)], *[_exact(at(a) * at(b), unit).alias(f"g{a}_{b}") for a, b in pairs]).first()
    natural = np.array([(sums[f"e{d}"] or 0) / unit for d in range(n)])
    gram = np.zeros((n, n))
    for a, b in pairs:
        gram[a, b] = gram[b, a] = (sums[f"g{a}_{b}"] or 0) / unit
    held = natural > 1e-9
    share = np.array([weights.get(k, 0.0) for k in names]) if weights else np.where(held, natural, 0.0) ** 0.7
    share = np.where(held, share, 0.0)
    share = share / share.sum() if share.sum() > 0 else share
    wanted = share > 0
    target = share * float(np.max(natural[wanted] / share[wanted])) if wanted.any() else natural * 0
    metric = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
    steps: list[np.ndarray] = []
    reached, unit = natural, _unit(max(target.sum(), natural.sum()))
    while len(steps) < rounds and np.max(np.abs(target - reached)) > tolerance * max(target.sum(), 1e-12):
        steps.append(metric @ (target - reached))
        rated = scored.select("p", t.alias("t"), _rate(steps, F.col("p"), t).alias("rate"))
        made = rated.agg(*[_exact(F.get("p", F.lit(d)) * F.col("t") * F.col("rate"), unit).alias(f"e{d}") for d in range(n)]).first()
        reached = np.array([(made[f"e{d}"] or 0) / unit for d in range(n)])
    report = {k: {"natural": natural[d] * mean, "target": target[d] * mean, "fitted": reached[d] * mean} for d, k in enumerate(names)}
    settled = bool(np.max(np.abs(target - reached)) <= tolerance * max(target.sum(), 1e-12))
    if not settled:
        warnings.warn(f"rates did not settle in {rounds} steps: {report}", stacklevel=2)
    return Rates(mean, steps, report, settled)


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a row: the rate rounded up or down by a draw fixed by the row's key."""
    draw = F.pmod(F.xxhash64(key, F.lit("mixing")), F.lit(1_000_003)) / 1_000_003.0
    return bound(rate, lambda r: (F.floor(r) + (draw < r - F.floor(r)).cast("long")).cast("int"))


def quality_domain(lang: str = "lang", quality: str = "quality") -> Column:
    """Domain of a labelled row: its language and quality."""
    return F.concat_ws("-", F.col(lang), F.when(F.col(quality) == 1, "good").when(F.col(quality) == 0, "poor"))


#: The classifier is fitted on at most about so many labels, a sample by hash; rates use all rows.
LABELLED = 20_000


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", limit: int = LABELLED) -> DataFrame:
    """Documents with a label; a label given twice counts once, two different ones both."""
    known = labels.select(F.col("doc_id").alias(id_col), F.col("quality").alias("__quality")).filter(F.col("quality").isNotNull()).distinct()
    n = known.count()
    if n > limit:
        known = known.filter(F.pmod(F.xxhash64(id_col, F.lit("mixing")), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    return docs.select(id_col, "text", "lang").join(known, id_col)


def fitted(docs: DataFrame, labels: DataFrame, **options) -> tuple[Domains, DataFrame, Rates]:
    """The domain model, the written rows (doc_id, tokens, p) of all documents, and their rates."""
    domains = Domains.fitted(labelled_rows(docs, labels), quality_domain("lang", "__quality"))
    scored = written(domains.scored(docs.select("doc_id", "text")).select("doc_id", "tokens", "p"), "posteriors")
    return domains, scored, fit_rates(scored, domains.names, **options)


def mixed_rates(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, tokens, domain, posterior, rate) for all documents; domain is the likeliest.

    Domains are language and quality of the labelled rows; of equally likely ones the first by
    name is told. Null and empty texts have no
    tokens and keep rate 1; repeated rows get equal rates; an empty table gives no rows;
    other columns are not read.
    """
    domains, scored, rates = fitted(docs, labels, **options)
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    named = F.get(F.array(*[F.lit(k) for k in domains.names]), best)
    return scored.select("doc_id", F.col("tokens").cast("long").alias("tokens"), named.alias("domain"), F.array_max("p").alias("posterior"), rates.of().alias("rate"))


def mixed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents, each repeated by its rate; all columns of docs, and no others.

    Rates are worked out anew from each row's own text, so text is never shuffled. Null and
    empty texts keep rate 1 and stay once; equal rows get equal numbers of copies; an empty
    table gives no rows.
    """
    domains, _, rates = fitted(docs, labels, **options)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), text_of().alias("__text"))
    rows = domains.scored(rows, "__text").withColumn("__n", copies(rates.of(), F.xxhash64("__id", "__text")))
    rows = rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__n"))))
    return rows.select("__row.*")
