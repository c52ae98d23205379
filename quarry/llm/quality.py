"""Quality by co-training two views of a document.

The content view sees the text (words, sentences, lines, characters), the metadata view only
what is known about the page without it: language, source, length. Both start from the labelled
rows. In every round each view names the unlabelled documents it is surest of, and the other view
learns them as its own. Each
view is then calibrated on labelled rows kept apart, and one logistic step over the calibrated
views scores all documents. Features and scores are built-in expressions.

Every unlabelled row takes part: a round scores them all in Spark, finds how sure a row must
be from histograms of the scores, and refits the views from sums over the rows they were
given. The driver holds a bounded sample of labelled rows, the sums and the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, small, text_of, written
from quarry.llm.toxicity import held_out, logistic

#: At most about so many labelled rows, a sample by hash.
LABELLED = 20_000
#: Bins of raw scores from -20 to 20, and how many tasks' sums are added up at once.
BINS, FAN = 8_000, 64
#: Digits that means, scales and weights keep: what the order of additions leaves is beyond them.
DIGITS = 9
#: One labelled row in so many is kept to calibrate the views and to mix them.
FOLDS = 4
#: Hash buckets of languages and sources in the metadata view.
LANGS, SOURCES = 16, 64


def _n_words(words: Column) -> Column:
    return F.greatest(F.size(words), F.lit(1)).cast("double")


def _words_lines(text: Column) -> tuple[Column, Column, Column]:
    """Letters of a whole text, its words and its lines."""
    return F.greatest(F.length(text), F.lit(1)).cast("double"), F.array_remove(F.split(text, SPACE), ""), F.array_remove(F.split(text, r"[\r\n]+"), "")


def content(text: Column) -> list[Column]:
    """A whole text: words, how many, how long, how often repeated, how they form sentences and lines; characters of each kind."""
    size, words, lines = _words_lines(text)
    n_words, n_lines = _n_words(words), _n_words(lines)
    ends = F.regexp_count(text, F.lit(r"[.!?](\s|$)")) / n_words
    unique_words, unique_lines = F.size(F.array_distinct(words)) / n_words, F.size(F.array_distinct(lines)) / n_lines
    upper, digits = (F.regexp_count(text, F.lit(p)) / size for p in (r"\p{Lu}", r"\p{Nd}"))
    symbols = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]")) / size
    form = [upper, F.sqrt(upper), digits, symbols, F.sqrt(symbols), n_words / n_lines / 100, F.log1p(n_lines) / 10]
    return [ends, F.log1p(ends * 20), unique_words, unique_words * unique_words, unique_lines, size / n_words / 10, F.log1p(n_words) / 10, (n_words < 20).cast("double"), *form]


def metadata(lang: Column, source: Column, n_chars: Column) -> list[Column]:
    """What is known about the page without its text: language, source, length."""
    one = lambda c, n: [(F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit(""))), F.lit(n)) == i).cast("double") for i in range(n)]
    log = F.log1p(F.greatest(F.coalesce(n_chars.cast("double"), F.lit(0.0)), F.lit(0.0))) / 10
    return [log, log * log, (log < 0.5).cast("double"), *one(lang, LANGS), *one(source, SOURCES)]


@dataclass
class View:
    """A logistic model over standardised features, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def fitted(x: np.ndarray, y: np.ndarray) -> View:
        mean, scale = x.mean(0), x.std(0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        return View(mean, scale, logistic((x - mean) / scale, y, decay=1.0))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -20, 20)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) * self.calibration[0] + self.calibration[1]

    def column(self, features: list[Column]) -> Column:
        slope = self.weights[:-1] / self.scale
        at = float(self.weights[-1] - slope @ self.mean)
        total = sum((f * float(w) for f, w in zip(features, slope, strict=True)), F.lit(at))
        return F.greatest(F.least(total, F.lit(20.0)), F.lit(-20.0)) * float(self.calibration[0]) + float(self.calibration[1])


@dataclass
class CoTrained:
    text: View
    page: View
    mix: np.ndarray
    exchanged: int

    def score(self, content_: list[Column], metadata_: list[Column]) -> Column:
        logit = self.text.column(content_) * float(self.mix[0]) + self.page.column(metadata_) * float(self.mix[1]) + float(self.mix[2])
        return 1 / (1 + F.exp(-logit))


def co_train(a: np.ndarray, b: np.ndarray, y: np.ndarray, pool_a: np.ndarray, pool_b: np.ndarray, rounds: int = 4, sure: float = 0.95, share: float = 0.1) -> CoTrained:
    """Views a and b of labelled rows y, and of the unlabelled pool.

    A round gives over at most ``share`` of the pool per class, the surest first, and none
    that a view is less than ``sure`` of. A pool row is given once by each view.
    """
    if len(set(y)) < 2:
        level = float(np.clip(np.mean(y) if len(y) else 1.0, 0.02, 0.98))
        flat = lambda x: View(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1))
        return CoTrained(flat(a), flat(b), np.array([0.0, 0.0, np.log(level / (1 - level))]), 0)
    given = {0: {}, 1: {}}  # what each view has learned from the other: pool row -> class
    views = [View.fitted(a, y), View.fitted(b, y)]
    pools, own = (pool_a, pool_b), (a, b)
    bound = np.log(sure / (1 - sure))
    for _ in range(rounds if len(pool_a) else 0):
        fresh = 0
        for giver in (0, 1):
            logit = views[giver].raw(pools[giver])
            taken = given[1 - giver]
            for label, order in ((1, np.argsort(-logit, kind="stable")), (0, np.argsort(logit, kind="stable"))):
                rows = [i for i in order if i not in taken and (logit[i] > bound if label else logit[i] < -bound)]
                rows = rows[: max(1, int(share * len(logit) * (np.mean(y) if label else 1 - np.mean(y))))]
                taken.update(dict.fromkeys(rows, label))
                fresh += len(rows)
        if not fresh:
            break
        for k in (0, 1):
            rows = list(given[k])
            views[k] = View.fitted(np.vstack([own[k], pools[k][rows]]), np.concatenate([y, [given[k][i] for i in rows]]))
    return CoTrained(*views, _calibrated(views, own, y), len(given[0]) + len(given[1]))


def _rows(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both views' features of a batch of unlabelled rows."""
    hot = lambda c, n: (batch[c].to_numpy()[:, None] == np.arange(n)).astype(float)
    plain = lambda k: np.column_stack([batch[c].to_numpy(float) for c in batch.columns if c[0] == k and c[1:].isdigit()])
    return plain("a"), np.hstack([plain("b"), hot("lang", LANGS), hot("source", SOURCES)])


def _bins(view: View, x: np.ndarray) -> np.ndarray:
    """The bin of each row's raw score. Added up feature by feature, so that a row gets the same one in any batch."""
    slope = view.weights[:-1] / view.scale
    total = np.full(len(x), view.weights[-1] - slope @ view.mean)
    for j, w in enumerate(slope):
        total += x[:, j] * w
    return np.minimum((np.clip(total, -20, 20) + 20) * (BINS / 40), BINS - 1).astype(int)


@dataclass
class Given:
    """What one view gave the other in a round, by bin: the share of its untaken rows given as good and as bad."""

    giver: int
    view: View
    good: np.ndarray
    bad: np.ndarray


def _taken(x: tuple[np.ndarray, np.ndarray], draw: np.ndarray, rules: list[Given]) -> list[np.ndarray]:
    """What each view has been given: 1, 0 or -1 for nothing, by the rules in their order."""
    taken = [np.full(len(draw), -1), np.full(len(draw), -1)]
    for rule in rules:
        mine, at = taken[1 - rule.giver], _bins(rule.view, x[rule.giver])
        free = mine < 0
        mine[free & (draw < rule.good[at])] = 1
        mine[free & (draw >= 1 - rule.bad[at])] = 0
    return taken


def _total(pool: DataFrame, of: Callable[[tuple[np.ndarray, np.ndarray], np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of what ``of`` makes of one, added up in pieces before the driver gets it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, met = 0.0, False
        for batch in batches:
            if len(batch):
                total, met = total + of(_rows(batch), batch["draw"].to_numpy()), True
        if met:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [total.tobytes()]})

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "sums": [np.sum([np.frombuffer(x) for x in rows.sort_values("part")["sums"]], axis=0).tobytes()]})

    schema = "part int, sums binary"
    # a tree over the tasks: no group holds more than FAN of their sums, however many tasks there are
    sums, tasks = pool.mapInPandas(run, schema), pool.rdd.getNumPartitions()
    while tasks > FAN:
        of_part = F.floor(F.col("part") / FAN).cast("int")
        sums, tasks = sums.withColumn("up", of_part).groupBy("up").applyInPandas(added, schema), -(-tasks // FAN)
    found = sums.collect()
    return np.sum([np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["part"])], axis=0)


def _quota(counts: np.ndarray, most: int) -> np.ndarray:
    """The share to take of each bin, first bins first, until ``most`` rows are taken."""
    before = np.cumsum(counts) - counts
    return np.clip((most - before) / np.maximum(counts, 1), 0, 1) * (counts > 0)


def _refitted(pool: DataFrame, rules: list[Given], own: tuple[np.ndarray, np.ndarray], y: np.ndarray, old: list[View]) -> tuple[list[View], int]:
    """Both views fitted to labelled rows and all rows given to them, by Newton steps over sums; and how many were given."""
    wide = [x.shape[1] for x in own]

    def moments(x, draw):
        taken = _taken(x, draw, rules)
        return np.concatenate([np.concatenate([[(k >= 0).sum()], v[k >= 0].sum(0), (v[k >= 0] ** 2).sum(0)]) for v, k in zip(x, taken, strict=True)])

    sums = np.split(_total(pool, moments), [1 + 2 * wide[0]])
    views, given = [], 0
    for m, x, v in zip(sums, own, old, strict=True):
        n, given = m[0] + len(x), given + int(m[0])
        mean = (m[1 : len(v.mean) + 1] + x.sum(0)) / n
        scale = np.sqrt(np.maximum((m[len(v.mean) + 1 :] + (x**2).sum(0)) / n - mean**2, 0))
        scale = np.where(scale > 1e-7, scale, 1.0)
        slope = v.weights[:-1] / v.scale
        mean, scale = np.round(mean, DIGITS), np.round(scale, DIGITS)
        views.append(View(mean, scale, np.append(slope * scale, v.weights[-1] + slope @ (mean - v.mean))))

    def newton(x, y, v):
        x = np.hstack([(x - v.mean) / v.scale, np.ones((len(x), 1))])
        z = x @ v.weights
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.concatenate([[(np.logaddexp(0, z) - y * z).sum()], x.T @ (y - p), ((x * (p * (1 - p) + 1e-9)[:, None]).T @ x).ravel()])

    d, sure = [w + 1 for w in wide], [(np.inf, v.weights, 0.0) for v in views]  # loss, weights and step of the best so far
    for _ in range(40):
        now = list(views)

        def steps(x, draw, now=now):
            taken = _taken(x, draw, rules)
            return np.concatenate([newton(f[k >= 0], k[k >= 0], v) for f, k, v in zip(x, taken, now, strict=True)])

        largest = 0.0
        for k, part in enumerate(np.split(_total(pool, steps), [1 + d[0] + d[0] ** 2])):
            part, w = part + newton(own[k], y, now[k]), now[k].weights
            keep = np.append(np.ones(wide[k]), 1e-6)
            loss, best, step = part[0] + keep @ w**2 / 2, *sure[k][1:]
            if loss <= sure[k][0] * (1 + 1e-12) + 1e-9:
                best, step = w, np.linalg.solve(part[1 + d[k] :].reshape(d[k], d[k]) + np.diag(keep), part[1 : 1 + d[k]] - keep * w)
                sure[k] = loss, best, step
            else:
                # too far: half the step from the best so far
                step = step / 2
                sure[k] = sure[k][0], best, step
            views[k] = View(now[k].mean, now[k].scale, best + step)
            largest = max(largest, np.abs(step).max())
        # a Newton step squares the error
        if largest < 1e-4:
            break
    return [View(v.mean, v.scale, np.round(v.weights, DIGITS)) for v in views], given


def _calibrated(views: list[View], own: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> np.ndarray:
    """Calibrate each view on rows, and say how they are mixed."""
    for v, x in zip(views, own, strict=True):
        v.calibration = tuple(logistic(v.raw(x)[:, None], y, decay=1e-3))
    return logistic(np.column_stack([v.logit(x) for v, x in zip(views, own, strict=True)]), y, decay=1e-3)


def co_train_all(a: np.ndarray, b: np.ndarray, y: np.ndarray, pool: DataFrame, n: int, held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, rounds: int = 4, sure: float = 0.95, share: float = 0.1) -> CoTrained:
    """``co_train`` over a pool that stays in Spark: n rows of columns a0.., b0.., lang, source, draw.

    ``held`` are labelled rows (both views' features, classes) that nothing was fitted to: on
    these the views are calibrated and mixed, if they have both classes.

    Where a bin holds more rows than may still be given, ``draw``, fixed by what a row holds, says
    which; rows that are equal share it. Scores do not depend on the order of rows or on their partitions.
    """
    start = co_train(a, b, y, a[:0], b[:0])
    apart = (held[:2], held[2]) if held is not None and len(set(held[2])) == 2 else ((a, b), y)
    if len(set(y)) < 2:
        return start
    if not n:
        return CoTrained(start.text, start.page, _calibrated([start.text, start.page], *apart), 0)
    own, views, rules, given = (a, b), [start.text, start.page], [], 0
    edge = int(np.ceil((np.log(sure / (1 - sure)) + 20) * BINS / 40))
    most = [max(1, int(share * n * p)) for p in (np.mean(y), 1 - np.mean(y))]
    for _ in range(rounds):
        now, held = list(views), list(rules)

        def histogram(x, draw, now=now, held=held):
            taken = _taken(x, draw, held)
            return np.concatenate([np.bincount(_bins(now[k], x[k])[taken[1 - k] < 0], minlength=BINS) for k in (0, 1)]).astype(float)

        fresh = 0.0
        for giver, counts in enumerate(np.split(_total(pool, histogram), 2)):
            good, bad = counts.copy(), counts.copy()
            good[:edge], bad[BINS - edge :] = 0, 0
            rule = Given(giver, now[giver], _quota(good[::-1], most[0])[::-1], _quota(bad, most[1]))
            rules.append(rule)
            fresh += (counts * (rule.good + rule.bad)).sum()
        if not fresh:
            break
        views, given = _refitted(pool, rules, own, y, views)
    return CoTrained(*views, _calibrated(views, *apart), given)


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, **options) -> CoTrained:
    """Learn from at most about ``limit`` labelled rows outside the held-out fold, and from all unlabelled rows.

    A document labelled twice is good only if both labels say so. Labelled rows are sampled
    row by row, so that a repeated doc_id brings no more of them; equal ones count once.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    a, b = content(text_of()), metadata(F.col("lang"), F.col("source"), F.col("n_chars"))
    bucket = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(n)).cast("int").alias(c)
    features = [*[c.alias(f"a{i}") for i, c in enumerate(a)], *[c.alias(f"b{i}") for i, c in enumerate(b[: -LANGS - SOURCES])], bucket("lang", LANGS), bucket("source", SOURCES)]
    # drawn by all that is read of a row, so that neither order nor partitions matter
    draw = (F.pmod(F.xxhash64(F.lit("quality"), "doc_id", "text", "lang", "source", "n_chars"), F.lit(1_000_000_000)) / 1e9).alias("draw")
    rows = written(docs.select("doc_id", draw, *features).join(small(written(known, "quality-labels")), "doc_id", "left"), "quality-features")
    pool = rows.filter("quality is null").drop("doc_id", "quality")
    marked = rows.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).distinct().drop("doc_id")
    n = marked.count()
    found = marked.filter(F.col("draw") < limit / max(n, limit)).toPandas()
    # in an order of their own, so that the sums do not depend on that of the rows
    found = found.sort_values(list(found.columns)).reset_index(drop=True)
    apart = (found["draw"].to_numpy() * 1e9).astype(np.int64) % FOLDS == 0
    y, (x, z) = (found["quality"].to_numpy() > 0).astype(float), _rows(found)
    return co_train_all(x[~apart], z[~apart], y[~apart], pool, pool.count(), (x[apart], z[apart], y[apart]), **options)


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, content_score, metadata_score, score, keep) for every row.

    Scores are the calibrated probability of good quality, 0 to 1; keep is score >= 0.5.
    Null text is empty text, null metadata a value of its own. Without labels of both
    classes the score is the labels' share. Repeated rows repeat; an empty table gives no
    rows; other columns are not read.
    """
    model = fit(docs, labels, **options)
    a, b = content(text_of()), metadata(F.col("lang"), F.col("source"), F.col("n_chars"))
    single = lambda v, x: 1 / (1 + F.exp(-v.column(x)))
    rows = docs.select("doc_id", single(model.text, a).alias("content_score"), single(model.page, b).alias("metadata_score"), model.score(a, b).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= 0.5).alias("keep"))


def good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows scored one half or more, all columns; null and empty texts are scored as empty, repeated rows share a fate."""
    model = fit(docs, labels, **options)
    score = model.score(content(text_of()), metadata(F.col("lang"), F.col("source"), F.col("n_chars")))
    return docs.filter(score >= 0.5)
