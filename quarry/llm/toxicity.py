"""Toxicity by a weighted finite-state pattern grammar.

A text becomes a string of word classes: insults (with weights), threats, targets, negations,
words of reported speech, quotation marks, ends of clauses and lines. Transducers rewrite that string one
after the other, composed into one machine: negation marks the insults it reaches, reported
speech those that are only told, targets those that are aimed at someone, threats need what
they are aimed at. What comes out of a clause is counted by kind with its weights; a
logistic model fitted on labelled texts turns the counts of the clauses into a score.

Insults are the fixed words below and words or stems learned from labelled texts, so that
inflected forms and other languages are found as far as the labels show them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_batches, text_of, written

#: The words of the grammar.
INSULTS = "asshole bastard bitch clown coward cretin disgusting dumb filth filthy fool freak garbage idiot idiots idiotic imbecile jerk loser losers moron morons moronic parasite pathetic pig scum stupid trash vermin worthless".split()
THREATS = "kill destroy hurt murder beat stab shoot crush burn hang strangle töten umbringen erschießen verprügeln erwürgen zerstören tuer frapper étrangler détruire brûler matar golpear estrangular destruir quemar".split()
TARGETS = "you your you're youre u ur he she they him her them this that these those people everyone du dich dir dein deine ihr euch sie ihn ihm tu te toi ton ta vous votre il elle lui eux ti usted ustedes vosotros tú él ella ellos".split()
NEGATIONS = "not never no isn't aren't wasn't weren't don't doesn't didn't won't can't cannot without hardly nor neither nicht nie niemals kein keine keinen keiner ohne pas jamais aucun aucune sans nunca jamás sin ningún ninguna tampoco".split()
REPORTS = "said says say told tells called calls quoted quotes wrote writes claimed claims reported reportedly allegedly accused sagte sagt schrieb nannte behauptete angeblich dit disait écrit affirma selon prétend dijo dice escribió llamó según afirmó".split()

#: A plain quotation mark opens before a word and closes elsewhere; “ opens in some languages and closes in others. Typographic apostrophes count as plain ones.
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.;!?:\n\"“„«”»]")
OPENING = re.compile(r"(?<![^\s(\[])\"(?=\S)")
ENDS, OPENS, CLOSES = frozenset(".;!?"), frozenset("„«"), frozenset('”»"')
#: What the composed machine can say of a clause, in the order of the model's inputs.
KINDS = ("insult", "aimed", "negated", "told", "threat")
#: At most so many labelled texts are read to learn words and weights; a sample by hash.
LABELLED = 20_000
#: Stems of these lengths are learned beside whole words, with at least this much evidence (G, in nats).
STEMS = (4, 5, 6, 7, 8)
EVIDENCE = 10.0

#: What ends a clause; a colon only for negation and aim.
BREAKS = ("end", "line", "colon")

Step = Callable[[object, str], tuple[object, str]]


@dataclass
class Transducer:
    """A start state and a step from (state, symbol in) to (state, symbol out)."""

    start: object
    step: Step
    table: dict = field(default_factory=dict)

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            key = state, s
            if key not in self.table:
                self.table[key] = self.step(state, s)
            state, said = self.table[key]
            out.append(said)
        return out

    def __rshift__(self, after: Transducer) -> Transducer:
        """This machine's output read by another: states are pairs, steps are kept as they are met."""

        def step(state, symbol):
            mine, said = self.step(state[0], symbol)
            other, said = after.step(state[1], said)
            return (mine, other), said

        return Transducer((self.start, after.start), step)


def negation(reach: int = 3) -> Transducer:
    """An insult or threat up to ``reach`` words after a negation, in its clause, is negated."""

    def step(left, s):
        if s == "negation":
            return reach, s
        if s in ("insult", "threat"):
            return max(left - 1, 0), "negated" if left else s
        return (0 if s in BREAKS else max(left - 1, 0)), s

    return Transducer(0, step)


def reported(reach: int = 60) -> Transducer:
    """An insult or threat in quotation marks, or after a word of reporting in its clause, is only told.

    A colon does not end what is reported. A quotation ends with its mark, its line or after
    ``reach`` words, so that a stray mark does not excuse the rest of a text.
    """

    def step(state, s):
        quoted, reporting = state
        if s == "quote":
            return (0 if quoted else reach, reporting), s
        if s in ("open", "close"):
            return (reach if s == "open" else 0, reporting), s
        if s == "report":
            return (max(quoted - 1, 0), True), s
        if s in ("end", "line"):
            return (0 if s == "line" else quoted, False), s
        return (max(quoted - 1, 0), reporting), "told" if s in ("insult", "threat") and (quoted or reporting) else s

    return Transducer((0, False), step)


def aimed(reach: int = 4) -> Transducer:
    """An insult shortly after a target is aimed; a threat is one only shortly after a target or before one."""

    def step(state, s):
        near, waits = state
        if s in BREAKS:
            return (0, 0), s
        if s == "target":
            return (reach, 0), "threat" if waits else s
        if s == "insult":
            return (max(near - 1, 0), max(waits - 1, 0)), "aimed" if near else s
        if s == "threat":
            return (max(near - 1, 0), 0 if near else 2), "threat" if near else "word"
        return (max(near - 1, 0), max(waits - 1, 0)), s

    return Transducer((0, 0), step)


def grammar() -> Transducer:
    return negation() >> reported() >> aimed()


class _Classes(dict):
    """Word to (class, weight), filled as words are met, within bounds."""

    LIMIT = 300_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.fixed = {w: (c, 1.0) for c, words in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}
        self.fixed |= {"\n": ("line", 0.0), ":": ("colon", 0.0), "“": ("quote", 0.0)}
        self.fixed |= {c: (k, 0.0) for k, marks in (("end", ENDS), ("open", OPENS), ("close", CLOSES)) for c in marks}

    def __missing__(self, word: str) -> tuple[str, float]:
        found = self.fixed.get(word, ("word", 0.0))
        weight = max([self.lexicon.get("=" + word, 0.0), *(self.lexicon.get(word[:n], 0.0) for n in STEMS if len(word) >= n)])
        if weight > 0:
            found = "insult", weight
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found
        return found


def counts(text: str, classes: _Classes, machine: Transducer) -> list[float]:
    """Weights by kind, the heaviest word, and how many clauses match, of a whole text."""
    out = [0.0] * (len(KINDS) + 2)
    met = [classes[w] for w in TOKEN.findall(OPENING.sub("„", text.lower().replace("’", "'")))]
    if not any(c == "insult" or c == "threat" for c, _ in met):
        return out
    clause = False
    for said, (kind, weight) in zip(machine.run([c for c, _ in met]), met, strict=True):
        if said in KINDS:
            weight = weight if kind == "insult" else 1.0
            out[KINDS.index(said)] += weight
            out[-2] = max(out[-2], weight)
            clause = True
        elif said in ("end", "line"):
            out[-1] += clause
            clause = False
    out[-1] += clause
    return out


def inputs(rows: list[list[float]]) -> np.ndarray:
    """What the model sees: all but the heaviest word grows ever slower."""
    x = np.array(rows, dtype=float).reshape(-1, len(KINDS) + 2)
    return np.hstack([np.log1p(x), x[:, -2:-1]])


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights[:-1] + self.weights[-1])))


def learned_words(rows: DataFrame) -> dict[str, float]:
    """Words (after "=") and stems that labels show to be insults, with weights up to 1. Texts of equal word sets count once, as toxic if one is."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.replace(F.lower("text"), F.lit("’"), F.lit("'")), F.lit(r"[\p{L}]+(?:'[\p{L}]+)?"), F.lit(0))))
    rows = rows.select("toxic", words.alias("words")).filter(F.size("words") > 0)
    # words hold no spaces, so that equal digests are equal sets
    rows = rows.groupBy(F.sha2(F.array_join("words", " "), 256)).agg(F.max("toxic").alias("toxic"), F.first("words").alias("words"))
    rows = written(rows.select("toxic", "words"), "toxicity-words")
    total = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    if not total["t"] or total["t"] == total["n"]:
        return {}
    share = total["t"] / total["n"]
    by_word = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    forms = [F.concat(F.lit("="), F.col("word")), *[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in STEMS]]
    by_form = by_word.select("t", "n", F.explode(F.array_compact(F.array(*forms))).alias("form")).groupBy("form").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    # the binomial's log likelihood at its own rate against that at the common rate
    rate = (F.col("t") + 0.25) / (F.col("n") + 0.5)
    gain = F.col("t") * F.log(rate / share) + (F.col("n") - F.col("t")) * F.log((1 - rate) / (1 - share))
    strong = by_form.withColumns({"gain": gain, "rate": rate}).filter((F.col("gain") >= EVIDENCE) & (F.col("rate") >= max(0.8, share)))
    # all of them: the bounded sample bounds how many forms can have so much evidence
    return {r["form"]: float(r["rate"]) for r in strong.orderBy("form").collect()}


def _features(lexicon: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, machine = _Classes(lexicon), grammar()
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [counts(t, classes, machine) for t in batch["text"]]})

    return run


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.02, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = decay * np.ones(len(w))
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LABELLED) -> Model:
    """Learn from labelled rows where ``learn`` (over doc_id) holds, at most about ``limit`` by hash.

    A document labelled twice is toxic if one label says so. Without usable labels the
    fixed words alone decide.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(learn) if learn is not None else known
    n = known.count()
    if n > limit:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).join(known, "doc_id").select("toxic", "text")
    rows = written(rows, "toxicity-labelled")
    lexicon = {f"={w}": 0.9 for w in INSULTS} | learned_words(rows)
    found = rows.mapInPandas(_features(lexicon), "toxic int, x array<double>").collect()
    # in an order of their own, so that the sums do not depend on that of the rows
    found = sorted((r["toxic"], r["x"]) for r in found)
    x, y = inputs([x for _, x in found]), np.array([t for t, _ in found], float)
    if len(set(y)) < 2:
        x, y = inputs([[0.0] * 7, [0.9, 0, 0, 0, 0, 0.9, 1], [0, 0.9, 0, 0, 0, 0.9, 1], [0, 0, 0.9, 0, 0, 0.9, 1], [0, 0, 0, 0.9, 0, 0.9, 1], [0, 0, 0, 0, 1, 1, 1]]), np.array([0, 1, 1, 0, 0, 1.0])
    return Model(lexicon, logistic(x, y))


def scores(texts: Column, model: Model) -> Column:
    """Score of each text, 0 to 1; null is empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classes, machine = _Classes(model.lexicon), grammar()
        for batch in batches:
            yield pd.Series(model.score(inputs([counts(t or "", classes, machine) for t in batch])))

    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(texts)


#: Rows of this fold are never learned from.
def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null and empty texts get the score of a text without matches. Repeated rows repeat; an
    empty table gives no rows; columns other than id and text are not read.
    """
    model = fit(docs, labels, ~held_out(F.col("doc_id")), id_col, text_col, **options)
    rows = in_batches(docs).select(F.col(id_col).alias("doc_id"), scores(F.col(text_col), model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows scored below one half, all columns; null and empty texts stay, repeated rows share a fate."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")), text_col=text_col, **options)
    return in_batches(docs).filter(scores(F.col(text_col), model) < 0.5)
