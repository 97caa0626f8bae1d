"""Mixing sources to target weights by soft membership. DataFrame functions only.

A multinomial logistic classifier learns domains from a labelled table: which of some chosen words, and of some marks
of the text's structure, occur in a document. It gives every document a posterior over the domains (soft membership).
Rates r >= 0 (how often a document is drawn, in expectation) then solve a least-squares problem: the expected tokens
of each domain, the sum of r * tokens * posterior, shall equal targets, and of all rates that do so as well the ones
nearest to 1 are taken. Each round of projected gradient is one aggregation to vectors and matrices of the size of the
domains: a document's rate is 1 less its posterior times the sum of all steps so far, projected on what isn't negative, so
nothing is kept between rounds. Steps are the gradient scaled by the curvature over the documents whose rate isn't zero; a round
tries several lengths of the step at once. Rounds end when the targets are met, or when the gradient is zero: then no rates meet
them better. A miss that is left is logged.

Training takes at most `most_rows` labelled rows, chosen by a hash of the id; totals cover all documents. A token is a
word here: words are parted by ASCII blanks.

Defined cases: null and empty texts have no tokens and the posterior of a text without words, and rate and copies like any
other; labelled rows without a domain don't teach; a repeated id in the labels teaches as often; a domain that no document is
labelled with gets next to no posterior; without any labelled row posteriors are equal; repeated rows are rows of their
own with the same rate; an empty table gives an empty result; other columns pass, whatever their names.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, fresh, named, taught_rows
from corpusloom.llm.quality_rules import SYMBOLS, words_of

LOG = logging.getLogger(__name__)
MOST_ROWS = 8000
#: Words and marks that the classifier looks at, and in how many sampled documents each must occur.
CHOSEN = 160
LEAST_DOCUMENTS = 8
ROUNDS = 60
#: Largest miss of any domain's target, as a share of all tokens, at which the rounds end.
CLOSE = 1e-6
#: How much more a miss weighs than a rate's distance from 1, both as shares of all tokens.
WEIGHT = 1e10
#: Targets that nonnegative rates can't meet: the gradient, as a share of all tokens, at which no rate can lower the miss any more.
STILL = 1e-9
#: Lengths of a step that one round tries.
LENGTHS = (1.0, 0.3, 0.05, 0.003)


def with_marks(rows: DataFrame, text: str, words: str) -> DataFrame:
    """Adds the column `words`: lower-cased words and marks of structure (which hold a blank, so no word equals one), and
    `<words>_n`, the number of words."""
    few, plain, size, n = (fresh(rows, f"{words}_{x}") for x in ("few", "plain", "size", "n"))
    marks = [fresh(rows, f"{words}_{x}") for x in ("symbols", "capitals", "bangs")]
    body = F.coalesce(F.col(text), F.lit(""))
    rest = named(rows)
    rows = rows.select(*rest, F.regexp_replace(body, "[a-z ]+", "").alias(few), words_of(F.lower(body)).alias(plain), F.length(body).alias(size))
    share = lambda kept: F.length(F.regexp_replace(few, f"[^{kept}]+", "")) / F.greatest(F.col(size), F.lit(1))
    grades = [F.floor(F.least(share(kept) * by, F.lit(5))).alias(name) for name, kept, by in zip(marks, (SYMBOLS, "A-Z", "!?"), (25, 10, 25))]
    rows = rows.select(*rest, plain, F.array_distinct(plain).alias(few), *grades)
    k = F.size(plain)
    variety = F.floor(F.size(few) / F.greatest(k, F.lit(1)) * 6)
    length = F.floor(F.least(F.log2(k + 1), F.lit(9)))
    found = [F.concat(F.lit(f" {name} "), c.cast("string")) for name, c in zip(("symbols", "capitals", "bangs", "variety", "length"), (*map(F.col, marks), variety, length))]
    return rows.select(*rest, F.concat(F.col(few), F.array(*found)).alias(words), k.cast("long").alias(n))


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", domain: str = "domain", most_rows: int = MOST_ROWS) -> dict:
    """The classifier: base log-weights of the domains, and log-weights by chosen word. labels: (key, domain)."""
    known = labels.select(F.col(key).alias("id"), F.col(domain).alias("domain")).where(F.col("domain").isin(*domains) & F.col("id").isNotNull())
    even: dict = {"base": [-math.log(len(domains))] * len(domains), "words": {}}
    taught = taught_rows(docs, known, ["domain"], key, text, most_rows, 11)
    rows = cut(with_marks(taught.select("domain", "text"), "text", "w").select("domain", "w"))
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    n = sum(sizes.values())
    if not n:
        return even
    each = [F.count_if(F.col("domain") == d).alias(f"d{i}") for i, d in enumerate(domains)]
    counts = rows.select("domain", F.explode("w").alias("w")).groupBy("w").agg(*each, F.count("*").alias("all")).where(F.col("all") >= LEAST_DOCUMENTS)
    chosen: set[str] = set()
    for i, d in enumerate(domains):
        if sizes.get(d):
            gain = information(F.col(f"d{i}"), F.col("all"), sizes[d], n)
            chosen.update(r["w"] for r in counts.orderBy(F.desc(gain), "w").limit(CHOSEN // len(domains) + 1).collect())
    names = sorted(chosen)
    if not names:
        return even
    sample = rows.select("domain", F.filter("w", lambda w: w.isin(*names)).alias("w")).collect()  # most_rows rows of CHOSEN words at most
    x, y = np.zeros((len(sample), len(names) + 1)), np.zeros((len(sample), len(domains)))
    at = {w: i for i, w in enumerate(names)}
    for k, r in enumerate(sorted(sample, key=lambda r: (r["domain"], sorted(r["w"])))):  # one order, so sums come out alike
        x[k, [at[w] for w in r["w"]]] = 1
        x[k, -1] = 1
        y[k, domains.index(r["domain"])] = 1
    w = softmax_regression(x, y)
    return {"base": w[-1].tolist(), "words": {name: w[i].tolist() for name, i in at.items()}}


def information(c: Column, both: Column, size: int, n: int) -> Column:
    """How much the presence of a word, found in c of a domain's `size` and in `both` of all n documents, tells about the domain."""

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    share = size / n
    return term(c, both * share) + term(both - c, both * (1 - share)) + term(F.lit(size) - c, (F.lit(n) - both) * share) + term(F.lit(n - size) - both + c, (F.lit(n) - both) * (1 - share))


def softmax_regression(x: np.ndarray, y: np.ndarray, rounds: int = 600, ridge: float = 2e-4) -> np.ndarray:
    """Weights (features x classes) of a multinomial logistic regression, by accelerated full gradients."""
    w = np.zeros((x.shape[1], y.shape[1]))
    look, t = w, 1.0
    step = 2.0 / max(float((x * x).sum(axis=1).mean()), 1.0)
    for _ in range(rounds):
        z = x @ look
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = look - step * (x.T @ (p - y) / len(x) + ridge * look)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        look, w = new + (before - 1) / t * (new - w), new
    return w


def with_posteriors(rows: DataFrame, model: dict, text: str, posterior: str, tokens: str) -> DataFrame:
    """Adds an array of the domains' posteriors and the number of tokens; one narrow pass."""
    words = fresh(rows, "mixing_words")
    rest = named(rows)
    rows = with_marks(rows, text, words)
    base = F.array(*[F.lit(float(x)) for x in model["base"]])
    n = F.col(rows.columns[-1])
    if not model["words"]:
        logs = base
        rows = rows.select(*rest, n.alias(tokens), logs.alias(words))
    else:
        table = F.create_map(*[x for w, v in model["words"].items() for x in (F.lit(w), F.array(*[F.lit(float(y)) for y in v]))])
        listed = F.filter(words, lambda w: w.isin(*model["words"]))
        weights = F.transform(listed, lambda w: F.element_at(table, w))
        logs = F.aggregate(weights, base, lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
        rows = rows.select(*rest, n.alias(tokens), logs.alias(words))
    top = F.array_max(words)
    rows = rows.select(*rest, tokens, F.transform(F.array(top), lambda t: F.transform(words, lambda x: F.exp(x - t)))[0].alias(words))
    total = F.aggregate(words, F.lit(0.0), lambda s, x: s + x)
    return rows.select(*rest, tokens, F.transform(F.array(total), lambda t: F.transform(words, lambda x: x / t))[0].alias(posterior))


def rate(posterior: str, steps: list[list[float]]) -> Column:
    """The rate after the steps: from 1, each step subtracts its product with the posterior, and what falls below 0 is 0."""
    out = F.lit(1.0)
    for step in steps:
        falls = [F.get(F.col(posterior), i) * F.lit(float(x)) for i, x in enumerate(step)]
        out = F.greatest(out - sum(falls[1:], falls[0]), F.lit(0.0))
    return out


def solve(features: DataFrame, posterior: str, tokens: str, d: int, goal: Callable[[np.ndarray], np.ndarray]) -> list[list[float]]:
    """The steps of projected gradient, added up to one. goal: from the domains' expected tokens at rate 1 to the targets."""
    p = [F.get(F.col(posterior), i) for i in range(d)]
    t = F.col(tokens).cast("double")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def measured(sums_of_steps: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each sum of steps the domains' expected tokens, the curvature, and half the tokens times squared rates: one aggregation."""
        rows = features.select(tokens, posterior, *[rate(posterior, [x.tolist()]).alias(f"r{k}") for k, x in enumerate(sums_of_steps)])
        cells = []
        for k in range(len(sums_of_steps)):
            r = F.col(f"r{k}")
            cells += [F.sum(r * t * p[i]) for i in range(d)] + [F.sum(F.when(r > 0, t * p[i] * p[j]).otherwise(0.0)) for i, j in pairs] + [F.sum(t * r * r) / 2]
        found = np.array([x or 0.0 for x in rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(cells)]).first()]).reshape(len(sums_of_steps), -1)
        out = []
        for row in found:
            m = np.zeros((d, d))
            for (i, j), x in zip(pairs, row[d:-1]):
                m[i, j] = m[j, i] = x
            out.append((row[:d], m, float(row[-1])))
        return out

    at = np.zeros(d)
    s, m, half = measured([at])[0]
    target, total = np.asarray(goal(s), dtype=float), max(float(s.sum()), 1.0)
    weight = total / WEIGHT
    height = lambda half, at: half + target @ at + weight / 2 * at @ at  # noqa: E731  lowest where the miss balances the rates' distance from 1
    scale, rounds = 1.0, 0
    while rounds < ROUNDS and scale > 1e-12 and np.abs(s - target).max() / total > CLOSE:
        slope = target - s + weight * at
        if np.abs(slope).max() <= STILL * total:
            break
        step = np.linalg.solve(m + weight * np.eye(d), -slope)
        tried = [at + scale * x * step for x in LENGTHS]
        found = measured(tried)
        rounds += 1
        best = min(range(len(tried)), key=lambda k: height(found[k][2], tried[k]))
        lower = height(found[best][2], tried[best]) < height(half, at)
        if lower or np.abs(target - found[best][0] + weight * tried[best]).max() < np.abs(slope).max():
            at, (s, m, half), scale = tried[best], found[best], 1.0
        else:
            scale *= LENGTHS[-1]
    left = float(np.abs(s - target).max()) / total
    (LOG.info if left <= CLOSE else LOG.warning)("mixing: expected tokens %s, targets %s, largest miss %.2g of all tokens after %d rounds", s.tolist(), target.tolist(), left, rounds)
    return [at.tolist()] if at.any() else []


def shares_of(weights: dict[str, float], domains: list[str]) -> Callable[[np.ndarray], np.ndarray]:
    """Targets: shares of as many tokens as there are."""
    w = np.array([weights[d] for d in domains], dtype=float)
    return lambda totals: totals.sum() * w / w.sum()


def factors_of(factors: dict[str, float], domains: list[str]) -> Callable[[np.ndarray], np.ndarray]:
    """Targets: multiples of what the domains have."""
    return lambda totals: totals * np.array([factors.get(d, 1.0) for d in domains])


def plan(docs: DataFrame, labels: DataFrame, domains: list[str], goal: Callable[[np.ndarray], np.ndarray], key: str = "doc_id", text: str = "text") -> tuple[dict, list[list[float]], DataFrame]:
    """The classifier, the steps, and (doc_id, tokens, posterior) of all documents, written."""
    model = fit(docs, labels, domains, key, text)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    features = cut(with_posteriors(rows, model, "text", "posterior", "tokens").select("doc_id", "tokens", "posterior"))
    return model, solve(features, "posterior", "tokens", len(domains), goal), features


def copies(rate_: Column, key: str) -> Column:
    """Whole copies whose expectation is the rate: its floor, and one more by a hash of the id."""
    part = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate_ + part).cast("int")


def mix(docs: DataFrame, labels: DataFrame, domains: list[str], goal: Callable[[np.ndarray], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies) for every row."""
    _, steps, features = plan(docs, labels, domains, goal, key, text)
    rows = features.withColumn("rate", rate("posterior", steps))
    p = [F.get(F.col("posterior"), i).alias(f"p_{d}") for i, d in enumerate(domains)]
    return rows.select("doc_id", "tokens", *p, "rate", copies(F.col("rate"), "doc_id").alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, domains: list[str], goal: Callable[[np.ndarray], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, each as often as its rate says."""
    model = fit(docs, labels, domains, key, text)
    posterior, tokens, n = (fresh(docs, x) for x in ("mixing_posterior", "mixing_tokens", "mixing_copies"))
    rows = cut(with_posteriors(docs, model, text, posterior, tokens))  # the posteriors beside the rows, so they are worked out once
    steps = solve(rows.select(tokens, posterior), posterior, tokens, len(domains), goal)
    rest = named(docs)
    drawn = rows.select(*rest, copies(rate(posterior, steps), key).alias(n)).where(F.col(n) > 0)
    return drawn.select(*rest, F.explode(F.sequence(F.lit(1), F.col(n))).alias(n)).select(*rest)
