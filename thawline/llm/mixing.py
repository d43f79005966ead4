"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A logistic regression, learned from a bounded sample of a labelled table, gives each document's posterior over domains. Its
features are a text's distinct words, hashed to buckets, weighted by how few labelled documents hold them and brought to
one length, the logarithm of the text's length, and the share of its words that are distinct. Its gradients are aggregations; the coefficients, whose number is fixed, are
searched on the driver. Documents get rates (how often each is to be seen) that minimise the squared distance of the domains'
expected token totals from their targets, sum over documents of rate * tokens * posterior, cut off below at the least
rate allowed.

The search is a projected gradient in its lazy form. By token, the gradient for a document's rate is the sum over domains
of (total - target) * posterior, so all gradients taken so far are a number a domain, and the rates are the projection
max(least, first - gradients . posterior). Each round is one aggregation over all documents; only the totals and their
derivatives, a few numbers, reach the driver. Steps are scaled by those derivatives, a matrix of domains by domains, which makes them
damped Newton steps on a multiplier a domain: with one step size for all domains strong weights need hundreds to
thousands of passes.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thawline.llm.common import materialize, small_rounds, spread, unused
from thawline.llm.decontam import words_of

BUCKETS = 1 << 13
#: Features beside the buckets: a constant; half of ln(1 + words) less 5, four times the distinct buckets' share of the words less 3, and their squares.
BIAS = BUCKETS
FEATURES = BUCKETS + 5
#: Length of a text's vector of words, and how coefficients of words are held down; chosen on held-out labels.
LENGTH, PULL = 5.0, 3.0


class Classifier(NamedTuple):
    """domains; rarity by bucket; coefficients by feature for each domain but the first (log odds to it); log of the priors; factor of the odds."""

    domains: list[str]
    rarity: list[float]
    weights: list[list[float]]
    prior: list[float]
    scale: float = 1.0


def _buckets(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _table(numbers: Sequence[float]) -> Column:
    """An array by feature; the optimizer makes one constant of it."""
    return F.split(F.lit(",".join(f"{w:.6g}" for w in numbers)), ",").cast("array<double>")


def _squares(distinct: Column, rarity: Column) -> Column:
    return F.aggregate(distinct, F.lit(0.0), lambda s, b: s + F.get(rarity, b) * F.get(rarity, b))


def _added(distinct: str, size: str, norm: str, weights: Sequence[float], rarity: Sequence[float]) -> Column:
    """A text's log odds: of distinct buckets, the length of their vector and the number of words."""
    both = [w * r for w, r in zip(weights, rarity, strict=False)]
    words = F.aggregate(distinct, F.lit(0.0), lambda s, b: s + F.get(_table(both), b))
    return words * LENGTH / F.greatest(F.col(norm), F.lit(1e-9)) + sum((float(w) * x for w, x in zip(weights[BIAS:], _others(distinct, size), strict=True)), F.lit(0.0))


def _others(distinct: str, size: str) -> list[Column]:
    """Features beside the buckets."""
    n = F.col(size).cast("double")
    long, new = (F.log1p(n) - 5) / 2, 4 * F.size(distinct) / F.greatest(n, F.lit(1.0)) - 3
    return [F.lit(1.0), long, long * long, new, new * new]


def fit(
    docs: DataFrame, labels: DataFrame, domains: list[str], doc_id: str = "doc_id", text: str = "text", domain: str = "domain",
    sample: int = 1500, checks: int = 500, rounds: int = 20,
) -> Classifier:
    """From ``labels`` (doc_id, domain): at most ``sample`` documents a domain, drawn by hash of doc_id, and the counts of all labels.

    Rows without id, text or one of ``domains`` are left out. Documents count so that each domain has its share of
    all labels. A bucket's rarity is the logarithm of the sample's size over the number of its documents that hold it. One
    factor of the odds, of greatest likelihood on ``checks`` further documents a domain (1 where there are none),
    corrects how sure the posteriors are. Where a domain has fewer documents than asked for, they are divided in that
    proportion.
    """
    given = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(domain).alias("domain")).dropna().where(F.col("domain").isin(domains)).distinct()
    total = {r["domain"]: r["n"] for r in given.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    prior = [math.log((total.get(d, 0) + 1) / (sum(total.values()) + len(domains))) for d in domains]
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id"))
    drawn = given.withColumn("r", place).where(F.col("r") <= sample + checks)
    first = F.lit(0)
    for d in domains:
        first = F.when(F.col("domain") == d, -(-total.get(d, 0) * sample // (sample + checks)) if total.get(d, 0) < sample + checks else sample).otherwise(first)
    drawn = drawn.select("doc_id", "domain", (F.col("r") > first).alias("check"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    held = texts.join(F.broadcast(drawn), "doc_id").select("domain", "check", _buckets(words_of(F.col("text"))).alias("b"))
    told = ["domain", "check", F.size("b").alias("size"), F.array_distinct("b").alias("b"), F.monotonically_increasing_id().alias("doc")]
    held = materialize(held.select(*told), "labelled")  # of bounded size
    known = held.where("not check")
    n = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Classifier(domains, [0.0] * BUCKETS, [[0.0] * FEATURES for _ in domains[1:]], prior)
    whole = sum(n.values())
    weight, y = F.lit(0.0), F.lit(0)
    for i, d in enumerate(domains):
        weight = F.when(F.col("domain") == d, math.exp(prior[i]) * whole / max(1, n.get(d, 0))).otherwise(weight)
        y = F.when(F.col("domain") == d, i).otherwise(y)
    known = known.withColumns({"y": y, "weight": weight})
    words = known.select("doc", "y", "weight", F.explode("b").alias("b"))
    rare = F.log((F.lit(whole) + 1.0) / (F.count("*") + 1)).alias("r")
    rare = materialize(words.groupBy("b").agg(rare), "rarity")  # a row a bucket at most
    rarity = [math.log(whole + 1)] * BUCKETS
    for r in rare.collect():
        rarity[r["b"]] = r["r"]
    words = words.join(F.broadcast(rare), "b")
    norms = words.groupBy("doc").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    words = words.join(F.broadcast(norms), "doc").select("doc", "y", "weight", "b", (F.col("r") * LENGTH / F.greatest("norm", F.lit(1e-9))).alias("v"))
    others = known.select("doc", "y", "weight", F.posexplode(F.array(*_others("b", "size"))).alias("b", "v")).withColumn("b", F.col("b") + BIAS)
    entries = words.unionByName(others).repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc")
    entries = materialize(entries, "entries")
    with small_rounds(docs.sparkSession):
        weights = _search(entries, prior, rounds)
    odds = [_added("b", "size", "norm", w, rarity) - (prior[i + 1] - prior[0]) for i, w in enumerate(weights)]
    rows = held.where("check").withColumn("norm", F.sqrt(_squares(F.col("b"), _table(rarity)))).select("domain", *odds).collect()  # of bounded size
    return Classifier(domains, rarity, weights, prior, _scale(domains, prior, rows))


def _search(entries: DataFrame, prior: list[float], rounds: int) -> list[list[float]]:
    """Coefficients (of domains but the first, less those of the first) of least penalised log-loss, by quasi-Newton steps.

    entries: (doc, y, weight, b, v), the features of the examples with their domain's place and their weight. A round is two
    joins with tables of bounded size, that of the coefficients and that of the examples, and an aggregation by feature.
    """
    k = len(prior)
    held = np.ones(FEATURES)
    held[BIAS:] = 0
    curved = np.ones(FEATURES)
    for r in entries.groupBy("b").agg(F.sum(F.col("weight") * F.col("v") * F.col("v"))).collect():
        curved[r[0]] = r[1]
    share = np.exp(prior)
    curved = (share * (1 - share))[:, None] * curved + PULL * held + 1e-3  # about the second derivatives, by which steps are scaled
    names = ", ".join(f"w{i} double" for i in range(k))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        table = entries.sparkSession.createDataFrame([(b, *w) for b, w in enumerate(x.T.tolist())], f"b int, {names}")
        z = entries.join(F.broadcast(table), "b").groupBy("doc", "y", "weight").agg(*[F.sum(F.col("v") * F.col(f"w{i}")).alias(f"z{i}") for i in range(k)])
        top = F.greatest(*[F.col(f"z{i}") for i in range(k)])
        rows = z.withColumn("all", top + F.log(sum((F.exp(F.col(f"z{i}") - top) for i in range(k)), F.lit(0.0))))
        told = [F.col("weight") * (F.exp(F.col(f"z{i}") - F.col("all")) - (F.col("y") == i).cast("double")) for i in range(k)]
        own = sum(((F.col("y") == i).cast("double") * F.col(f"z{i}") for i in range(k)), F.lit(0.0))
        rows = rows.select("doc", (F.col("weight") * (F.col("all") - own)).alias("lost"), *[t.alias(f"g{i}") for i, t in enumerate(told)])
        sums = entries.select("doc", "b", "v").join(F.broadcast(rows), "doc").groupBy("b")
        sums = sums.agg(F.sum("lost").alias("lost"), *[F.sum(F.col(f"g{i}") * F.col("v")) for i in range(k)]).collect()  # a row a feature at most
        slope = PULL * held * x
        lost = PULL * float((held * x * x).sum()) / 2
        for r in sums:
            slope[:, r[0]] += r[2:]
            lost += r[1] if r[0] == BIAS else 0.0
        return lost, slope

    x = np.zeros((k, FEATURES))
    x[:, BIAS] = prior
    lost, slope = loss(x)
    seen, past = [lost], []
    for _ in range(rounds):
        step, parts = slope.copy(), []
        for s, y in reversed(past):
            a = (s * step).sum() / (s * y).sum()
            parts.append(a)
            step -= a * y
        step /= curved
        if past:
            s, y = past[-1]
            step *= (s * y).sum() / (y * y / curved).sum()
        for (s, y), a in zip(past, reversed(parts), strict=True):
            step += s * (a - (y * step).sum() / (s * y).sum())
        length = 1.0
        while True:
            now, there = loss(x - length * step)
            if now <= lost - 1e-4 * length * (slope * step).sum() or length < 1e-4:
                break
            length /= 4
        s, y = -length * step, there - slope
        if (s * y).sum() > 1e-12:
            past = [*past[-7:], (s, y)]
        x, lost, slope = x + s, now, there
        seen.append(lost)
        if len(seen) > 3 and seen[-4] - lost < 3e-3 * seen[0]:  # three rounds that hardly gain
            break
    return [(w - x[0]).tolist() for w in x[1:]]


def _scale(domains: list[str], prior: list[float], known: list) -> float:
    """Factor of the summed weights of greatest likelihood, by halving the interval of its logarithm; 1 without documents of two domains."""
    y = np.array([domains.index(r[0]) for r in known], int)
    if len(set(y.tolist())) < 2:
        return 1.0
    sums = np.array([[0.0, *r[1:]] for r in known])
    logs = np.array(prior)
    weight = (np.exp(logs) / np.maximum(1, np.bincount(y, minlength=len(domains))))[y]

    def slope(scale: float) -> float:
        z = scale * sums + logs
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return float((weight * (sums[np.arange(len(y)), y] - (p * sums).sum(1))).sum())

    low, high = math.log(1e-4), math.log(10.0)  # the likelihood is concave in the factor
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(math.exp(mid)) > 0 else (low, mid)
    return math.exp((low + high) / 2)


def with_posteriors(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` (words) and ``posterior`` (array, by domain). Texts without words have the prior."""
    b, norm, x, e = unused(docs, "b", "norm", "x", "e")
    docs = docs.withColumn(b, _buckets(words_of(F.col(f"`{text}`")))).withColumn("n_tokens", F.size(b).cast("long")).withColumn(b, F.array_distinct(b))
    docs = docs.withColumn(norm, F.sqrt(_squares(F.col(b), _table(model.rarity))))
    logits = [F.lit(0.0)]
    for i, w in enumerate(model.weights):
        prior = model.prior[i + 1] - model.prior[0]
        logits.append(F.when(F.col("n_tokens") > 0, (_added(b, "n_tokens", norm, w, model.rarity) - prior) * model.scale).otherwise(0.0) + prior)
    docs = docs.withColumn(x, F.array(*logits))
    docs = docs.withColumn(e, F.transform(x, lambda y: F.exp(y - F.array_max(x))))
    return docs.withColumn("posterior", F.transform(e, lambda y: y / F.aggregate(e, F.lit(0.0), lambda s, z: s + z))).drop(b, norm, x, e)


class Plan(NamedTuple):
    """steps: what is taken off a rate, a number a domain each; least rate; token totals reached, and targets.

    met: each domain is within the tolerance of its own target; optimal: where it isn't, no rates come nearer.
    """

    steps: list[list[float]]
    least: float
    reached: list[float]
    targets: list[float]
    met: bool
    optimal: bool


def rate_of(steps: Sequence[Sequence[float | Column]], least: float, start: Column | None = None) -> Column:
    """The rate of a document from its posterior by the steps."""
    r = F.lit(max(1.0, least)) if start is None else start
    for s in steps:
        r = F.greatest(F.lit(float(least)), r - sum((F.lit(x) * F.element_at("posterior", i + 1) for i, x in enumerate(s)), F.lit(0.0)))
    return r


def _totals(known: DataFrame, points: list[np.ndarray], least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For some multipliers at once: totals by domain, and how fast they fall with the multipliers. One aggregation.

    The multipliers are an array of constants and not numbers in the expressions: so all rounds run the same compiled
    code, where the driver would else compile and hold code of its own for each.
    """
    k = len(points[0])
    tried = known.select("n_tokens", "posterior", F.posexplode(F.lit([[float(v) for v in x] for x in points])).alias("j", "m"))
    p = [F.element_at("posterior", i + 1) for i in range(k)]
    n = F.col("n_tokens").cast("double")
    rows = tried.withColumn("r", rate_of([[F.element_at("m", i + 1) for i in range(k)]], least))
    free = F.when(F.col("r") > least, n).otherwise(0.0)
    sums = [F.sum(n * F.col("r") * x) for x in p] + [F.sum(free * x * y) for x in p for y in p]
    sums = [F.coalesce(x, F.lit(0.0)).alias(f"x{i}") for i, x in enumerate(sums)]
    out = np.zeros((len(points), k + k * k))
    for row in rows.groupBy("j").agg(*sums).collect():
        out[row[0]] = row[1:]
    return [(x[:k], x[k:].reshape(k, k)) for x in out]


def solve(
    known: DataFrame, weights: list[float], budget: float | None = None, least: float = 0.0, tolerance: float = 1e-3, most_rounds: int = 400
) -> Plan:
    """Rates for rows of (n_tokens, posterior) whose expected totals meet ``weights`` times ``budget``.

    The default budget is all tokens, or, with a least rate over 0, so many that no domain has to shrink below it.
    Of all rates that meet the targets these are nearest to the first rate (1, or the least), by squares weighted by
    tokens: max(least, first - multipliers . posterior), the multipliers being the gradients taken so far. A round tries
    some lengths of a step along the gradient, scaled by the totals' derivatives, in one aggregation. A pull on the
    multipliers keeps the problem solvable where no rates meet the targets. It is lessened until each domain is within
    ``tolerance`` of its own target, and at last so small that the rates are those of least squared distance. A domain
    without tokens is left out of the objective.
    ``most_rounds`` only guards against a search that doesn't end; then neither ``met`` nor ``optimal`` holds.
    """
    k, whole = len(weights), sum(weights)
    share = np.array(weights, float) / whole
    start = max(1.0, least)
    reached, gram = _totals(known, [np.zeros(k)], -1.0)[0]
    sums = reached / start
    if budget is None:
        budget = float(sums.sum()) if least <= 0 else max([least * s / w for s, w in zip(sums, share, strict=True) if w > 0], default=0.0)
    targets = budget * share
    near = np.maximum(tolerance * targets, 1e-9 * budget)
    met = lambda totals: bool((np.abs(totals - targets) <= near).all())
    g = np.diag(gram)
    if met(reached) or not (g > 0).any():
        return Plan([], least, reached.tolist(), targets.tolist(), met(reached), True)
    scale = np.where(g > 0, 1 / np.sqrt(np.where(g > 0, g, 1.0)), 0.0)  # by what the domain's documents can move
    y, rounds, optimal = np.zeros(k), 0, False  # the multipliers are scale * y
    totals, fall = _totals(known, [y], least)[0]
    for pull in (1e-3, 1e-5, 1e-7, 1e-9):
        slope = scale * (totals - targets) - pull * y  # of the concave dual
        while rounds < most_rounds and not met(totals) and (np.abs(slope) > 0.01 * scale * near).any():
            step = np.linalg.solve(scale[:, None] * fall * scale + pull * np.eye(k), slope)
            low, high, best, tries = 0.0, np.inf, None, [1.0, 0.5, 0.25, 0.0625]
            while rounds < most_rounds:
                rounds += 1
                for t, (now, fell) in zip(tries, _totals(known, [scale * (y + t * step) for t in tries], least), strict=True):
                    to = scale * (now - targets) - pull * (y + t * step)
                    left = float(to @ step)
                    low, high = (max(low, t), high) if left >= 0 else (low, min(high, t))
                    if best is None or abs(left) < abs(best[0]):
                        best = left, t, now, fell, to
                if abs(best[0]) <= 0.3 * float(slope @ step) or high == np.inf or high - low < 1e-12:
                    break
                tries = [low + (high - low) * f for f in (0.8, 0.5, 0.2, 0.02)]
            _, t, totals, fall, slope = best
            y = y + t * step
        if met(totals) or rounds >= most_rounds:
            break
    else:
        optimal = True
    return Plan([(scale * y).tolist()], least, totals.tolist(), targets.tolist(), met(totals), optimal or met(totals))


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], text: str = "text", budget: float | None = None, least: float = 0.0, unmet: str = "warn",
    keep_text: bool = True, **fitting,
) -> DataFrame:
    """Add ``n_tokens``, ``posterior`` (array by sorted domain) and ``rate`` to every row of ``docs``.

    targets: domain to weight. Null and empty texts have no tokens, the prior, and a rate like others of that
    posterior; long texts count whole. Columns of the result that ``docs`` has already are replaced; other columns stay,
    whatever their names (``text`` unless ``keep_text`` is false, which saves writing the texts); repeated rows
    get equal rates, as do texts of equal posteriors; empty tables give an empty result. ``report`` tells of the result
    which token totals were reached against the targets; where a domain isn't within 0.1% of its own, a warning does too,
    or ValueError is raised with ``unmet="raise"``.
    """
    domains = sorted(targets)
    docs = spread(docs.drop(*[c for c in docs.columns if c.lower() in ("n_tokens", "posterior", "rate")]))
    model = fit(docs, labels, domains, text=text, **fitting)
    known = with_posteriors(docs, model, text)
    known = materialize(known if keep_text else known.drop(text), "posteriors")  # classified once, whatever is asked of the rates
    with small_rounds(docs.sparkSession):
        plan = solve(known.select("n_tokens", "posterior"), [targets[d] for d in domains], budget, least)
    told = {"domains": domains, "reached": plan.reached, "targets": plan.targets, "met": plan.met, "optimal": plan.optimal}
    if not plan.met:
        totals = ", ".join(f"{d} {a:.0f} of {b:.0f}" for d, a, b in zip(domains, plan.reached, plan.targets, strict=True))
        how = "no rates come nearer" if plan.optimal else "the search didn't end"
        if unmet == "raise":
            raise ValueError(f"token targets not met ({how}): {totals}")
        warnings.warn(f"token targets not met ({how}): {totals}", stacklevel=2)
    return known.withColumn("rate", rate_of(plan.steps, plan.least).alias("rate", metadata=told))


def report(mixed: DataFrame) -> dict:
    """domains, their token totals reached and targets, met and optimal of a result of ``mix``; kept in files of it too."""
    return dict(mixed.schema["rate"].metadata)


def drawn(docs: DataFrame, *by: str) -> DataFrame:
    """Each row floor(rate + u) times, u in [0, 1) from a hash of the columns ``by``; expected copies are the rate.

    Rows of null rate or none are left out. Copies are made by thousands, so that no row becomes a long array.
    """
    u = F.pmod(F.xxhash64(F.lit("draw"), *by), F.lit(1 << 20)).cast("double") / float(1 << 20)
    copies, some, one = unused(docs, "copies", "some", "one")
    out = docs.withColumn(copies, F.floor(F.col("rate") + u).cast("long")).where(F.col(copies) > 0)
    out = out.withColumn(some, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({copies} - 1) div 1000"))))
    left = F.least(F.lit(1000).cast("long"), F.col(copies) - F.col(some) * 1000)
    return out.withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), left))).drop(copies, some, one)
