"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Statistics of a text are Spark expressions. On a bounded sample of labelled rows, boosted shallow trees are grown; every
path from a root to a node is a rule, a conjunction of thresholds. A logistic model with a lasso penalty over the rules
keeps the few that matter; the penalty is the one that does best on rows set aside. The rules kept become one constant, which one Spark
expression folds over the statistics: scoring is a scan that neither shuffles nor leaves the JVM, and its plan is as small for many rules as for one.

Defined cases: a null text counts as empty, and an empty one is scored like any other. Labels other than 0 and 1 and
labels without a document are left out; of several labels of one document, the mean decides (a tie is 1). With labels of
one kind only, the score is near 0 or 1 for all; without labels it is 0.5. Repeated rows each get a score, and equal texts the same
one. Very long texts are scored whole, by statistics of fixed size. Columns of ``docs`` may have any names but ``_score``. Empty tables are
scored to empty ones; where documents or labels are missing altogether, the score is 0.5.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are fitted on, at most: those whose ids have the smallest hashes.
FIT_ROWS = 10_000
TREES, DEPTH, BINS, RATE = 40, 3, 48, 0.15
PENALTIES = (0.02, 0.008, 0.003, 0.001, 0.0003)
REJECT_BELOW = 0.3
RULES = "array<struct<weight: double, conditions: array<struct<at: int, threshold: double, above: boolean>>>>"


def bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns that are computed once a row. They come out of a generator over an array of one struct, so that
    the optimizer can neither copy them into each expression that reads them nor move filters on those below them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def counted(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with what is counted in a text, by name."""
    t = F.coalesce(text, F.lit(""))
    df = bound(df, {"_text": t, "_words": F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""), "_lines": F.split(t, "\n")})
    count = lambda p: F.regexp_count("_text", F.lit(p))
    lost = lambda x: F.length("_text") - F.length(F.replace("_text", F.lit(x), F.lit("")))
    size, words = F.size, F.col("_words")
    counts = {
        "n_chars": F.length("_text"), "n_words": size(words), "n_lines": size("_lines"), "n_distinct_words": size(F.array_distinct(words)), "n_distinct_lines": size(F.array_distinct("_lines")),
        "n_short_words": size(F.filter(words, lambda w: F.length(w) <= 3)), "n_long_words": size(F.filter(words, lambda w: F.length(w) >= 16)),
        "n_symbols": count(r"[#$%&*|<>{}\[\]\\/~^@=+_]"), "n_symbol_runs": count(r"[#$%&*|]{2,}"), "n_digits": count(r"[0-9]"), "n_upper": count(r"[A-Z]"),
        "n_stops": count(r"[.!?]"), "n_commas": lost(","), "n_pipes": lost("|"), "n_open_lines": count(r"[^.!?\n]\n"),
    }
    return bound(df, counts)


def statistics() -> dict[str, Column]:
    """The statistics, by name, over the columns of :func:`counted`. All are finite, also for empty texts."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = {n: F.col(f"n_{n}").cast("double") for n in ("chars", "words", "lines")} | {"word_length": share("n_chars", "n_words")}
    out |= {n: share(f"n_{n}", "n_chars") for n in ("symbols", "digits", "upper")}
    out |= {n: share(f"n_{n}", "n_words") for n in ("symbol_runs", "stops", "commas", "short_words", "long_words", "pipes", "distinct_words")}
    return out | {n: share(f"n_{n}", "n_lines") for n in ("distinct_lines", "open_lines")}


def described(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the statistics of a text by name and as the array ``_stats``, each computed once a row however many rules read it."""
    return bound(bound(counted(df, text), statistics()), {"_stats": F.array(*statistics())})


@dataclass
class Rule:
    """statistic, threshold and side (above: greater than) of each condition; all must hold."""

    conditions: tuple[tuple[str, float, bool], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, threshold, above in self.conditions:
            v = x[:, names.index(name)]
            out &= v > threshold if above else v <= threshold
        return out


@dataclass
class RuleEnsemble:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)

    def score(self) -> Column:
        """0 to 1, over the columns of :func:`described`. Weights are added in the order of the rules."""
        names = list(statistics())
        rules = [{"weight": r.weight, "conditions": [{"at": names.index(n), "threshold": t, "above": above} for n, t, above in r.conditions]} for r in self.rules]
        holds = lambda c: (F.get("_stats", c["at"]) > c["threshold"]) == c["above"]
        add = lambda margin, r: margin + F.when(F.forall(r["conditions"], holds), r["weight"]).otherwise(F.lit(0.0))
        margin = F.aggregate(F.from_json(F.lit(json.dumps(rules)), RULES), F.lit(self.intercept), add)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


# --- fitting -------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def least_rows(n: int) -> int:
    """Rows that a rule must hold for, and fail for, of n."""
    return min(20, max(3, n // 50))


def _thresholds(x: np.ndarray) -> list[np.ndarray]:
    """Candidate thresholds of each statistic: quantiles, midway between neighbouring values."""
    out = []
    for v in x.T:
        u = np.unique(v)
        mids = (u[1:] + u[:-1]) / 2
        out.append(mids if len(mids) <= BINS else np.unique(mids[np.searchsorted(u[1:], np.quantile(v, np.linspace(0, 1, BINS + 2)[1:-1])).clip(0, len(mids) - 1)]))
    return out


def grow(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, rows: np.ndarray, names: list[str]) -> tuple[list[tuple], list[tuple]]:
    """One regression tree on the gradient: conditions of every node but the root, and (rows, mean) of its leaves."""
    paths, leaves, todo, least = [], [], [(rows, ())], least_rows(len(gradient))
    while todo:
        own, path = todo.pop()
        if path:
            paths.append(path)
        best, (g, n) = None, (gradient[own].sum(), len(own))
        if len(path) < DEPTH and n >= 2 * least:
            for j, cut in enumerate(cuts):
                if len(cut):
                    c = codes[own, j]
                    size = np.cumsum(np.bincount(c, minlength=len(cut) + 1))[:-1]
                    total = np.cumsum(np.bincount(c, weights=gradient[own], minlength=len(cut) + 1))[:-1]
                    ok = (size >= least) & (n - size >= least)
                    gain = np.where(ok, total**2 / np.maximum(size, 1) + (g - total) ** 2 / np.maximum(n - size, 1) - g * g / n, -1.0)
                    if (k := int(gain.argmax())) >= 0 and gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                        best = gain[k], j, k
        if best is None:
            leaves.append((own, g / n))
            continue
        _, j, k = best
        low = codes[own, j] <= k
        todo += [(own[low], (*path, (names[j], float(cuts[j][k]), False))), (own[~low], (*path, (names[j], float(cuts[j][k]), True)))]
    return paths, leaves


def tightest(path: tuple) -> tuple:
    """The conditions of a path without those that another on the same side of the same statistic implies."""
    out: dict[tuple[str, bool], float] = {}
    for name, threshold, above in path:
        old = out.get((name, above))
        out[name, above] = threshold if old is None else max(old, threshold) if above else min(old, threshold)
    return tuple(sorted((name, threshold, above) for (name, above), threshold in out.items()))


def candidate_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> list[Rule]:
    """Rules from boosted trees, each grown on half of the rows; rules that hold for the same rows once."""
    cuts = _thresholds(x)
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    rng, margin, found = np.random.default_rng(seed), np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(TREES):
        gradient = y - _sigmoid(margin)
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        paths, leaves = grow(codes, cuts, gradient, rows, names) if len(rows) else ([], [])
        p = _sigmoid(margin)
        for own, mean in leaves:
            margin[own] += RATE * mean / max(1e-3, float((p[own] * (1 - p[own])).mean()))
        for path in paths:
            rule = Rule(tightest(path))
            holds = rule.holds(x, names)
            if least_rows(len(y)) <= holds.sum() <= len(y) - least_rows(len(y)):
                found.setdefault(np.packbits(holds).tobytes(), rule)
    return list(found.values())


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient. Columns hold 0 and 1. The penalty is on columns scaled to mean 0 and unit deviation,
    which are never built: z is multiplied as it is (single precision), and shifts and scales are applied to the vectors."""
    n = len(y)
    mean = z.mean(axis=0, dtype=float)
    dev = np.sqrt(mean * (1 - mean)) + 1e-9
    forward = lambda v: z @ (u := (v / dev).astype(np.float32)) - float(mean @ u)
    backward = lambda r: (z.T @ r.astype(np.float32) - mean * r.sum()) / dev
    v = np.ones(z.shape[1])
    for _ in range(30):  # largest eigenvalue, by powers
        v = backward(forward(v / (np.linalg.norm(v) + 1e-12)))
    step = 4 / (1.05 * np.linalg.norm(v) / n + 1)
    b, w = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))), np.zeros(z.shape[1])
    vb, v, t = b, w.copy(), 1.0
    for _ in range(rounds):
        r = _sigmoid(vb + forward(v)) - y
        nb, u = vb - step * r.mean(), v - step * backward(r) / n
        nw = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, v = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        done = np.abs(nw - w).max(initial=0) + abs(nb - b) < 1e-6
        b, w, t = nb, nw, nt
        if done:
            break
    return b - float((w * mean / dev).sum()), w / dev


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble(0.0)
    if y.min() == y.max():
        return RuleEnsemble(40.0 if y[0] else -40.0)
    aside = np.arange(len(y)) % 5 == 4
    rules = candidate_rules(x[~aside], y[~aside], names) or []
    if not rules:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))))
    z = np.empty((len(y), len(rules)), np.float32)
    for j, r in enumerate(rules):
        z[:, j] = r.holds(x, names)
    losses, fitted, z_aside = [], z[~aside], z[aside]
    for penalty in PENALTIES:
        b, w = lasso_logistic(fitted, y[~aside], penalty)
        p = np.clip(_sigmoid(b + z_aside @ w), 1e-6, 1 - 1e-6)
        losses.append(-np.mean(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p)) if aside.any() else penalty)
    del fitted, z_aside
    b, w = lasso_logistic(z, y, PENALTIES[int(np.argmin(losses))])
    kept = [Rule(r.conditions, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4]
    return RuleEnsemble(float(b), kept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> RuleEnsemble:
    """An ensemble from (doc_id, text) and (doc_id, label) on at most ``most`` labelled rows; their statistics go to the driver."""
    own = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("_y"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    names = list(statistics())
    got = described(rows, F.col("text")).select("doc_id", *names, "_y").toPandas().sort_values("doc_id", kind="stable")
    return fit_rules(got[names].to_numpy(float), got["_y"].to_numpy(float), names)


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """The columns of ``docs`` and ``_score``, 0 to 1."""
    kept = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    rows = described(kept, F.col(f"_c{docs.columns.index('text')}"))
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)], model.score().alias("_score"))
