"""Group-balanced regressions fitted by Newton steps over Spark aggregations.

Each iteration is one aggregation for objective, gradient and Hessian (d^2 numbers); only
those sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsfuse.functions.scalars import sigmoid
from obsfuse.runtime import attach, durable

LOG_2PI = 1.8378770664093453


@dataclass(frozen=True)
class Standardiser:
    center: list[float]
    scale: list[float]

    def columns(self, features: str = "features") -> list[Column]:
        return [
            (F.col(features)[i] - F.lit(c)) / F.lit(s)
            for i, (c, s) in enumerate(zip(self.center, self.scale, strict=True))
        ]


def group_weights(df: DataFrame, group: str = "group_id", name: str = "w") -> DataFrame:
    """1 / (G n_g): every group carries the same total weight."""
    return attach(df, _shares(df, group, name), [group])


def _shares(df: DataFrame, group: str, name: str) -> DataFrame:
    """The weight of one row of each group."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.count(F.lit(1)).alias("__g"))
    return counts.crossJoin(F.broadcast(total)).select(group, (F.lit(1.0) / (F.col("__g") * F.col("__n"))).alias(name))


def standardise(df: DataFrame, size: int, features: str = "features", weight: str = "w") -> Standardiser:
    """Weighted mean and scale; a scale of at most 1e-12 becomes 1."""
    w = F.col(weight)
    first = df.agg(*[(F.sum(w * F.col(features)[i]) / F.sum(w)).alias(f"m{i}") for i in range(size)]).collect()[0]
    center = [float(first[f"m{i}"]) for i in range(size)]
    second = df.agg(
        *[(F.sum(w * (F.col(features)[i] - F.lit(c)) ** 2) / F.sum(w)).alias(f"v{i}") for i, c in enumerate(center)]
    ).collect()[0]
    scale = [float(np.sqrt(second[f"v{i}"])) for i in range(size)]
    return Standardiser(center, [s if s > 1e-12 else 1.0 for s in scale])


Evaluation = tuple[float, np.ndarray, np.ndarray]


def newton(
    evaluate: Callable[[np.ndarray], Evaluation],
    objectives: Callable[[list[np.ndarray]], list[float]],
    start: np.ndarray,
    iterations: int,
    tolerance: float,
    halvings: int = 20,
) -> tuple[np.ndarray, int, bool]:
    """Damped Newton: the first step fraction 1, 1/2, 1/4 ... that lowers the objective.

    ``evaluate`` returns objective, gradient and Hessian from one pass, so an accepted full
    step costs one pass; shorter fractions are tried together in one more.
    """
    theta = start
    value, grad, hess = evaluate(theta)
    for it in range(1, iterations + 1):
        step = np.linalg.solve(hess + 1e-12 * np.eye(len(theta)), grad)
        if np.linalg.norm(step) <= tolerance * (1.0 + np.linalg.norm(theta)):
            return theta, it, True
        fraction, trial = 1.0, evaluate(theta - step)
        if not trial[0] < value - 1e-14:
            fractions = [0.5**k for k in range(1, halvings)]
            found = objectives([theta - f * step for f in fractions])
            good = [f for f, v in zip(fractions, found, strict=True) if v < value - 1e-14]
            if not good:
                return theta, it, bool(abs(trial[0] - value) <= 1e-12 * (1.0 + abs(value)))
            fraction = good[0]
            trial = evaluate(theta - fraction * step)
        theta = theta - fraction * step
        value, grad, hess = trial
        if np.linalg.norm(fraction * step) <= tolerance * (1.0 + np.linalg.norm(theta)):
            return theta, it, True
    return theta, iterations, False


def _linear(x: Sequence[Column], theta: np.ndarray) -> Column:
    return sum((F.lit(float(t)) * c for t, c in zip(theta[1:], x, strict=True)), F.lit(float(theta[0])))


@dataclass(frozen=True)
class LogisticModel:
    standardiser: Standardiser
    theta: np.ndarray
    iterations: int
    converged: bool
    lower: float = 0.01
    upper: float = 0.99

    def probability(self, features: str = "features") -> Column:
        raw = sigmoid(_linear(self.standardiser.columns(features), self.theta))
        return F.least(F.greatest(raw, F.lit(self.lower)), F.lit(self.upper))


def fit_logistic(
    df: DataFrame, size: int, ridge: float = 1e-3, iterations: int = 100, tolerance: float = 1e-9
) -> tuple[LogisticModel, DataFrame]:
    """Group-balanced ridge logistic fit; returns the model and a one-row report.

    Rows: group_id, features (array), label (0/1), optional ``mask``.
    """
    rows = df.where("mask") if "mask" in df.columns else df
    rows = durable(group_weights(rows.select("group_id", "features", "label")))
    std = standardise(rows, size)
    x = std.columns()
    data = rows.select("w", "label", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    cols = [F.lit(1.0), *[F.col(f"x{i}") for i in range(size)]]
    reg = np.diag([0.0, *[ridge] * size])
    w, y = F.col("w"), F.col("label")
    d = size + 1

    def loss(t: np.ndarray) -> Column:
        z = _linear(cols[1:], t)
        return F.sum(w * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z))

    def evaluate(theta: np.ndarray) -> Evaluation:
        p = data.withColumn("p", sigmoid(_linear(cols[1:], theta)))
        r = w * (F.col("p") - y)
        k = w * F.col("p") * (1 - F.col("p"))
        row = p.agg(
            loss(theta).alias("o"),
            *[F.sum(r * cols[i]).alias(f"g{i}") for i in range(d)],
            *[F.sum(k * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)],
        ).collect()[0]
        grad = np.array([row[f"g{i}"] for i in range(d)]) + reg @ theta
        hess = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) + reg
        return float(row["o"]) + 0.5 * float(theta @ reg @ theta), grad, hess

    def objectives(thetas: list[np.ndarray]) -> list[float]:
        row = data.agg(*[loss(t).alias(f"o{i}") for i, t in enumerate(thetas)]).collect()[0]
        return [float(row[f"o{i}"]) + 0.5 * float(t @ reg @ t) for i, t in enumerate(thetas)]

    rate = float(data.agg((F.sum(w * y) / F.sum(w)).alias("r")).collect()[0]["r"])
    start = np.zeros(d)
    clipped = min(max(rate, 1e-6), 1 - 1e-6)
    start[0] = np.log(clipped / (1 - clipped))
    theta, n, ok = newton(evaluate, objectives, start, iterations, tolerance)
    model = LogisticModel(std, theta, n, ok)
    scored = rows.withColumn("p", model.probability())
    p = F.col("p")
    report = scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("group_id").alias("groups"),
        F.lit(rate).alias("nominal_fraction"),
        (-F.sum(w * (y * F.log(p) + (1 - y) * F.log(1 - p)))).alias("log_loss"),
        F.sum(w * (p - y) ** 2).alias("brier"),
        F.lit(ok).alias("converged"),
    )
    return model, report


# --- conditional logit -----------------------------------------------------------------------


@dataclass(frozen=True)
class ChoiceModel:
    standardiser: Standardiser
    theta: np.ndarray  # null indicator first
    iterations: int
    converged: bool

    def logit(self) -> Column:
        null = F.when(F.col("kind") == "null", 1.0).otherwise(0.0)
        x = self.standardiser.columns()
        linked = F.when(F.col("kind") == "null", 0.0).otherwise(1.0)
        parts = [linked * F.lit(float(t)) * c for t, c in zip(self.theta[1:], x, strict=True)]
        return sum(parts, null * F.lit(float(self.theta[0])))


def example_weights(df: DataFrame) -> DataFrame:
    """1 / (G examples_g) on every candidate row of an example.

    An example lies in one group, so the weight is attached by group, not by example.
    """
    rows = df.where("example_id IS NOT NULL")
    ex = rows.select("group_id", "example_id").distinct()
    return attach(rows, _shares(ex, "group_id", "w"), ["group_id"])


def fit_choice(
    df: DataFrame, size: int, ridge: float = 1e-3, iterations: int = 100, tolerance: float = 1e-9
) -> ChoiceModel:
    """Conditional logit over the candidates of each example (one is true).

    Gradient and Hessian come from per-example sums of exp-weighted moments, so an example
    of any size is combined on the map side.  An overflowing trial step has an infinite
    objective and is halved.
    """
    rows = durable(example_weights(df))
    linked = rows.where(F.col("kind") != "null")
    std = standardise(linked, size)
    null = F.when(F.col("kind") == "null", 1.0).otherwise(0.0)
    d = size + 1
    x = [null, *[F.when(F.col("kind") == "null", 0.0).otherwise(c) for c in std.columns()]]
    wide = rows.select("example_id", "w", "is_true", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    true = wide.where("is_true").select("example_id", *[F.col(f"x{i}").alias(f"t{i}") for i in range(d)])
    # candidates relative to the true one: the softmax and all moments only need these
    data = durable(attach(wide, true, ["example_id"], how="inner", salt=4, merge=True).select("example_id", "w", *[(F.col(f"x{i}") - F.col(f"t{i}")).alias(f"d{i}") for i in range(d)]))
    cols = [F.col(f"d{i}") for i in range(d)]
    tri = [(i, j) for i in range(d) for j in range(i, d)]

    def logit(theta: np.ndarray) -> Column:
        return sum((F.lit(float(t)) * c for t, c in zip(theta, cols, strict=True)), F.lit(0.0))

    def evaluate(theta: np.ndarray) -> Evaluation:
        e = data.withColumn("e", F.exp(logit(theta)))
        per = e.groupBy("example_id").agg(
            F.max("w").alias("w"), F.sum("e").alias("s"),
            *[F.sum(F.col("e") * cols[i]).alias(f"a{i}") for i in range(d)],
            *[F.sum(F.col("e") * cols[i] * cols[j]).alias(f"b{i}_{j}") for i, j in tri],
        )
        m = [F.col(f"a{i}") / F.col("s") for i in range(d)]
        row = per.agg(
            F.sum(F.col("w") * F.log("s")).alias("o"),
            *[F.sum(F.col("w") * m[i]).alias(f"g{i}") for i in range(d)],
            *[F.sum(F.col("w") * (F.col(f"b{i}_{j}") / F.col("s") - m[i] * m[j])).alias(f"h{i}_{j}") for i, j in tri],
        ).collect()[0]
        grad = np.array([row[f"g{i}"] for i in range(d)]) + ridge * theta
        hess = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) + ridge * np.eye(d)
        return float(row["o"]) + 0.5 * ridge * float(theta @ theta), grad, hess

    def objectives(thetas: list[np.ndarray]) -> list[float]:
        per = data.groupBy("example_id").agg(F.max("w").alias("w"), *[F.sum(F.exp(logit(t))).alias(f"s{k}") for k, t in enumerate(thetas)])
        row = per.agg(*[F.sum(F.col("w") * F.log(f"s{k}")).alias(f"o{k}") for k in range(len(thetas))]).collect()[0]
        return [float(row[f"o{k}"]) + 0.5 * ridge * float(t @ t) for k, t in enumerate(thetas)]

    theta, n, ok = newton(evaluate, objectives, np.zeros(d), iterations, tolerance, 24)
    return ChoiceModel(std, theta, n, ok)


def choice_probabilities(df: DataFrame, model: ChoiceModel) -> DataFrame:
    l = df.withColumn("__l", model.logit())  # noqa: E741
    top = l.groupBy("example_id").agg(F.max("__l").alias("__top"))
    e = attach(l, top, ["example_id"], salt=4, merge=True).withColumn("__e", F.exp(F.col("__l") - F.col("__top")))
    total = e.groupBy("example_id").agg(F.sum("__e").alias("__s"))
    return attach(e, total, ["example_id"], salt=4, merge=True).withColumn("probability", F.col("__e") / F.col("__s")).select(*df.columns, "probability")


def cross_fit_choice(df: DataFrame, size: int, folds: int = 4, ridge: float = 1e-3) -> DataFrame:
    """Out-of-fold probabilities; fold = sorted group index mod ``folds``."""
    from obsfuse.operators.ranking import with_row_number

    fold = with_row_number(df.select("group_id").distinct(), [], ["group_id"], "__i").select(
        "group_id", F.pmod(F.col("__i") - 1, F.lit(folds)).cast("int").alias("fold")
    )
    tagged = durable(attach(df, fold, ["group_id"], how="inner"))
    out = None
    for k in range(folds):
        model = fit_choice(tagged.where(F.col("fold") != k), size, ridge)
        if not model.converged:
            raise RuntimeError("cross-fit optimisation did not converge")
        part = choice_probabilities(tagged.where(F.col("fold") == k), model)
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def choice_report(predicted: DataFrame, bins: int = 10) -> DataFrame:
    """Group-balanced log score, uniform log score, Brier, accuracy and ECE (one row)."""
    rows = example_weights(predicted)
    p, t = F.col("probability"), F.col("is_true")
    per = rows.groupBy("example_id").agg(
        F.max("w").alias("w"),
        F.count(F.lit(1)).alias("candidates"),
        F.max(F.when(t, p)).alias("p_true"),
        F.sum((p - F.when(t, 1.0).otherwise(0.0)) ** 2).alias("brier"),
        F.max(F.struct(p, (-F.xxhash64("candidate_id")).alias("h"), t)).alias("best"),
    )
    per = per.withColumns({"confidence": F.col("best.probability"), "hit": F.when(F.col("best.is_true"), 1.0).otherwise(0.0)})
    w = F.col("w")
    base = per.agg(
        F.count(F.lit(1)).alias("examples"),
        (-F.sum(w * F.log(F.greatest("p_true", F.lit(2.2250738585072014e-308))))).alias("log_loss"),
        F.sum(w * F.log("candidates")).alias("uniform_log_loss"),
        F.sum(w * F.col("brier")).alias("brier"),
        F.sum(w * F.col("hit")).alias("accuracy"),
    )
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    ece = per.groupBy(b.alias("bin")).agg(
        F.abs(F.sum(w * F.col("confidence")) - F.sum(w * F.col("hit"))).alias("gap")
    ).agg(F.sum("gap").alias("ece"))
    return base.crossJoin(ece)


# --- three-axis variance regression ------------------------------------------------------------


@dataclass(frozen=True)
class VarianceRegression:
    standardiser: Standardiser
    theta: np.ndarray  # (3, d)
    iterations: int
    converged: bool
    lower: float = -30.0
    upper: float = 30.0
    floor: float = 1e-12

    def variances(self, features: str = "features") -> list[Column]:
        x = self.standardiser.columns(features)
        return [
            F.greatest(F.exp(F.least(F.greatest(_linear(x, t), F.lit(self.lower)), F.lit(self.upper))), F.lit(self.floor))
            for t in self.theta
        ]


def fit_variance_regression(
    df: DataFrame,
    size: int,
    residuals: Sequence[str] = ("e_ray", "e_tangent", "e_normal"),
    ridge: float = 1e-3,
    coupling: float = 1e-2,
    iterations: int = 100,
    tolerance: float = 1e-8,
) -> VarianceRegression:
    """Log-variance linear in features per axis; the two lateral axes are coupled.

    All three axes share one aggregation per iteration (block gradient and Hessian).
    """
    rows = durable(group_weights(df.select("group_id", "features", *residuals)))
    std = standardise(rows, size)
    data = rows.select(
        "w", *[(F.col(r) * F.col(r)).alias(f"r{k}") for k, r in enumerate(residuals)], *[c.alias(f"x{i + 1}") for i, c in enumerate(std.columns())]
    )
    d = size + 1
    cols = [F.lit(1.0), *[F.col(f"x{i + 1}") for i in range(size)]]
    base = VarianceRegression(std, np.zeros((3, d)), 0, False)
    reg = np.diag([0.0, *[ridge] * size])
    link = np.zeros((3 * d, 3 * d))
    eye = coupling * np.eye(d)
    link[d : 2 * d, d : 2 * d] = link[2 * d :, 2 * d :] = eye
    link[d : 2 * d, 2 * d :] = link[2 * d :, d : 2 * d] = -eye
    penalty = np.kron(np.eye(3), reg) + link
    w = F.col("w")

    def eta(t: np.ndarray) -> Column:
        return F.least(F.greatest(_linear(cols[1:], t), F.lit(base.lower)), F.lit(base.upper))

    def loss(t: np.ndarray) -> Column:
        parts = [eta(t[k * d : k * d + d]) for k in range(3)]
        return F.sum(w * sum((0.5 * (p + F.col(f"r{k}") * F.exp(-p)) for k, p in enumerate(parts)), F.lit(0.0)))

    def evaluate(theta: np.ndarray) -> Evaluation:
        q = data.withColumns({f"q{k}": F.col(f"r{k}") * F.exp(-eta(theta[k * d : k * d + d])) for k in range(3)})
        row = q.agg(
            loss(theta).alias("o"),
            *[F.sum(0.5 * w * (1 - F.col(f"q{k}")) * cols[i]).alias(f"g{k}_{i}") for k in range(3) for i in range(d)],
            *[F.sum(0.5 * w * F.col(f"q{k}") * cols[i] * cols[j]).alias(f"h{k}_{i}_{j}") for k in range(3) for i in range(d) for j in range(i, d)],
        ).collect()[0]
        grad = np.array([row[f"g{k}_{i}"] for k in range(3) for i in range(d)]) + penalty @ theta
        hess = penalty.copy()
        for k in range(3):
            hess[k * d : k * d + d, k * d : k * d + d] += np.array([[row[f"h{k}_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        return float(row["o"]) + 0.5 * float(theta @ penalty @ theta), grad, hess

    def objectives(thetas: list[np.ndarray]) -> list[float]:
        row = data.agg(*[loss(t).alias(f"o{i}") for i, t in enumerate(thetas)]).collect()[0]
        return [float(row[f"o{i}"]) + 0.5 * float(t @ penalty @ t) for i, t in enumerate(thetas)]

    mean = data.agg(*[F.sum(w * F.col(f"r{k}")).alias(f"m{k}") for k in range(3)]).collect()[0]
    start = np.zeros(3 * d)
    for k in range(3):
        start[k * d] = np.log(max(float(mean[f"m{k}"]), base.floor))
    theta, n, ok = newton(evaluate, objectives, start, iterations, tolerance)
    return VarianceRegression(std, theta.reshape(3, d), n, ok)


def variance_scores(
    df: DataFrame, candidate: Sequence[Column], baseline: Sequence[Column], residuals: Sequence[str] = ("e_ray", "e_tangent", "e_normal")
) -> DataFrame:
    """Per group mean NLL, coverage at 90 %, RMS width and energy / 3 of two models."""
    out: list[Column] = [F.count(F.lit(1)).alias("n")]
    staged = df.withColumns(
        {f"__{n}{k}": v for n, vs in (("candidate", candidate), ("baseline", baseline)) for k, v in enumerate(vs)}
    )
    for n in ("candidate", "baseline"):
        v = [F.col(f"__{n}{k}") for k in range(3)]
        energy = sum((F.col(r) * F.col(r) / c for r, c in zip(residuals, v, strict=True)), F.lit(0.0))
        logs = sum((F.log(c) for c in v), F.lit(0.0))
        out += [
            F.avg(0.5 * (3 * LOG_2PI + logs + energy)).alias(f"{n}_nll"),
            F.avg(F.when(energy <= 6.25138863, 1.0).otherwise(0.0)).alias(f"{n}_coverage_90"),
            F.avg(F.sqrt((v[0] + v[1] + v[2]) / 3.0)).alias(f"{n}_width"),
            (F.avg(energy) / 3.0).alias(f"{n}_energy"),
        ]
    return staged.groupBy("group_id").agg(*out)


def promotion_summary(groups: DataFrame, maximum_nll_delta: float = 0.0, minimum_improved: float = 0.5, maximum_width_ratio: float = 1.0) -> DataFrame:
    """Equal-group criteria for replacing the baseline variance model (one row)."""
    delta = F.col("candidate_nll") - F.col("baseline_nll")
    a = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg(delta).alias("mean_nll_delta"),
        F.max(delta).alias("worst_nll_delta"),
        F.avg(F.when(delta < 0, 1.0).otherwise(0.0)).alias("improved_fraction"),
        (F.avg("candidate_width") / F.avg("baseline_width")).alias("width_ratio"),
        F.avg(F.abs(F.col("candidate_coverage_90") - 0.9)).alias("candidate_coverage_error"),
        F.avg(F.abs(F.col("baseline_coverage_90") - 0.9)).alias("baseline_coverage_error"),
    )
    ok = (
        (F.col("mean_nll_delta") <= maximum_nll_delta)
        & (F.col("improved_fraction") >= minimum_improved)
        & (F.col("width_ratio") <= maximum_width_ratio)
        & (F.col("candidate_coverage_error") <= F.col("baseline_coverage_error"))
    )
    return a.withColumn("promoted", ok)
