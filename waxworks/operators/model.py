"""Keeper model: Bayesian logistic regression over all of a record's features.

It keeps the contract of a contextual bandit's scorer (a probability, a positive uncertainty that
shrinks with evidence, cheap updates). A row is a short list of (slot, value) over every hashed
category, every number and every title term; a pass is one Spark aggregate by slot, for any number of
models at once, and the driver sees two numbers for each slot.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waxworks.functions.numeric import VOCABULARY, sigmoid
from waxworks.operators.bandit import predicted_flag, reward
from waxworks.operators.features import CONDITION_COLUMNS, NUMBER_COLUMNS, TITLE_TERMS
from waxworks.operators.metrics import MAX_CLASS_WEIGHT, evaluate
from waxworks.operators.ordering import split_by_position
from waxworks.session import stable

# Cut for accuracy while training, rounds without progress before stopping.
TRAIN_CUT, PATIENCE = 0.2, 15

#: Categories and their numbers of slots, in the order of the slots.
CATEGORIES = (
    ("artist_idx", VOCABULARY["artist"]), ("label_idx", VOCABULARY["label"]),
    *((f"genre_{i}", VOCABULARY["genre"]) for i in (1, 2, 3)), *((f"style_{i}", VOCABULARY["style"]) for i in (1, 2, 3)),
)
PLAIN = NUMBER_COLUMNS + CONDITION_COLUMNS
#: Intercept, numbers and condition; each category; then the title's terms.
FIRST_CATEGORY = 1 + len(PLAIN)
FIRST_TERM = FIRST_CATEGORY + sum(n for _, n in CATEGORIES)

ENTRIES = "array<struct<slot: int, value: double>>"


def width(title_terms: int = TITLE_TERMS) -> int:
    return FIRST_TERM + title_terms


@dataclass
class KeeperModel:
    """Weight and precision of every slot, and how the fit went."""

    weights: np.ndarray
    precision: np.ndarray
    history: list[dict] = field(default_factory=list)

    def to_rows(self, spark: SparkSession) -> DataFrame:
        """(slot, weight, precision)."""
        rows = [(i, float(w), float(p)) for i, (w, p) in enumerate(zip(self.weights, self.precision))]
        return spark.createDataFrame(rows, "slot int, weight double, precision double")

    @staticmethod
    def from_rows(rows: DataFrame) -> KeeperModel:
        found = rows.orderBy("slot").toPandas()  # one row for each slot
        return KeeperModel(found["weight"].to_numpy(float), found["precision"].to_numpy(float))


def design(df: DataFrame) -> DataFrame:
    """Add ``x``: (slot, value) of the intercept, numbers, condition, hashed categories and title terms.

    Values of 0, empty categories and unknown terms have no entry. The title's block comes from the columns
    ``title_idx`` and ``title_weight``; a frame without them has none.
    """

    def entry(slot: Column, value: Column) -> Column:
        return F.struct(slot.cast("int").alias("slot"), value.cast("double").alias("value"))

    plain = [entry(F.lit(0), F.lit(1.0)), *[entry(F.lit(1 + i), F.col(n)) for i, n in enumerate(PLAIN)]]
    at = FIRST_CATEGORY
    for name, size in CATEGORIES:
        plain.append(entry(F.lit(at) + F.col(name), (F.col(name) > 0).cast("double")))
        at += size
    x = F.array(*plain)
    if "title_idx" in df.columns:
        x = F.concat(x, F.zip_with("title_idx", "title_weight", lambda i, w: entry(i + FIRST_TERM, w)))
    return df.withColumn("x", F.filter(x, lambda e: F.coalesce(e["value"], F.lit(0.0)) != 0).cast(ENTRIES))


def _vector(values: np.ndarray) -> Column:
    """A constant array; one literal, however long."""
    return F.split(F.lit(",".join(map(repr, np.asarray(values, float).tolist()))), ",").cast("array<double>")


def _linear(x: str, weights: np.ndarray) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, e: a + e["value"] * F.get(_vector(weights), e["slot"]))


def probability(x: str, weights: np.ndarray) -> Column:
    return sigmoid(F.least(F.greatest(_linear(x, weights), F.lit(-35.0)), F.lit(35.0)))


# ---------------------------------------------------------------- passes


@dataclass
class Point:
    """Weights at which a pass is wanted, and the weight of positive rows there."""

    weights: np.ndarray
    pos_weight: float


# sums over rows that come with the bias slot
_SUMS = ("train_loss", "val_loss", "val_right")


def slot_sums(rows: DataFrame, points: list[Point]) -> DataFrame:
    """Sums by slot over (x, y, is_val): for each point gradient and curvature of the training rows, and losses.

    Every point is evaluated in the same scan: a row's probabilities are computed once, its entries carry
    the residuals to their slots, and map-side sums leave a task with one row for each slot.
    """
    train, y = ~F.col("is_val"), F.col("y")
    own = [train.cast("long").alias("n_train"), F.col("is_val").cast("long").alias("n_val"), "x"]
    named = rows.select("*", *[probability("x", p.weights).alias(f"p{k}") for k, p in enumerate(points)])
    for k, point in enumerate(points):
        p = F.col(f"p{k}")
        weight = F.when(y > 0, F.lit(float(point.pos_weight))).otherwise(F.lit(1.0))
        loss = -(y * F.log(p) + (1 - y) * F.log1p(-p))
        right = F.col("is_val") & ((p > TRAIN_CUT) == (y > 0))
        own += [
            F.when(train, weight * (y - p)).otherwise(0.0).alias(f"r{k}"), F.when(train, weight * p * (1 - p)).otherwise(0.0).alias(f"c{k}"),
            F.when(train, weight * loss).otherwise(0.0).alias(f"train_loss{k}"), F.when(train, F.lit(0.0)).otherwise(loss).alias(f"val_loss{k}"),
            right.cast("double").alias(f"val_right{k}"),
        ]
    wide = named.select(*own)
    flat = wide.select(F.explode("x").alias("e"), *[c for c in wide.columns if c != "x"])
    value = F.col("e.value")
    sums = [F.sum("n_train").alias("n_train"), F.sum("n_val").alias("n_val")]
    for k in range(len(points)):
        sums += [F.sum(value * F.col(f"r{k}")).alias(f"gradient{k}"), F.sum(value * value * F.col(f"c{k}")).alias(f"curvature{k}")]
        sums += [F.sum(f"{s}{k}").alias(f"{s}{k}") for s in _SUMS]
    return flat.groupBy(F.col("e.slot").alias("slot")).agg(*sums)


def _pass(rows: DataFrame, points: list[Point]) -> list[tuple[np.ndarray, np.ndarray, dict]]:
    """Gradient, curvature and losses at every point."""
    found = slot_sums(rows, points).toPandas()  # one row for each slot in use
    out = []
    for k, point in enumerate(points):
        gradient, curvature = np.zeros(len(point.weights)), np.zeros(len(point.weights))
        gradient[found["slot"]], curvature[found["slot"]] = found[f"gradient{k}"], found[f"curvature{k}"]
        bias = found[found["slot"] == 0]  # every row has this entry once
        names = {"n_train": "n_train", "n_val": "n_val", **{s: f"{s}{k}" for s in _SUMS}}
        out.append((gradient, curvature, {n: float(bias[c].sum()) for n, c in names.items()}))
    return out


class Search:
    """L-BFGS for a logistic loss with a Gaussian prior, told the sums of one pass at a time.

    ``point`` is where the next pass is wanted. The curvature's diagonal scales the two loops. A step that
    doesn't lower the loss enough is halved.
    """

    KEPT, HALVINGS = 10, 12
    GAIN = 1e-5  # a step that promises less, as a share of the loss, is the last

    def __init__(self, mean: np.ndarray, precision: np.ndarray, free: np.ndarray | None = None):
        self.mean, self.precision = mean, precision
        self.free = np.ones(len(mean), bool) if free is None else free  # the others stay at the mean
        self.point, self.at, self.done = mean.copy(), None, False
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.step, self.halved = 1.0, 0

    def told(self, loss: float, gradient: np.ndarray, curvature: np.ndarray) -> bool:
        """Takes the sums at ``point``; whether the step there counts."""
        away = self.point - self.mean
        value = loss + 0.5 * float(self.precision @ away**2)
        slope = np.where(self.free, self.precision * away - gradient, 0.0)
        if self.at is not None:
            weights, before, old, direction = self.at
            if value > before + 1e-4 * self.step * float(old @ direction):
                self.step, self.halved = self.step / 2, self.halved + 1
                self.done = self.halved >= self.HALVINGS
                self.point = weights + self.step * direction
                return False
            moved, turned = self.point - weights, slope - old
            if moved @ turned > 1e-12:
                self.pairs = [*self.pairs, (moved, turned)][-self.KEPT :]
        direction = -self._scaled(slope, 1.0 / (curvature + self.precision))
        self.at, self.step, self.halved = (self.point.copy(), value, slope, direction), 1.0, 0
        self.done = -float(slope @ direction) < self.GAIN * max(1.0, value)
        self.point = self.point + direction
        return True

    def _scaled(self, slope: np.ndarray, scale: np.ndarray) -> np.ndarray:
        out, used = slope.copy(), []
        for moved, turned in reversed(self.pairs):
            a = (moved @ out) / (moved @ turned)
            out -= a * turned
            used.append(a)
        if self.pairs:
            moved, turned = self.pairs[-1]
            out *= scale * float(moved @ turned) / float(turned @ (scale * turned))
        else:
            out *= scale / 8  # slots occur together, so the diagonal alone would step too far
        for (moved, turned), a in zip(self.pairs, reversed(used)):
            out += (a - (turned @ out) / (moved @ turned)) * moved
        return out


def positive_weight(rows: DataFrame) -> float:
    n = rows.filter(~F.col("is_val")).agg(F.sum("y").alias("pos"), F.count("*").alias("n")).first()
    pos = float(n["pos"] or 0)
    return min((n["n"] - pos) / (pos + 1e-6), MAX_CLASS_WEIGHT)


@dataclass(frozen=True)
class Setting:
    """One configuration to fit."""

    name: str
    l2: float = 1.0
    max_weight: float = MAX_CLASS_WEIGHT
    titles: bool = True


def fit_models(rows: DataFrame, settings: list[Setting], rounds: int = 25, halve_every: int | None = None, title_terms: int = TITLE_TERMS) -> list[KeeperModel]:
    """Models of all settings on the class-weighted loss of (x, y, is_val), one scan a round for all of them.

    A setting stops when a step no longer moves its weights, or after PATIENCE steps without better
    accuracy on the validation rows; the step with the best accuracy is its model. With ``halve_every``
    the weaker half of those still running stops after every so many rounds.
    """
    d = width(title_terms)
    rows = stable(rows.select("x", "y", "is_val"))  # read once a round
    balance = positive_weight(rows)
    runs = []
    for s in settings:
        free = np.ones(d, bool)
        free[FIRST_TERM:] = s.titles
        runs.append({"search": Search(np.zeros(d), np.full(d, float(s.l2)), free), "weight": min(balance, s.max_weight), "l2": s.l2, "best": None, "score": (-1.0, 0.0), "stale": 0, "history": []})
    active = list(runs)
    for step in range(rounds):
        points = [Point(r["search"].point.copy(), r["weight"]) for r in active]
        for run, point, (gradient, curvature, sums) in zip(list(active), points, _pass(rows, points)):
            if not run["search"].told(sums["train_loss"], gradient, curvature):
                continue
            accuracy, val_loss = sums["val_right"] / max(sums["n_val"], 1.0), sums["val_loss"] / max(sums["n_val"], 1.0)
            run["history"].append({"round": step, "train_loss": sums["train_loss"] / max(sums["n_train"], 1.0), "val_loss": val_loss, "val_accuracy": accuracy})
            fitted = KeeperModel(point.weights, curvature + run["l2"])
            if run["best"] is None or (step and accuracy > run["score"][0]) or len(run["history"]) == 2:  # the untrained start is no candidate
                run["best"], run["score"], run["stale"] = fitted, (accuracy, -val_loss), 0
            else:
                run["stale"] += 1
        active = [r for r in active if not r["search"].done and r["stale"] < PATIENCE]
        if halve_every and (step + 1) % halve_every == 0 and len(active) > 1:
            active = sorted(active, key=lambda r: r["score"], reverse=True)[: -(-len(active) // 2)]
        if not active:
            break
    return [KeeperModel(r["best"].weights, r["best"].precision, r["history"]) for r in runs]


def fit_keeper_model(rows: DataFrame, l2: float = 1.0, rounds: int = 25, max_weight: float = MAX_CLASS_WEIGHT, title_terms: int = TITLE_TERMS) -> KeeperModel:
    """The model of one setting."""
    return fit_models(rows, [Setting("only", l2, max_weight)], rounds, title_terms=title_terms)[0]


def update_keeper_model(model: KeeperModel, rows: DataFrame, steps: int = 10) -> KeeperModel:
    """Posterior after new (x, y), with the model as the prior.

    The new precision is the old one plus the curvature of the new rows, so evidence adds up and a
    batch costs passes over that batch only.
    """
    fresh = stable(rows.select("x", "y", F.lit(False).alias("is_val")))
    weight, search, history = positive_weight(fresh), Search(model.weights, model.precision), []
    weights, gained = model.weights, np.zeros(len(model.weights))
    for step in range(steps):
        point = search.point.copy()
        gradient, curvature, sums = _pass(fresh, [Point(point, weight)])[0]
        if search.told(sums["train_loss"], gradient, curvature):
            weights, gained = point, curvature
            history.append({"round": step, "train_loss": sums["train_loss"] / max(sums["n_train"], 1.0), "n_rows": sums["n_train"]})
        if search.done:
            break
    return KeeperModel(weights, model.precision + gained, history)


# ---------------------------------------------------------------- scores


def score(df: DataFrame, model: KeeperModel | None) -> DataFrame:
    """Add ``mean`` and ``uncertainty`` to rows with ``x``; 0.5 and no uncertainty without a model."""
    if model is None:
        return df.withColumns({"mean": F.lit(0.5), "uncertainty": F.lit(None).cast("double")})
    variance = _vector(1.0 / model.precision)
    spread = F.aggregate("x", F.lit(0.0), lambda a, e: a + e["value"] * e["value"] * F.get(variance, e["slot"]))
    named = df.withColumns({"mean": probability("x", model.weights), "uncertainty": spread})
    slope = F.col("mean") * (1 - F.col("mean"))
    return named.withColumn("uncertainty", F.sqrt(slope * slope * F.col("uncertainty") + 1e-6))


def instance_log(feedback: DataFrame, records: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Training instances to append, and the ones whose record is unknown.

    ``feedback`` is (instance_id, record_id, predicted_prob, uncertainty, actual).
    """
    known = records.select(F.col("id").alias("record_id"))
    flag = predicted_flag(F.col("predicted_prob"), F.lit(threshold))
    found = feedback.join(known, "record_id").withColumn("predicted", flag)
    logged = found.select(
        "instance_id", "record_id", "predicted", "predicted_prob", "uncertainty", "actual",
        reward(F.col("predicted"), F.col("actual")).alias("reward"),
    )
    return logged, feedback.join(known, "record_id", "left_anti")


def training_rows(featured: DataFrame, label: str, *order, cuts=(0.8,), names=("train", "val")) -> DataFrame:
    """(x, y, split, is_val) with the ordered split of the labelled rows."""
    placed = split_by_position(featured, *order, cuts=cuts, names=names)
    return placed.withColumns({"y": F.col(label).cast("double"), "is_val": F.col("split") == "val"})


#: Settings that are compared by default.
SETTINGS = (
    Setting("baseline"), Setting("stronger_prior", l2=10.0), Setting("weaker_prior", l2=0.1),
    Setting("unweighted", max_weight=1.0), Setting("without_titles", titles=False),
)


def metrics_of(rows: DataFrame, models: dict[str, KeeperModel]) -> DataFrame:
    """name, accuracy, precision, recall, f1 and mean_uncertainty of every model on (x, y), in one pass."""
    scored = rows.select("x", "y")
    for i, m in enumerate(models.values()):
        scored = score(scored, m).withColumnsRenamed({"mean": f"m{i}", "uncertainty": f"u{i}"})
    each = [F.struct(F.lit(name).alias("name"), F.col(f"m{i}").alias("predicted_prob"), F.col(f"u{i}").alias("uncertainty")) for i, name in enumerate(models)]
    flat = scored.select(F.explode(F.array(*each)).alias("s"), (F.col("y") > 0).alias("actual")).select("s.*", "actual")
    return evaluate(flat, ["name"])


def compare_models(designed: DataFrame, label: str, *order, settings=SETTINGS, rounds: int = 12, halve_every: int | None = 4) -> DataFrame:
    """Test metrics of each setting on the same 60/20/20 split, best F1 first. All are fitted in the same scans."""
    rows = training_rows(designed, label, *order, cuts=(0.6, 0.8), names=("train", "val", "test")).select("x", "y", "is_val", "split")
    rows = stable(rows)
    fitted = fit_models(rows.filter("split <> 'test'"), list(settings), rounds, halve_every)
    found = metrics_of(rows.filter("split = 'test'"), {s.name: m for s, m in zip(settings, fitted)}).toPandas()  # one row for each setting
    schema = "name string, accuracy double, precision double, recall double, f1 double, mean_uncertainty double"
    return designed.sparkSession.createDataFrame(found, schema).orderBy(F.col("f1").desc(), "name")
