"""Classifiers and their weighted ensemble, on ``pyspark.ml``."""

from __future__ import annotations

import math
import random
import threading
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark import SparkContext
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.operators import evaluate as E
from zonewright.operators import voting
from zonewright.operators.base import Stage, hold, scratch_path, shared_folder

# Names of the common boosting families are accepted for the member that
# takes their place.
ALIASES = {"xgboost": "boosted", "lightgbm": "forest", "catboost": "logistic"}
KINDS = ("boosted", "forest", "logistic", "bayes")
# Parameter names of those families, as understood here.
PARAMETERS = {
    "boosted": {
        "n_estimators": "maxIter", "iterations": "maxIter", "max_depth": "maxDepth", "depth": "maxDepth",
        "learning_rate": "stepSize", "subsample": "subsamplingRate", "min_child_weight": "minInstancesPerNode",
        "min_child_samples": "minInstancesPerNode", "gamma": "minInfoGain", "colsample_bytree": "featureSubsetStrategy",
    },
    "forest": {
        "n_estimators": "numTrees", "iterations": "numTrees", "max_depth": "maxDepth", "depth": "maxDepth",
        "subsample": "subsamplingRate", "min_child_samples": "minInstancesPerNode",
        "min_child_weight": "minInstancesPerNode", "gamma": "minInfoGain", "colsample_bytree": "featureSubsetStrategy",
    },
    "logistic": {"iterations": "maxIter", "n_estimators": "maxIter", "l2_leaf_reg": "regParam", "reg_lambda": "regParam"},
    "bayes": {"smoothing": "smoothing"},
}
# Options of those families that pyspark.ml has no counterpart for.
WITHOUT_COUNTERPART = {
    "boosted": ("reg_alpha", "reg_lambda", "colsample_bylevel", "max_delta_step", "scale_pos_weight"),
    "forest": ("reg_alpha", "reg_lambda", "num_leaves", "subsample_freq"),
    "logistic": ("depth", "random_strength", "bagging_temperature", "one_hot_max_size", "min_data_in_leaf"),
    "bayes": (),
}
DEFAULTS = {
    "boosted": {"maxIter": 500, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 5},
    "forest": {"numTrees": 500, "maxDepth": 12, "subsamplingRate": 0.8, "minInstancesPerNode": 20},
    "logistic": {"maxIter": 500, "regParam": 0.001},
    "bayes": {},
}
# A forest is fitted in parts of so many trees at most, side by side, over tasks of so many rows: each
# task keeps statistics of every open node, so more tasks than rows ask for are work without rows.
TREES, FOREST_ROWS = 64, 65_536
# A part has at most so many bytes of trees on the driver, by their most nodes; larger trees make smaller
# parts. The parts in work at a time take two fifths of its memory at most (in a local session with the
# counts of their tasks, which are in the same memory: each then gets a core's share at most), and a forest that would take more than half of
# that is kept in the shared folder, part by part.
PART_BYTES = 128 << 20
# Boosters of step s seldom end before a few times 1/s rounds, so their first fit has STEPS / s:
# a fit starts anew, and one long fit takes less time than a row of growing ones.
STEPS = 4
DEFAULT_ENSEMBLE = (
    {"type": "boosted", "weight": 0.4},
    {"type": "forest", "weight": 0.4},
    {"type": "logistic", "weight": 0.2},
)


def resolve(kind: str) -> str:
    name = ALIASES.get(kind, kind)
    if name not in KINDS:
        raise ValueError(f"unknown model {kind!r}; use one of {KINDS} or {tuple(ALIASES)}")
    return name


class Member(Estimator, Stage):
    """One classifier. ``options`` takes pyspark.ml names or common aliases.

    ``class_weight='balanced'`` (or ``is_unbalance``) weighs classes by
    N / (k * n); a dict gives the weight of each class index, 1 for the rest.

    Boosting is binary in pyspark.ml, so ``boosted`` fits one model per class,
    however many there are. ``fit_rows`` bounds the labelled rows a booster is
    fitted on, by a hash of the features, if that is too costly; by default
    it takes all. With a ``validation`` column, ``early_stopping_rounds`` ends a
    booster at the round after which the validation loss did not improve for as
    many rounds; rounds are added by doubling until that is seen, and the trees of later
    rounds are left off. ``best_iterations`` and ``losses`` tell what happened.
    """

    SETTINGS = {
        "type": "forest",
        "features": "features",
        "label": "label",
        "output": "probs",
        "options": {},
        "class_weight": None,
        "validation": None,
        "n_classes": None,
        "is_unbalance": False,
        "fit_rows": None,
        "early_stopping_rounds": None,
        "parallelism": 16,
        "seed": 42,
    }

    def _fit(self, df: DataFrame) -> "MemberModel":
        kind, features, label = resolve(self.get("type")), self.get("features"), self.get("label")
        n = self.get("n_classes")
        if n is None:
            n = int(df.agg(F.max(label)).first()[0]) + 1
        params = {**DEFAULTS[kind]}
        for name, value in self.get("options").items():
            if name in WITHOUT_COUNTERPART[kind]:
                raise ValueError(f"{name} has no counterpart in a {kind} member")
            target = PARAMETERS[kind].get(name, name)
            params[target] = str(value) if target == "featureSubsetStrategy" else value
        validation = self.get("validation")
        data = df.select(features, F.col(label).cast("double").alias(label), *([validation] if validation else []))
        given = "balanced" if self.get("is_unbalance") else self.get("class_weight")
        if given == "balanced":
            weights = hold(voting.class_weights(data, label).select(label, "class_weight"))
            data = data.join(weights, label)
            params["weightCol"] = "class_weight"
        elif isinstance(given, dict):
            weights = df.sparkSession.createDataFrame([(float(c), float(w)) for c, w in given.items()], f"`{label}` double, class_weight double")
            data = data.join(weights, label, "left").na.fill(1.0, ["class_weight"])
            params["weightCol"] = "class_weight"
        elif given is not None:
            raise ValueError(f"class_weight must be balanced or a dict, not {given!r}")
        common = {"featuresCol": features, "labelCol": label, "predictionCol": "__pred", "rawPredictionCol": "__raw", "probabilityCol": "__prob"}
        model = MemberModel(**{**self.settings(), "type": kind, "n_classes": n})
        if kind == "boosted":
            if self.get("fit_rows"):
                share = self.get("fit_rows") / max(data.count(), 1)
                data = data.where(F.pmod(F.xxhash64(F.unwrap_udt(features)), F.lit(1 << 20)) < share * (1 << 20))
            data = held(data).persist()
            rounds = self.get("early_stopping_rounds")

            def against_rest(c: int) -> tuple[Model, list[float]]:
                one = data.withColumn("__one", F.when(F.col(label) == c, 1.0).otherwise(0.0))
                booster = GBTClassifier(
                    featuresCol=features, labelCol="__one", predictionCol="__pred", seed=self.get("seed"), **params
                ).setRawPredictionCol("__raw").setProbabilityCol("__prob")
                if not validation:
                    return booster.fit(one), []
                if rounds is None:  # stops by the tolerance of pyspark.ml
                    child = booster.setValidationIndicatorCol(validation).fit(one)
                    return child, child.evaluateEachIteration(one.where(validation))
                training, held_out = one.where(~F.col(validation)), one.where(validation)
                limit, fitted = booster.getMaxIter(), 0
                tried = min(limit, 2 * rounds)
                while True:  # the first rounds of a longer fit are those of a shorter one
                    if tried > fitted:
                        fitted = min(limit, max(tried, math.ceil(STEPS / booster.getStepSize())))
                        child = booster.setMaxIter(fitted).fit(training)
                        found = child.evaluateEachIteration(held_out)
                    losses = found[:tried]
                    best = stopping_round(losses, rounds)
                    if tried == limit or tried - best >= rounds:
                        break
                    tried = min(limit, 2 * tried)
                return first_rounds(child, best), losses

            losses: dict[str, list[float]] = {}
            with ThreadPoolExecutor(self.get("parallelism")) as pool:
                for c, (child, found) in enumerate(pool.map(against_rest, range(n))):
                    model.children[f"class_{c}"] = child
                    if found:
                        losses[f"class_{c}"] = [float(x) for x in found]
            data.unpersist()
            model._set(losses=losses, best_iterations={name: child.getNumTrees for name, child in model.children.items()})
            return model
        if validation:
            data = data.where(~F.col(validation))  # these members have no use for validation rows
        if kind == "forest":
            data = data.persist()
            rows = data.count()
            tasks = max(1, -(-rows // FOREST_ROWS))
            few = data.coalesce(tasks)
            trees, tree = params.pop("numTrees"), tree_bytes(rows, n, params)
            one, own = data.where(F.col(features).isNotNull()).select(features).first(), df.sparkSession.sparkContext
            room, counts = Room.of(df.sparkSession), 0
            if own.master.startswith("local["):  # tasks keep their counts in the driver's memory
                params.setdefault("maxMemoryInMB", max(16, min(256, room.bytes // own.defaultParallelism >> 20)))
                width = len(one[0]) if one else 1
                counts = min(tasks, own.defaultParallelism) * count_bytes(rows, n, width, {"numTrees": min(trees, TREES), **params})
            most = max(1, min(TREES, PART_BYTES // tree))
            sizes = [min(most, trees - i) for i in range(0, trees, most)]
            stored = scratch_path(df.sparkSession, "forest") if 2 * trees * tree > room.bytes else None

            def part(i: int) -> Any:
                with room.taken(sizes[i] * tree + counts):
                    child = RandomForestClassifier(**common, **params, numTrees=sizes[i], seed=self.get("seed") + i).fit(few)
                    if stored is None:
                        return child
                    child.write().save(f"{stored}/part_{i}")
                    return f"{stored}/part_{i}"

            with ThreadPoolExecutor(self.get("parallelism")) as pool:
                found = {f"part_{i}": child for i, child in enumerate(pool.map(part, range(len(sizes))))}
            model.children = found if stored is None else StoredParts(found)
            model._set(trees=dict(zip(found, sizes)), tree_bytes=tree)
            data.unpersist()
            return model
        elif kind == "logistic":
            estimator = LogisticRegression(**common, **params, family="multinomial")
        else:
            estimator = NaiveBayes(**common, **params)
        model.children["model"] = estimator.fit(data)
        return model


def tree_bytes(rows: int, classes: int, params: dict[str, Any]) -> int:
    """Most bytes of a fitted tree on the driver: each node holds counts of the classes, for
    itself and its halves while it is grown."""
    least = max(1, params.get("minInstancesPerNode", 1))
    nodes = min(2 ** (params.get("maxDepth", 5) + 1), 2 * max(1, rows // least))
    return int(nodes * (256 + 32 * classes))


def count_bytes(rows: int, classes: int, width: int, params: dict[str, Any]) -> int:
    """Most bytes of the counts that a task of a forest's fit keeps for its open nodes: by class,
    for the bins of each feature a node draws, within the memory that pyspark.ml gives them."""
    nodes = params["numTrees"] * min(2 ** max(0, params.get("maxDepth", 5) - 1), max(1, rows // max(1, params.get("minInstancesPerNode", 1))))
    drawn = math.ceil(math.sqrt(width)) if params.get("featureSubsetStrategy", "auto") == "auto" and params["numTrees"] > 1 else width
    return min(params.get("maxMemoryInMB", 256) << 20, nodes * drawn * params.get("maxBins", 32) * (classes + 1) * 8)


class Room:
    """What the forests of a session may take of the driver's memory at a time, whichever
    search, folds or ensemble they belong to. One that asks for more than all is let in alone."""

    _rooms: dict[str, "Room"] = {}
    _lock = threading.Lock()

    def __init__(self, size: int) -> None:
        self.bytes, self.used, self.change = size, 0, threading.Condition()

    @classmethod
    def of(cls, spark: SparkSession) -> "Room":
        with cls._lock:
            application = spark.sparkContext.applicationId
            if application not in cls._rooms:
                cls._rooms[application] = Room(spark._jvm.Runtime.getRuntime().maxMemory() * 2 // 5)
            return cls._rooms[application]

    @contextmanager
    def taken(self, size: int) -> Iterator[None]:
        size = min(size, self.bytes)
        with self.change:
            self.change.wait_for(lambda: self.used + size <= self.bytes)
            self.used += size
        try:
            yield
        finally:
            with self.change:
                self.used -= size
                self.change.notify_all()


class StoredParts(Mapping):
    """Parts of a forest in the shared folder, by name; each is loaded when it is asked for."""

    def __init__(self, paths: dict[str, str]) -> None:
        self.paths = paths

    def __getitem__(self, name: str) -> RandomForestClassificationModel:
        return RandomForestClassificationModel.load(self.paths[name])

    def __iter__(self) -> Iterator[str]:
        return iter(self.paths)

    def __len__(self) -> int:
        return len(self.paths)


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model a fit of so many rounds gives: the first trees of a longer one."""
    if model.getNumTrees == rounds:
        return model
    context, given = SparkContext._active_spark_context, model._java_obj
    classes, trees, weights = context._jvm.org.apache.spark.ml, given.trees(), given.treeWeights()
    own = context._gateway.new_array(classes.regression.DecisionTreeRegressionModel, rounds), context._gateway.new_array(context._jvm.double, rounds)
    for i in range(rounds):
        own[0][i], own[1][i] = trees[i], weights[i]
    short = classes.classification.GBTClassificationModel(given.uid(), *own, given.numFeatures(), given.numClasses())
    given.copyValues(short, classes.param.ParamMap.empty())
    short.set("maxIter", rounds)
    out = GBTClassificationModel(short)
    out._resetUid(model.uid)
    out._transfer_params_from_java()
    return out


def held(df: DataFrame) -> DataFrame:
    """The rows in the same partitions and order, without the plan that made them, which
    every task of a fit would carry."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stopping_round(losses: list[float], patience: int) -> int:
    """Rounds to keep: up to the least loss before it failed to improve for
    ``patience`` rounds."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


class MemberModel(Model, Stage):
    """``losses``: validation loss by round, ``best_iterations``: rounds kept,
    both by class and for boosters only. ``trees``: of each part of a forest,
    ``tree_bytes``: the most that one of them takes on the driver."""

    SETTINGS = {**Member.SETTINGS, "losses": {}, "best_iterations": {}, "trees": {}, "tree_bytes": 0}

    def _transform(self, df: DataFrame) -> DataFrame:
        output = self.get("output")
        out = df
        if self.get("type") != "boosted":
            shares, probs = self._shares(), None
            if isinstance(self.children, StoredParts) and not df.isStreaming:
                out, probs, classes = self._added(out, shares)
            else:
                for name, child in self.children.items():
                    out, probs = self._with_part(out, name, child, shares[name], probs)
                classes = child.numClasses
            absent = self.get("n_classes") - classes
            if absent > 0:  # the last classes were not among the training rows
                probs = F.concat(probs, F.array_repeat(F.lit(0.0), absent))
            return out.withColumn(output, probs).drop("__sum", *[f"__{name}" for name in self.children])
        for name, child in self.children.items():
            out = child.transform(out).withColumn(f"__{name}", F.get(vector_to_array("__prob"), F.lit(1)))
            out = out.drop("__prob", "__raw", "__pred")
        each = [f"__{name}" for name in self.children]
        total = sum((F.col(c) for c in each), F.lit(0.0))
        return out.withColumn(output, F.array(*[F.col(c) / total for c in each])).drop(*each)

    def _with_part(self, df: DataFrame, name: str, child: Model, share: float, probs: Column | None) -> tuple[DataFrame, Column]:
        """``df`` with the probabilities of a child, and the sum so far: parts of a forest weigh by their trees."""
        own = vector_to_array("__prob") if share == 1 else F.transform(vector_to_array("__prob"), lambda x: x * F.lit(share))
        out = child.transform(df).withColumn(f"__{name}", own).drop("__prob", "__raw", "__pred")
        return out, F.col(f"__{name}") if probs is None else F.zip_with(probs, f"__{name}", lambda x, y: x + y)

    def _added(self, df: DataFrame, shares: dict[str, float]) -> tuple[DataFrame, Column, int]:
        """``df`` with the sum of the parts' probabilities. The parts are read again a few at a
        time, each time scoring all rows, so the driver never holds the forest."""
        room, trees, tree = Room.of(df.sparkSession), self.get("trees"), self.get("tree_bytes")
        groups: list[list[str]] = []
        for name in self.children:
            if not groups or sum(trees[n] for n in (*groups[-1], name)) * tree > PART_BYTES:
                groups.append([])
            groups[-1].append(name)
        out, probs, classes = df, None, 0
        for group in groups:
            with room.taken(sum(trees[n] for n in group) * tree):
                for name in group:
                    child = self.children[name]
                    out, probs = self._with_part(out, name, child, shares[name], probs)
                    classes = child.numClasses
                out = hold(out.withColumn("__sum", probs).drop(*[f"__{name}" for name in group]))
                probs, child = F.col("__sum"), None
        return out, probs, classes

    def _shares(self) -> dict[str, float]:
        """Weight of each child: by its trees for the parts of a forest, else equal."""
        forest, told = self.get("type") == "forest", self.get("trees")
        trees = told or {name: child.getNumTrees if forest else 1 for name, child in self.children.items()}
        return {name: n / sum(trees.values()) for name, n in trees.items()}

    def importances(self) -> list[float] | None:
        """Scores that sum to 1: impurity gain, or mean absolute coefficients."""
        import numpy as np

        if self.get("type") in ("boosted", "forest"):
            each = [child.featureImportances.toArray() for child in self.children.values()]  # parts of a forest one at a time
            score = np.average(each, axis=0, weights=list(self._shares().values()))
        elif self.get("type") == "logistic":
            score = np.abs(self.children["model"].coefficientMatrix.toArray()).mean(axis=0)
        else:
            return None
        total = score.sum()
        return [float(x) for x in (score / total if total > 0 else score)]


def create_member(kind: str, **params: Any) -> Member:
    resolve(kind)
    settings = {k: params.pop(k) for k in list(params) if k in Member.SETTINGS}
    return Member(type=kind, options=params, **settings)


class Ensemble(Estimator, Stage):
    """Members fitted on the same rows and combined by weight.

    ``voting='soft'`` averages probabilities; ``'hard'`` counts predictions.
    """

    SETTINGS = {
        "members": list(DEFAULT_ENSEMBLE),
        "voting": "soft",
        "features": "features",
        "label": "label",
        "n_classes": None,
        "validation": None,
        "seed": 42,
    }

    def _fit(self, df: DataFrame) -> "EnsembleModel":
        if self.get("voting") not in ("soft", "hard"):
            raise ValueError("voting must be soft or hard")
        n = self.get("n_classes") or int(df.agg(F.max(self.get("label"))).first()[0]) + 1
        named = {f"m{i}_{resolve(member['type'])}": member for i, member in enumerate(self.get("members"))}
        weights = {name: float(member.get("weight", 1.0)) for name, member in named.items()}
        model = EnsembleModel(**{**self.settings(), "n_classes": n})

        def fitted(name: str) -> MemberModel:
            member = named[name]
            return Member(
                type=member["type"], options=member.get("options", {}), class_weight=member.get("class_weight"),
                features=self.get("features"), label=self.get("label"), n_classes=n, output=f"__{name}",
                validation=self.get("validation"), seed=self.get("seed"),
            ).fit(df)

        with ThreadPoolExecutor(max(len(named), 1)) as pool:  # members are fitted side by side
            model.children.update(zip(named, pool.map(fitted, named)))
        model._set(weights=voting.normalized_weights(weights))
        return model


class EnsembleModel(Model, Stage):
    SETTINGS = {**Ensemble.SETTINGS, "weights": {}}

    def _transform(self, df: DataFrame) -> DataFrame:
        out, weights = df, self.get("weights")
        for name in weights:
            out = self.children[name].transform(out)
        columns = {name: F.col(f"__{name}") for name in weights}
        out = out.withColumn("probs", voting.soft_vote(columns, weights))
        if self.get("voting") == "hard":
            picks = {name: voting.predicted_class(c) for name, c in columns.items()}
            prediction = voting.hard_vote(picks, weights)
        else:
            prediction = voting.predicted_class(F.col("probs"))
        return out.withColumn("prediction", prediction.cast("int")).drop(*[f"__{name}" for name in weights])

    def importance_table(self, df: DataFrame, names: list[str]) -> DataFrame:
        """``(feature, importance)``: weighted over the members that have any."""
        spark = df.sparkSession
        rows = [
            (name, feature, score)
            for name in self.get("weights")
            for feature, score in zip(names, self.children[name].importances() or ())
        ]
        table = spark.createDataFrame(rows, "member string, feature string, importance double")
        weights = spark.createDataFrame(list(self.get("weights").items()), "member string, weight double")
        return voting.combined_importance(table, weights)


def metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> dict[str, float]:
    """Five label metrics of a scored table as numbers."""
    return E.label_metrics(E.confusion(scored, label, prediction)).first().asDict()


def cross_validate(df: DataFrame, estimator: Estimator, k: int = 5, fold: str = "fold", label: str = "label", parallelism: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(per fold, summary)`` tables; ``fold`` holds the fold numbers. Folds
    are fitted side by side, ``parallelism`` at a time."""
    df = df.persist()

    def run(f: int) -> tuple:
        model = estimator.fit(df.where(F.col(fold) != f))
        return f, *metrics(model.transform(df.where(F.col(fold) == f)), label).values()

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(run, range(k)))
    names = ["accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro"]
    schema = "fold int, " + ", ".join(f"{n} double" for n in names)
    scores = df.sparkSession.createDataFrame(rows, schema)
    df.unpersist()
    return scores, E.fold_summary(scores, names)


# Search ranges (low, high, kind).
SEARCH_SPACES: dict[str, dict[str, tuple[float, float, str]]] = {
    "boosted": {
        "n_estimators": (100, 1000, "int"),
        "max_depth": (3, 12, "int"),
        "learning_rate": (0.01, 0.3, "log"),
        "subsample": (0.6, 1.0, "float"),
        "colsample_bytree": (0.6, 1.0, "float"),
        "min_child_weight": (1, 10, "int"),
        "gamma": (0.0, 0.5, "float"),
    },
    "forest": {
        "n_estimators": (100, 1000, "int"),
        "max_depth": (5, 16, "int"),
        "subsample": (0.6, 1.0, "float"),
        "min_child_samples": (5, 50, "int"),
    },
}


def sample_parameters(kind: str, trials: int, seed: int = 42, space: dict | None = None) -> list[dict[str, Any]]:
    space = space or SEARCH_SPACES.get(resolve(kind))
    if space is None:
        raise ValueError(f"no search space for {kind!r}")
    rng = random.Random(seed)

    def draw(low: float, high: float, how: str) -> float | int:
        if how == "int":
            return rng.randint(int(low), int(high))
        if how == "log":
            return low * (high / low) ** rng.random()
        return rng.uniform(low, high)

    return [{name: draw(*bounds) for name, bounds in space.items()} for _ in range(trials)]


def search(
    train: DataFrame, validation: DataFrame, kind: str, trials: int = 50, seed: int = 42,
    space: dict | None = None, parallelism: int = 2, **settings: Any,
) -> tuple[dict[str, Any], DataFrame]:
    """``(best parameters, trials table)`` by macro F1 on the validation rows."""
    candidates = sample_parameters(kind, trials, seed, space)

    def run(params: dict[str, Any]) -> float:
        model = Member(type=kind, options=params, seed=seed, **settings).fit(train)
        scored = model.transform(validation).withColumn("prediction", voting.predicted_class(F.col("probs")))
        return metrics(scored, settings.get("label", "label"))["f1_macro"]

    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(run, candidates))
    best = max(range(trials), key=lambda i: scores[i])
    rows = [(i, str(p), float(s)) for i, (p, s) in enumerate(zip(candidates, scores))]
    return candidates[best], train.sparkSession.createDataFrame(rows, "trial int, params string, f1_macro double")


def halving_search(
    train: DataFrame, validation: DataFrame, kind: str, key: str, trials: int = 27, eta: int = 3, seed: int = 42,
    space: dict | None = None, parallelism: int = 4, scaled: tuple[str, ...] = ("n_estimators", "iterations"), **settings: Any,
) -> tuple[dict[str, Any], DataFrame]:
    """``(best parameters, rungs table)``: a search by successive halving.

    The first rung fits all trials on a small share of the training rows; the
    best ``1/eta`` of them go on to ``eta`` times the share, until the last rung
    fits on all rows. The options named by ``scaled``, trees or rounds, shrink
    with the share. Samples are nested, by a hash of ``key``. The trials of a
    rung are fitted side by side. Scores are macro F1 on all validation rows;
    equal scores go by trial number. A share without rows is left out.

    The table has (rung, trial, share, params, f1_macro), a row per fit.
    """
    if trials < 1 or eta < 2:
        raise ValueError("a search needs a trial, and rungs that shrink")
    candidates = sample_parameters(kind, trials, seed, space)
    label = settings.get("label", "label")
    if settings.get("n_classes") is None:
        settings["n_classes"] = int(train.agg(F.max(label)).first()[0]) + 1
    sizes = [trials]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // eta))
    last, place = len(sizes) - 1, F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 30))
    train, validation = train.persist(), validation.persist()
    live, rows = list(range(trials)), []
    for rung, size in enumerate(sizes):
        share = eta ** float(rung - last)
        sample = train if rung == last else train.where(place < share * (1 << 30))

        def run(trial: int, sample: DataFrame = sample, share: float = share) -> float:
            options = {n: max(1, round(v * share)) if n in scaled else v for n, v in candidates[trial].items()}
            model = Member(type=kind, options=options, seed=seed, **settings).fit(sample)
            scored = model.transform(validation).withColumn("prediction", voting.predicted_class(F.col("probs")))
            return float(metrics(scored, label)["f1_macro"])

        live = live[:size]
        if sample.isEmpty():
            continue
        with ThreadPoolExecutor(parallelism) as pool:
            scores = dict(zip(live, pool.map(run, live)))
        rows += [(rung, t, share, str(candidates[t]), scores[t]) for t in live]
        live = sorted(live, key=lambda t: (-scores[t], t))
    train.unpersist()
    validation.unpersist()
    return candidates[live[0]], train.sparkSession.createDataFrame(rows, "rung int, trial int, share double, params string, f1_macro double")


def permutation_importance(
    model: Model, df: DataFrame, key: str, columns: list[str], label: str = "label", seed: int = 42
) -> DataFrame:
    """``(column, drop)``: loss of accuracy when a column's values are dealt
    anew among the rows.

    A row takes the value of the next row in the hash order of the whole table,
    the last that of the first. Rows are ordered in ranges side by side; what
    follows a range's last row is the first of the next range.
    """
    from pyspark.sql import Window

    from zonewright.operators.splits import hash_order

    def accuracy(rows: DataFrame) -> float:
        return metrics(model.transform(rows), label)["accuracy"]

    base = accuracy(df)
    ranged = df.withColumn("__h", hash_order(key, seed)).repartitionByRange("__h").withColumn("__range", F.spark_partition_id())
    ranged = hold(ranged)
    inside = Window.partitionBy("__range").orderBy("__h")
    value = F.struct(*[F.col(c).alias(f"x{i}") for i, c in enumerate(columns)])
    firsts = ranged.groupBy("__range").agg(F.min_by(value, "__h").alias("__first"))  # a row per range
    order = Window.orderBy("__range")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("__range", F.coalesce(F.lead("__first").over(order), F.first("__first").over(everything)).alias("__after"))
    followed = ranged.withColumn("__next", F.lead(value).over(inside)).join(after, "__range")
    # Ordered once: every column is dealt from the same next row.
    followed = hold(followed.withColumn("__next", F.coalesce("__next", "__after")).drop("__h", "__range", "__after"))
    rows = []
    for i, c in enumerate(columns):
        dealt = followed.withColumn(c, F.col("__next")[f"x{i}"]).drop("__next")
        rows.append((c, base - accuracy(dealt)))
    return df.sparkSession.createDataFrame(rows, "column string, drop double")
