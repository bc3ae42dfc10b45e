"""Training and scoring of landmark classifiers over folds that hold one person out."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut_lineage

#: Columns that tell whose and what a row is.
METADATA = ("label", "person", "session", "stream_id", "hand_id", "frame_no", "t_ms", "fold")

def feature_array(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """rows with features: the named columns and no others, rounded to single precision.

    Columns that say what a row is, or that are no numbers, are refused; a null is null.
    """
    columns = list(columns)
    kinds = dict(rows.dtypes)
    wrong = [c for c in columns if c in METADATA or not kinds[c].startswith(("double", "float", "decimal", "int", "bigint", "smallint", "tinyint"))]
    if wrong or len(set(columns)) != len(columns):
        raise ValueError(f"not features: {wrong or 'repeated columns'}")
    return rows.withColumn("features", F.array(*[F.col(c).cast("float").cast("double") for c in columns]))


def train_history(
    rows: DataFrame, width: int, hidden: tuple[int, ...] = (64, 32), max_iter: int = 500, seed: int = 42, validation: float = 0.1, patience: int = 15
) -> tuple[PipelineModel, list[float]]:
    """A multilayer perceptron over features (arrays of width numbers) and label, and its validation loss after each round.

    A share ``validation`` of each label's rows, by a hash of features and
    label, is held out.  Rounds of ``patience`` iterations start from the last
    weights; a round that does not lower the loss on those rows is the last one,
    and the weights of the best round are kept.  Without rows to validate, all
    max_iter iterations run at once.
    """
    index = StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
    place = F.pmod(F.xxhash64("features", "label"), F.lit(10_000))
    own = F.when(F.size("features") == width, F.col("features")).otherwise(F.raise_error(F.lit(f"a row does not have {width} features")))
    ready = cut_lineage(index.transform(rows.select("label", array_to_vector(own).alias("vector"), (place < validation * 10_000).alias("held"))))
    kept, held = ready.filter("not held"), ready.filter("held")
    if held.isEmpty() or kept.isEmpty():
        kept, held, patience = ready, None, max_iter
    net = MultilayerPerceptronClassifier(featuresCol="vector", labelCol="label_idx", layers=[width, *hidden, len(index.labels) + 1], seed=seed)
    best, history, done = None, [], 0
    while done < max_iter:
        step = min(patience, max_iter - done)
        model = net.setMaxIter(step).fit(kept)
        done += step
        if held is None:
            best = model
            break
        likely = F.get(vector_to_array("probability"), F.col("label_idx").cast("int"))
        history.append(model.transform(held).agg(F.avg(-F.log(F.greatest(likely, F.lit(1e-12))))).first()[0])
        if best is not None and history[-1] >= min(history[:-1]):
            break
        best = model
        net.setInitialWeights(model.weights)
    return PipelineModel(stages=[index, best]), history


def train(rows: DataFrame, width: int, **options) -> PipelineModel:
    """The model of train_history."""
    return train_history(rows, width, **options)[0]


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with pred and probabilities."""
    names = F.array(*[F.lit(x) for x in [*model.stages[0].labels, ""]])
    out = model.transform(rows.withColumn("vector", array_to_vector("features")))
    return out.select(*rows.columns, F.get(names, F.col("prediction").cast("int")).alias("pred"), vector_to_array("probability").alias("probabilities"))


def save(model: PipelineModel, path: str) -> None:
    """The model, and beside it its labels in the order of their indices."""
    model.write().overwrite().save(f"{path}/model")
    labels = list(enumerate(model.stages[0].labels))
    SparkSession.active().createDataFrame(labels, "label_idx int, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")


def load(spark: SparkSession, path: str) -> PipelineModel:
    """A saved model; one whose labels are not those beside it is refused."""
    model = PipelineModel.load(f"{path}/model")
    labels = [r.label for r in spark.read.parquet(f"{path}/labels").orderBy("label_idx").collect()]  # as many as classes
    if labels != model.stages[0].labels:
        raise ValueError(f"labels beside {path} are not the model's")
    return model


#: Rows that the fits of a grid learn from at most, those with the smallest hashes, and fits whose weights are sent around at once.
MAX_ROWS, MAX_FITS = 20_000, 200
_PLAN = "fit int, fold string, seed int, people array<string>, share double, dropped string"


def fit_network(x: np.ndarray, y: np.ndarray, n_labels: int, hidden: tuple[int, ...], max_iter: int, seed: int, validation: float, patience: int) -> list[np.ndarray]:
    """Weights of a perceptron with rectified layers: Adam over batches of rows until the held-out loss has not fallen for ``patience`` passes."""
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], *hidden, n_labels]
    weights = [w for a, b in zip(sizes, sizes[1:]) for w in (rng.normal(0, np.sqrt(2 / (a + b)), (a, b)), np.zeros(b))]
    # A share of each label's rows is held out; a label's only row is not.
    order = rng.permutation(len(y))
    held = np.zeros(len(y), bool)
    for label in np.unique(y):
        mine = order[y[order] == label]
        held[mine[: min(len(mine) - 1, int(np.ceil(validation * len(mine))))]] = True
    low, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-9
    z = (x - low) / scale
    kept, first, second, step = np.flatnonzero(~held), [0.0] * len(weights), [0.0] * len(weights), 0
    best, least, waited = None, np.inf, 0
    for _ in range(max_iter):
        rng.shuffle(kept)
        for a in range(0, len(kept), 64):
            some = kept[a : a + 64]
            layers = forward(weights, z[some])
            delta = (layers[-1] - np.eye(n_labels)[y[some]]) / len(some)
            step += 1
            for k in range(len(weights) - 2, -1, -2):
                grads = layers[k // 2].T @ delta + 1e-4 * weights[k], delta.sum(axis=0)
                delta = (delta @ weights[k].T) * (layers[k // 2] > 0)
                for i, g in zip((k, k + 1), grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    weights[i] = weights[i] - 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        judged = held if held.any() else ~held
        loss = -np.log(np.maximum(forward(weights, z[judged])[-1][np.arange(judged.sum()), y[judged]], 1e-12)).mean()
        best, least, waited = (list(weights), loss, 0) if loss < least - 1e-4 else (best, least, waited + 1)
        if waited >= patience:
            break
    return [low, scale, *best]


def forward(weights: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """The values of each layer, the last one as probabilities."""
    layers = [x]
    for k in range(0, len(weights), 2):
        out = layers[-1] @ weights[k] + weights[k + 1]
        layers.append(np.maximum(out, 0) if k + 2 < len(weights) else out)
    likely = np.exp(layers[-1] - layers[-1].max(axis=1, keepdims=True))
    return [*layers[:-1], likely / likely.sum(axis=1, keepdims=True)]


def grid(rows: DataFrame, width: int, plan: list[tuple], group: str = "person", hidden: tuple[int, ...] = (64, 32), max_iter: int = 500, validation: float = 0.1, patience: int = 15, max_rows: int = MAX_ROWS) -> DataFrame:
    """fit, n, accuracy of each fit of a plan: all fits side by side, one to a task, then all rows of its fold scored.

    plan: rows of (fit, fold, seed, people, share, dropped): the person whose
    rows are tested; the persons whose rows are learnt from (None: all but the
    fold); the share of those by a hash; and a value of ``group`` that is left
    out (None: none).  Fits learn from the max_rows rows with the smallest
    hashes; scoring reads every row whose label at least two known persons have.
    A fit without rows to learn from has no result.
    """
    spark = rows.sparkSession
    place = F.xxhash64("features", "label", "person")
    sample = rows.select("person", "label", "features", F.col(group).alias("part"), place.alias("place")).orderBy("place", "person", "label").limit(max_rows).collect()
    names = sorted({r.label for r in sample})
    at = {name: k for k, name in enumerate(names)}
    columns = {"x": np.array([r.features for r in sample], float).reshape(len(sample), width), "y": np.array([at[r.label] for r in sample], int), "part": np.array([r.part for r in sample], object)}
    columns |= {"person": np.array([r.person for r in sample], object), "place": np.array([r.place % 1000 / 1000 for r in sample], float)}
    sent = spark.sparkContext.broadcast(columns)

    def fits(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for batch in it:
            for r in batch.itertuples(index=False):
                use = (c["person"] != r.fold) & (c["place"] < r.share)
                if r.people is not None:
                    use &= np.isin(c["person"], list(r.people))
                if r.dropped is not None:
                    use &= c["part"] != r.dropped
                if use.any():
                    weights = fit_network(c["x"][use], c["y"][use], len(names), hidden, max_iter, r.seed, validation, patience)
                    yield pd.DataFrame({"fit": [r.fit], "fold": [r.fold], "weights": [pickle.dumps([w.astype("<f4") for w in weights])]})

    known = rows.filter("person <> 'unknown'")
    shared = known.groupBy("label").agg(F.count_distinct("person").alias("n")).filter("n > 1").select("label")
    tested = rows.join(shared, "label", "left_semi").select("person", "label", "features")
    out = []
    for a in range(0, len(plan), MAX_FITS):
        some = spark.createDataFrame(plan[a : a + MAX_FITS], _PLAN)
        models = some.repartition(len(plan[a : a + MAX_FITS]), "fit").mapInPandas(fits, "fit int, fold string, weights binary")
        of: dict[str, list] = {}
        for r in models.collect():  # at most MAX_FITS rows
            of.setdefault(r.fold, []).append((r.fit, r.weights))
        out.append(tested.filter(F.col("person").isin(list(of))).mapInPandas(_scorer(spark.sparkContext.broadcast((of, names))), "fit int, n long, ok long"))
    return reduce(DataFrame.unionByName, out).groupBy("fit").agg(F.sum("n").alias("n"), (F.sum("ok") / F.sum("n")).alias("accuracy"))


def _scorer(models: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, names = models.value
        opened = {person: [(fit, pickle.loads(raw)) for fit, raw in fits] for person, fits in of.items()}
        labels = np.array(names, object)
        for batch in it:
            out = []
            for person, mine in batch.groupby("person"):
                x, label = np.array(mine["features"].tolist(), float), mine["label"].to_numpy()
                for fit, (low, scale, *weights) in opened[person]:
                    pred = labels[forward(weights, (x - low) / scale)[-1].argmax(axis=1)]
                    out.append((fit, len(x), int((pred == label).sum())))
            yield pd.DataFrame(out, columns=["fit", "n", "ok"])

    return task


def _people(rows: DataFrame) -> list[str]:
    people = [r.person for r in rows.filter("person <> 'unknown'").select("person").distinct().orderBy("person").collect()]
    if len(people) < 2:
        raise ValueError("two known persons are needed")
    return people


def _named(rows: DataFrame, told: list[tuple], schema: str) -> DataFrame:
    """A plan's fits by what they stand for."""
    return F.broadcast(rows.sparkSession.createDataFrame([(k, *t) for k, t in enumerate(told)], f"fit int, {schema}"))  # as many rows as fits


def leave_one_out(rows: DataFrame, width: int, seed: int = 42, **options) -> DataFrame:
    """fold, n, accuracy of each known person's rows by a model of all others; 'unknown' rows train in every fold.

    Labels that fewer than two known persons have are not scored.
    """
    people = _people(rows)
    done = grid(rows, width, [(k, p, seed, None, 1.0, None) for k, p in enumerate(people)], **options)
    return done.join(_named(rows, [(p,) for p in people], "fold string"), "fit").select("fold", "n", "accuracy")


def seed_sweep(rows: DataFrame, width: int, seeds: Iterable[int], **options) -> DataFrame:
    """fold, n_seeds, mean, least, most and spread (standard deviation) of the accuracy over seeds."""
    told = [(p, s) for p in _people(rows) for s in seeds]
    runs = grid(rows, width, [(k, p, s, None, 1.0, None) for k, (p, s) in enumerate(told)], **options).join(_named(rows, told, "fold string, seed int"), "fit")
    a = F.col("accuracy")
    return runs.groupBy("fold").agg(F.count("*").alias("n_seeds"), F.avg(a).alias("mean"), F.min(a).alias("least"), F.max(a).alias("most"), F.coalesce(F.stddev(a), F.lit(0.0)).alias("spread"))


def learning_curve(rows: DataFrame, width: int, shares: Iterable[float] = (1.0,), seed: int = 42, **options) -> DataFrame:
    """n_people, share, n_folds, accuracy: means over folds of models of so many other persons (the first by name) and of a share of their rows.

    The share is taken by a hash of the features, so smaller ones lie in larger ones.
    """
    people = _people(rows)
    told = [(k, float(share), p) for share in shares for k in range(1, len(people)) for p in people]
    plan = [(i, p, seed, [q for q in people if q != p][:k], share, None) for i, (k, share, p) in enumerate(told)]
    runs = grid(rows, width, plan, **options).join(_named(rows, told, "n_people int, share double, fold string"), "fit")
    return runs.groupBy("n_people", "share").agg(F.count("*").alias("n_folds"), F.avg("accuracy").alias("accuracy"))


def ablation(rows: DataFrame, width: int, group: str = "person", seed: int = 42, **options) -> DataFrame:
    """dropped, fold, accuracy and loss (against the same fold with nothing dropped) when a group's rows are left out of training."""
    people = _people(rows)
    groups = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]
    told = [(None, p) for p in people] + [(g, p) for g in groups for p in people if group != "person" or p != g]
    runs = grid(rows, width, [(k, p, seed, None, 1.0, g) for k, (g, p) in enumerate(told)], group=group, **options)
    named = cut_lineage(runs.join(_named(rows, told, "dropped string, fold string"), "fit"))
    whole = named.filter("dropped is null").select("fold", F.col("accuracy").alias("whole"))
    return named.filter("dropped is not null").join(whole, "fold").select("dropped", "fold", "accuracy", (F.col("whole") - F.col("accuracy")).alias("loss"))
