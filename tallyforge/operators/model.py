"""Folds, ridge models, probes and their scores.

Ridge models are fitted from sums of products, one aggregate over all folds at once: what
reaches the driver is a matrix per group whose size is that of the features squared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import leakage_score, severity
from .graph import written
from .ranks import running_sums

#: Weights of models that are broadcast: 8 MB.
_FEW = 1_000_000


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 17) -> DataFrame:
    """``df`` with ``fold``: rows of each label dealt round in a seeded order."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """``df`` with ``fold``: whole groups, dealt back and forth in order of size."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_all": F.lit(0), "_one": F.lit(1)})
    sizes = running_sums(sizes, ["_all"], ["_n", group], {"_place": "_one"}, descending=("_n",))
    r = F.col("_place")
    turn = (F.floor(r / k) % 2).cast("int")
    fold = F.when(turn == 0, r % k).otherwise(k - 1 - r % k).cast("int")
    return df.join(sizes.select(group, fold.alias("fold")), group)


def _deal(k: int):
    """Groups one by one, the largest first, each to the fold where the squares of its classes' shares grow least."""

    def run(pdf):
        table = pdf.pivot(index="_g", columns="_l", values="_n").fillna(0)
        table = table.iloc[np.lexsort((table.index.to_numpy(str), -table.to_numpy().sum(axis=1)))]
        counts = table.to_numpy(float)
        share = counts / counts.sum(axis=0)
        load, folds = np.zeros((k, share.shape[1])), []
        for x in share:
            f = int(np.argmin(load @ x))
            load[f] += x
            folds.append(f)
        return pd.DataFrame({"_g": table.index, "fold": folds})

    return run


def stratified_group_folds(df: DataFrame, label: str, group: str, k: int, seed: int = 17, parts: int = 2000) -> DataFrame:
    """``df`` with ``fold``: whole groups, every fold with about the same share of each label.

    Groups of at least 1 / (``parts`` * k) of all rows, at most ``parts`` * k of them, are dealt one by one.  Any other
    group goes by the rarest of its labels: along the groups of a label in a hashed order, each fold takes
    a stretch as long as its lack of that label after the large groups.  So what one task sees is bounded, and a share is off by a small
    group at most, but for labels that come along with rarer ones.  A null label is a label; rows without a group have no fold.
    """
    rows = df.withColumns({"_g": F.col(group).cast("string"), "_l": F.to_json(F.struct(F.col(label).alias("l")))})
    cells = written(rows.where("_g is not null").groupBy("_g", "_l").agg(F.count(F.lit(1)).alias("_n")))
    total = cells.agg(F.sum("_n")).first()[0] or 0
    labels = cells.groupBy("_l").agg(F.sum("_n").alias("_all"))
    groups = cells.join(labels, "_l").groupBy("_g").agg(F.sum("_n").alias("_size"), F.min(F.struct("_all", "_l", "_n")).alias("_r"))
    groups = written(groups.select("_g", (F.col("_size") * parts * k >= total).alias("_large"), "_r._l", "_r._n"))
    large = cells.join(groups.where("_large").select("_g"), "_g")
    large = written(large.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_deal(k), "_g string, fold int"))
    sums = F.array(*[F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("_n"))), F.lit(0)).cast("double") for f in range(k)])
    load = cells.join(large, "_g").groupBy("_l").agg(sums.alias("_load"))
    small = groups.where("not _large").withColumn("_h", F.xxhash64("_g", F.lit(seed)))
    lacks = small.groupBy("_l").agg(F.sum("_n").cast("double").alias("_s")).join(load, "_l", "left")
    lacks = lacks.withColumn("_load", F.coalesce("_load", F.array_repeat(F.lit(0.0), k)))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    # folds are filled to one level: the least of those that any number of the emptiest folds would reach
    level = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda m: (F.col("_s") + add(F.slice(F.array_sort("_load"), F.lit(1), m))) / m))
    lacks = lacks.withColumn("_level", level).withColumn("_lack", F.transform("_load", lambda x: F.greatest(F.col("_level") - x, F.lit(0.0))))
    ends = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda m: add(F.slice("_lack", F.lit(1), m))) if k > 1 else F.array().cast("array<double>")
    small = running_sums(small, ["_l"], ["_h", "_g"], {"_before": "_n"}).join(lacks.select("_l", ends.alias("_ends")), "_l")
    middle = F.coalesce("_before", F.lit(0)) + F.col("_n") / 2
    small = small.select("_g", F.size(F.filter("_ends", lambda e: e <= middle)).alias("fold"))
    return rows.join(large.unionByName(small), "_g", "left").select(*[c for c in df.columns if c != "fold"], "fold")


def overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys in both: must be empty."""
    return train.select(key).intersect(test.select(key))


def products(x: list[str], y: str) -> Column:
    """The aggregate: sums of products of (1, x..., y), the upper half of a square matrix row by row."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    return F.array(*[F.coalesce(F.sum(a * b), F.lit(0.0)) for i, a in enumerate(cols) for b in cols[i:]])


def square(halves: np.ndarray, m: int) -> np.ndarray:
    """Matrices of ``m`` rows from their upper halves."""
    out = np.zeros((len(halves), m, m))
    i, j = np.triu_indices(m)
    out[:, i, j] = halves
    out[:, j, i] = halves
    return out


def ridge(a: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a ridge model on standardized features, from a matrix of sums."""
    n, m = a[0, 0], len(a) - 2
    mean = a[0, 1 : m + 1] / n
    ymean = a[0, m + 1] / n
    cov = a[1 : m + 1, 1 : m + 1] - n * np.outer(mean, mean)
    cross = a[1 : m + 1, m + 1] - n * mean * ymean
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    sd[sd == 0] = 1.0
    w = np.linalg.solve(cov / np.outer(sd, sd) + alpha * np.eye(m), cross / sd) / sd
    return float(ymean - mean @ w), w


def balanced_folds(sizes: dict[str, float], k: int) -> dict[str, int]:
    """Whole groups dealt to ``k`` folds: the largest first, each to the fold with least rows."""
    load, out = [0.0] * k, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        f = load.index(min(load))
        load[f] += sizes[g]
        out[g] = f
    return out


def _fits(x: list[str], alphas: tuple, folds: int):
    """Models of one batch: for each inner group of the others the weights of the fold that it isn't in, and, with a
    null group, those of all others; weights are (intercept, x...) for each alpha."""
    m = len(x) + 2

    def fit(key, pdf):
        pdf = pdf[pdf["n"] > 0].sort_values("g", kind="stable")
        if not len(pdf):
            return pd.DataFrame({"b": [], "g": [], "w": []})
        cells = square(np.array(pdf["s"].tolist()), m)
        flat = lambda a: [[i, *w.tolist()] for i, w in (ridge(a, alpha) for alpha in alphas)]
        groups, models = [None], [flat(cells.sum(axis=0))]
        n = min(folds, len(pdf))
        if n > 1:
            dealt = balanced_folds(dict(zip(pdf["g"], pdf["n"], strict=True)), n)
            of = pdf["g"].map(dealt).to_numpy()
            rest = [flat(cells[of != f].sum(axis=0)) for f in range(n)]
            groups += pdf["g"].tolist()
            models += [rest[f] for f in of]
        return pd.DataFrame({"b": [key[0]] * len(groups), "g": groups, "w": models})

    return fit


def held_out_ridge(df: DataFrame, batch: str, inner: str, x: list[str], y: str, alphas: tuple = (0.01, 0.1, 1.0, 10.0, 100.0), folds: int = 5) -> DataFrame:
    """``df`` with ``prediction`` and ``alpha``: each batch predicted by a model of the others.

    The alpha of a batch is the one of least inner error: the other batches' inner groups are
    dealt to ``folds`` folds, each is predicted by the rest, and the mean absolute errors of the
    inner groups are averaged; ties go to the smaller alpha.  A batch whose others have one inner group only takes the
    smallest alpha; one without others is predicted null, as are rows without a batch; rows without an inner group teach nothing.

    Sums of products of (batch, inner) cells are enough for all fits.  A batch is fitted in a task of its own from one
    matrix an inner group; models are joined to the rows as arrays of weights.  Rows have few batches and inner groups, so a join that
    deals them by these would send a large share to one task: models of up to ``_FEW`` weights are broadcast instead, and the rows
    stay where they are; with more models, which many groups share, rows are dealt by them.
    """
    alphas = tuple(sorted(alphas))
    text = lambda c: F.col(c).cast("string")
    rows = df.withColumns({"_b": text(batch), "_g": text(inner)})
    cells = rows.where("_b is not null and _g is not null").groupBy("_b", "_g").agg(products(x, y).alias("s"), F.count(F.lit(1)).alias("n"))
    cells = written(cells)
    every = cells.groupBy("_g").agg(F.array(*[F.sum(F.col("s")[i]) for i in range((len(x) + 2) * (len(x) + 3) // 2)]).alias("all"), F.sum("n").alias("many"))
    batches = cells.select("_b").distinct()
    # what the other batches know of a group is all that is known less the batch's own
    pairs = every.join(batches.agg(F.collect_list("_b").alias("_bs"))).select("*", F.explode("_bs").alias("_b")).drop("_bs")
    others = pairs.join(cells, ["_b", "_g"], "left")
    less = F.when(F.col("s").isNull(), F.col("all")).otherwise(F.zip_with("all", "s", lambda a, c: a - c))
    others = others.select(F.col("_b").alias("b"), F.col("_g").alias("g"), less.alias("s"), (F.col("many") - F.coalesce("n", F.lit(0))).alias("n"))
    models = written(others.groupBy("b").applyInPandas(_fits(x, alphas, folds), "b string, g string, w array<array<double>>"))

    values = F.array(*[F.col(c).cast("double") for c in x])
    predict = lambda w: F.aggregate(F.zip_with(F.slice(w, 2, len(x)), values, lambda u, v: u * v), F.get(w, 0), lambda s, t: s + t)
    small = F.broadcast if models.count() * len(alphas) * (len(x) + 1) <= _FEW else lambda df: df
    by_group = models.where("g is not null").groupBy(F.col("g").alias("_mg")).agg(F.collect_list(F.struct("b", "w")).alias("_models"))
    met = rows.join(small(by_group), F.col("_g") == F.col("_mg")).withColumn("_model", F.explode("_models")).where(F.col("_model.b") != F.col("_b"))
    errors = [F.avg(F.abs(predict(F.col("_model.w")[i]) - F.col(y))).alias(f"e{i}") for i in range(len(alphas))]
    per = met.groupBy("_g", F.col("_model.b").alias("b")).agg(*errors).groupBy("b").agg(*[F.avg(f"e{i}").alias(f"e{i}") for i in range(len(alphas))])
    best = F.array_min(F.array(*[F.struct(F.col(f"e{i}").alias("e"), F.lit(i).alias("i")) for i in range(len(alphas))]))["i"]
    chosen = models.where("g is null").join(per.select("b", best.alias("i")), "b", "left").withColumn("i", F.coalesce("i", F.lit(0)))
    chosen = chosen.select(F.col("b").alias("_mb"), F.col("w")[F.col("i")].alias("_w"), F.array(*map(F.lit, alphas))[F.col("i")].alias("_alpha"))
    out = rows.join(small(chosen), F.col("_b") == F.col("_mb"), "left")
    return out.select(*df.columns, predict(F.col("_w")).alias("prediction"), F.col("_alpha").alias("alpha"))


def leave_group_out(df: DataFrame, group: str, x: list[str], y: str, alpha: float = 1.0, trains: Column | None = None) -> DataFrame:
    """``df`` with ``prediction``: every row by a ridge model of the other groups.

    Rows where ``trains`` doesn't hold, or with a null target or group, are predicted but teach nothing (a null group is predicted
    null).  The sums of all rows less the group's own are the sums of the others, so one aggregate serves all
    models; each is solved from its matrix where that lies.  Null where no other group teaches.
    """
    m = len(x) + 2
    ok = F.coalesce(trains if trains is not None else F.lit(True), F.lit(False)) & F.col(y).isNotNull() & F.col(group).isNotNull()
    rows = df.withColumn("_t", ok)
    own = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_mg"), "_t").agg(products(x, y).alias("s"), F.count(F.lit(1)).alias("n"))
    zero = F.array_repeat(F.lit(0.0), m * (m + 1) // 2)
    own = written(own.groupBy("_mg").agg(F.coalesce(F.max(F.when(F.col("_t"), F.col("s"))), zero).alias("s"), F.coalesce(F.max(F.when(F.col("_t"), F.col("n"))), F.lit(0)).alias("n")))
    total = own.agg(F.array(*[F.sum(F.col("s")[i]) for i in range(m * (m + 1) // 2)]).alias("all"), F.sum("n").alias("many"))
    others = own.join(F.broadcast(total)).select("_mg", F.zip_with("all", "s", lambda a, c: a - c).alias("s"), (F.col("many") - F.col("n")).alias("n"))
    kind = dict(df.dtypes)[group]

    def fit(batches):
        for pdf in batches:
            pdf = pdf[pdf["n"] > 0]
            models = [ridge(a, alpha) for a in square(np.array(pdf["s"].tolist()).reshape(len(pdf), -1), m)] if len(pdf) else []
            yield pd.DataFrame({"_mg": pdf["_mg"], "_w": pd.Series([[b, *w.tolist()] for b, w in models], index=pdf.index, dtype=object)})

    models = others.mapInPandas(fit, f"_mg {kind}, _w array<double>")
    values = F.array(*[F.col(c).cast("double") for c in x])
    predicted = F.aggregate(F.zip_with(F.slice("_w", 2, len(x)), values, lambda u, v: u * v), F.get("_w", 0), lambda s, t: s + t)
    return rows.join(models, F.col(group) == F.col("_mg"), "left").select(*df.columns, predicted.alias("prediction"))


def centroid_predictions(df: DataFrame, label: str, vector: str, fold: str) -> DataFrame:
    """``df`` with ``predicted``: the label whose mean vector over the other folds is nearest."""
    x = df.select(label, fold, F.posexplode(vector).alias("i", "v"))
    cell = x.groupBy(label, fold, "i").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    folds = df.select(F.col(fold).alias("held")).distinct()
    means = cell.join(F.broadcast(folds)).where(F.col(fold) != F.col("held")).groupBy("held", label, "i").agg((F.sum("s") / F.sum("n")).alias("m"))
    models = means.groupBy("held", label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("c")).groupBy("held").agg(F.collect_list(F.struct(F.col(label).alias("l"), "c")).alias("models"))
    met = df.join(F.broadcast(models), F.col(fold) == F.col("held"))
    far = F.transform("models", lambda m: F.struct(F.aggregate(F.zip_with(m["c"], F.col(vector), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t).alias("d"), m["l"].alias("l")))
    return met.withColumn("predicted", F.array_min(far)["l"]).drop("held", "models")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_recall(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col(predicted)).alias("hits")).withColumn("recall", F.col("hits") / F.col("n"))


def recoverability(df: DataFrame, label: str, vector: str, key: str, folds: int = 3, seed: int = 17) -> DataFrame:
    """One row: how well a centroid probe recovers the label out of fold, against chance."""
    dealt = stratified_folds(df, label, key, folds, seed)
    by = class_recall(centroid_predictions(dealt, label, vector, "fold"), label, "predicted")
    row = by.agg(F.count(F.lit(1)).alias("classes"), F.avg("recall").alias("balanced_accuracy"))
    row = row.withColumn("chance", 1 / F.col("classes"))
    score = leakage_score(F.col("balanced_accuracy"), F.col("chance"))
    return row.withColumn("score", score).withColumn("severity", severity(F.col("score")))


def _nearest(k: int):
    """The ``k`` nearest training rows of one block to each test row of another."""

    def run(asked, known):
        out = []
        if len(asked) and len(known):
            order = np.argsort(known["_k"].to_numpy(), kind="stable")
            keys, target = known["_k"].to_numpy()[order], known["_y"].to_numpy()[order]
            points = np.stack(known["_x"].to_numpy()[order])
            at = np.stack(asked["_x"].to_numpy())
            for i in range(0, len(at), 256):
                d = np.zeros((len(at[i : i + 256]), len(points)))
                for c in range(points.shape[1]):
                    d += (at[i : i + 256, c, None] - points[None, :, c]) ** 2
                for row in d:
                    # all that are as near as the k-th, then by distance and key
                    may = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
                    best = may[np.argsort(row[may], kind="stable")[:k]]
                    out.append([{"d": float(row[j]), "k": int(keys[j]), "y": float(target[j])} for j in best])
        return pd.DataFrame({"_i": asked["_i"] if out else pd.Series([], dtype="int64"), "near": pd.Series(out, index=asked.index if out else None, dtype=object)})

    return run


def knn(train: DataFrame, test: DataFrame, key: str, x: list[str], y: str, k: int = 5, block: int = 20_000) -> DataFrame:
    """(key, prediction): for every test row the mean target of the ``k`` nearest training rows, ties to smaller keys.

    All test rows meet all training rows, in pairs of blocks of about ``block`` rows, a task each; only the ``k`` nearest of a block leave
    it.  Training rows with a null or NaN in key, target or features teach nothing; test rows with such features, and all where nothing
    teaches, are predicted null.
    """
    point = F.array(*[F.col(c).cast("double") for c in x]).alias("_x")
    plain = ~F.exists("_x", lambda v: v.isNull() | F.isnan(v))
    known = train.select(F.col(key).cast("long").alias("_k"), F.col(y).cast("double").alias("_y"), point)
    known = written(known.where(plain & F.col("_k").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_y")).withColumn("_i", F.monotonically_increasing_id()))
    asked = written(test.select(F.col(key).cast("long").alias(key), point).withColumn("_i", F.monotonically_increasing_id()))
    n, m = max(1, -(-known.count() // block)), max(1, -(-asked.count() // block))
    # numbers of rows are dealt round, so that blocks are alike in size whatever the keys
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    a = asked.where(plain).select("_i", "_x", (F.col("_i") % m).cast("int").alias("_m"), every(n).alias("_n"))
    b = known.select("_k", "_y", "_x", (F.col("_i") % n).cast("int").alias("_n"), every(m).alias("_m"))
    near = a.groupBy("_m", "_n").cogroup(b.groupBy("_m", "_n")).applyInPandas(_nearest(k), "_i long, near array<struct<d:double,k:long,y:double>>")
    best = near.groupBy("_i").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("_near"))
    mean = F.aggregate("_near", F.lit(0.0), lambda s, r: s + r["y"]) / F.nullif(F.size("_near"), F.lit(0))
    return asked.join(best, "_i", "left").select(key, mean.alias("prediction"))
