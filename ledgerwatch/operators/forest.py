"""Isolation Forest on Spark (Liu, Ting and Zhou 2008).

Fitting: one pass hashes each row key into a small pool, each tree draws its rows from the
pool by a second hash, and the trees are built in parallel from about ``trees x rows`` rows
in all, whatever the size of the table. Scoring: the finished trees are a bounded set of
arrays that every task walks over Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, StructField, StructType,
)

from ledgerwatch.functions.checks import require, require_number
from ledgerwatch.functions.features import BASE_FEATURES
from ledgerwatch.functions.hashing import unit_hash
from ledgerwatch.functions.numeric import num
from ledgerwatch.operators.extras import merge_moments
from ledgerwatch.operators.leaf_boxes import BLOCK, LeafBoxes
from ledgerwatch.operators.prefix import exact_quantile
from ledgerwatch.session import materialise, parts_by_bytes, python_tasks, require_columns

TREES = 100
ROWS_PER_TREE = 256
OVERDRAW = 1.5
MAX_MODEL_NODES = 4_000_000

_NODE_SCHEMA = StructType([
    StructField("trial", IntegerType()), StructField("tree", IntegerType()),
    StructField("node", IntegerType()), StructField("feature", IntegerType()),
    StructField("threshold", DoubleType()), StructField("path", DoubleType()),
    StructField("size", IntegerType()),
])


def check_parameters(contamination: float, seed: int) -> None:
    """A share of anomalies between 0 and 1, and a whole number that starts the draws."""
    require_number("contamination", contamination, 0, 1)
    require(isinstance(seed, int) and not isinstance(seed, bool), TypeError, f"seed: expected a whole number, not {seed!r}")


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + float(np.euler_gamma)) - 2.0 * (n - 1.0) / n


def depth_limit(rows: int) -> int:
    return max(1, math.ceil(math.log2(max(rows, 2))))


@dataclass(frozen=True)
class Spec:
    """Trees to grow for one trial."""

    trees: int = TREES
    rows: int = ROWS_PER_TREE


@dataclass
class Forest:
    """A fitted model. Trees are stored as complete binary heaps of equal depth, so that a
    walk is a fixed number of vector steps; a leaf above the last level repeats its value
    below."""

    features: tuple[str, ...]
    rows: int
    contamination: float
    seed: int
    split_feature: np.ndarray = field(repr=False)
    split_value: np.ndarray = field(repr=False)
    leaf_path: np.ndarray = field(repr=False)
    threshold: float | None = None

    @property
    def trees(self) -> int:
        return len(self.split_feature)

    @property
    def arrays(self) -> tuple:
        """What scoring needs, as plain arrays that any Python worker can read."""
        return self.rows, self.split_feature, self.split_value, self.leaf_path

    @property
    def checksum(self) -> str:
        digest = hashlib.sha256(json.dumps([list(self.features), self.rows]).encode())
        for part in (self.split_feature, self.split_value, self.leaf_path):
            digest.update(np.ascontiguousarray(part).tobytes())
        return digest.hexdigest()


# -- fitting -----------------------------------------------------------------------------


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (heap position, feature, split, path length, rows) of one tree."""
    nodes, open_nodes = [], [(0, 0, np.arange(len(x)))]
    while open_nodes:
        at, level, rows = open_nodes.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(low < high)
        if level >= depth or len(rows) <= 1 or not len(varying):
            nodes.append((at, -1, 0.0, level + expected_path(len(rows)), len(rows)))
            continue
        f = int(rng.choice(varying))
        cut = float(rng.uniform(low[f], high[f]))
        if cut >= high[f]:
            cut = float(low[f])
        nodes.append((at, f, cut, 0.0, len(rows)))
        left = part[:, f] <= cut
        open_nodes.append((2 * at + 2, level + 1, rows[~left]))
        open_nodes.append((2 * at + 1, level + 1, rows[left]))
    return nodes


def _feature_rows(df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    values = [num(F.col(f)).alias(f) for f in features]
    rows = df.select(F.col(key).alias("_key"), *values)
    return rows.dropna(subset=list(features))


def tree_nodes(
    df: DataFrame, features: Sequence[str], specs: Sequence[Spec], seed: int, key: str, total: int,
) -> DataFrame:
    """Node table of all trials, grown in one pass over the rows."""
    largest = max(s.rows for s in specs)
    wanted = 2 * max(sum(s.trees * s.rows for s in specs), largest * 8)
    share = min(1.0, wanted / total)
    pool_size = share * total
    pool = _feature_rows(df, features, key).where(unit_hash(F.col("_key"), F.lit(seed)) < share)

    def trees_of(trial: int, spec: Spec) -> Column:
        p = min(1.0, OVERDRAW * spec.rows / pool_size)
        return F.transform(
            F.sequence(F.lit(0), F.lit(spec.trees - 1)),
            lambda t: F.struct(F.lit(trial).alias("trial"), t.alias("tree"), F.lit(p).alias("_p")),
        )

    # One rule at every size: each tree draws from the pool by a hash of its own. A join with
    # the trees, as its condition is compiled; a lambda over them is not.
    every = df.sparkSession.range(1).select(F.inline(F.concat(*[trees_of(i, s) for i, s in enumerate(specs)])))
    chosen = unit_hash(F.col("_key"), F.lit(seed + 1), F.col("trial"), F.col("tree")) < F.col("_p")
    drawn = pool.join(every, chosen).select("trial", "tree", "_key", *features)
    drawn = drawn.select(
        "trial", "tree", *features,
        F.xxhash64("_key", F.lit(seed + 2), "trial", "tree").alias("_order"),
    )
    names, limits = list(features), [s.rows for s in specs]

    def build(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        trial, tree = int(group[0]), int(group[1])
        rows = min(limits[trial], total)
        sample = pdf.sort_values(["_order", *names], kind="stable").head(rows)
        rng = np.random.default_rng([seed, trial, tree])
        grown = _grow(sample[names].to_numpy(float), depth_limit(rows), rng)
        return pd.DataFrame(
            [(trial, tree, *node) for node in grown], columns=_NODE_SCHEMA.names
        )

    # A group holds about twice the rows of a tree, independent of the table.
    tasks = min(sum(s.trees for s in specs), python_tasks(df.sparkSession))
    return drawn.repartition(tasks, "trial", "tree").groupBy("trial", "tree").applyInPandas(build, _NODE_SCHEMA)


def _heaps(nodes: pd.DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heap arrays (split feature, split value, leaf path) of the trees of one trial."""
    trees = sorted(nodes["tree"].unique())
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((len(trees), inner), np.int32)
    value = np.full((len(trees), inner), np.inf)
    path = np.zeros((len(trees), leaves))
    place = {tree: i for i, tree in enumerate(trees)}
    for row in nodes.sort_values(["tree", "node"]).itertuples(index=False):
        i, level = place[row.tree], int(row.node + 1).bit_length() - 1
        if row.feature >= 0:
            feature[i, row.node], value[i, row.node] = row.feature, row.threshold
        else:
            width = 2 ** (depth - level)
            first = (row.node + 1 - 2**level) * width
            path[i, first:first + width] = row.path
    return feature, value, path


def _collect_nodes(nodes: DataFrame, specs: Sequence[Spec]) -> pd.DataFrame:
    """The model itself comes to the driver: at most trees x (2 rows - 1) nodes."""
    bound = sum(s.trees * (2 * s.rows - 1) for s in specs)
    if bound > MAX_MODEL_NODES:
        raise ValueError(f"a model may have {MAX_MODEL_NODES} nodes, these parameters allow {bound}")
    return nodes.toPandas()


def fit(
    df: DataFrame, features: Sequence[str] = BASE_FEATURES, contamination: float = 0.01,
    seed: int = 42, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE, key: str = "hash",
    threshold: str = "exact",
) -> Forest:
    """Fit a forest and its decision threshold.

    ``threshold``: ``exact`` is the interpolated contamination quantile of the training
    scores, ``none`` skips the scoring pass. Rows that are labelled as well are better given
    to ``fit_detect``, which scores them once for both.
    """
    return fit_trials(
        df, [Spec(trees, rows_per_tree)], features, contamination, seed, key, threshold
    )[0]


def fit_detect(
    df: DataFrame, features: Sequence[str] = BASE_FEATURES, contamination: float = 0.01,
    seed: int = 42, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE, key: str = "hash",
) -> tuple[Forest, DataFrame]:
    """(the forest, the labelled rows of ``df``): as ``fit`` and then ``detect``.

    The rows are written once and counted and drawn from there; scores are written once, and
    threshold and labels come from the stored scores. Give it the columns that are needed.
    """
    rows = materialise(df, "forest-rows")
    forest = fit(rows, features, contamination, seed, trees, rows_per_tree, key, "none")
    scored = materialise(score(rows, forest), "forest-scores")
    forest.threshold = exact_quantile(scored, "anomaly_score", contamination)
    return forest, labelled(scored, forest)


def fit_trials(
    df: DataFrame, specs: Sequence[Spec], features: Sequence[str] = BASE_FEATURES,
    contamination: float = 0.01, seed: int = 42, key: str = "hash", threshold: str = "none",
) -> list[Forest]:
    """Fit one forest per trial; all trials share one pass over the data."""
    check_parameters(contamination, seed)
    require_columns(df, key, *features)
    if threshold not in ("exact", "none"):
        raise ValueError("threshold must be exact or none")
    total = _feature_rows(df, features, key).count()
    if total == 0:
        raise ValueError("cannot fit on an empty table")
    grown = _collect_nodes(tree_nodes(df, features, specs, seed, key, total), specs)
    forests = []
    for trial, spec in enumerate(specs):
        rows = min(spec.rows, total)
        heaps = _heaps(grown[grown["trial"] == trial], depth_limit(rows))
        forest = Forest(tuple(features), rows, contamination, seed, *heaps)
        if threshold != "none":
            forest.threshold = score_threshold(df, forest)
        forests.append(forest)
    return forests


def score_threshold(df: DataFrame, forest: Forest) -> float:
    """The contamination quantile of the scores, which are computed and stored once."""
    scored = materialise(score(df, forest).select("anomaly_score"), "forest-scores")
    return exact_quantile(scored, "anomaly_score", forest.contamination)


# -- scoring -----------------------------------------------------------------------------


def _mean_path(x: np.ndarray, feature: np.ndarray, value: np.ndarray, path: np.ndarray) -> np.ndarray:
    rows, width = x.shape
    flat, base = np.ascontiguousarray(x).ravel(), np.arange(rows) * width
    depth = int(math.log2(path.shape[1]))
    total = np.zeros(rows)
    for t in range(len(feature)):
        at = np.zeros(rows, np.int64)
        for _ in range(depth):
            right = ~(flat[base + feature[t][at]] <= value[t][at])
            at = 2 * at + 1 + right
        total += path[t][at - (2**depth - 1)]
    return total / len(feature)


def score_arrays(x: np.ndarray, arrays: tuple) -> np.ndarray:
    """Scores of a block of rows: near -1 for outliers, towards 0 for ordinary rows.

    ``arrays`` is ``Forest.arrays``.
    """
    rows, feature, value, path = arrays
    return -np.exp2(-_mean_path(x, feature, value, path) / max(expected_path(rows), 1e-12))


#: Cells of a tree's table at most; a tree of more is walked.
CELLS = 1 << 17


class Cells:
    """Trees as tables: a tree's splits cut every feature into ranges, and each cell has one leaf.

    A value's place among all splits of its feature is found once, its range in a tree is looked up,
    and the ranges together address the cell. Paths are summed tree by tree, as a walk does.
    """

    def __init__(self, arrays: tuple) -> None:
        self.arrays = arrays
        _, feature, value, path = arrays
        width = int(feature.max(initial=0)) + 1
        used = np.isfinite(value)
        self.splits = [np.unique(value[used & (feature == f)]) for f in range(width)]
        self.trees = []
        for t in range(len(feature)):
            own = [np.unique(value[t][used[t] & (feature[t] == f)]) for f in range(width)]
            sizes = [len(s) + 1 for s in own]
            if math.prod(sizes) > CELLS:
                self.trees.append(None)
                continue
            cells = np.stack(np.meshgrid(*[np.append(s, np.inf) for s in own], indexing="ij"), -1).reshape(-1, width)
            strides = [math.prod(sizes[f + 1:]) for f in range(width)]
            places = [np.searchsorted(o, np.append(s, np.inf)) * n for o, s, n in zip(own, self.splits, strides)]
            self.trees.append((places, _mean_path(cells, feature[t : t + 1], value[t : t + 1], path[t : t + 1])))

    def moved_scores(self, x: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
        """The scores of a block, and those with one feature after the other taken from ``other``."""
        rows, feature, value, path = self.arrays
        width = x.shape[1]
        variants = [x]
        for f in range(width):
            variants.append(x.copy())
            variants[-1][:, f] = other[:, f]
        here, there = ([np.searchsorted(s, block[:, f]) for f, s in enumerate(self.splits)] for block in (x, other))
        totals = [np.zeros(len(x)) for _ in variants]
        for t, tree in enumerate(self.trees):
            if tree is None:
                for total, v in zip(totals, variants):
                    total += _mean_path(v, feature[t : t + 1], value[t : t + 1], path[t : t + 1])
                continue
            places, leaf = tree
            mine = [np.take(p, r) for p, r in zip(places, here)]
            cell = sum(mine[1:], mine[0])
            base = np.take(leaf, cell)
            totals[0] += base
            for f, total in enumerate(totals[1:]):
                total += np.take(leaf, cell - mine[f] + np.take(places[f], there[f])) if f < len(mine) else base
        return [-np.exp2(-(total / len(feature)) / max(expected_path(rows), 1e-12)) for total in totals]


def score(df: DataFrame, forest: Forest, name: str = "anomaly_score") -> DataFrame:
    """Add the score; a row with a missing feature gets null."""
    require_columns(df, *forest.features)
    shared = df.sparkSession.sparkContext.broadcast(forest.arrays)

    @F.pandas_udf(DoubleType())
    def scores(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns])
        found = score_arrays(x, shared.value)
        return pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, found))

    # Marked as not repeatable, or the optimizer would copy the walk into pushed-down filters
    # on the score and run it twice.
    raw = scores.asNondeterministic()(*[F.col(f).cast("double") for f in forest.features])
    return df.withColumn(name, raw).withColumn(name, F.when(~F.isnan(name), F.col(name)))


def score_many(df: DataFrame, forests: Sequence[Forest], name: str = "scores") -> DataFrame:
    """Add an array with the score of every forest (same features), in one pass."""
    features = forests[0].features
    shared = df.sparkSession.sparkContext.broadcast([f.arrays for f in forests])

    @F.pandas_udf(ArrayType(DoubleType()))
    def scores(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns])
        found = np.column_stack([score_arrays(x, f) for f in shared.value])
        return pd.Series(list(found))

    walked = scores.asNondeterministic()
    return df.withColumn(name, walked(*[F.col(f).cast("double") for f in features]))


_MOMENTS = "feature string, n bigint, mean double, m2 double, lo double, hi double"


def _blocks(batches: Iterator[pd.DataFrame], rows: int = BLOCK) -> Iterator[np.ndarray]:
    """The batches of a task, put together to blocks of about so many rows."""
    held, size = [], 0
    for pdf in batches:
        held.append(pdf.to_numpy(float))
        size += len(pdf)
        if size >= rows:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def score_moments(df: DataFrame, forests: Sequence[Forest]) -> DataFrame:
    """Moments of the scores of every forest (same features), named by its number; rows have all features.

    Rows that lie close together share most of the work (``leaf_boxes``), so they are dealt to the
    tasks in the order of their features, rows equal in all of them by where they were read.
    """
    features = list(forests[0].features)
    shared = df.sparkSession.sparkContext.broadcast([f.arrays for f in forests])
    names = [str(i) for i in range(len(forests))]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        boxes = None  # once a task, if it has rows
        norm = np.array([[max(expected_path(rows), 1e-12)] for rows, *_ in shared.value])
        for x in _blocks(batches):
            boxes = boxes or LeafBoxes(shared.value, len(features), _mean_path)
            n, mean, m2 = 0, np.zeros(len(names)), np.zeros(len(names))
            lo, hi = np.full(len(names), np.inf), np.full(len(names), -np.inf)
            for rows, paths in boxes.mean_paths(x):
                scores = -np.exp2(-paths / norm)
                here = scores.mean(axis=1)
                gap, both = here - mean, n + len(rows)
                m2 += ((scores - here[:, None]) ** 2).sum(axis=1) + gap * gap * n * len(rows) / both
                mean += gap * len(rows) / both
                lo, hi, n = np.minimum(lo, scores.min(axis=1)), np.maximum(hi, scores.max(axis=1)), both
            yield pd.DataFrame({"feature": names, "n": n, "mean": mean, "m2": m2, "lo": lo, "hi": hi})

    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.spark_partition_id().alias("_part"))
    parts = parts_by_bytes(df, 32 << 20, python_tasks(df.sparkSession))
    near = rows.repartitionByRange(parts, *features, "_part").select(*features)
    return merge_moments(near.mapInPandas(moments, _MOMENTS))


def labelled(scored: DataFrame, forest: Forest) -> DataFrame:
    """Add confidence and label to scores; an anomaly lies strictly below the threshold."""
    if forest.threshold is None:
        raise ValueError("the forest has no threshold; fit it with one")
    below = F.col("anomaly_score") < F.lit(forest.threshold)
    return scored.withColumns({
        "confidence": F.abs("anomaly_score"),
        "anomaly": F.when(below, "anomaly").otherwise("normal"),
    })


def detect(df: DataFrame, forest: Forest) -> DataFrame:
    """Add score, confidence and the label."""
    return labelled(score(df, forest), forest)


def only_anomalies(detected: DataFrame) -> DataFrame:
    require_columns(detected, "anomaly")
    return detected.where(F.col("anomaly") == "anomaly")


def batch_predict(tx: DataFrame, forest: Forest, key: str = "hash") -> DataFrame:
    """The prediction table: key, is_anomaly, confidence, anomaly_score."""
    return detect(tx, forest).select(
        key, (F.col("anomaly") == "anomaly").alias("is_anomaly"), "confidence", "anomaly_score"
    )


def with_explanation(detected: DataFrame, features: Sequence[str]) -> DataFrame:
    """The feature values as a map and one line of text."""
    names = F.array(*[F.lit(f) for f in features])
    values = F.array(*[F.col(f).cast("double") for f in features])
    text = F.format_string(
        "score %.4f from " + ", ".join(f"{f}=%s" for f in features),
        F.col("anomaly_score"), *[F.col(f).cast("string") for f in features],
    )
    return detected.withColumns({
        "features_used": F.map_from_arrays(names, values), "explanation": text,
    })


# -- tuning and importance ---------------------------------------------------------------


def trial_specs(trials: int = 20, seed: int = 42) -> list[Spec]:
    """Random search space: 50 to 200 trees, 256 to 1024 rows per tree."""
    rng = np.random.default_rng(seed)
    return [
        Spec(int(rng.choice([50, 100, 150, 200])), int(rng.choice([256, 256, 512, 1024])))
        for _ in range(trials)
    ]


def tune(
    df: DataFrame, features: Sequence[str] = BASE_FEATURES, trials: int = 20, seed: int = 42,
    key: str = "hash", contamination: float = 0.01,
) -> tuple[DataFrame, Forest]:
    """(one row per trial, the forest of the best trial): best is the largest variance of
    scores over all rows. All trials share the fitting pass and the scoring pass.
    """
    specs = trial_specs(trials, seed)
    forests = fit_trials(df, specs, features, contamination, seed, key)
    moments = score_moments(_feature_rows(df, features, key), forests).collect()
    spread = {int(r["feature"]): r["m2"] / r["n"] for r in moments}
    table = [(i, s.trees, s.rows, spread[i]) for i, s in enumerate(specs)]
    best = max(table, key=lambda row: (row[3], -row[0]))[0]
    trial_table = df.sparkSession.createDataFrame(
        [(*row, row[0] == best) for row in table],
        "trial int, n_estimators int, max_samples int, score_variance double, is_best boolean",
    )
    return trial_table, forests[best]


def permutation_importance(
    df: DataFrame, forest: Forest, key: str = "hash", seed: int = 42,
) -> DataFrame:
    """Mean absolute score change per feature when its values are shuffled between rows.

    Two hash orders number the rows; joining on the number pairs every row with a partner.
    The numbering runs per slice of the order, so there is no global sort, and one join serves
    all features: each is replaced by the partner's value in turn.
    """
    from ledgerwatch.operators.ordered import hashed_row_numbers

    features = list(forest.features)
    rows = materialise(_feature_rows(df, features, key), "importance-rows")

    def numbered(salt: int, columns: list[Column]) -> DataFrame:
        at = unit_hash(F.col("_key"), F.lit(seed + salt))
        return hashed_row_numbers(rows, at, "_key", "_at").select("_at", *columns)

    own = numbered(1, [F.col(f) for f in features])
    partner = numbered(2, [F.col(f).alias(f"p_{f}") for f in features])
    shared = df.sparkSession.sparkContext.broadcast(forest.arrays)
    width = len(features)

    @F.pandas_udf(ArrayType(DoubleType()))
    def changes(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        cells = Cells(shared.value)  # once a task
        for columns in batches:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            base, *moved = cells.moved_scores(x[:, :width], x[:, width:])
            yield pd.Series(list(np.column_stack([np.abs(base - m) for m in moved])))

    paired = own.join(partner, "_at").select(
        changes.asNondeterministic()(*features, *[f"p_{f}" for f in features]).alias("change")
    )
    wide = paired.agg(*[
        F.avg(F.element_at("change", i + 1)).alias(f) for i, f in enumerate(features)
    ])
    return wide.unpivot([], features, "feature", "importance")


# -- storage -----------------------------------------------------------------------------


def node_rows(forest: Forest) -> list[tuple]:
    """(tree, node, feature, threshold, path): inner nodes in heap order, then the leaves' paths."""
    rows = []
    for tree in range(forest.trees):
        for node, (f, v) in enumerate(zip(forest.split_feature[tree], forest.split_value[tree])):
            rows.append((tree, node, int(f), float(v), None))
        for leaf, p in enumerate(forest.leaf_path[tree]):
            rows.append((tree, leaf, None, None, float(p)))
    return rows


NODE_TABLE = "tree int, node int, feature int, threshold double, path double"


def save(spark: SparkSession, forest: Forest, path: str) -> str:
    """Write the trees as a table and the parameters as one row; returns the checksum.

    The rows are plain tuples: a pandas column with missing integers becomes floats in a
    session without Arrow.
    """
    spark.createDataFrame(node_rows(forest), NODE_TABLE).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = [(
        list(forest.features), forest.rows, forest.contamination, forest.seed, forest.threshold,
        forest.checksum,
    )]
    spark.createDataFrame(
        meta, "features array<string>, rows int, contamination double, seed int, "
              "threshold double, checksum string",
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return forest.checksum


def load(spark: SparkSession, path: str) -> Forest:
    """Read a saved forest (bounded by its parameters); raises ``ValueError`` when the checksum does not match."""
    meta = spark.read.parquet(f"{path}/meta").first()
    nodes = sorted(spark.read.parquet(f"{path}/nodes").collect(), key=lambda r: (r["tree"], r["node"]))
    trees = nodes[-1]["tree"] + 1
    inner = [r for r in nodes if r["path"] is None]
    forest = Forest(
        tuple(meta["features"]), meta["rows"], meta["contamination"], meta["seed"],
        np.array([r["feature"] for r in inner], np.int32).reshape(trees, -1),
        np.array([r["threshold"] for r in inner], float).reshape(trees, -1),
        np.array([r["path"] for r in nodes if r["path"] is not None], float).reshape(trees, -1),
        meta["threshold"],
    )
    if forest.checksum != meta["checksum"]:
        raise ValueError(f"checksum of the model in {path} does not match")
    return forest
