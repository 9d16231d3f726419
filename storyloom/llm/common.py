"""What several operators share: written intermediate tables, folds, calibration."""

from __future__ import annotations

import gc
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.session import scratch

#: White space of a word split, as a class: blank and the controls 9 to 13.
SPACE = r"\x20\x09-\x0D"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written copy survives lost executors, is computed once however often it
    is used, and carries its real size, so Spark broadcasts it only when small.
    """
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more, and the files of the shuffles behind them."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Files of shuffles go when the driver's collector finds that nothing refers to them; a job of many rounds has it look here."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of an Arrow batch where a row holds a whole text or set. A task holds some batches at once, on both sides of its pipe.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def set_small_batches(spark: SparkSession) -> None:
    """The session moves ``BATCH_ROWS`` rows at a time to and from Python workers, fewer where it said so before."""
    rows = int(spark.conf.get(ARROW_ROWS, None) or 0)
    spark.conf.set(ARROW_ROWS, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))


@contextmanager
def small_batches(spark: SparkSession):
    """``set_small_batches`` for the jobs run inside; the session's own setting comes back after them."""
    before = spark.conf.get(ARROW_ROWS, None)
    set_small_batches(spark)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_ROWS)
        else:
            spark.conf.set(ARROW_ROWS, before)


def unused(columns: list[str], name: str) -> str:
    """``name``, longer as long as a column has it; names differ by more than case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """CRC-32 of the key written as text, modulo ``parts``."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): one row per document; documents labelled both ways are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    return rows.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("high")).where("label = high").drop("high")


def bounded_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> list:
    """(text, label) pairs for fitting on the driver: of each label the first ``max_rows``
    labelled ids in hash order, as far as their texts fill ``max_bytes``. Null text is empty;
    a text that alone is longer than ``max_bytes`` is passed over.

    ``labels`` is (doc_id, label). The ids are drawn before any text is read, so
    what meets the texts is at most ``2 * max_rows`` rows of two numbers.
    """
    picked = None
    for label in (0, 1):
        own = labels.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = own if picked is None else picked.unionByName(own)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").where(F.octet_length("text") <= max_bytes)
    filled = F.sum(F.octet_length("text")).over(
        Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("filled", filled).where(F.col("filled") <= max_bytes)
    return sorted((r.text, r.label) for r in rows.select("text", "label").collect())


def label_rows(docs: DataFrame, labels: DataFrame) -> dict[int, int]:
    """How many rows of ``docs`` carry each label of ``labels`` (doc_id, label); no text is read."""
    counts = docs.select("doc_id").join(labels, "doc_id").groupBy("label").agg(F.count("*").alias("rows")).collect()
    return {0: 0, 1: 0} | {r.label: r.rows for r in counts}


def row_weights(sample: list, totals: dict[int, int]) -> dict[int, float]:
    """What a sampled row of each label stands for: the label's rows over its sampled rows."""
    sampled = {label: sum(y == label for _, y in sample) for label in (0, 1)}
    return {label: totals[label] / sampled[label] if sampled[label] else 0.0 for label in (0, 1)}


class Logistic:
    """Ridge logistic regression on standardised, clipped features (Newton steps); a row counts ``weights`` times."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1.0):
        x, y = np.asarray(features, float), np.asarray(labels, float)
        times = np.ones(len(x)) if weights is None else np.asarray(weights, float)
        self.mean = np.average(x, 0, times) if len(x) else np.zeros(x.shape[1])
        self.scale = np.sqrt(np.average((x - self.mean) ** 2, 0, times)) + 1e-9 if len(x) else np.ones(x.shape[1])
        # One pseudo-row of each label keeps the fit defined for a single class.
        a = np.vstack([self._design(x), self._design(np.vstack([self.mean, self.mean]))])
        times = np.append(times, [1.0, 1.0])
        y, w = np.append(y, [0.0, 1.0]), np.zeros(x.shape[1] + 1)
        penalty = np.diag([1e-3] + [ridge] * x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve(a.T @ (a * (times * (p * (1 - p) + 1e-9))[:, None]) + penalty, a.T @ (times * (y - p)) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -6, 6)])

    def __call__(self, features: np.ndarray) -> np.ndarray:
        z = self._design(np.asarray(features, float)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
