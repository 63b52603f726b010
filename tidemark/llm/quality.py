"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

The features approximate a Gaussian kernel over standardised statistics of the text alone. The sampled rows' statistics
are dealt to a fixed number of tasks; each sums its part of the normal equations, and the driver adds the sums and
solves a system of fixed size. Calibration fits a monotone curve to other labelled rows and joins its steps by straight lines.

Fitting uses a bounded sample of labelled rows (fit_rows, calibration_rows), chosen by a hash of the id; scoring is
map-only over all documents.

Defined results: null and empty texts have all-zero statistics and get a score like any other; rows without a label, or
with a null one, take no part in fitting; repeated rows and repeated labels count as often as they stand; with labels
of fewer than two kinds, or none, every score is their mean (1 without any); columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import bounded, mapped
from tidemark.llm.bpe import slices

STATISTICS = (
    "log_chars", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "upper", "digits", "punctuation",
    "symbols", "white", "other", "lines", "mean_line", "repeated_lines", "repeated_pairs", "words_with_symbols", "ends_well", "capital_words", "entropy",
)
SYMBOLS = bytes(c for c in range(33, 127) if chr(c) not in ".,;:!?'\"()-" and not chr(c).isalnum())
PUNCTUATION = b".,;:!?'\"()-"
DIGITS, UPPER, LOWER, WHITE = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b" \t\n\r\x0b\x0c"
HAS_SYMBOL = re.compile("[" + re.escape(SYMBOLS.decode()) + "]")
#: Rows whose features are held at once.
BLOCK = 2000


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of one text."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = text.encode("utf-8", "replace")
    n = len(data)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda some: float(count[list(some)].sum()) / n
    words = text.split()
    m = max(1, len(words))
    code: dict[str, int] = {}
    number = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    often = np.bincount(number) if len(number) else np.zeros(1, np.int64)
    pairs = number[:-1] * len(code) + number[1:]
    p = often[often > 0] / m
    sizes = np.array([len(w) for w in code], np.int64) if code else np.zeros(1, np.int64)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    strange = sum(int(often[i]) for w, i in code.items() if HAS_SYMBOL.search(w))
    capital = sum(int(often[i]) for w, i in code.items() if w[0].isupper())
    mean = float((sizes * often).sum()) / m
    return [
        np.log1p(n), np.log1p(len(words)), mean, float(often[sizes > 20].sum()) / m if code else 0.0, len(code) / m, float(often.max()) / m,
        share(UPPER), share(DIGITS), share(PUNCTUATION), share(SYMBOLS), share(WHITE), float(count[128:].sum()) / n,
        np.log1p(len(lines)), np.log1p(n / k), 1 - len(set(lines)) / k, 1 - len(np.unique(pairs)) / max(1, len(pairs)),
        strange / m, sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / k, capital / m, float(-(p * np.log2(p)).sum()) / np.log2(m + 1) if len(p) else 0.0,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending, and the calibrated value at each
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.cos(z @ self.waves + self.phase) * np.sqrt(2.0 / len(self.phase))
        return np.hstack([np.ones((len(x), 1)), z, f])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(x[at : at + BLOCK]) @ self.weights for at in range(0, max(1, len(x)), BLOCK)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; (mean raw score, value) of each pool, strictly rising in raw."""
    raw, back = np.unique(raw, return_inverse=True)
    n = np.bincount(back).astype(float)
    total = np.bincount(back, y)
    pools: list[list[float]] = []  # rows, sum of y, sum of raw
    for k, s, x in zip(n, total, raw, strict=True):
        pools.append([k, s, x * k])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    k, s, x = np.array(pools).T
    return x / k, s / k


def _with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep and stats array<double>, one slice of a batch at a time."""
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b, at):
                stats = [statistics(x) for x in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:at], pa.array(stats, pa.list_(pa.float64()))], [*keep, "stats"])

    kinds = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in keep)
    return mapped(df.select(*(f"`{x}`" for x in keep), text), run, f"{kinds}, stats array<double>")


def _summed(df: DataFrame, schema: str, of, tasks: int = 16) -> list[np.ndarray]:
    """of(batches) gives one row of binary sums a task; df, of few and short rows, is dealt to tasks first, so that no more
    sums than these exist, in however many tasks df is made. They are added here; empty without rows."""
    parts = df.repartition(tasks).mapInPandas(of, schema).collect()
    return [sum(np.frombuffer(r[i]) for r in parts) for i in range(len(schema.split(", ")))] if parts else []


def fit(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", fit_rows: int = 30_000, calibration_rows: int = 10_000, waves: int = 384, width: float = 4.0, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fits on the documents that labels (key, label) name; a fifth of them, by hash, calibrate.

    labels must already leave out what is held out. The joined side holds fit_rows + calibration_rows rows at most, so
    it is broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.col(label).cast("double").alias("_y"))
    limit = fit_rows + calibration_rows
    chosen = bounded(known, key, limit)
    share = max(1, round(100 * calibration_rows / limit))
    part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100)) < share
    joined = docs.select(key, text).join(F.broadcast(chosen.withColumn("_calibrates", part)), key)
    rows = _with_statistics(joined, text, ["_y", "_calibrates"]).persist()
    try:
        first = rows.select("_y", *(F.col("stats")[i].alias(f"s{i}") for i in range(len(STATISTICS))))
        got = first.agg(F.count("*"), F.avg("_y"), F.min("_y"), F.max("_y"), *(f(f"s{i}") for f in (F.avg, F.stddev_pop) for i in range(len(STATISTICS)))).first()
        d = len(STATISTICS)
        rng = np.random.default_rng(seed)
        w, phase = rng.standard_normal((d, waves)) / width, rng.uniform(0, 2 * np.pi, waves)
        size = 1 + d + waves
        if not got[0] or got[2] == got[3]:
            flat = np.array([1.0 if got[1] is None else got[1]])
            return Model(np.zeros(d), np.ones(d), w, phase, np.zeros(size), np.zeros(1), flat)
        mean, scale = np.array(got[4 : 4 + d], float), np.array(got[4 + d :], float)
        model = Model(mean, np.where(scale > 1e-9, scale, 1.0), w, phase, np.zeros(size), np.zeros(1), np.zeros(1))

        def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a, b, n = np.zeros((size, size)), np.zeros(size), np.zeros(1)
            for t in batches:
                for at in range(0, len(t), BLOCK):
                    some = t.iloc[at : at + BLOCK]
                    f = model.features(np.stack(some["stats"].to_numpy()))
                    a += f.T @ f
                    b += f.T @ some["_y"].to_numpy()
                    n += len(some)
            yield pd.DataFrame([[a.tobytes(), b.tobytes(), n.tobytes()]], columns=["a", "b", "n"])

        learned = rows.where(~F.col("_calibrates")).select("_y", "stats")
        sums = _summed(learned, "a binary, b binary, n binary", equations) or [np.zeros(size * size), np.zeros(size), np.zeros(1)]
        a, b, n = sums[0].reshape(size, size), sums[1], max(1.0, float(sums[2][0]))
        penalty = ridge * n * np.eye(size) / size
        penalty[0, 0] = 1e-9 * n
        model.weights = np.linalg.solve(a + penalty + 1e-9 * np.eye(size), b)
        other = rows.where("_calibrates").select("_y", "stats").toPandas()  # calibration_rows at most
        if len(other):
            model.knots, model.values = isotonic(model.raw(np.stack(other["stats"].to_numpy())), other["_y"].to_numpy())
        else:
            model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    finally:
        rows.unpersist()


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with out, from 0 to 1; map-only."""
    kept = [x for x in df.columns if x != out]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b, at):
                x = np.array([statistics(t) for t in some.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(model.score(x))], [*kept, out])

    schema = T.StructType([*(df.schema[x] for x in kept), T.StructField(out, T.DoubleType())])
    return mapped(df.select(*(f"`{x}`" for x in kept)), run, schema)


def accepted(score: Column) -> Column:
    return score >= 0.5
