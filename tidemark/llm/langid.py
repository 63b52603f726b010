"""Language of a text: the mean of hashed subword embeddings, a linear softmax over it, and a calibrated rejection.

A word's subwords are its character n-grams with marks at both ends; each hashes to a row of the embedding table. The
model is linear after the mean, so a worker keeps, for each word it has met, the sum of its subwords' scores.

Training is stochastic gradient descent in numpy over a bounded sample of documents (fit_rows), each reduced on the
executors to at most `buckets` counts. Another part of the sample (by hash) fits a temperature and the score below
which a prediction is rejected.

Defined results: null text, and text without a letter, is `und` with score 0 and is rejected; documents whose language
is null take no part in fitting; with no language to learn every text is `und`; repeated rows count as often as they
stand; texts are read whole; columns named like an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import bounded, mapped
from tidemark.llm.bpe import WHITE_SPACE, slices

UNKNOWN = "und"
WORD = re.compile(f"[^{WHITE_SPACE}]+")
#: Words that a worker keeps; what comes after that is scored for its batch only.
KEPT = 200_000


def subwords(word: str, buckets: int, sizes: tuple[int, ...] = (1, 2, 3, 4)) -> list[int]:
    marked = f"<{word.lower()}>"
    data = marked.encode("utf-8", "replace")
    if len(data) == len(marked):
        return [zlib.crc32(data[i : i + n]) % buckets for n in sizes for i in range(len(data) - n + 1)]
    return [zlib.crc32(marked[i : i + n].encode("utf-8", "replace")) % buckets for n in sizes for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: the subwords' scores, embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    words: dict[str, int] = field(default_factory=dict, repr=False)
    sums: list[np.ndarray] = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "words": {}, "sums": []}

    def logits(self, texts: list[str | None]) -> np.ndarray:
        buckets, k = self.table.shape
        parts = [WORD.findall(x) if x else [] for x in texts]
        words = self.words
        base = len(words)
        new = [w for w in set().union(*parts) if w not in words]
        made = [np.empty((0, k + 1))]
        for at in range(0, len(new), 4000):
            grams = [subwords(w, buckets) for w in new[at : at + 4000]]
            n = np.array([len(g) for g in grams])
            flat = self.table[np.concatenate(grams)]
            made.append(np.hstack([np.add.reduceat(flat, np.concatenate([[0], np.cumsum(n)[:-1]])), n[:, None]]))
        words.update(zip(new, range(base, base + len(new)), strict=True))
        known = np.vstack([*self.sums, *made])
        out = np.tile(self.bias, (len(texts), 1)).astype(float)
        get = words.__getitem__
        for i, x in enumerate(parts):
            if x:
                total = known[np.fromiter(map(get, x), np.int64, len(x))].sum(axis=0)
                out[i] += total[:k] / total[k]
        if base < KEPT:
            self.sums = [known]
        else:
            for w in new:
                del words[w]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), [True] * len(texts)
        p = softmax(self.logits(texts) / self.temperature)
        best, score = p.argmax(axis=1), p.max(axis=1)
        letters = np.array([bool(x) and any(map(str.isalpha, x)) for x in texts], bool)
        names = [self.languages[i] if a else UNKNOWN for i, a in zip(best, letters, strict=True)]
        score = np.where(letters, score, 0.0)
        return names, score, (~letters | (score < self.reject_below)).tolist()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], buckets: int, dim: int = 16, epochs: int = 8, rate: float = 20.0, seed: int = 3) -> Model:
    """rows: subword buckets, their shares of the document, index of the language."""
    rng, k = np.random.default_rng(seed), len(languages)
    embed = rng.uniform(-1, 1, (buckets, dim)) / dim
    weights, bias = rng.standard_normal((dim, k)) * 0.1, np.zeros(k)
    steps, at = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share, y = rows[i]
            lr = rate * (1 - at / steps)
            at += 1
            h = share @ embed[ids]
            g = softmax((h @ weights + bias)[None])[0]
            g[y] -= 1.0
            back = weights @ g
            weights -= 0.02 * lr * np.outer(h, g)
            bias -= 0.002 * lr * g
            embed[ids] -= lr * share[:, None] * back
    return Model(languages, embed @ weights, bias)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = 3000, buckets: int = 1 << 14, reject_share: float = 0.001, least: float = 0.3) -> Model:
    """docs must already leave out what is held out; fit_rows documents at most are gathered, as counts.

    A quarter of them fits the temperature and reject_below: the score that all but reject_share of the right
    predictions reach, but least at least and 0.5 at most.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    chosen = bounded(known.select(key, text, lang), key, fit_rows, rows=known.select(key).count(), salt=9)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b, 1):
                ids, shares = [], []
                for x in some.column(1).to_pylist():
                    n = np.zeros(buckets)
                    for w in WORD.findall(x):
                        np.add.at(n, subwords(w, buckets), 1.0)
                    used = np.flatnonzero(n)
                    ids.append(used.astype("<i4").tobytes())
                    shares.append((n[used] / max(1.0, n.sum())).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["key", "lang", "ids", "shares"])

    kind = docs.schema[key].dataType.simpleString()
    got = mapped(chosen, counted, f"key {kind}, lang string, ids binary, shares binary").collect()
    got = sorted(((zlib.crc32(str(r["key"]).encode(), 1), r["lang"], np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["shares"], "<f4").astype(float)) for r in got if r["ids"]), key=lambda r: (r[0], r[1]))
    languages = sorted({r[1] for r in got})
    if not languages:
        return Model([], np.zeros((buckets, 1)), np.zeros(1))
    number = {x: i for i, x in enumerate(languages)}
    part = [r for r in got if r[0] % 4 == 0]
    model = train([(r[2], r[3], number[r[1]]) for r in got if r[0] % 4] or [(r[2], r[3], number[r[1]]) for r in got], languages, buckets)
    if part:
        z = np.array([r[3] @ model.table[r[2]] + model.bias for r in part])
        y = np.array([number[r[1]] for r in part])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 120), key=loss))
        p = softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        if len(right):
            model.reject_below = float(np.clip(np.quantile(right, reject_share), least, 0.5))
    return model


def identify(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """df with the predicted language, its score from 0 to 1, and whether it is rejected; map-only."""
    kept = [x for x in df.columns if x not in names]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b, at):
                lang, score, rejected = model.predict(some.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected, pa.bool_())], [*kept, *names])

    plain = df.select(*(f"`{x}`" for x in kept))
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*(df.schema[x] for x in kept), *(T.StructField(x, k) for x, k in zip(names, kinds, strict=True))])
    return mapped(plain, run, schema)
