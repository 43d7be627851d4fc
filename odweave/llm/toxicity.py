"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its lower-cased characters at every place of the whole
text. What isn't a letter, mark or digit separates words, a run of it counts as one space, and an n-gram has
that space at its ends at most: writing without spaces is one long word. A feature's value is the log ratio of
its (smoothed) shares of toxic and other training texts; a text's values are divided by the fourth root of the
sum of their fourth powers, which lets a few strong features stand out of a long text's many weak ones.
Logistic regression with both classes weighted alike gives the score. A training text's own counts are left out
of its ratios, without which its rare n-grams would look better than a new text's.

The classifier is fitted on a bounded sample of labelled rows: of each class those ROWS_PER_CLASS whose ids
hash lowest, as long as their features stay under TRAIN_FEATURES. Scoring covers all texts.

Defined results: null and empty texts have no features and get the score of the intercept; labels that are
null are no labels; ids are integers (others raise where they are cast); a row labelled twice counts once, as toxic if any label says so; repeated documents are
scored each; without labels of both classes every score is 0; a null id belongs to the training fold but has
no label.
"""

from __future__ import annotations

import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.common import give_back, written

#: Characters of an n-gram.
SIZES = (4, 5, 6)
BITS = 20
#: The bounds of the sample that a classifier is fitted on.
ROWS_PER_CLASS = 3000
TRAIN_FEATURES = 8_000_000
#: Texts added to a feature's, in proportion to the classes' sizes.
SMOOTHING = 20.0
L2 = 1e-4
ROUNDS = 60
FOLDS = 5


def _letters() -> np.ndarray:
    """Whether each character up to U+FFFF is a letter, mark or digit; those beyond count as letters."""
    return np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(1 << 16)])


_word: list[np.ndarray] = []


def ngrams(text: str) -> np.ndarray:
    """The hashed n-grams of a text, repeats included."""
    if not _word:
        _word.append(_letters())
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _word[0][np.minimum(x, 0xFFFF)] | (x > 0xFFFF)
    stay = word.copy()
    stay[0] = True
    stay[1:] |= word[:-1]
    x = np.where(word, x, np.uint32(0))[stay]
    space = np.flatnonzero(x == 0)
    # from each place the characters up to the next space
    ahead = np.repeat(space[1:], np.diff(space)) - np.arange(len(x) - 1)
    acc, out, weight = np.zeros(len(x), np.uint32), [np.zeros(0, np.uint32)], 1
    for k in range(1, min(max(SIZES), len(x)) + 1):
        weight = weight * 0x9E3779B1 & 0xFFFFFFFF
        acc = acc[: len(x) - k + 1] + (x[k - 1 :] + np.uint32(1)) * np.uint32(weight)
        if k in SIZES:
            use = acc[ahead[: len(acc)] >= k - 1]
            out.append((use ^ (use >> np.uint32(15))) * np.uint32(0x7C1B3C6D + 2 * k) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def features(text: str, last: np.ndarray) -> np.ndarray:
    """The distinct n-grams of a text. last is a work array with a place for each feature."""
    f = ngrams(text)
    n = np.arange(len(f), dtype=np.int32)
    last[f] = n
    return f[last[f] == n]


def sample(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, toxic) of at most ROWS_PER_CLASS rows of each class, none of them held out."""
    clean = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.when(F.col(label_col) == 1, 1).otherwise(0)).alias("_toxic"))
    )
    order = F.xxhash64("_id")
    parts = [clean.filter(F.col("_toxic") == c).orderBy(order, "_id").limit(ROWS_PER_CLASS) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def held_out(id_col):
    """Whether a row's label may not be learnt."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(order, toxic, n, features) of the sample; the sample is small by its bound and so broadcast."""
    chosen = written(sample(labels, id_col, label_col), "sample")
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text")).join(
        F.broadcast(chosen), F.col("_doc") == F.col("_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(1 << BITS, np.int32)
        for b in batches:
            got = [features(t or "", last) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(map(len, got), pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in got], pa.binary()),
                ],
                names=["order", "toxic", "n", "features"],
            )

    return rows.select(F.xxhash64("_id").alias("order"), "_toxic", "_text").mapInArrow(
        run, "order long, toxic int, n long, features binary"
    )


def _parts(n: int) -> list[slice]:
    return [slice(a, a + (1 << 20)) for a in range(0, n, 1 << 20)]


def fit(index: np.ndarray, length: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of each feature's presence before a text is scaled, ratio) and the intercept.

    index has the features of all texts one after another. The driver fits, so all work goes in parts: besides
    index it holds 6 bytes for each of its entries, and some arrays of a place for each feature.
    """
    size, n = 1 << BITS, len(length)
    row = np.repeat(np.arange(n, dtype=np.uint16 if n < 1 << 16 else np.int32), length)
    flag = toxic.astype(bool)
    parts = _parts(len(index))
    count = [np.zeros(size, np.float32), np.zeros(size, np.float32)]
    for s in parts:
        own = flag[row[s]]
        count[0] += np.bincount(index[s][own], minlength=size).astype(np.float32)
        count[1] += np.bincount(index[s][~own], minlength=size).astype(np.float32)
    total = [float(c.sum(dtype=np.float64)) for c in count]
    # smoothed in proportion to the classes' sizes, so that a feature never seen has ratio 0
    prior = [SMOOTHING * 2 * t / sum(total) for t in total]
    even = np.log(prior[0] / prior[1])
    # a training text's ratios leave the text itself out, as a new text's do
    value, norm = np.empty(len(index), np.float32), np.zeros(n)
    for s in parts:
        own = flag[row[s]]
        v = np.log(count[0][index[s]] - own + prior[0]) - np.log(count[1][index[s]] - ~own + prior[1]) - even
        value[s] = v
        norm += np.bincount(row[s], v**4, n)
    norm = np.maximum(norm**0.25, 1e-9).astype(np.float32)
    for s in parts:
        value[s] /= norm[row[s]]
    ratio = np.log(count[0] + np.float32(prior[0])) - np.log(count[1] + np.float32(prior[1])) - np.float32(even)
    del count
    share = np.where(flag, 0.5 / flag.sum(), 0.5 / (~flag).sum())
    y = flag.astype(np.float64)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, z = p[:-1], np.full(n, p[-1])
        for s in parts:
            z += np.bincount(row[s], value[s] * w[index[s]], n)
        e = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = np.empty(size + 1)
        g[:-1] = w
        g[:-1] *= L2
        for s in parts:
            g[:-1] += np.bincount(index[s], value[s] * e[row[s]], size)
        g[-1] = e.sum()
        return float((share * (np.logaddexp(0, z) - y * z)).sum() + L2 / 2 * (w @ w)), g

    p = _minimise(loss, np.zeros(size + 1))
    return np.stack([ratio * p[:-1].astype(np.float32), ratio]), float(p[-1])


def _minimise(loss, p: np.ndarray) -> np.ndarray:
    """Quasi-Newton steps with a limited memory."""
    past: deque = deque(maxlen=5)
    f, g = loss(p)
    for _ in range(ROUNDS):
        q, used = g.copy(), []
        for s, y in reversed(past):
            used.append((s @ q) / (s @ y))
            q -= used[-1] * y
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(used), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step = 1.0 if past else 1.0 / max(1e-12, float(np.linalg.norm(q)))
        for _ in range(25):
            f2, g2 = loss(p - step * q)
            if f2 <= f - 1e-4 * step * (q @ g):
                break
            step /= 2
        else:
            return p
        # in place, as each of these arrays has a place for every feature
        q *= -step
        p += q
        np.subtract(g2, g, out=g)
        if q @ g > 1e-14:
            past.append((q.astype(np.float32), g.astype(np.float32)))
        small = abs(f - f2) < 1e-6
        f, g = f2, g2
        if small:
            break
    return p


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> bytes:
    """The classifier as bytes: the intercept, then weight and ratio of each feature; empty without both classes."""
    rows = written(training_rows(docs, labels, id_col, text_col, label_col), "train")
    sizes = rows.select("order", "toxic", "n").toPandas().sort_values(["order", "toxic", "n"])
    within = sizes[sizes.n.cumsum() <= TRAIN_FEATURES]
    if within.toxic.nunique() < 2:
        return b""
    chosen = rows.filter(F.col("order") <= int(within.order.max())).select("toxic", "n", "features").toArrow()
    flat = pa.concat_arrays(chosen["features"].chunks)
    first = int(np.frombuffer(flat.buffers()[1], "<i4", 1, 4 * flat.offset)[0])
    index = np.frombuffer(flat.buffers()[2], "<u4", pc.sum(chosen["n"]).as_py(), first)
    weights, bias = fit(index, chosen["n"].to_numpy(), chosen["toxic"].to_numpy())
    model = np.concatenate([np.float32([bias]), weights.ravel()]).astype("<f4", copy=False).tobytes()
    del rows, sizes, within, chosen, flat, index, weights
    give_back()
    return model


def score(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """docs with ``score``, 0 to 1."""
    docs = docs.drop("score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, last = np.frombuffer(held.value, "<f4"), np.zeros(1 << BITS, np.int32)
        bias, (weight, ratio) = (float(flat[0]), flat[1:].reshape(2, -1)) if len(flat) else (0.0, (None, None))
        for b in batches:
            out = []
            for t in b.column(b.schema.get_field_index(text_col)).to_pylist():
                if weight is None:
                    out.append(0.0)
                    continue
                f = features(t or "", last)
                norm = float((ratio[f].astype(np.float64) ** 4).sum()) ** 0.25
                z = bias + float(weight[f].sum(dtype=np.float64)) / max(1e-9, norm)
                out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, f"{fields}, score double")
