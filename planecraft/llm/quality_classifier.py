"""Quality classifier: co-training of a text view and a page-metadata view.

Two logistic models see different sides of a document: hashed byte trigrams and
character classes of the text, and the page's metadata alone (source, language,
stated length). Both are first fitted on a bounded sample of labelled documents.
In every round each view scores all documents outside that sample, in one pass of
the table; those it is sure of become pseudo-labelled examples of the other view.
A task hands on only their sums: for each view, label and cell (a hash of source and
language, so that rare kinds count too) the number of documents and the sum of their
features. The views are then refitted on the labelled documents and the cells' means,
weighted by the cells' documents; both kinds have half of a class's weight, however
many documents there are. Each view is calibrated (Platt) on labelled documents held
out of the fit, and the calibrated views are combined by a logistic model over their
log odds, fitted on the same held-out documents. All documents are scored by one pass.

Defined results: null text counts as empty, null metadata is a value of its own,
a null label is no label, and a doc_id with labels that contradict one another has
none. Of a labelled doc_id that repeats, one row is learnt from: the least by its
features. Without labels of both classes every score is 0.5 and all documents are
kept. Repeated rows get equal scores; an empty table gives an empty result. `keep`
returns the input's own columns whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planecraft.llm.jobs import by_hash, prepare, stored
from planecraft.llm.text_arrays import spans, text_bytes

SCORED = "doc_id long, text_score double, meta_score double, score double, kept boolean"
TRIGRAM_BITS = 10
CLASS_FEATURES = 8
META_DIMS = 128


@dataclass(frozen=True)
class CoTraining:
    """Bounds and rates of the fit: labelled documents (at most, by the hash of doc_id), passes over all others, and the probability from which a view is sure."""

    labelled: int = 4000
    rounds: int = 3
    sure: float = 0.97
    cells: int = 16
    steps: int = 150
    threshold: float = 0.5


def text_view(column: pa.Array) -> np.ndarray:
    """Per text: square-rooted, normalised counts of hashed byte trigrams, and the shares of character classes."""
    data, bounds = text_bytes(column)
    out = np.zeros((len(bounds) - 1, (1 << TRIGRAM_BITS) + CLASS_FEATURES), np.float32)
    groups = np.zeros(256, np.uint8)
    for i, chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\n\r", b".,;:'\"()-?", b"!", b"#*$%&|<>")):
        groups[list(chars)] = i + 1
    for a, b in spans(bounds):
        part = data[bounds[a] : bounds[b]]
        x = part.astype(np.uint32)
        codes = ((x[:-2] + x[1:-1] * 331 + x[2:] * 109_561) * np.uint32(2_654_435_761)) >> np.uint32(32 - TRIGRAM_BITS) if len(x) > 2 else x[:0]
        kinds = groups[part]
        for i in range(a, b):
            s, e = bounds[i] - bounds[a], bounds[i + 1] - bounds[a]
            if e - s > 2:
                row = np.sqrt(np.bincount(codes[s : e - 2], minlength=1 << TRIGRAM_BITS))
                out[i, : 1 << TRIGRAM_BITS] = row / np.sqrt((row * row).sum()) * 4
            if e > s:
                out[i, 1 << TRIGRAM_BITS :] = np.bincount(kinds[s:e], minlength=CLASS_FEATURES) / (e - s) * 4
    return out


def meta_view(batch: pa.RecordBatch) -> np.ndarray:
    """Per document: hashed source, language and class of the stated length, and that length; nothing of the text."""
    stated = np.array([-1.0 if v is None else float(v) for v in batch.column("n_chars").to_pylist()])
    out = np.zeros((len(stated), META_DIMS), np.float32)
    rows = np.arange(len(stated))
    names = {name: batch.column(name).to_pylist() for name in ("source", "lang")}
    names["length"] = [int(max(v, -1)).bit_length() if v >= 0 else None for v in stated]
    for name, values in names.items():
        at = np.array([zlib.crc32(f"{name}={v}".encode()) % (META_DIMS - 8) for v in values], np.int64)
        out[rows, at] += 1
    out[:, -8] = stated < 0
    out[:, -7] = np.log1p(np.maximum(stated, 0)) / 8
    out[:, -4] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int, l2: float = 1e-3, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (bias last) by full-batch gradient descent with Nesterov momentum; classes weigh the same."""
    x1 = np.concatenate((x, np.ones((len(x), 1))), 1, dtype=np.float32)
    weight = np.ones(len(y)) if weight is None else weight
    weight = np.where(y > 0, 0.5 / max(1e-9, weight[y > 0].sum()), 0.5 / max(1e-9, weight[y <= 0].sum())).astype(np.float32) * weight.astype(np.float32)
    y = y.astype(np.float32)
    step = 4 / max(1e-9, float((weight @ (x1 * x1)).sum()))
    w = v = np.zeros(x1.shape[1], np.float32)
    for i in range(steps):
        grad = x1.T @ (weight * (sigmoid(x1 @ v) - y)) + np.float32(l2) * np.append(v[:-1], np.float32(0))
        new = v - np.float32(step) * grad
        v = new + np.float32(i / (i + 3)) * (new - w)
        w = new
    return w


def linear(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass(frozen=True)
class Model:
    """Both views' weights, their calibrations (slope, bias) and the combining weights."""

    views: tuple[np.ndarray, np.ndarray]
    calibration: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray
    threshold: float

    def log_odds(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.stack([linear(c, linear(w, x)[:, None]) for w, c, x in zip(self.views, self.calibration, views)], 1)


def platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and bias that turn scores into calibrated log odds (Newton's method, targets smoothed)."""
    x = np.stack((z, np.ones_like(z)), 1)
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ w)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * w)
        w = np.clip(w, -50, 50)
    return w


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(batch.column("text")), meta_view(batch)


Cells = dict[tuple[int, int, int], tuple[int, np.ndarray]]


def sure_sums(batch: pa.RecordBatch, model: Model, how: CoTraining) -> Cells:
    """(view, label, cell): number and feature sum of the documents whose label the other view is sure of."""
    views, found = _views(batch), {}
    cell = np.array([zlib.crc32(f"{s}/{v}".encode()) % how.cells for s, v in zip(batch.column("source").to_pylist(), batch.column("lang").to_pylist())], np.int64)
    good = sigmoid(model.log_odds(views))
    for giver, taker in ((0, 1), (1, 0)):
        for label, p in ((1, good[:, giver]), (0, 1 - good[:, giver])):
            at = np.flatnonzero(p >= how.sure)
            for c in np.unique(cell[at]).tolist():
                own = at[cell[at] == c]
                found[taker, label, c] = (len(own), views[taker][own].sum(0, dtype=np.float64))
    return found


def exchanged(others: DataFrame, model: Model, how: CoTraining) -> Cells:
    """The sums over all documents; added in two steps, so that no task gets more than the square root of all tasks' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Cells = {}
        for batch in batches:
            if batch.num_rows:
                for key, (n, x) in sure_sums(batch, model, how).items():
                    m, y = total.get(key, (0, 0.0))
                    total[key] = (m + n, y + x)
        part = TaskContext.get().partitionId() % 1024
        rows = [(*key, part, n, x.tobytes()) for key, (n, x) in total.items()]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("view", "label", "cell", "part", "n", "total"), map(list, zip(*rows)))), schema=pa.schema([(c, pa.int32()) for c in ("view", "label", "cell", "part")] + [("n", pa.int64()), ("total", pa.binary())]))

    def add(pdf):
        total = sum(np.frombuffer(x) for x in pdf["total"])
        return pdf.head(1).assign(n=pdf["n"].sum(), total=[total.tobytes()])

    schema = "view int, label int, cell int, part int, n long, total binary"
    sums = others.mapInArrow(run, schema).groupBy("view", "label", "cell", "part").applyInPandas(add, schema).groupBy("view", "label", "cell").applyInPandas(add, schema)
    return {(r["view"], r["label"], r["cell"]): (r["n"], np.frombuffer(bytes(r["total"]))) for r in sums.collect()}  # 4 x cells rows at most


def refitted(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, sums: Cells, how: CoTraining) -> Model | None:
    """A model of labelled documents and of the cells' means. A third of the labelled is held out for calibration and combination."""
    held = np.arange(len(y)) % 3 == 2
    if min((y[held] > 0).sum(), (y[held] <= 0).sum(), (y[~held] > 0).sum(), (y[~held] <= 0).sum()) < 2:
        return None
    fitted = []
    for i, x in enumerate(views):
        rows, target, weight = [x[~held]], [y[~held].astype(float)], [np.ones((~held).sum())]
        for label in (0, 1):
            own = [(n, total) for (view, given, _), (n, total) in sorted(sums.items()) if (view, given) == (i, label)]
            if own:
                n = np.array([n for n, _ in own], float)
                rows.append(np.stack([total / m for m, total in own]).astype(np.float32))
                target.append(np.full(len(own), float(label)))
                weight.append(n / n.sum() * (y[~held] == label).sum())
        fitted.append(logistic(np.concatenate(rows), np.concatenate(target), how.steps, weight=np.concatenate(weight)))
    calibration = tuple(platt(linear(w, x[held]), y[held]) for w, x in zip(fitted, views))
    model = Model(tuple(fitted), calibration, np.zeros(3), how.threshold)
    combined = logistic(model.log_odds(tuple(x[held] for x in views)).astype(float), y[held].astype(float), 500, 1e-4)
    return Model(model.views, model.calibration, combined, how.threshold)


def chosen_labels(labels: DataFrame, how: CoTraining) -> DataFrame:
    """(doc_id, _label) of at most `labelled` doc_ids whose labels agree."""
    agreed = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_label"), F.max("quality").alias("most"))
    return agreed.where("_label = most").select("doc_id", (F.col("_label") > 0).cast("int").alias("_label")).orderBy(*by_hash("doc_id")).limit(how.labelled)


def fit(docs: DataFrame, labels: DataFrame, how: CoTraining = CoTraining()) -> Model | None:
    """Fit on the labelled documents with the smallest hashes of doc_id, then exchange over all others."""
    prepare(docs.sparkSession)
    chosen = stored(chosen_labels(labels, how), "chosen")
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, meta = _views(batch)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "label": batch.column("_label"), "text": [x.tobytes() for x in text.astype(np.float16)], "meta": [x.tobytes() for x in meta.astype(np.float16)]})

    learnt = rows.join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, label int, text binary, meta binary")
    learnt = learnt.groupBy("doc_id", "label").agg(F.min(F.struct("text", "meta")).alias("x")).select("doc_id", "label", "x.*").toArrow().sort_by("doc_id")  # a row of each chosen doc_id
    y = learnt["label"].to_numpy()

    def matrix(name: str) -> np.ndarray:
        width = META_DIMS if name == "meta" else (1 << TRIGRAM_BITS) + CLASS_FEATURES
        return np.frombuffer(b"".join(learnt[name].to_pylist()), np.float16).reshape(-1, width).astype(np.float32)

    views = (matrix("text"), matrix("meta"))
    model = refitted(views, y, {}, how)
    others = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    before: dict = {}
    for _ in range(how.rounds if model is not None else 0):
        sums = exchanged(others, model, how)
        if (now := {key: n for key, (n, _) in sums.items()}) == before:
            break  # the same documents as a round ago
        model, before = refitted(views, y, sums, how), now
    return model


def judge(batch: pa.RecordBatch, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if model is None:
        half = np.full(batch.num_rows, 0.5)
        return half, half, half, np.ones(batch.num_rows, bool)
    odds = model.log_odds(_views(batch))
    score = sigmoid(linear(model.combined, odds))
    return sigmoid(odds[:, 0]), sigmoid(odds[:, 1]), score, score >= model.threshold


def assess(docs: DataFrame, labels: DataFrame, how: CoTraining = CoTraining()) -> DataFrame:
    """Both calibrated views' scores, the combined score and the verdict of every document."""
    model = fit(docs, labels, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, meta, score, kept = judge(batch, model)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "text_score": text, "meta_score": meta, "score": score, "kept": kept})

    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, SCORED)


def keep(docs: DataFrame, labels: DataFrame, how: CoTraining = CoTraining()) -> DataFrame:
    """The documents scored at the threshold or above, with all their columns."""
    model = fit(docs, labels, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judge(batch, model)[3], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
