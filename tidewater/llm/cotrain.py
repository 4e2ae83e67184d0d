"""Quality classifier by co-training (operator 9).

Two views of a document are kept apart. The text view sees what is written: the
shapes of character trigrams (letters, capitals, digits and the punctuation
between them), how far words repeat, line layout and how far the text compresses.
The metadata view sees the columns beside the text only: source, language and
``n_chars``. Each view is a logistic regression on a bounded sample of labelled
rows. In every round each view scores all unlabelled documents and hands those it
is surest of, with a calibrated probability of at least ``sure``, to the other, at most ``per_round`` of them, as
many of each class as the prior gives; a view that cannot tell the classes apart is
never sure and teaches nothing. Both views are calibrated on labelled rows kept
apart, and the calibrated logits are added, less the prior that both
contain, to score all documents.

``max_labelled`` bounds the labelled sample, chosen by a hash of the id; pseudo
labels are drawn from all documents, and every document is scored whole, very
long ones too. Rows whose label is null are no labels; a document with several
labels counts with the mean, 0.5 or more being 1. Null texts are empty, and an
empty text scores by its metadata alone. Null sources and languages are
categories of their own; a null or missing ``n_chars`` is its own case. With
labels of one class or none the score is that class or 0.5. Ties in confidence go
by a hash of the id. Repeated rows give their result again; rows without an id
are scored but lend no pseudo-label; an empty table gives an empty table; other
columns are ignored. ``kept`` is score >= ``threshold``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, materialize, slices, table, text_buffers
from tidewater.llm.words import word_codes

BUCKETS, SOURCES, LANGS = 512, 64, 32
TEXT_DIM, META_DIM = BUCKETS + 11, SOURCES + LANGS + 2


def shape_table() -> np.ndarray:
    """Shape of a byte: letters of one case are one, digits are one, other ASCII stays itself."""
    lut = np.arange(256, dtype=np.uint32)
    lut[97:123], lut[65:91], lut[48:58], lut[128:] = 97, 65, 48, 97
    return lut


def _hash(text: str | None, buckets: int) -> int:
    return zlib.crc32(("\0" if text is None else text).encode()) % buckets


def trigram_buckets(raw: np.ndarray) -> np.ndarray:
    s = shape_table()[raw]
    code = np.zeros(len(raw), np.uint32)
    code[2:] = (s[:-2] << 16) | (s[1:-1] << 8) | s[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(23)).astype(np.int32)


def text_extras(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Share of distinct words, share of the commonest word, log words."""
    rows = len(offs) - 1
    words, row = word_codes(raw, offs)
    out = np.zeros((rows, 3))
    if not len(words):
        return out
    order = np.lexsort((words, row))
    w, r = words[order], row[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(w)))
    total = np.bincount(row, minlength=rows)
    distinct = np.bincount(r[new], minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, r[new], runs)
    some = np.maximum(total, 1)
    # shares are taken against what a text of that length can reach: repetition shows at any length
    out[:, 0] = np.log1p(total) - np.log1p(distinct)
    out[:, 1] = top / some
    out[:, 2] = np.log1p(total) / 10
    return out


def layout(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Length, lines, kinds of characters and compression of each text."""
    rows, lens = len(offs) - 1, np.diff(offs).astype(np.float64)
    out = np.zeros((rows, 8))
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs]) if len(raw) else np.zeros(rows)
    some = np.maximum(lens, 1)
    lines = sums(raw == 10) + 1
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(lens) / 10, np.log(lines) / 10, np.log1p(lens / lines) / 10
    upper, digit, space = sums((raw >= 65) & (raw <= 90)), sums((raw >= 48) & (raw <= 57)), sums((raw == 32) | (raw == 10))
    lower = sums(((raw >= 97) & (raw <= 122)) | (raw >= 128))
    out[:, 3], out[:, 4], out[:, 5], out[:, 6] = upper / some, digit / some, space / some, (lens - upper - digit - space - lower) / some
    for i in range(rows):
        part = raw[offs[i] : offs[i + 1]]
        out[i, 7] = np.log((len(zlib.compress(part, 1)) + 1) / (len(part) + 1)) if len(part) else 0.0
    return out


@dataclass
class View:
    """A logistic regression with standardised features and a calibration of its logit."""

    weight: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return self.scale * logit + self.shift


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_view(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> View:
    """Newton's method with an L2 penalty in standardised space; folded back to raw features."""
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 1e-9, std, np.inf)
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ w)
        g = z.T @ (p - y) + ridge * w
        s = np.maximum(p * (1 - p), 1e-4)
        if z.shape[1] > len(x):  # fewer rows than features: solve in the space of rows
            zr = z / ridge
            step = g / ridge - zr.T @ np.linalg.solve(z @ zr.T + np.diag(1 / s), z @ (g / ridge))
        else:
            step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(ridge), g)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    weight = w[:-1] / std
    return View(weight, float(w[-1] - weight @ mean))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling with smoothed targets."""
    logit = view.logit(x)[:, None]
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = logit.std() or 1.0
    fitted = fit_view(logit / spread, target, l2=0.1)
    view.scale, view.shift = float(fitted.weight[0] / spread), fitted.bias


@dataclass
class Model:
    text: View | None
    meta: View | None
    prior: float
    rounds: list


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pick, rounds: int, per_round: int) -> Model:
    """xt, xm, y: both views of the labelled rows.

    ``pick(views, most)`` gives for each teaching view the documents it is surest
    of, ``most[class]`` of a class at most: (text features, metadata features, labels).
    """
    if len(y) < 10 or y.min() == y.max():
        p = 0.5 if not len(y) else float(y.mean())
        return Model(None, None, float(np.clip(p, 1e-3, 1 - 1e-3)) if len(y) else 0.5, [])
    held = np.arange(len(y)) % 5 == 4
    label = y[~held].astype(float)
    sets = {"text": (xt[~held], label), "meta": (xm[~held], label)}
    most = {1: max(1, int(per_round * label.mean())), 0: max(1, int(per_round * (1 - label.mean())))}
    log = []
    for _ in range(rounds):
        views = {k: fit_view(*v) for k, v in sets.items()}
        for k, x in (("text", xt), ("meta", xm)):
            calibrate(views[k], x[held], y[held])
        taught = pick(views, most)
        for teacher, pupil, own in (("text", "meta", 1), ("meta", "text", 0)):
            given = taught[teacher]
            sets[pupil] = (np.vstack([sets[pupil][0], given[own]]), np.concatenate([sets[pupil][1], given[2]]))
        log.append({k: len(v[2]) for k, v in taught.items()})
        if not any(log[-1].values()):
            break
    text, meta = fit_view(*sets["text"]), fit_view(*sets["meta"])
    calibrate(text, xt[held], y[held])
    calibrate(meta, xm[held], y[held])
    return Model(text, meta, float(y.mean()), log)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), chars.alias("chars"))


def meta_features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the source, bucket of the language, and log n_chars with a mark where it is missing."""
    chars = np.array([-1.0 if v is None or not v >= 0 else v for v in batch.column("chars").to_pylist()])
    return (
        np.array([_hash(v, SOURCES) for v in batch.column("source").to_pylist()], np.int64),
        np.array([_hash(v, LANGS) for v in batch.column("lang").to_pylist()], np.int64),
        np.stack([np.log1p(np.maximum(chars, 0)) / 10, (chars < 0).astype(float)], 1),
    )


def _rows_of(batch: pa.RecordBatch, rows: np.ndarray, raw: np.ndarray, offs: np.ndarray, buckets: np.ndarray, text_rest: np.ndarray, meta: tuple) -> tuple[list[bytes], list[bytes]]:
    """float32 feature bytes of some rows in both views."""
    xt, xm = [], []
    for i in rows.tolist():
        share = np.bincount(buckets[offs[i] : offs[i + 1]], minlength=BUCKETS) / max(1, offs[i + 1] - offs[i])
        xt.append(np.concatenate([share, text_rest[i]]).astype(np.float32).tobytes())
        cats = np.zeros(SOURCES + LANGS)
        cats[meta[0][i]] = cats[SOURCES + meta[1][i]] = 1
        xm.append(np.concatenate([cats, meta[2][i]]).astype(np.float32).tobytes())
    return xt, xm


def text_numbers(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.hstack([text_extras(raw, offs), layout(raw, offs)])


def _features(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, source, lang, chars, y) as float32 feature bytes of both views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                raw, offs = text_buffers(batch.column("text"))
                xt, xm = _rows_of(batch, np.arange(batch.num_rows), raw, offs, trigram_buckets(raw), text_numbers(raw, offs), meta_features(batch))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "xt": pa.array(xt, pa.binary()), "xm": pa.array(xm, pa.binary())})

    return rows.mapInArrow(run, "doc_id long, y int, xt binary, xm binary")


def _logits(text: View, meta: View, raw: np.ndarray, offs: np.ndarray, buckets: np.ndarray, text_rest: np.ndarray, features: tuple) -> tuple[np.ndarray, np.ndarray]:
    lens = np.maximum(np.diff(offs), 1)
    sums = np.diff(np.concatenate([[0.0], np.cumsum(text.weight[:BUCKETS][buckets])])[offs]) if len(raw) else np.zeros(len(lens))
    w = meta.weight
    return sums / lens + text_rest @ text.weight[BUCKETS:] + text.bias, w[features[0]] + w[SOURCES + features[1]] + features[2] @ w[SOURCES + LANGS :] + meta.bias


def surest(docs: DataFrame, views: dict[str, View], most: dict[int, int], sure: float, taken: set[int]) -> dict[str, list]:
    """For each view the rows (xt, xm, class, id) of all documents that it is surest of; each task passes on its own surest only."""
    shared = docs.sparkSession.sparkContext.broadcast((views, frozenset(taken)))  # weights, and ids taken in earlier rounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, taken = shared.value
        best: dict[tuple, list] = {(v, c): [] for v in ("text", "meta") for c in (0, 1)}
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                raw, offs = text_buffers(batch.column("text"))
                buckets, rest, features = trigram_buckets(raw), text_numbers(raw, offs), meta_features(batch)
                ids, mark = np.asarray(batch.column("doc_id")), np.asarray(batch.column("mark"))
                free = np.array([i not in taken for i in ids.tolist()], bool)
                for view, logit in zip(("text", "meta"), _logits(views["text"], views["meta"], raw, offs, buckets, rest, features)):
                    p = sigmoid(views[view].calibrated(logit))
                    for cls in (0, 1):
                        trust = p if cls else 1 - p
                        rows = np.flatnonzero(free & (trust >= sure))
                        held = best[view, cls]
                        if len(held) >= most[cls]:
                            rows = rows[trust[rows] >= held[-1][0]]
                        if len(rows) > most[cls]:
                            rows = rows[np.lexsort((ids[rows], mark[rows], -trust[rows]))[: most[cls]]]
                        if len(rows):
                            xt, xm = _rows_of(batch, rows, raw, offs, buckets, rest, features)
                            held.extend(zip(trust[rows].tolist(), mark[rows].tolist(), ids[rows].tolist(), xt, xm))
                            held.sort(key=lambda x: (-x[0], x[1], x[2]))
                            del held[most[cls] :]
        for (view, cls), held in best.items():
            if held:
                trust, mark, ids, xt, xm = zip(*held)
                yield pa.RecordBatch.from_pydict({
                    "view": pa.array([view] * len(held)), "cls": pa.array([cls] * len(held), pa.int32()), "trust": pa.array(trust, pa.float64()), "mark": pa.array(mark, pa.int64()),
                    "doc_id": pa.array(ids, pa.int64()), "xt": pa.array(xt, pa.binary()), "xm": pa.array(xm, pa.binary()),
                })

    marked = docs.where("doc_id is not null").withColumn("mark", F.xxhash64("doc_id", F.lit(2)))
    found = materialize(marked.mapInArrow(run, "view string, cls int, trust double, mark long, doc_id long, xt binary, xm binary"), "surest")
    out: dict[str, list] = {"text": [], "meta": []}
    for view in out:
        for cls in (1, 0):
            top = found.where((F.col("view") == view) & (F.col("cls") == cls)).orderBy(F.desc("trust"), "mark", "doc_id").limit(most[cls])
            out[view] += [(r["xt"], r["xm"], cls, r["doc_id"]) for r in top.collect()]  # at most per_round rows
    return out


def train(docs: DataFrame, labels: DataFrame, max_labelled: int, rounds: int, per_round: int, sure: float) -> Model:
    """docs: (doc_id, text, source, lang, chars). Labelled ids are chosen by hash; the bounded choice is broadcast."""
    million = 1_000_000
    part = F.pmod(F.xxhash64("doc_id"), F.lit(million))
    labels = labels.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    share = min(million, max_labelled * million // max(1, labels.count()))
    chosen = labels.where(part < share).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    got = _features(docs.join(F.broadcast(chosen), "doc_id")).collect()  # chosen holds about max_labelled rows, features have a fixed size
    got.sort(key=lambda r: (r["doc_id"], bytes(r["xt"])))
    matrix = lambda rows, k, dim: np.array([np.frombuffer(r[k], np.float32) for r in rows], float).reshape(len(rows), dim)
    free = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    taken: set[int] = set()

    def pick(views: dict[str, View], most: dict[int, int]) -> dict[str, tuple]:
        found = surest(free, views, most, sure, taken)
        for rows in found.values():
            taken.update(r[3] for r in rows)
        return {view: (matrix(rows, 0, TEXT_DIM), matrix(rows, 1, META_DIM), np.array([r[2] for r in rows], float)) for view, rows in found.items()}

    return co_train(matrix(got, "xt", TEXT_DIM), matrix(got, "xm", META_DIM), np.array([r["y"] for r in got], np.int64), pick, rounds, per_round)


def score(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                n = batch.num_rows
                if model.text is None:
                    p = a = b = np.full(n, model.prior)
                else:
                    raw, offs = text_buffers(batch.column("text"))
                    lt, lm = _logits(model.text, model.meta, raw, offs, trigram_buckets(raw), text_numbers(raw, offs), meta_features(batch))
                    ct, cm = model.text.calibrated(lt), model.meta.calibrated(lm)
                    prior = np.log(model.prior / (1 - model.prior))
                    both = np.where(np.diff(offs) > 0, ct + cm - prior, cm)
                    p, a, b = sigmoid(both), sigmoid(ct), sigmoid(cm)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": p, "text_score": a, "meta_score": b, "kept": p >= threshold})

    return docs.mapInArrow(run, "doc_id long, score double, text_score double, meta_score double, kept boolean")


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = 2500, rounds: int = 2, per_round: int = 200, sure: float = 0.95, threshold: float = 0.5,
) -> DataFrame:
    """doc_id, score, text_score, meta_score, kept of every row of docs."""
    bounded_batches(docs.sparkSession)
    rows = _columns(docs, id_col, text_col)
    model = train(rows, labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("y")), max_labelled, rounds, per_round, sure)
    return score(rows, model, threshold)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose crc32(doc_id as text) modulo 3 is 1 are never trained on."""
    held_out = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(3)) == 1
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = classify_quality(docs, labels.where(~held_out("doc_id")))
    return found.withColumn("held_out", held_out("doc_id"))
