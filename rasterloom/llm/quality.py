"""Document quality by a linear-chain conditional random field over lines.

Each line is good (1) or bad (0). The score of a labelling is the sum of, for each line, weights times features
of the line and its two neighbours, and, for each pair of neighbouring lines, a weight for their two labels.
Training maximises the conditional likelihood of labelled documents, whose lines all carry the document's label.
A document's score is the mean over lines, weighted by length, of the forward-backward marginal of good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import PrefixHash, binary_parts, mix64, narrow, read, saved
from rasterloom.llm.hyperminhash import slices

#: The model is fitted on at most so many labelled documents, those with the least hash of their id,
SAMPLE_DOCUMENTS = 6_000
#: and, among them, on those of at most so many bytes, so that the driver holds a bounded matrix.
SAMPLE_BYTES = 20_000
#: Scores from here on are predicted good.
CUT = 0.3
_LUT = np.zeros(256, np.int8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence marks, 6 odd marks, 7 letter beyond ASCII (lead), 8 its next byte
_LUT[97:123], _LUT[65:91], _LUT[48:58] = 1, 2, 3
_LUT[[32, 9, 11, 12, 13, 10]] = 4
_LUT[[ord(c) for c in ".,;:'\"-()?"]] = 5
_LUT[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_LUT[192:] = 7
_LUT[128:192] = 8
#: Features of one line; the same of the line before and after, and a constant, follow.
FEATURES = ["log_length", "upper", "digits", "marks", "odd", "same_next", "repeats", "word_length", "long_words", "caps_words", "odd_ends", "one_word"]
WIDE = 3 * len(FEATURES) + 1


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, length in bytes and features of each line that isn't blank, for texts end to end in data."""
    n = len(data)
    kind = _LUT[data]
    # Lines and words end at line ends, spaces and text ends.
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    solid = kind != 4
    first = solid & (np.concatenate([[True], ~solid[:-1]]) | cut[:-1])
    last = solid & (np.concatenate([~solid[1:], [True]]) | cut[1:])
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(ws):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(FEATURES)))
    breaks = np.cumsum(data == 10)
    doc = np.searchsorted(at, ws, "right") - 1
    line = breaks[ws]
    new = np.ones(len(ws), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    words = np.diff(np.append(starts, len(ws))).astype(np.float64)
    lo, hi = ws[starts], we[np.append(starts[1:], len(ws)) - 1]
    length = (hi - lo).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(mask)])
        return s[hi] - s[lo]

    upper = share((kind == 2) | ((data >= 0x80) & (data <= 0x9E) & (np.concatenate([[0], data[:-1]]) == 0xC3)))
    letters = np.maximum(1, share((kind == 1) | (kind == 2) | (kind == 7)))
    chars = np.maximum(1, length - share(kind == 8))
    h = mix64(PrefixHash(data).of(ws, we))
    n_of = np.repeat(np.arange(len(starts)), words.astype(np.int64))
    same = np.concatenate([(h[1:] == h[:-1]) & ~new[1:], [False]])
    order = np.lexsort((h, n_of))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (n_of[order][1:] != n_of[order][:-1])
    distinct = np.bincount(n_of[order][fresh], minlength=len(starts))
    size = we - ws
    by = lambda x: np.add.reduceat(x.astype(np.float64), starts)
    ups = np.concatenate([[0], np.cumsum(kind == 2)])
    small = np.concatenate([[0], np.cumsum(kind == 1)])
    caps = (ups[we] - ups[ws] > 0) & (small[we] - small[ws] == 0) & (size > 1)
    odd_end = kind[we - 1] == 6
    x = np.stack(
        [
            np.log1p(chars) / 5,
            upper / letters,
            share(kind == 3) / chars,
            share(kind == 5) / chars * 5,
            share(kind == 6) / chars * 5,
            by(same) / words,
            (1 - distinct / words) * np.minimum(1, words / 20),
            np.minimum(by(size) / words / 10, 3),
            by(size > 25) / words,
            by(caps) / words,
            by(odd_end) / words,
            (words == 1).astype(np.float64),
        ],
        axis=1,
    )
    return doc[starts], length, x


def with_neighbours(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Features of each line, of the lines before and after it in its text (zeros if there is none), and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    inner = (doc[1:] == doc[:-1])[:, None]
    before[1:], after[:-1] = x[:-1] * inner, x[1:] * inner
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def marginals(doc: np.ndarray, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: P(line good), and P(labels of a line and the next one in its text), 4 x pairs.

    emit: score of good less score of bad of each line; trans: 2 x 2 scores of neighbouring labels.
    """
    n = len(doc)
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(start, n))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    score = np.stack([np.zeros(n), emit], axis=1)
    f[start] = score[start]
    for t in range(1, int(size[0]) if n else 0):
        k = start[: np.searchsorted(-size, -t, "left")] + t  # texts with more than t lines
        p = f[k - 1]
        f[k] = np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1]) + score[k]
    for t in range(1, int(size[0]) if n else 0):
        k = np.searchsorted(-size, -t, "left")
        k = start[:k] + size[:k] - 1 - t
        q = b[k + 1] + score[k + 1]
        b[k] = np.logaddexp(trans[:, 0] + q[:, :1], trans[:, 1] + q[:, 1:])
    z = np.logaddexp(f[:, 0] + b[:, 0], f[:, 1] + b[:, 1])
    k = np.flatnonzero(doc[1:] == doc[:-1])
    after = score[k + 1] + b[k + 1] - z[k][:, None]
    pair = np.stack([np.exp(f[k, i] + trans[i, j] + after[:, j]) for i in (0, 1) for j in (0, 1)])
    return np.exp(f[:, 1] + b[:, 1] - z), pair


def fit(doc: np.ndarray, x: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of greatest conditional likelihood (by Adam, from zero), each document with its weight.

    Scores are scaled by the text's number of lines, as documents and not lines are labelled.
    """
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    theta = np.zeros(len(w) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    lines = np.bincount(doc)[doc]
    share = weight[doc] / lines
    share /= share.sum()
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    y = label[doc].astype(np.float64)
    seen = np.zeros((4, len(inner)))
    seen[label[doc][inner] * 3, np.arange(len(inner))] = 1  # both labels of a pair are the document's
    for step in range(1, steps + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        emit = x @ w
        p, pair = marginals(doc, emit, trans)
        g = np.concatenate([x.T @ ((p - y) * share), ((pair - seen) * share[inner]).sum(axis=1)])
        g += ridge * theta + np.concatenate([np.zeros(len(w)), 0.05 * theta[-4:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def scores(data: np.ndarray, at: np.ndarray, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """Score of each text; one without lines gets the model's share of good documents."""
    weights, trans, prior = model
    doc, length, x = line_features(data, at)
    p, _ = marginals(doc, with_neighbours(doc, x) @ weights, trans)
    total = np.bincount(doc, length, minlength=len(at) - 1)
    good = np.bincount(doc, length * p, minlength=len(at) - 1)
    return np.where(total > 0, np.clip(good / np.maximum(total, 1), 0, 1), prior)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = binary_parts(batch.column(1))
        doc, length, x = line_features(data, at)
        end = np.cumsum(np.bincount(doc, minlength=batch.num_rows))
        rows = [x[i:j].astype(np.float32).tobytes() for i, j in zip([0, *end[:-1]], end, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "label", "lines"])


def sample(docs: DataFrame, labels: DataFrame, label: str, documents: int) -> list:
    """(doc_id, label, lines) of at most `documents` labelled documents of at most SAMPLE_BYTES bytes; of an id's rows, one of the least text hash."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).select("doc_id", F.col("label").cast("int").alias("label"))
    d = docs.select("doc_id", F.encode("text", "utf-8").alias("bytes")).where(F.length("bytes") <= SAMPLE_BYTES)
    d = d.join(narrow(saved(known, "labelled")), "doc_id")
    d = d.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("bytes").alias("h"), "bytes")).alias("least")).select("doc_id", "least.bytes", "label")
    return sorted(d.mapInArrow(_features, "doc_id long, label int, lines binary").collect(), key=lambda r: r.doc_id)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", documents: int = SAMPLE_DOCUMENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits the model on a bounded sample: at most `documents` labelled documents of at most SAMPLE_BYTES bytes.

    Labels: ids whose crc32 as text isn't a multiple of 5; null labels and ids with two different ones are left
    out. Without any usable label the model scores each document 0.5.
    """
    rows = [r for r in sample(docs, labels, label, documents) if len(r.lines)]
    good = np.array([r.label for r in rows], np.int64)
    if not len(rows):
        return np.zeros(WIDE), np.zeros((2, 2)), 0.5
    x = [np.frombuffer(r.lines, np.float32).reshape(-1, len(FEATURES)).astype(np.float64) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(a) for a in x])
    weights, trans = fit(doc, with_neighbours(doc, np.concatenate(x)), good, np.ones(len(rows)))
    return weights, trans, float(good.mean())


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs (all its columns, of which text is read) with a column score: 0 to 1, higher for better text.

    A null, empty or blank text scores as the share of good documents in the sample. Equal texts have equal
    scores, so repeated rows have the same one. Very long texts are read whole, in one task with a pass over all its
    lines. An empty table gives no rows, and a column of the name score is replaced.
    """
    rest = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = binary_parts(batch.column("__bytes"))
            found = [scores(data[at[i] : at[j]], at[i : j + 1] - at[i], model) for i, j in slices(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.concatenate([np.zeros(0), *found]))], names=[*rest, "score"])

    schema = docs.select(*rest).schema.add("score", "double")
    return docs.select(*rest, F.encode("text", "utf-8").alias("__bytes")).mapInArrow(run, schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: whether it is held out of training, its score, and the prediction at 0.3."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
