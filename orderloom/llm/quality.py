"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes get learned vectors. Learned filters of ``3 * REACH`` bytes slide over the text in
steps of three bytes; their largest responses within each chunk of 384 bytes (chunks overlap by half
and cover the whole text) describe the chunk. Means, least and largest values over all chunks are
combined into one probability.

Training takes a bounded sample of labelled rows and runs in one task; only the weights, some 30 kB,
come back. Scoring reads every text in whole where it lies, block by block, without any shuffle.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import fold, release, slices

STEP, REACH, DEPTH, FILTERS = 3, 3, 8, 48
SEGMENT = 64  # filter positions of half a chunk, 192 bytes
SPAN = STEP * SEGMENT
BLOCK = 2048  # segments computed at once
_AFTER = STEP * (REACH - 1)  # bytes that a filter reads past its own step

Weights = dict[str, np.ndarray]


def start(rng: np.random.Generator) -> Weights:
    scale = (STEP * REACH * DEPTH) ** -0.5
    return {
        "bytes": rng.normal(0, 1, (256, DEPTH)).astype(np.float32),
        "filters": rng.normal(0, scale, (REACH, STEP * DEPTH, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32),
        "level": np.array([1.0], np.float32),
    }


def padded(text: np.ndarray) -> np.ndarray:
    """Bytes filled up with zeros to whole segments, with room for a filter to run out."""
    n = -(-(len(text) + _AFTER) // SPAN) * SPAN
    return np.concatenate([text, np.zeros(n - len(text), np.uint8)])


def responses(w: Weights, data: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Filter responses (segment, position, filter) of whole segments; follow: the bytes after them.

    Each segment is a product of its own: products of other shapes, and other places in them, may round
    differently, and a text's score would depend on the texts beside it.
    """
    rows = w["bytes"][np.concatenate([data, follow])].reshape(-1, STEP * DEPTH)
    n = len(data) // STEP
    out = np.matmul(rows[:n].reshape(-1, SEGMENT, STEP * DEPTH), w["filters"][0])
    for k in range(1, REACH):
        out += np.matmul(rows[k : n + k].reshape(-1, SEGMENT, STEP * DEPTH), w["filters"][k])
    return out


def segment_maxima(w: Weights, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each segment of padded texts of so many segments."""
    out = []
    final = np.zeros(len(data) // SPAN, bool)
    final[np.cumsum(counts) - 1] = True
    for low in range(0, len(data), BLOCK * SPAN):
        high = min(len(data), low + BLOCK * SPAN)
        follow = data[high : high + _AFTER]
        follow = np.concatenate([follow, np.zeros(_AFTER - len(follow), np.uint8)])
        found = responses(w, data[low:high], follow)
        found[final[low // SPAN : high // SPAN], 1 - REACH :] = -np.inf  # these would see the next text
        out.append(found.max(axis=1))
    return np.concatenate(out)


def chunks_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second segment of every chunk, and where each text's chunks start."""
    chunks = np.maximum(counts - 1, 1)
    starts = np.cumsum(chunks) - chunks
    first = np.arange(chunks.sum()) - np.repeat(starts, chunks) + np.repeat(np.cumsum(counts) - counts, chunks)
    return first, first + np.repeat(counts > 1, chunks), starts


def pooled(chunks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean, least and largest of the chunks of each text."""
    n = np.diff(np.append(starts, len(chunks)))[:, None]
    return np.concatenate(
        [np.add.reduceat(chunks, starts) / n, np.minimum.reduceat(chunks, starts), np.maximum.reduceat(chunks, starts)], axis=1
    )


def probabilities(w: Weights, texts: list[np.ndarray]) -> np.ndarray:
    blocks = [padded(t) for t in texts]
    counts = np.array([len(b) // SPAN for b in blocks])
    maxima = segment_maxima(w, np.concatenate(blocks), counts)
    first, second, starts = chunks_of(counts)
    hidden = np.tanh(np.maximum(maxima[first], maxima[second]) + w["bias"])
    logit = np.full(len(texts), float(w["level"][0]))
    for feature, weight in zip(pooled(hidden, starts).T.astype(np.float64), w["out"].astype(np.float64)):
        logit += feature * weight  # one after another, whatever the number of texts
    return 1 / (1 + np.exp(-logit))


def gradients(w: Weights, texts: list[np.ndarray], labels: np.ndarray) -> tuple[Weights, float]:
    blocks = [padded(t) for t in texts]
    data = np.concatenate(blocks)
    counts = np.array([len(b) // SPAN for b in blocks])
    raw = responses(w, data, np.zeros(_AFTER, np.uint8))
    raw[np.cumsum(counts) - 1, 1 - REACH :] = -np.inf  # these would see the next text
    place = raw.argmax(axis=1)
    maxima = np.take_along_axis(raw, place[:, None, :], 1)[:, 0]
    first, second, starts = chunks_of(counts)
    later = maxima[second] > maxima[first]
    hidden = np.tanh(np.where(later, maxima[second], maxima[first]) + w["bias"])
    features = pooled(hidden, starts)
    logit = features @ w["out"] + w["level"][0]
    p = 1 / (1 + np.exp(-logit))
    loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
    d_logit = (p - labels) / len(labels)
    d_features = d_logit[:, None] * w["out"][None]
    n = np.diff(np.append(starts, len(hidden)))
    owner = np.repeat(np.arange(len(texts)), n)
    mean, least, most = np.split(d_features, 3, axis=1)
    _, low, high = np.split(features, 3, axis=1)
    d_hidden = (mean / n[:, None])[owner]
    for slope, edge in ((least, low), (most, high)):  # chunks that overlap often share the least or largest
        at = hidden == edge[owner]
        d_hidden += slope[owner] * at / np.add.reduceat(at, starts, dtype=np.int64)[owner]
    d_max = (d_hidden * (1 - hidden**2)).astype(np.float32)
    winner = np.where(later, second[:, None], first[:, None])
    column = np.broadcast_to(np.arange(FILTERS), winner.shape)
    d_segment = np.zeros_like(maxima)
    np.add.at(d_segment, (winner, column), d_max)
    at = (np.arange(len(maxima))[:, None] * SEGMENT + place) * STEP
    extended = np.concatenate([data, np.zeros(_AFTER, np.uint8)])
    d_filters = np.zeros_like(w["filters"])
    d_bytes = np.zeros_like(w["bytes"])
    for k in range(REACH):
        for j in range(STEP):
            seen = extended[at + k * STEP + j]  # (segment, filter)
            part = w["filters"][k, j * DEPTH : (j + 1) * DEPTH]
            d_filters[k, j * DEPTH : (j + 1) * DEPTH] = np.einsum("sfd,sf->df", w["bytes"][seen], d_segment)
            flat = seen.ravel()
            for d in range(DEPTH):
                d_bytes[:, d] += np.bincount(flat, (d_segment * part[d]).ravel(), 256)
    return {
        "bytes": d_bytes,
        "filters": d_filters,
        "bias": d_max.sum(axis=0),
        "out": (features * d_logit[:, None]).sum(axis=0),
        "level": np.array([d_logit.sum()]),
    }, loss


def train(
    texts: list[np.ndarray], labels: np.ndarray, steps: int = 1000, batch: int = 32, rate: float = 3e-3, seed: int = 7
) -> Weights:
    """About ``steps`` steps of Adam on the log loss; texts of like length share a batch. One class or no rows: its share."""
    rng = np.random.default_rng(seed)
    w = start(rng)
    if len(labels) == 0 or labels.min() == labels.max():
        w["out"][:] = 0
        w["level"][:] = 0 if len(labels) == 0 else 6 * (2 * labels[0] - 1)
        return w
    sizes = np.array([len(t) for t in texts])
    first, second, turn = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(3))
    turn = 0
    n_batches = -(-len(texts) // batch)
    epochs = -(-steps // n_batches)
    for epoch in range(epochs):
        order = np.argsort(sizes * rng.uniform(0.5, 2, len(sizes)), kind="stable")
        for part in rng.permutation(n_batches):
            rows = order[part * batch : (part + 1) * batch]
            grads, _ = gradients(w, [texts[k] for k in rows], labels[rows])
            turn += 1
            step = rate * min(1.0, turn / 50) * (1 - 0.9 * (turn - 1) / (epochs * n_batches))
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                move = (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
                w[k] = (w[k] - step * (move + 1e-3 * w[k])).astype(np.float32)
    return w


def dumps(w: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def loads(data: bytes) -> Weights:
    with np.load(io.BytesIO(data)) as file:
        return {k: file[k] for k in file.files}


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = 4000,
    longest: int = 1 << 16,
) -> bytes:
    """Weights learned from at most ``sample_rows`` labelled rows whose crc32 fold is not 0.

    The sample is that of the smallest hashes of the id; texts of more than ``longest`` bytes are no
    examples. Rows without id or label teach nothing; an id labelled twice counts with its smaller
    label; without any example every text scores 0.5.
    """
    known = (
        labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull() & (fold(id_column) != 0))
        .groupBy(id_column)
        .agg(F.min(label).cast("double").alias("label"))
    )
    texts = docs.select(id_column, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Three labelled ids for each example wanted, since a label's text may be missing or too long.
    chosen = known.orderBy(F.xxhash64(id_column), id_column).limit(3 * sample_rows)
    examples = (
        texts.filter(F.octet_length("text") <= longest)
        .join(F.broadcast(chosen), id_column)
        .select(id_column, "label", "text")
        .orderBy(F.xxhash64(id_column), id_column, "text")
        .limit(sample_rows)
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marks = [], []
        for batch in batches:
            marks += batch.column(0).to_pylist()
            seen += [np.frombuffer(t.as_py().encode(), np.uint8) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([pa.array([dumps(train(seen, np.array(marks)))], pa.binary())], ["weights"])

    rows = examples.select("label", "text").coalesce(1).mapInArrow(learn, "weights binary").collect()
    return bytes(rows[0]["weights"]) if rows else dumps(train([], np.zeros(0)))


def score(docs: DataFrame, weights: bytes, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All rows and columns with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts are scored as one chunk of zeros. Columns named score or predicted are
    replaced; repeated rows stay repeated and score alike; an empty table stays empty.
    """
    rows = docs.drop("score", "predicted").withColumn(text, F.col(text).cast("string"))
    place = rows.columns.index(text)
    names = [*rows.columns, "score", "predicted"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = loads(weights)
        for batch in batches:
            scores = [np.zeros(0)]
            for part in slices(batch.column(place), 1 << 20):
                n = len(part.offsets) - 1
                scores.append(probabilities(w, [part.data[part.offsets[k] : part.offsets[k + 1]] for k in range(n)]))
            scores = np.concatenate(scores)
            more = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)
            release()

    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return rows.mapInArrow(mark, T.StructType([*rows.schema.fields, *extra]))
