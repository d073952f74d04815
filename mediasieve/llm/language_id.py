"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasieve.llm.batches import bound_batches, slices

UNKNOWN = "und"
FOLDS = 5
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass
class ByteConvNet:
    """Filters of several widths over bytes, max pooling over a window, softmax.

    ``taps[w]`` has for each place in a filter of width w a row of FILTERS
    numbers for every byte (a convolution of one-hot bytes); byte 0 pads.
    """

    langs: list[str]
    taps: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, tables by pairs of bytes (and by the last byte of an odd width)."""
        tables = []
        for w, taps in self.taps.items():
            mine = [(taps[j][:, None, :] + taps[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
            tables.append(mine + ([taps[w - 1]] if w % 2 else []))
        return tables

    def log_probs(self, windows: np.ndarray, tables: list[list[np.ndarray]], step: int = 256) -> np.ndarray:
        """(n, languages) for (n, WINDOW) bytes."""
        parts = [np.empty((0, len(self.langs)), np.float32)]
        for i in range(0, len(windows), step):
            x = windows[i : i + step].astype(np.intp)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            pooled = []
            for w, mine in zip(self.taps, tables):
                size = WINDOW - w + 1
                z = np.take(mine[0], pairs[:, :size], axis=0)
                for k, table in enumerate(mine[1:], 1):
                    at = pairs[:, 2 * k : 2 * k + size] if len(table) > 256 else x[:, 2 * k : 2 * k + size]
                    z += np.take(table, at, axis=0)
                pooled.append(z.max(axis=1))
            parts.append(_log_softmax(np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.out_bias))
        return np.concatenate(parts)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(text: bytes) -> np.ndarray:
    """The whole text, A-Z lower-cased, as rows of WINDOW bytes; the last is padded with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.lower().ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 5) -> ByteConvNet:
    """Adam on cross-entropy; the gradient of max pooling goes to the winning place of each filter."""
    rng = np.random.default_rng(seed)
    n_features = FILTERS * len(WIDTHS)
    taps = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    params = [*taps.values(), np.zeros(n_features, np.float32), rng.normal(0, 0.2, (n_features, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    filters = np.arange(FILTERS)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            x, y = windows[order[i : i + batch]].astype(np.intp), labels[order[i : i + batch]]
            best, pooled = [], []
            for w in WIDTHS:
                size = WINDOW - w + 1
                z = sum(np.take(taps[w][j], x[:, j : j + size], axis=0) for j in range(w))
                best.append(z.argmax(axis=1))
                pooled.append(np.take_along_axis(z, best[-1][:, None, :], axis=1)[:, 0])
            hidden = np.concatenate(pooled, axis=1) + params[-3]
            active = np.maximum(hidden, 0) * (rng.random(hidden.shape) > 0.25) / 0.75
            error = np.exp(_log_softmax(active @ params[-2] + params[-1]))
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = (error @ params[-2].T) * (active > 0) / 0.75
            grads = []
            for k, w in enumerate(WIDTHS):
                g, mine = np.zeros_like(taps[w]), back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, best[k] + j, axis=1), filters[None, :]), mine)
                grads.append(g)
            grads += [back.sum(axis=0), active.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ByteConvNet(langs, taps, *params[-3:])


def fit(docs: DataFrame, max_sample: int = 6000) -> ByteConvNet | None:
    """A network from a bounded sample of the labelled rows that are not held out.

    ``max_sample`` bounds the sample: one window of text from that many rows,
    the same number for each language (one at least), chosen by hash. All
    labels are learned. The first job counts labels without reading texts. None
    if there is nothing to learn from.
    """
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = sorted(rows.groupBy("lang").count().collect())
    if not counts:
        return None
    each = max(1, max_sample // len(counts))
    part = F.map_from_arrays(F.lit([lang for lang, _ in counts]), F.lit([min(1.0, (each + 4 * each**0.5 + 4) / n) for _, n in counts]))
    draw = F.pmod(F.xxhash64("doc_id", "lang", "text", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1
    sample = (
        rows.where(draw < F.element_at(part, F.col("lang")))
        .where(F.col("text").rlike(r"\p{L}"))
        .select("lang", F.substr("text", start.cast("int"), F.lit(WINDOW)).alias("piece"))
        .collect()
    )
    drawn = sorted(((r.lang, r.piece.encode()) for r in sample), key=lambda x: (x[0], zlib.crc32(x[1]), x[1]))
    # A few more than wanted are drawn, so that no language gets too few.
    sample = sorted(x for _, some in groupby(drawn, key=lambda x: x[0]) for x in islice(some, each))
    if not sample:
        return None
    langs = sorted({lang for lang, _ in sample})
    place = {lang: k for k, lang in enumerate(langs)}
    windows = np.concatenate([windows_of(piece[:WINDOW]) for _, piece in sample])
    return train(windows, np.array([place[lang] for lang, _ in sample]), langs)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def classify(texts: list[str | None], net: ByteConvNet | None, tables: list[list[np.ndarray]]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    at = [k for k, t in enumerate(texts) if net and has_letter(t)]
    while at:
        some, size = [], 0
        while at and size < 1 << 21:
            some.append(at.pop())
            size += len(texts[some[-1]])
        windows = [windows_of(texts[k].encode()) for k in some]
        ends = np.cumsum([0, *map(len, windows)])
        logs = np.add.reduceat(net.log_probs(np.concatenate(windows), tables), ends[:-1], axis=0) / np.diff(ends)[:, None]
        for k, p in zip(some, np.exp(_log_softmax(logs))):
            langs[k], scores[k] = net.langs[int(p.argmax())], float(min(1.0, p.max()))
    return langs, scores


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs(doc_id, text)``.

    Each whole text is cut into windows of WINDOW bytes, which are classified in
    batches; the language has the largest mean log probability, the score is
    its share of the softmax of those means. Null texts and those without a
    letter, and all if nothing could be learned, get ``und`` with score 0.
    Repeated rows give repeated results; an empty table gives none. No shuffle;
    further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pair_tables() if net else []
        for batch in slices(batches):
            langs, scores = classify(batch.column("text").to_pylist(), net, tables)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteConvNet | None, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is in a known language with a score of ``min_score`` or more.

    Without a network every text that has a letter stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pair_tables() if net else []
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            keep = [s >= min_score for s in classify(texts, net, tables)[1]] if net else list(map(has_letter, texts))
            yield batch.filter(pa.array(keep, pa.bool_()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, max_sample: int = 6000) -> DataFrame:
    """``predict`` for ``docs(doc_id, text, lang)`` with a network fitted on its labelled rows that are not held out."""
    return predict(docs, fit(docs, max_sample))
