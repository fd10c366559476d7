"""Language identification by a byte convolutional network, trained and run in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, the last one filled up with zeros. Each byte has an embedding;
filters of several widths slide over the window, each keeps its highest response (max pooling), and a softmax reads those.
The log-probabilities of a text's windows are averaged by the bytes they hold, so the whole text counts.

Training reads at most ``DOCS_PER_LANGUAGE`` documents of each language (the first by a hash of doc_id) and of each one
passage of ``PASSAGE`` characters at a place given by that hash: a bounded sample for the classifier only.

Defined results: a null text or one without a letter is ``und`` with score 0. Equal texts give equal results, in repeated rows
too. A null doc_id is never learned from. If no language was learned every text is ``und``. A very long text is many windows,
worked off a few at a time, and all of them count. An empty table gives an empty result. Extra columns pass through; result
columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_remainder, lean, low_hashes, small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
DOCS_PER_LANGUAGE = 400
PASSAGE = 1024
#: Rounds of windows that one inference step works off.
_STEP = 512


def windows(data: bytes) -> np.ndarray:
    """The bytes as rows of WINDOW, at least one row."""
    rows = max(1, -(-len(data) // WINDOW))
    out = np.zeros(rows * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(rows, WINDOW)


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: list[np.ndarray]  # of each width (width * EMBED, FILTERS)
    soft: np.ndarray  # (FILTERS * widths, languages)
    bias: np.ndarray

    def pooled(self, rows: np.ndarray, where: bool = False):
        """Highest response of each filter, and on demand the places of those."""
        flat = self.embed[rows].reshape(len(rows), WINDOW * EMBED)
        best, places = [], []
        for width, kernel in zip(WIDTHS, self.filters, strict=True):
            n = WINDOW - width + 1
            view = np.lib.stride_tricks.as_strided(flat, (len(rows), n, width * EMBED), (flat.strides[0], EMBED * flat.strides[1], flat.strides[1]))
            response = np.ascontiguousarray(view).reshape(-1, width * EMBED) @ kernel
            response = response.reshape(len(rows), n, FILTERS)
            if where:
                place = response.argmax(1)
                places.append(place)
                best.append(np.take_along_axis(response, place[:, None], 1)[:, 0])
            else:
                best.append(response.max(1))
        pooled = np.maximum(np.concatenate(best, 1), 0)
        return (pooled, flat, places) if where else pooled

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        z = self.pooled(rows) @ self.soft + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(texts: list[str], languages: list[str], steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    known = sorted(set(languages))
    shapes = [(256, EMBED), *((w * EMBED, FILTERS) for w in WIDTHS), (FILTERS * len(WIDTHS), max(1, len(known))), (max(1, len(known)),)]
    params = [rng.normal(0, 0.5 if i == 0 else (2 / s[0]) ** 0.5 if len(s) > 1 else 0, s).astype(np.float32) for i, s in enumerate(shapes)]
    network = Network(known, params[0], params[1:-2], params[-2], params[-1])
    rows, target = [], []
    for text, language in zip(texts, languages, strict=True):
        own = windows(text.encode())
        rows.append(own)
        target += [known.index(language)] * len(own)
    if len(known) < 2 or not rows:
        return network
    rows, target = np.concatenate(rows), np.array(target)
    by_language = [np.flatnonzero(target == i) for i in range(len(known))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, max(1, batch // len(known))) for own in by_language])
        x, y = rows[pick].copy(), target[pick]
        short = rng.random(len(x)) < 0.3  # texts may be shorter than a window
        for i in np.flatnonzero(short):
            x[i, rng.integers(16, WINDOW) :] = 0
        pooled, flat, places = network.pooled(x, where=True)
        z = pooled @ network.soft + network.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        grads = [np.zeros_like(params[0])]
        back = (p @ network.soft.T) * (pooled > 0)
        for j, (width, place) in enumerate(zip(WIDTHS, places, strict=True)):
            own = back[:, j * FILTERS : (j + 1) * FILTERS]
            at = place[:, :, None] * EMBED + np.arange(width * EMBED)
            seen = np.take_along_axis(flat[:, None], at, 2)
            grads.append(np.einsum("bf,bfk->kf", own, seen))
            taps = (own[:, :, None] * network.filters[j].T[None]).reshape(-1, EMBED)
            byte = x[np.arange(len(x))[:, None, None], place[:, :, None] + np.arange(width)].reshape(-1)
            np.add.at(grads[0], byte, taps)
        grads += [pooled.T @ p, p.sum(0)]
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return network


def predict(network: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The likeliest language of each whole text, and its probability."""
    import regex

    letter = regex.compile(r"\p{L}")
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    which = [i for i, t in enumerate(texts) if t and letter.search(t)] if len(network.languages) else []
    pieces = [windows(texts[i].encode("utf-8", "replace")) for i in which]
    if not pieces:
        return names, scores
    counts = np.array([len(p) for p in pieces])
    sizes = np.array([len(texts[i].encode("utf-8", "replace")) for i in which])
    rows = np.concatenate(pieces)
    logs = np.concatenate([network.log_probabilities(rows[i : i + _STEP]) for i in range(0, len(rows), _STEP)]).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    held = np.full(len(rows), float(WINDOW))
    held[starts + counts - 1] = sizes - (counts - 1) * WINDOW
    mean = np.add.reduceat(logs * held[:, None], starts) / sizes[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    for i, best, row in zip(which, p.argmax(1), p, strict=True):
        names[i], scores[i] = network.languages[best], float(row[best])
    return names, scores


def fit(documents: DataFrame, folds: int = 3, held_out: int = 1) -> Network:
    """Learns lang from text of documents outside the held-out fold of crc32(doc_id as text)."""
    known = documents.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(crc_remainder(F.col("doc_id"), folds) != held_out)
    place = F.xxhash64("doc_id")
    room = F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1
    passage = F.substring(F.col("text"), (F.pmod(place, room) + 1).cast("int"), F.lit(PASSAGE))
    totals = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # as many rows as there are languages
    if not totals:
        return train([], [])
    few = F.lit(False)
    for name, total in sorted(totals.items()):
        few = few | ((F.col("lang") == name) & low_hashes("doc_id", DOCS_PER_LANGUAGE, total))
    picked: dict[str, list] = {}
    for r in known.where(few).select("lang", passage.alias("passage"), place.alias("h")).toLocalIterator():  # one scan; a bounded number of rows
        picked.setdefault(r.lang, []).append((r.h, r.passage))
    rows = [(name, text) for name in sorted(picked) for _, text in sorted(picked[name])[:DOCS_PER_LANGUAGE]]
    return train([text for _, text in rows], [name for name, _ in rows])


def identify(df: DataFrame, network: Network, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds lang_pred (string) and score (double) to every row; the text goes unless keep_text."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    own = ("lang_pred", "score")
    keep = [f for f in df.schema.fields if f.name not in own and (keep_text or f.name != text)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            found, scores = predict(shared.value, batch.column(text).to_pylist())
            columns = [batch.column(n) for n in names] + [pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *own])

    return df.select(*dict.fromkeys([*names, text])).mapInArrow(lean(run), schema)
