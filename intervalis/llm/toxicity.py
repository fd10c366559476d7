"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its whole form and its character 3- to 6-grams (with word borders), each hashed to one of ``BUCKETS``
embedding rows. A segment of ``SEGMENT`` words is the mean of its words' vectors; embeddings and softmax weights are trained
jointly in numpy. A misspelling that was never seen shares most n-gram rows with the word it imitates. The odds of a text
are the sum of its segments' odds, so a short insult in a long text is not averaged away.

Every embedding row of the training texts is trained. Its trust, from how unevenly its texts are labelled, is the width of its
prior: rows that chance explains stay near zero, so a few thousand labels do not teach what hundreds of thousands of chance
n-grams mean.

Training reads at most ``TOXIC_DOCS`` + ``CLEAN_DOCS`` labelled documents, the first ones by a hash of doc_id; that bound is
the only sample. What goes to the executors is one float for each bucket, a fixed size.

Defined results: null and empty texts have no words and score the prior. Rows with equal texts score equal. A null doc_id
is scored, never learned from, and counted as held out only if its crc32 remainder says so (null gives false). A doc_id that
has several texts teaches the least of them, one with both labels counts as toxic. Without labels of both classes every text
scores the share of toxic labels. A very long text counts as a whole: each of its segments is scored. An empty table gives an
empty result. Extra columns pass through ``score``; result columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_remainder, first_by_hash, lean, small_batches

BUCKETS = 1 << 18
GRAMS = (3, 4, 5, 6)
DIM = 8
SEGMENT = 16
TRUST_POWER = 3
TOXIC_DOCS, CLEAN_DOCS = 1500, 2500
THRESHOLD = 0.3
_CACHE_WORDS = 150_000
_CHUNK = 20_000


def _gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' n-grams, and how many each word has."""
    marked = [f"<{w}>" for w in words]
    lengths = np.array([len(w) for w in marked])
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    position = np.arange(len(codes))
    word = np.repeat(np.arange(len(words)), lengths)
    mixed, found, owner = np.zeros(len(codes), dtype=np.uint64), [], []
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        mixed[: len(codes) - n + 1] = mixed[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            inside = np.flatnonzero(position + n <= ends)
            found.append(mixed[inside])
            owner.append(word[inside])
    whole = np.array([hash_word(w) for w in words], dtype=np.uint64)
    hashes, owners = np.concatenate([*found, whole]), np.concatenate([*owner, np.arange(len(words))])
    order = np.argsort(owners, kind="stable")
    hashes = hashes[order]
    hashes ^= hashes >> np.uint64(29)
    return ((hashes * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 18)).astype(np.int64), np.bincount(owners, minlength=len(words))


def hash_word(word: str) -> int:
    import zlib

    data = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 32 | zlib.crc32(data, 0x5F3759DF)


@dataclass
class Model:
    """weights: of each bucket, embedding times softmax difference, the toxic class less the other."""

    weights: np.ndarray
    bias: float
    scale: tuple[float, float]

    def word_logits(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, dtype=np.float32)
        if len(words) > _CHUNK:
            return np.concatenate([self.word_logits(words[i : i + _CHUNK]) for i in range(0, len(words), _CHUNK)])
        buckets, counts = _gram_hashes(words)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return (np.add.reduceat(self.weights[buckets], starts) / counts).astype(np.float32)

    def scores(self, texts: list[str | None], cache: dict) -> np.ndarray:
        split = [(t or "").lower().split() for t in texts]
        new = list({w for ws in split for w in ws if w not in cache})
        if len(cache) + len(new) > _CACHE_WORDS:
            cache.clear()
            new = list({w for ws in split for w in ws})
        cache.update(zip(new, self.word_logits(new).tolist(), strict=True))
        return np.array([self.score(np.array([cache[w] for w in ws], dtype=np.float64)) for ws in split])

    def score(self, logits: np.ndarray) -> float:
        """Odds of the segments add up; a text without words has the odds of one neutral segment."""
        ends = np.cumsum(logits)
        if len(logits) <= SEGMENT:
            means = ends[-1:] / max(1, len(logits)) if len(logits) else np.zeros(1)
        else:  # half-overlapping segments, so each short passage lies whole in one
            first = np.append(np.arange(0, len(logits) - SEGMENT, SEGMENT // 2), len(logits) - SEGMENT)
            total = np.concatenate([[0.0], ends])
            means = (total[first + SEGMENT] - total[first]) / SEGMENT
        high = float(means.max())
        doc = high + float(np.log(np.exp(np.minimum(means - high, 0)).sum() / (2 if len(means) > 1 else 1))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.scale[0] * doc + self.scale[1], -60, 60))))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic regression by Newton's method."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * len(y) * (w - np.array([1.0, 0.0])) * np.array([1, 0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.diag([1, 1e-3]), x.T @ (p - y) + pull)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _trust(docs: np.ndarray, ids: list[np.ndarray], y: np.ndarray, gram: np.ndarray, counts: np.ndarray, rows: int) -> np.ndarray:
    """How freely each embedding row may move, from 0 to 1: the prior width that its texts allow.

    The log-likelihood ratio of its presence in toxic and clean texts is set against the log of the number of texts, which is
    what chance reaches for one of very many rows; below that, a row is held back by a power of the share.
    """
    starts = np.concatenate([[0], np.cumsum(counts)])
    seen = np.zeros((2, rows))
    for d in docs:
        own = np.unique(ids[d])
        spans = counts[own]
        at = np.repeat(starts[own] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        seen[int(y[d]), np.unique(gram[at])] += 1
    total = seen.sum(0)
    share = max(1e-9, (y[docs] > 0).mean())
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num(seen[1] * np.log(seen[1] / (total * share))) + np.nan_to_num(seen[0] * np.log(seen[0] / (total * (1 - share))))
    return (np.clip(ratio / np.log(max(3, len(docs))), 0, 1) ** TRUST_POWER * np.minimum(1, total / 3)).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = 150, rate: float = 0.05, ridge: float = 0.02, seed: int = 7) -> Model:
    """Joint gradient descent on the embeddings of all n-grams of the texts and on the softmax weights.

    A segment is the average of its words' vectors, read by the softmax; a text's odds are the sum of its segments' odds, so
    the gradient goes to the segments that look toxic. Every row is trained; how far it moves and how hard ``ridge`` pulls it
    back follows its trust. Every fifth text is kept aside to scale the odds afterwards. The gradient of the embeddings has rank
    one, so each step costs a few passes over segments x words and words x n-grams.
    """
    y = np.array(labels, dtype=np.float64)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
    prior = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, dtype=np.float32), prior, (1.0, 0.0))
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in (t or "").lower().split()], dtype=np.int32) for t in texts]
    words = list(vocabulary) or [""]
    del vocabulary
    hashed = [_gram_hashes(words[i : i + _CHUNK]) for i in range(0, len(words), _CHUNK)]  # in chunks, to bound the driver's memory
    buckets, counts = np.concatenate([h[0].astype(np.int32) for h in hashed]), np.concatenate([h[1] for h in hashed])
    del hashed
    held = np.arange(len(y)) % 5 == 4
    docs = np.flatnonzero(~held & np.array([len(i) > 0 for i in ids]))
    if not len(docs) or y[docs].min() == y[docs].max():
        return Model(np.zeros(BUCKETS, dtype=np.float32), prior, (1.0, 0.0))
    present = np.zeros(BUCKETS, dtype=bool)
    present[buckets] = True
    used, gram = np.flatnonzero(present), (np.cumsum(present) - 1).astype(np.int32)[buckets]
    del buckets
    trust = _trust(docs, ids, y, gram, counts, len(used))[:, None]
    first = np.cumsum(counts) - counts
    cuts = [*range(0, len(words), 4 * _CHUNK), len(words)]  # blocks of words, to bound the driver's memory
    blocks = [(slice(a, b), slice(int(first[a]), int(first[b - 1] + counts[b - 1]))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    term = np.concatenate([ids[d] for d in docs])
    lengths = np.array([len(ids[d]) for d in docs])
    segments = -(-lengths // SEGMENT)
    base = np.concatenate([[0], np.cumsum(segments)[:-1]])
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    segment = (np.repeat(base, lengths) + place // SEGMENT).astype(np.int32)
    doc = np.repeat(np.arange(len(docs)), segments)
    share_of = 1.0 / np.bincount(segment)
    target, weight = y[docs], np.where(y[docs] > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    rng = np.random.default_rng(seed)
    table, soft = trust * rng.normal(0, 0.02, (len(used), DIM)).astype(np.float32), rng.normal(0, 1.0, DIM).astype(np.float32)
    bias, gain = prior - float(np.log(np.median(segments))), 10.0
    moments = [np.zeros_like(table), np.zeros_like(table), np.zeros_like(soft), np.zeros_like(soft), 0.0, 0.0]
    for step in range(1, epochs + 1):
        effect = table @ soft * gain
        by_word = np.concatenate([np.add.reduceat(effect[gram[at]], first[of] - at.start) for of, at in blocks]) / counts
        z = np.bincount(segment, by_word[term]) * share_of
        odds = np.exp(np.clip(z + bias, -30, 30))
        total = np.bincount(doc, odds)
        wrong = weight * (total / (1 + total) - target) / len(docs)
        back = (wrong / total)[doc] * odds
        on_word = np.bincount(term, (back * share_of)[segment], minlength=len(words))
        on_gram = sum(np.bincount(gram[at], np.repeat(on_word[of] / counts[of], counts[of]), minlength=len(table)) for of, at in blocks)
        on_gram = (on_gram * gain).astype(np.float32)
        slopes = (on_gram[:, None] * soft, on_gram @ table, float(wrong.sum()))
        moved = []
        for i, g in enumerate(slopes):
            moments[2 * i] = 0.9 * moments[2 * i] + 0.1 * g
            moments[2 * i + 1] = 0.99 * moments[2 * i + 1] + 0.01 * g * g
            moved.append(rate * (moments[2 * i] / (1 - 0.9**step)) / (np.sqrt(moments[2 * i + 1] / (1 - 0.99**step)) + 1e-7))
        table = table * (1 - ridge * (1 - trust)) - trust * moved[0]
        soft, bias = soft - moved[1], bias - float(moved[2])
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = table @ soft * gain
    model = Model(weights, bias, (1.0, 0.0))
    aside = np.flatnonzero(held)
    if y[aside].sum() >= 5 and (1 - y[aside]).sum() >= 5:
        known = model.word_logits(words).astype(np.float64)
        raw = np.clip([model.score(known[ids[d]]) for d in aside], 1e-12, 1 - 1e-12)
        model.scale = _fit_logistic(np.log(raw / (1 - raw)), y[aside])
    return model


def fit(documents: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """Learns labels.toxic from documents outside the held-out fold of crc32(doc_id as text)."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(crc_remainder(F.col("doc_id"), folds) != held_out)
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    bounds = ((1, TOXIC_DOCS), (0, CLEAN_DOCS))
    toxic, clean = (first_by_hash(known.where(F.col("toxic") == v), "doc_id", n, totals.get(v, 0)) for v, n in bounds)
    picked = toxic.unionAll(clean)
    chosen: dict[int, int] = {}
    for r in picked.collect():  # at most TOXIC_DOCS + CLEAN_DOCS ids
        chosen[r.doc_id] = max(r.toxic, chosen.get(r.doc_id, 0))
    if not chosen:
        return train([], [])
    spark = documents.sparkSession
    ids = spark.createDataFrame([(i,) for i in sorted(chosen)], "doc_id bigint")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi").toLocalIterator()
    least: dict[int, str] = {}
    for r in rows:
        least[r.doc_id] = min(r.text or "", least.get(r.doc_id, r.text or ""))
    return train([least[i] for i in sorted(least)], [chosen[i] for i in sorted(least)])


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """Adds score (double) and predicted (int) to every row; the text goes unless keep_text."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in ("score", "predicted") and (keep_text or f.name != text)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict = {}
        for batch in batches:
            scores = shared.value.scores(batch.column(text).to_pylist(), cache)
            made = [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, names=[*names, "score", "predicted"])

    return df.select(*dict.fromkeys([*names, text])).mapInArrow(lean(run), schema)
