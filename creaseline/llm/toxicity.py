"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or (operator 8)."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creaseline.llm.common import map_texts

#: Bound of the labelled documents that are fitted on, and of the positions of the hashed features.
MAX_TRAIN_DOCS, FEATURES = 6_000, 1 << 18
EPOCHS, RATE, PENALTY, START = 120, 0.2, 2e-4, -6.0
#: A feature is learnt if so many of the fitted documents have it.
MIN_DOCS = 4
THRESHOLD = 0.7
#: Sentences end at these marks or at a line end; longer ones are cut after so many words.
SENTENCE_WORDS = 60
_sentence = re.compile(r"[^.!?\n]+[.!?]*").finditer
_token = re.compile(r"[^\W\d_]+").findall
_ids: dict[str, tuple[int, int]] = {}


def features_of(word: str) -> tuple[int, int]:
    """Positions of a lower-case word and of its first four letters."""
    known = _ids.get(word)
    if known is None:
        if len(_ids) > 500_000:
            _ids.clear()
        known = _ids[word] = (zlib.crc32(word.encode()) % FEATURES, zlib.crc32(b"^" + word[:4].encode()) % FEATURES)
    return known


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences that have a word; a text without words has none."""
    out = []
    for m in _sentence(text):
        words = _token(m.group().lower())
        for i in range(0, len(words), SENTENCE_WORDS):
            out.append((m.start(), m.end(), words[i : i + SENTENCE_WORDS]))
    return out


def bags(text: str | None) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Sentence spans of a text, its distinct features per sentence one after another, and where each sentence starts."""
    spans, ids, starts = [], [], []
    for start, end, words in sentences(text or ""):
        own = {f for w in words for f in features_of(w)}
        spans.append((start, end))
        starts.append(len(ids))
        ids.extend(own)
    return spans, np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64)


def noisy_or(logits: np.ndarray) -> float:
    """Probability that some sentence is toxic: 1 - product of (1 - p)."""
    return float(-np.expm1(-np.logaddexp(0.0, logits).sum())) if len(logits) else 0.0


def fit(rows: list[tuple[bytes, bytes, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias from documents (feature bytes, sentence starts, label) by full-batch projected Adam.

    The loss is the log loss of the noisy-or of a document's sentences, so which sentence is to blame is learnt,
    not given.  Words only ever speak for toxicity: weights stay at or above zero, and a penalty keeps most at
    zero.  Without documents of both labels the model scores every sentence by the starting bias.
    """
    weights, bias = np.zeros(FEATURES), START
    rows = [r for r in rows if len(r[1])]
    if len({r[2] for r in rows}) < 2:
        return weights, bias
    ids = np.concatenate([np.frombuffer(f, dtype="<i4") for f, _, _ in rows]).astype(np.int64)
    sizes = [len(f) // 4 for f, _, _ in rows]
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    starts = np.concatenate([np.frombuffer(s, dtype="<i4") + b for (_, s, _), b in zip(rows, base)]).astype(np.int64)
    per_doc = np.array([len(s) // 4 for _, s, _ in rows])
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    sentence_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
    # A document counts once for a feature, however many of its sentences have it.
    doc_of = np.repeat(np.arange(len(rows)), sizes)
    in_docs = np.bincount(np.unique(doc_of * FEATURES + ids) % FEATURES, minlength=FEATURES)
    used = np.nonzero(in_docs >= MIN_DOCS)[0]
    place_of = np.full(FEATURES, len(used))
    place_of[used] = np.arange(len(used))
    place = place_of[ids]
    label = np.array([float(r[2]) for r in rows])
    share = label.mean()
    doc_weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share))
    w, bias = np.zeros(len(used) + 1), START
    m, v = np.zeros(len(used) + 2), np.zeros(len(used) + 2)
    for t in range(1, EPOCHS + 1):
        z = np.add.reduceat(w[place], starts) + bias
        total = np.add.reduceat(np.logaddexp(0.0, z), first)
        toxic = -np.expm1(-total)
        # d loss / d total: clean documents pay total itself, toxic ones -log(1 - exp(-total)).
        slope = np.where(label > 0, -np.exp(-total) / np.maximum(toxic, 1e-9), 1.0) * doc_weight
        dz = np.repeat(slope, per_doc) / (1 + np.exp(-z))
        g = np.append(np.bincount(place, weights=dz[sentence_of], minlength=len(used) + 1), dz.sum()) / len(rows)
        g[:-2] += PENALTY
        g[-2] = 0.0
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = np.maximum(w - step[:-1], 0.0)
        bias = min(bias - step[-1], START / 2)
    weights[used] = w[:-1]
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """Fit on labelled documents: at most `max_docs`, the first by a hash of doc_id.

    Only hashed features of those documents reach the driver.  Null labels and labels without a document teach
    nothing; of repeated labels of an id the highest counts.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = docs.select("doc_id").distinct().join(one, "doc_id")
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), "doc_id").limit(max_docs)

    def bag(texts):
        own = [bags(t) for t in texts]
        return {"f": [x[1].astype("<i4").tobytes() for x in own], "s": [x[2].astype("<i4").tobytes() for x in own]}

    # `chosen` has at most max_docs rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = map_texts(rows, bag, {"f": T.BinaryType(), "s": T.BinaryType()}).collect()
    return fit([(bytes(r["f"]), bytes(r["s"]), int(r["_toxic"] > 0)) for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["f"])))])


def toxicity_scores(docs: DataFrame, model: tuple[np.ndarray, float], spans: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` without text, with `score` and `predicted`; with `spans`, `toxic_spans` (start, end, score) too.

    `score` is the noisy-or over all sentences of the text; a text without words (or null) scores 0.  Spans are the
    sentences whose own score reaches 0.5, in code points.  Other columns pass through, columns of these names are
    replaced, repeated rows score alike.
    """
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # bounded by FEATURES
    fields: dict[str, T.DataType] = {"score": T.DoubleType(), "predicted": T.IntegerType()}
    if spans:
        one = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("score", T.DoubleType())
        fields["toxic_spans"] = T.ArrayType(one)

    def score(texts):
        w, b = shared.value
        out: dict[str, list] = {n: [] for n in fields}
        for text in texts:
            own, ids, starts = bags(text)
            logits = np.add.reduceat(w[ids], starts).astype(np.float64) + b if len(starts) else np.zeros(0)
            value = noisy_or(logits)
            out["score"].append(value)
            out["predicted"].append(int(value >= threshold))
            if spans:
                p = 1 / (1 + np.exp(-logits))
                out["toxic_spans"].append([{"start": s, "end": e, "score": float(x)} for (s, e), x in zip(own, p) if x >= 0.5])
        return out

    return map_texts(docs, score, fields)


def held_out(doc_id="doc_id"):
    """Rows whose crc32 of the id's text leaves 1 when divided by 3: their labels are never learnt."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
