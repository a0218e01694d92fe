"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A
text is cut into overlapping windows; a window's gain is the length that it
compresses to with the ordinary dictionary less that with the toxic one. Both
stand behind a large base of ordinary text, so that gains come from what only
toxic text has. A text's strongest gains give its score by a calibrated logistic
curve.

Labels say which texts are toxic, not where. So the toxic dictionary is trained on
the places of toxic samples that tell: words, with the bytes around them, whose
log-odds of standing in a toxic sample are above ``TELLING`` by two standard errors.
The ordinary one is trained on windows of ordinary samples. Of either, the content
is used, behind the base; their entropy tables are left out, as lengths can only be
compared under the same ones.

Training takes a bounded sample of the labelled rows, ``SAMPLE`` documents of
either class at most, those with the smallest hashes of their ids; texts of more
than ``SAMPLE_CHARS`` characters aren't trained on. Scoring reads whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, table, tidy
from .textkernel import trim

SAMPLE, SAMPLE_CHARS = 3000, 30_000
WINDOW, STEP = 48, 32
LEVEL = 3
#: Least log-odds of a telling word, in texts that it must stand in at least, and bytes of text before and after it.
TELLING, TEXTS, AROUND = 1.0, 3, 6
#: Bytes of the base, and of either dictionary with its tables.
BASE_BYTES, TRAINED_BYTES = 100_000, 2048
_WORD = re.compile(rb"[^\x00-\x20!-/:-@\[-`{-~]+")


def windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STEP), STEP)]


def _compressor(raw: bytes):
    import zstandard

    content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False)


def _trained(samples: list[bytes]) -> bytes:
    """A dictionary that zstandard trains on the samples; samples too few to train on are its content as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(TRAINED_BYTES, samples, k=16, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)


@dataclass
class Model:
    base: bytes
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def gains(self, texts: list[bytes]) -> list[np.ndarray]:
        """Gains of each text's windows, largest first."""
        plain, toxic = _compressors(self)
        return [np.sort([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(t)])[::-1] for t in texts]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(self.gains(texts)) @ self.weights, -30, 30)))


_MADE: dict = {}


def _compressors(model: Model):
    key = hash((model.base, model.ordinary, model.toxic))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = _compressor(model.base + model.ordinary), _compressor(model.base + model.toxic)
    return _MADE[key]


def features(gains: list[np.ndarray]) -> np.ndarray:
    """Of each text: its three largest gains, their square, the log of its windows, and 1."""
    out = np.zeros((len(gains), 6))
    for i, g in enumerate(gains):
        out[i, : min(3, len(g))] = g[:3] / 8
        out[i, 3:] = (g[0] / 8) ** 2, np.log(len(g)) / 4, 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        move = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w


def apart(texts: list[bytes]) -> list[bytes]:
    """The texts without copies and near copies of earlier ones, which would pass for words that many texts share."""
    seen, out = set(), []
    for t in texts:
        w = t.split()
        marks = sorted({zlib.crc32(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))})[:4]
        if sum(m in seen for m in marks) * 2 <= len(marks) - (len(marks) == 1):
            out.append(t)
        seen.update(marks)
    return out


def train(toxic: list[bytes], ordinary: list[bytes], toxic_rate: float = 0.1) -> Model:
    """Dictionaries from two thirds of the samples, calibration on the rest.

    toxic_rate: share of toxic texts among labelled rows, to which scores are calibrated.
    """
    toxic, ordinary = apart(toxic), apart(ordinary)
    held = lambda rows: ([r for i, r in enumerate(rows) if i % 3], rows[::3])
    (toxic, toxic_held), (ordinary, ordinary_held) = held(toxic), held(ordinary)
    base = b"".join(ordinary)[:BASE_BYTES]  # of the sample's texts as many as fit
    usual, special = _trained([w for t in ordinary for w in windows(t)]), _trained(telling(toxic, ordinary))
    # Of the same length, so that offsets into the base cost the same with both.
    size = min(max(len(special), 64), TRAINED_BYTES * 7 // 8)
    usual, special = usual[-size:].rjust(size), special[-size:].rjust(size)
    model = Model(base, usual, special, np.zeros(6))
    x = features(model.gains(toxic_held + ordinary_held))
    y = np.concatenate([np.ones(len(toxic_held)), np.zeros(len(ordinary_held))])
    if len(toxic_held) and len(ordinary_held):
        w = _logistic(x, y)
        # The sample's classes aren't as frequent as in the labelled rows.
        w[-1] += np.log(toxic_rate / (1 - toxic_rate)) - np.log(len(toxic_held) / len(ordinary_held))
        model.weights = w
    else:
        model.weights[-1] = 30.0 if len(toxic_held) else -30.0
    return model


def telling(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Telling words of toxic texts at all their places, with the bytes around them."""
    counts = [Counter(w for t in texts for w in {w.lower() for w in _WORD.findall(t)}) for texts in (toxic, ordinary)]
    m, n = len(toxic), len(ordinary)
    words = set()
    for w, a in counts[0].items():
        b = counts[1][w]
        odds = math.log((a + 0.5) / (m - a + 0.5)) - math.log((b + 0.5) / (n - b + 0.5))
        if a >= TEXTS and odds - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > TELLING:
            words.add(w)
    return [t[max(0, m.start() - AROUND) : m.end() + AROUND] for t in toxic for m in _WORD.finditer(t) if m[0].lower() in words]


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed) -> tuple[list[bytes], list[bytes], float]:
    """(toxic texts, other texts, share of toxic rows) of labelled documents; allowed: condition on doc_id."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(allowed)
    # A document with several labels is toxic if one of them says so.
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = marks.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    found = bounded_sample(docs.select("doc_id", "text"), marks, "toxic", [1, 0], SAMPLE, SAMPLE_CHARS)
    out = {label: [t.encode("utf-8", "replace") for t in found[label]] for label in (1, 0)}
    return out[1], out[0], min(0.99, max(0.001, (toxic or 0) / total)) if total else 0.1


def fit(docs: DataFrame, labels: DataFrame, allowed=None) -> Model:
    model = train(*labelled_sample(docs, labels, F.lit(True) if allowed is None else allowed))
    tidy(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds a score (0 to 1) and a prediction (1 if score >= threshold) to rows with a text, in the place of columns of these names.

    Null texts are scored as empty ones; repeated rows get a score each.
    """
    docs = docs.drop(*names)
    place, held = docs.columns.index("text"), [*docs.columns, *names]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def rows(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column(place).to_pylist()]
            found = shared.value.scores(texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], held)
        trim()

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(rows, f"{kinds}, `{names[0]}` double, `{names[1]}` int")


def in_fold(column: str = "doc_id"):
    """Rows held out: crc32 of the id as text leaves 2 when divided by 4."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned from labelled rows outside the fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ~in_fold())
    return score(docs, model).select("doc_id", F.coalesce(in_fold(), F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
