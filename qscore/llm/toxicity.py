"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Every coordinate has a learning rate of its own, which falls with the gradients it has seen, and L1
regularisation leaves most weights at exactly zero; what is left is small enough to broadcast. Words also
count by their first three, four and five letters, so that inflected forms not seen in learning are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from qscore.llm.samples import labelled

BITS = 20
SAMPLE = 6000  # labelled documents of each class that are learnt from, at most
_STRIP = "\"'`.,;:!?()[]{}<>|*#$%&-_/\\"
_STEMS = (3, 4, 5)
_KNOWN = 200_000  # words whose hashes a task remembers
_BIGRAM, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PARAMETERS = {"alpha": 1.0, "beta": 1.0, "l1": 6.0, "l2": 1.0, "epochs": 4}


class _Hasher:
    """Hashes of words and of their stems (first letters), remembered for frequent words."""

    def __init__(self) -> None:
        self._reset(1 << 16)

    def _reset(self, room: int) -> None:
        self.known: dict[str, int] = {}
        self.hashes = np.zeros((1 + len(_STEMS), room), np.uint64)

    def _learn(self, word: str) -> int:
        at = len(self.known)
        if at == self.hashes.shape[1]:
            self.hashes = np.hstack([self.hashes, np.zeros_like(self.hashes)])
        bare = word.strip(_STRIP)
        # A stem is another symbol than a word of the same letters.
        forms = [bare, *(f"{bare[:n]}\0{n}" for n in _STEMS)]
        self.hashes[:, at] = [xxhash.xxh64_intdigest(x) for x in forms]
        self.known[word] = at
        return at

    def words(self, text: str | None) -> np.ndarray:
        """One row for the words and one for each kind of stem."""
        if len(self.known) >= _KNOWN:
            self._reset(1 << 16)
        known, learn = self.known, self._learn
        at = [i if (i := known.get(w)) is not None else learn(w) for w in (text.lower().split() if text else [])]
        return self.hashes[:, np.array(at, np.int64)]


def _buckets(forms: np.ndarray) -> list[np.ndarray]:
    """Buckets of words and stems, of pairs of neighbours, and of pairs one word apart."""
    shift, words = np.uint64(64 - BITS), forms[0]
    with np.errstate(over="ignore"):
        mixed = [forms.ravel() * _BIGRAM]
        for gap, odd in ((1, _BIGRAM), (2, _SKIP)):
            a, b = words[:-gap], words[gap:]
            mixed.append(((a ^ (a >> np.uint64(29))) * odd + b) * _SKIP)
        return [((x ^ (x >> np.uint64(32))) * _BIGRAM >> shift).astype(np.int64) for x in mixed]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = _Hasher()
    for batch in batches:
        found = [np.unique(np.concatenate(_buckets(hasher.words(t)))).astype(np.int32) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "buckets": found})


def _fit(parameters: dict):
    alpha, beta, l1, l2, epochs = (parameters[k] for k in ("alpha", "beta", "l1", "l2", "epochs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "label": [], "buckets": []}), *batches])
        order = np.argsort([xxhash.xxh64_intdigest(str(int(i))) for i in rows["doc_id"]], kind="stable")
        samples = [(np.append(b, 1 << BITS).astype(np.int64), y) for b, y in rows.iloc[order][["buckets", "label"]].values]
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

        def weights(z, n):
            return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

        for _ in range(epochs):
            for at, y in samples:
                w = weights(z[at], n[at])
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
                n[at] += g * g
        w = weights(z, n)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "weight": w[at]})

    return run


def fit(sample: DataFrame, **parameters) -> dict[int, float]:
    """Weights by bucket (bucket 2^20: the constant) from rows (doc_id, text, label), which must be few: they
    are learnt from one after the other. Fewer than 2^20 + 2 weights, mostly far fewer. No rows, no weights."""
    seen = sample.mapInPandas(_features, "doc_id long, label int, buckets array<int>")
    rows = seen.repartition(1).mapInPandas(_fit(_PARAMETERS | parameters), "bucket int, weight double")
    return {r["bucket"]: r["weight"] for r in rows.collect()}


def score(docs: DataFrame, weights: dict[int, float], into: str = "toxicity") -> DataFrame:
    """``docs`` with a score (0 to 1) in the column ``into``, from the text alone; a null text is scored as an empty one."""
    spark = docs.sparkSession
    at = np.array(sorted(weights), dtype=np.int64)
    sent = spark.sparkContext.broadcast((at, np.array([weights[i] for i in at.tolist()])))

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w = sent.value
        table = np.zeros((1 << BITS) + 1)
        table[at] = w
        hasher = _Hasher()
        for texts in batches:
            out = np.empty(len(texts))
            for i, t in enumerate(texts):
                hit = np.concatenate([b[table[b] != 0] for b in _buckets(hasher.words(t))])
                out[i] = table[np.unique(hit)].sum() + table[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn(into, toxicity("text"))


def learn_and_score(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE, into: str = "toxicity") -> DataFrame:
    """Learns from ``labels`` (doc_id, toxic) where ``usable`` holds, from at most ``sample`` documents of each
    class, and scores all of ``docs``.

    Needs doc_id and text; other columns pass through, but for one named ``into``, which is replaced. A null or empty text gets the score of the
    constant alone; repeated rows get the same score; without labels every score is 0.5.
    """
    return score(docs, fit(labelled(docs, labels, "toxic", usable, sample)), into)
