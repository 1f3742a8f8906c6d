"""Quality of documents from a linear-chain conditional random field over their lines.

Each line is good or bad. What speaks for either is measured on the line itself and on the lines next to
it, and neighbouring labels depend on each other. Forward-backward gives the probability that a line is
good; the mean over the lines, weighted by length, is the quality of the document.

Only documents are labelled, so learning goes in two steps: at first every line has its document's label;
then the lines of bad documents that look good to the first model are labelled good, and the field is
learnt anew. The sums over all lines of the sample are taken in one task: the sample is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from qscore.llm.samples import labelled

SAMPLE = 1500  # labelled documents of each class that are learnt from, at most
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!#$%&*|<>=+~^@_{}[]\\/"
_STOPS = b".,;:?'\"()-"
_MEASURES = 14
_WIDTH = 3 * _MEASURES + 1


def _measures(line: bytes, seen: bool) -> tuple:
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return (0.0,) * (_MEASURES - 2) + (1.0, float(seen))
    upper = size - len(line.translate(None, _UPPER))
    lower = size - len(line.translate(None, _LOWER))
    marks = size - len(line.translate(None, _MARKS))
    digits = size - len(line.translate(None, _DIGITS))
    stops = size - len(line.translate(None, _STOPS))
    return (
        marks / size,
        min(1.0, marks / n),
        upper / (upper + lower + 1),
        digits / size,
        stops / size,
        (1.0 - len(set(words)) / n) if n > 1 else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        line.count(b"|") / n,
        line.count(b"!!") / n,
        min(size / n, 20.0) / 20,
        float(words[-1][-1:] in (b".", b"!", b"?")),
        float(line[:1].isupper() or line[0] > 127),
        min(n, 10) / 10,
        float(seen),
    )


def _lines(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Measures of each line, and their lengths (1 at least)."""
    lines, known, rows = (text or b"").split(b"\n"), set(), []
    for line in lines:
        rows.append(_measures(line, len(line) > 0 and line in known))
        known.add(line)
    return np.array(rows, np.float32), np.array([max(1, len(x)) for x in lines], np.float32)


def _around(x: np.ndarray) -> np.ndarray:
    """Measures of a line, of the line before, of the line after, and a constant."""
    none = np.zeros((1, x.shape[1]), x.dtype)
    before, after = np.vstack([none, x[:-1]]), np.vstack([x[1:], none])
    return np.hstack([x, before, after, np.ones((len(x), 1), x.dtype)])


class _Chains:
    """Documents laid out so that all their lines of one number stand together, longest documents first."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[self.order]
        steps = int(self.lengths[0]) if len(lengths) else 0
        alive = np.searchsorted(-self.lengths, -np.arange(steps), side="left")
        self.at = [starts[: alive[t]] + t for t in range(steps)]

    def marginals(self, lines: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected counts of neighbouring labels, from the score of good
        over bad of each line and the scores of neighbouring labels (bad and good by bad and good)."""
        total = len(lines)
        local = np.exp(np.clip(np.stack([-lines / 2, lines / 2], 1), -30, 30))
        link = np.exp(np.clip(pairs, -30, 30))
        ahead, back = np.empty((total, 2)), np.ones((total, 2))
        for t, at in enumerate(self.at):
            a = local[at] if t == 0 else local[at] * (ahead[self.at[t - 1][: len(at)]] @ link)
            ahead[at] = a / a.sum(1, keepdims=True)
        counts = np.zeros((2, 2))
        for t in range(len(self.at) - 2, -1, -1):
            after = self.at[t + 1]
            here = self.at[t][: len(after)]
            onward = local[after] * back[after]
            b = onward @ link.T
            joint = ahead[here][:, :, None] * link * onward[:, None, :]
            counts += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            back[here] = b / b.sum(1, keepdims=True)
        both = ahead * back
        return both[:, 1] / both.sum(1), counts


def _learn(x: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
    """Weights of the measures and of the neighbouring labels, by gradient steps (Adam) on the mean
    log-likelihood. ``weight`` is that of a document; the steps are the same at every size."""
    chains = _Chains(lengths)
    first = np.zeros(len(x), bool)
    first[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = True
    per_line = np.repeat(weight, lengths)
    pair_seen = np.zeros((2, 2))
    np.add.at(pair_seen, (labels[:-1][~first[1:]], labels[1:][~first[1:]]), 1.0)
    w, m, v = (np.zeros(_WIDTH + 4) for _ in range(3))
    for i in range(1, rounds + 1):
        good, counts = chains.marginals(x @ w[:_WIDTH], w[_WIDTH:].reshape(2, 2))
        slope = np.concatenate([x.T @ ((labels - good) * per_line), (pair_seen - counts).ravel()])
        slope = slope / len(x) - 1e-4 * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return w


def _fit(rounds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "label": [], "measures": [], "n": []}), *batches])
        rows = rows.sort_values("doc_id", kind="stable")
        if not rows["label"].nunique():
            yield pd.DataFrame({"weights": [np.zeros(_WIDTH + 4)]})
            return
        lengths, label = rows["n"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        x = np.vstack([_around(np.asarray(m, np.float32).reshape(-1, _MEASURES)) for m in rows["measures"]])
        x = x.astype(np.float64)
        of_line = np.repeat(label, lengths)
        share = np.array([max(1, (label == k).sum()) for k in (0, 1)])
        weight = (len(label) / 2 / share)[label]
        # The first model looks at single lines: each is a chain of its own.
        single = _learn(x, np.ones(len(x), np.int64), of_line, np.repeat(weight, lengths), rounds)
        seems = x @ single[:_WIDTH]
        worst = np.minimum.reduceat(seems, np.concatenate(([0], np.cumsum(lengths)[:-1])))
        bad = (of_line == 0) & ((seems < 0) | (seems == np.repeat(worst, lengths)))
        w = _learn(x, lengths, 1 - bad.astype(np.int64), np.ones(len(label)), rounds)
        yield pd.DataFrame({"weights": [w]})

    return run


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [_lines(t)[0] for t in batch["text"]]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "label": batch["label"],
                "measures": [r.ravel() for r in rows],
                "n": [len(r) for r in rows],
            }
        )


def fit(sample: DataFrame, rounds: int = 120) -> list[float]:
    """Weights of the field from rows (doc_id, text, label), which must be few. No rows: all zero."""
    seen = sample.withColumn("text", F.col("text").cast("binary"))
    seen = seen.mapInPandas(_measure, "doc_id long, label int, measures array<float>, n int")
    rows = seen.repartition(1).mapInPandas(_fit(rounds), "weights array<double>").collect()
    return list(rows[0]["weights"]) if rows else [0.0] * (_WIDTH + 4)


_HELD = 200_000  # lines that a task looks at together


def score(docs: DataFrame, weights: list[float], into: str = "quality") -> DataFrame:
    """``docs`` with a score (0 to 1) in the column ``into``, from the text alone; a null text is one empty line."""
    w = np.array(weights)

    def held(texts: list[bytes | None]) -> list[float]:
        out: list[float] = []
        x, sizes, lengths = [], [], []

        def flush() -> None:
            if not lengths:
                return
            n = np.array(lengths, np.int64)
            lines, size = np.concatenate(x), np.concatenate(sizes)
            good, _ = _Chains(n).marginals(lines, w[_WIDTH:].reshape(2, 2))
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            out.extend((np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)).tolist())
            x.clear(), sizes.clear(), lengths.clear()

        held_lines = 0
        for t in texts:
            measures, size = _lines(t)
            x.append(_around(measures) @ w[:_WIDTH])
            sizes.append(size.astype(np.float64))
            lengths.append(len(size))
            held_lines += len(size)
            if held_lines > _HELD:
                flush()
                held_lines = 0
        flush()
        return out

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(held(list(texts)), dtype="float64")

    return docs.withColumn(into, quality(F.col("text").cast("binary")))


def learn_and_score(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE, into: str = "quality") -> DataFrame:
    """Learns from ``labels`` (doc_id, quality) where ``usable`` holds, from at most ``sample`` documents of
    each class, and scores all of ``docs``.

    Needs doc_id and text; other columns pass through, but for one named ``into``, which is replaced. A null or empty text is scored as one empty line;
    repeated rows get the same score; without labels every score is 0.5.
    """
    return score(docs, fit(labelled(docs, labels, "quality", usable, sample)), into)
