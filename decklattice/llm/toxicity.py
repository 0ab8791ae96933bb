"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine."""

from __future__ import annotations

import heapq
import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, worker_state

#: Labelled documents of each class that a model is fitted on at most (taken by smallest hash).
SAMPLE_PER_CLASS = 1000
LANDMARKS, DIM_BITS, DECAY, SPAN = 192, 16, 0.5, 5
DIMS = 1 << DIM_BITS
#: Spans: longest, and the step between the pieces of a longer token.
LONGEST, STEP = 24, 12
ROUNDS, TOPS = 3, 3
KEPT_TOKENS = 200_000
FLOOR = -1.5
_CLEAN = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
#: (second, third) offsets of the three characters of a subsequence, and its weight.
GAPS = [(j, k, DECAY ** (k - 2)) for k in range(2, SPAN) for j in range(1, k)]


def spans_of_token(token: str) -> list[str]:
    """What a token is judged by: its letters and digits, in overlapping pieces if it is long."""
    t = _CLEAN.sub("", token)
    if len(t) <= LONGEST:
        return [t] if len(t) > 2 else []
    return [t[i : i + LONGEST] for i in range(0, len(t) - STEP, STEP)]


def spelt_out(tokens: list[str]) -> list[str]:
    """Runs of three or more one-character tokens, each run as one token."""
    if sum(len(t) == 1 for t in tokens) < 3:
        return []
    out, run = [], []
    for t in [*tokens, ""]:
        if len(t) == 1:
            run.append(t)
            continue
        if len(run) > 2:
            out.append("".join(run))
        run = []
    return out


def _codes(spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed gap-weighted subsequences of three characters: (codes, weights), 0 weight where none."""
    n = max(map(len, spans)) + 2
    text = np.zeros((len(spans), n + SPAN - 1), np.uint32)
    for i, s in enumerate(spans):
        text[i, : len(s) + 2] = np.frombuffer(("^" + s + "$").encode("utf-32-le"), "<u4")
    a = text[:, :n] * np.uint32(0x9E3779B1)
    codes, weights = [], []
    for j, k, w in GAPS:
        b, c = text[:, j : n + j], text[:, k : n + k]
        h = (a ^ (b * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D) ^ (c * np.uint32(0x27D4EB2F))
        codes.append((h >> np.uint32(32 - DIM_BITS)).astype(np.int32))
        weights.append(np.where(c > 0, np.float32(w), np.float32(0)))
    return np.concatenate(codes, 1), np.concatenate(weights, 1)


@dataclass(frozen=True)
class Model:
    """A fitted model: a weight for each hashed subsequence, an offset, and the calibration."""

    weights: np.ndarray
    offset: float
    slopes: tuple[float, ...]
    shift: float

    def margins(self, spans: list[str]) -> np.ndarray:
        if not spans:
            return np.empty(0)
        out = np.empty(len(spans))
        order = sorted(range(len(spans)), key=lambda i: len(spans[i]))
        for at in range(0, len(order), 4096):
            some = order[at : at + 4096]
            codes, w = _codes([spans[i] for i in some])
            out[some] = (self.weights[codes] * w).sum(1) / np.sqrt((w * w).sum(1)) + self.offset
        return out

    def probability(self, tops: list[float]) -> float:
        """The calibrated score of a text from the margins of its most toxic spans."""
        z = self.shift + sum(a * x for a, x in zip(self.slopes, tops))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def worst(margins) -> list[float]:
    """The largest margins, as many as a text is judged by; the floor where it has fewer."""
    return (heapq.nlargest(TOPS, margins) + [FLOOR] * TOPS)[:TOPS]


NEVER = Model(np.zeros(DIMS, np.float32), FLOOR, (0.0,) * 3, -60.0)


class Scorer:
    """Margins of documents: a text is judged by its most toxic spans, each occurrence for itself."""

    def __init__(self, model: Model):
        self.model, self.new, self.old = model, {}, {}

    def _fill(self, tokens: set[str]) -> None:
        missing = [t for t in tokens if t not in self.new]
        if not missing:
            return
        if len(self.new) + len(missing) > KEPT_TOKENS:
            self.old, self.new = self.new, {}
            missing = list(tokens)
        for t in missing:
            if t in self.old:
                self.new[t] = self.old[t]
        missing = [t for t in missing if t not in self.new]
        spans, owner = [], []
        for i, t in enumerate(missing):
            for s in spans_of_token(t):
                spans.append(s)
                owner.append(i)
        best = np.full(len(missing), FLOOR)
        if spans:
            np.maximum.at(best, owner, self.model.margins(spans))
        self.new.update(zip(missing, best.tolist()))

    def margins(self, texts: list[str]) -> list[list[float]]:
        docs = []
        for t in texts:
            t = t.lower()
            tokens = t.split()
            if sum(len(x) == 1 for x in tokens) > 2:
                runs = [run for sentence in _SENTENCE.split(t) for run in spelt_out(sentence.split())]
                tokens += [s for run in runs for s in spans_of_token(run)]
            docs.append(tokens)
        self._fill(set().union(*docs))
        get = self.new.__getitem__
        return [worst(map(get, d)) for d in docs]


def _features(spans: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of spans against landmark rows (dense, scaled)."""
    out = np.empty((len(spans), len(landmarks)), np.float32)
    for at in range(0, len(spans), 2048):
        codes, w = _codes(spans[at : at + 2048])
        w = w / np.sqrt((w * w).sum(1, keepdims=True))
        for m in range(len(landmarks)):
            out[at : at + 2048, m] = (landmarks[m][codes] * w).sum(1)
    return out


def _dense(spans: list[str]) -> np.ndarray:
    codes, w = _codes(spans)
    w = w / np.sqrt((w * w).sum(1, keepdims=True))
    out = np.zeros((len(spans), DIMS), np.float32)
    for i in range(len(spans)):
        np.add.at(out[i], codes[i], w[i])
    return out


def _combined(factors: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """The sum of landmark rows times their factors, in doubles, some columns at a time: all at once would copy the rows."""
    at = range(0, DIMS, DIMS // 32)
    return np.concatenate([factors @ landmarks[:, i : i + DIMS // 32] for i in at]).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by accelerated gradient descent."""
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    weight = weight / weight.sum()
    scale = 1 / (2 * np.linalg.eigvalsh((x1 * weight[:, None]).T @ x1)[-1] + l2)
    w = v = np.zeros(x1.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        grad = -2 * x1.T @ (weight * y * slack) + l2 * v
        new = v - scale * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def fit(bags: list[tuple[int, list[str]]]) -> Model:
    """Fit on (label, spans of the sentences) of labelled documents.

    Landmarks are the spans most associated with the label and the most common others. The labels
    are those of whole texts, so the machine is trained on the sentences that show it: of each
    toxic text the spans that are landmarks or score high (else its highest), of each other text
    its highest of each round and some of its other spans. The worst mistakes of a round become
    landmarks of the next. Without both labels every score is 0.
    """
    pos, neg = [s for y, s in bags if y == 1 and s], [s for y, s in bags if y != 1 and s]
    if not pos or not neg:
        return NEVER
    count: dict[str, list[int]] = {}
    for k, side in ((0, pos), (1, neg)):
        for spans in side:
            for s in set(spans):
                count.setdefault(s, [0, 0])[k] += 1
    prior = len(neg) / len(pos)
    odds = {s: np.log((a + 0.1) * prior / (b + 1.0)) * np.sqrt(a) for s, (a, b) in count.items()}
    toxic = sorted((s for s, (a, b) in count.items() if a * prior > 2 * b), key=lambda s: (-odds[s], s))[: LANDMARKS // 2]
    common = sorted((s for s in count if s not in set(toxic)), key=lambda s: (-count[s][1], s))[: LANDMARKS - len(toxic)]
    if not toxic:
        return NEVER
    shown = set(toxic)
    rng = np.random.default_rng(7)
    chosen = [[x for x in s if x in shown] or [max(s, key=lambda x: (odds[x], x))] for s in pos]
    hard = [{max(s, key=lambda x: (odds[x], x)), *(s[i] for i in rng.integers(0, len(s), 3))} for s in neg]
    all_spans, marked = sorted(count), [*toxic, *common]
    for _ in range(ROUNDS):
        marks = _dense(marked)
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
        root = vectors / np.sqrt(np.maximum(values, 1e-4))  # K^(-1/2) up to a rotation
        times: dict[str, list[float]] = {}
        for k, side in ((0, chosen), (1, hard)):
            for own in side:
                for x in own:
                    times.setdefault(x, [0.0, 0.0])[k] += 1 / len(side)
        spans = sorted(times)
        phi = _features(spans, marks) @ root
        cost = np.array([times[x] for x in spans])
        w, offset = _svm(np.concatenate([phi, phi]), np.repeat([1.0, -1.0], len(spans)), np.concatenate([cost[:, 0], cost[:, 1]]))
        weights = _combined(root @ w, marks)
        del marks, phi
        model = Model(weights, offset, (), 0.0)
        margin = dict(zip(all_spans, model.margins(all_spans)))
        chosen = [[x for x in s if x in shown or margin[x] > 0.5] or [max(s, key=lambda x: (margin[x], x))] for s in pos]
        wrong = [max(s, key=lambda x: (margin[x], x)) for s in neg]
        hard = [h | {x} for h, x in zip(hard, wrong)]
        near = sorted((x for x in set(wrong) if x not in marked and count[x][0] * prior <= 4 * count[x][1]), key=lambda x: (-margin[x], x))
        marked = marked + near[: LANDMARKS // 4]
    x = np.array([[*worst(margin[x] for x in s), 1.0] for s in [*pos, *neg]])
    y = np.concatenate([np.ones(len(pos)), np.zeros(len(neg))])
    beta = np.zeros(TOPS + 1)
    ridge = np.diag([0.02] * TOPS + [1e-6]) * len(y) / 100
    for _ in range(50):  # logistic regression, Newton steps; the natural share of labels is kept
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ beta)
        beta = beta - np.clip(step, -2, 2)
    return Model(weights, offset, tuple(np.maximum(beta[:TOPS], 0).tolist()), float(beta[TOPS]))


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels no model sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sentence_spans(batches):
    import pyarrow as pa

    for b in batches:
        out = []
        for text in b.column(2).to_pylist():
            own: Counter[str] = Counter()
            for sentence in _SENTENCE.split((text or "").lower()):
                tokens = sentence.split()
                for t in tokens + spelt_out(tokens):
                    own.update(spans_of_token(t))
            out.append(sorted(s for s, n in own.items() for _ in range(min(n, TOPS))))
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.list_(pa.string()))], ["toxic", "spans"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, none of them held out.

    Documents with two labels count as toxic if either says so; labels without a document, null
    ids and null labels are ignored; a null or empty text has a label but no spans. Without both
    labels every score is that of a text without spans.
    """
    seen = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    seen = seen.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = None
    for y in (1, 0):
        some = seen.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = some if drawn is None else drawn.union(some)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = named.join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text")
    bags = rows.mapInArrow(_sentence_spans, "toxic int, spans array<string>").toLocalIterator()
    model = fit(sorted((r.toxic, list(map(sys.intern, r.spans))) for r in bags))
    give_back()  # the driver's memory, as later stages need it
    return model


def worker_scorer(value: tuple) -> Scorer:
    """The worker's scorer of a model: one for all its tasks. Tasks import it, as what is sent with them carries no state."""
    return worker_state(("scorer", *value[1:]), lambda: Scorer(Model(*value)))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts score as a text without any span: the lowest score. A null id counts as
    not held out; repeated rows score alike; an empty table gives no rows; other columns are not
    read. The model is of fixed size and goes to the tasks with the function.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), is_held_out(F.col(id_col)).alias("held_out"))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.weights, model.offset, model.slopes, model.shift))

    def run(batches):
        import pyarrow as pa

        from .toxicity import worker_scorer

        scorer = worker_scorer(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                s = [scorer.model.probability(m) for m in scorer.margins([t or "" for t in b.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``score`` would predict 1 for, columns and types as they are."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.weights, model.offset, model.slopes, model.shift))
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        from .toxicity import worker_scorer

        scorer = worker_scorer(held.value)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                b = whole.slice(begin, 256)
                margins = scorer.margins([t or "" for t in b.column(at).to_pylist()])
                yield b.filter(pa.array([scorer.model.probability(m) < threshold for m in margins], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
