"""Toxicity: maximal-scoring segments over token log-odds, calibrated by the extreme-value law."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import cut, free_name
from granary.llm.language_id import WORD, words_of

EULER = 0.5772156649015329


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence, in linear time.

    Candidates are kept as (first, end, sum before, sum after, the last earlier candidate that began lower). A new
    one is joined to the last candidate that began lower, as long as that one also ended lower; what lies between is
    absorbed. Links lead past candidates that began higher, so none of those is looked at again; where no candidate
    began lower, all are final.
    """
    done: list[tuple[int, int, float]] = []
    held: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for k, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        first, before, after = k, total, total + s
        total = after
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0 or held[j][3] >= after:
                break
            first, before, link = held[j][0], held[j][2], held[j][4]
            del held[j:]
            j = link
        if j < 0:
            done += [(a, b, end - start) for a, b, start, end, _ in held]
            held = []
        held.append((first, k + 1, before, after, j))
    return done + [(a, b, end - start) for a, b, start, end, _ in held]


@dataclass
class ToxicityModel:
    """Token scores, the law's lambda and log K, and the logistic curve from evidence to probability."""

    scores: dict[str, float] = field(default_factory=dict)
    default: float = -1.0
    rate: float = 0.0
    log_k: float = 0.0
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def tokens(self, text: str | None) -> np.ndarray:
        get, default = self.scores.get, self.default
        found = [np.array([get(w, default) for w in words]) for words in words_of(text or "") if words]
        return np.concatenate(found) if found else np.zeros(0)

    def segments(self, x: np.ndarray) -> list[tuple[int, int, float]]:
        """Maximal segments of token scores; the stretches between scoring tokens count as one step each."""
        up = np.flatnonzero(x > 0)
        if not len(up):
            return []
        run = np.cumsum(x)
        gap = np.diff(run[up] - x[up], prepend=0.0) - np.concatenate([[0.0], x[up][:-1]])
        steps = np.empty(2 * len(up))
        steps[0::2], steps[1::2] = gap, x[up]
        return [(int(up[a // 2]), int(up[(b - 1) // 2]) + 1, s) for a, b, s in maximal_segments(steps.tolist())]

    def bits(self, score: float, n: int) -> float:
        """Minus the log of the expected number of segments that score as much by chance in n tokens."""
        return self.rate * score - self.log_k - np.log(max(n, 1))

    def evidence(self, text: str | None) -> tuple[float, float, int, float]:
        """Of a whole text: the best segment's and all significant segments' evidence, tokens, best raw score."""
        x = self.tokens(text)
        found = self.segments(x) if self.rate else []
        best = max((s for _, _, s in found), default=0.0)
        each = [self.bits(s, len(x)) for _, _, s in found]
        return max([0.0, *each]), float(sum(e for e in each if e > 0)), len(x), best

    def probability(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a + b * np.log1p(best) + c * np.log1p(total))))


def log_odds(counts: pd.DataFrame, docs: tuple[int, int], prior: float, gap: float) -> tuple[dict[str, float], float, dict[str, float]]:
    """Token scores from counts (token, clean, toxic) of documents that hold a token, and the clean share of each.

    The Dirichlet prior of a token is `prior` times its share of all documents, which draws rare tokens to 0; a
    standard error is taken off the log-odds, and gap from every token, so that a text at large scores below 0.
    """
    share = (counts["clean"] + counts["toxic"]) / max(sum(docs), 1)
    a = prior * share + 0.01
    odds = lambda y, n: np.log((y + a) / (n + prior - y - a).clip(lower=0.5))
    delta = odds(counts["toxic"], docs[1]) - odds(counts["clean"], docs[0])
    error = np.sqrt(1 / (counts["toxic"] + a) + 1 / (counts["clean"] + a))
    value = np.sign(delta) * (delta.abs() - error).clip(lower=0) - gap
    return dict(zip(counts["token"], value.clip(-5, 8).astype(float), strict=True)), -gap, dict(zip(counts["token"], counts["clean"].astype(float), strict=True))


def _rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive solution of sum p exp(rate s) = 1; 0 where there is none."""
    p = weights / weights.sum()
    if not (values[p > 0] > 0).any() or (p * values).sum() >= 0:
        return 0.0
    lo, hi = 0.0, 1.0
    while (p * np.exp(hi * values)).sum() < 1 and hi < 100:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(mid * values)).sum() > 1 else (mid, hi)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights with an intercept, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_docs: int = 20_000, prior: float = 50.0, gap: float = 0.3) -> ToxicityModel:
    """Model from labels (id, label 0 or 1; null labels and ids do not count) of documents.

    max_docs bounds the sample: where there are more labels, those whose hashed id lies below the share that gives
    max_docs of them on average. The sample, ids and labels only, is sent to the documents, which are read once for
    their texts. To the driver come the counts of all tokens of the sampled texts, and five figures for each of these.
    Repeated labels count once, repeated documents as often as they occur. Without documents of both labels, as in
    empty tables, the model knows nothing and scores every text alike.
    """
    labels = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).filter("_id IS NOT NULL AND _toxic IN (0, 1)").dropDuplicates(["_id"])
    n = labels.count()
    bound = int(min(1.0, max_docs / max(n, 1)) * (1 << 40))
    sample = labels.filter(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1 << 40)) < bound)
    rows = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "_id").select("text", "_toxic"))  # max_docs rows of 12 bytes

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        out = lambda: pd.concat([pd.DataFrame({"token": list(c), "toxic": k, "n": list(c.values())}) for k, c in enumerate(found)]).astype({"token": str, "toxic": "int32", "n": "int64"})
        for b in batches:
            for text, toxic in zip(b["text"], b["_toxic"], strict=True):
                found[toxic].update({w for words in words_of(text or "") for w in words} | {""})
                if sum(map(len, found)) > 300_000:
                    yield out()
                    for c in found:
                        c.clear()
        yield out()

    counted = rows.mapInPandas(count, "token string, toxic int, n long").groupBy("token").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    counts = counted.toArrow().to_pandas().sort_values("token", ignore_index=True)
    of_all = counts[counts["token"] == ""]
    docs_by = (int(of_all["clean"].sum()), int(of_all["toxic"].sum()))
    if not all(docs_by):
        return ToxicityModel()
    counts = counts[counts["token"] != ""].reset_index(drop=True)
    scores, default, clean = log_odds(counts, docs_by, prior, gap)
    values, weights = np.array([*scores.values(), default]), np.array([*(clean[t] + 0.5 for t in scores), 1.0])
    model = ToxicityModel({t: x for t, x in scores.items() if x != default}, default, _rate(values, weights))
    if not model.rate:
        return model

    def features(model: ToxicityModel) -> np.ndarray:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(*sent.value.evidence(t), k) for t, k in zip(b["text"], b["_toxic"], strict=True)], columns=["best", "total", "n", "raw", "toxic"])

        return np.array(rows.mapInPandas(run, "best double, total double, n long, raw double, toxic int").collect(), dtype=np.float64)

    x = features(model)
    chance = x[(x[:, 4] == 0) & (x[:, 2] > 0)]
    if len(chance):
        model.log_k = float(np.median(model.rate * chance[:, 3] - np.log(chance[:, 2]))) - EULER
        x = features(model)
    x = x[np.lexsort(x.T)]
    model.curve = tuple(_logistic(np.log1p(x[:, :2]), x[:, 4]))
    return model


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with toxic_score (0 to 1) and toxic_spans (columns of these names are replaced).

    toxic_spans: every maximal segment whose expected number by chance in a text of this length is below 1, as
    characters begin and end, score and that number e_value. Null and empty texts have no evidence. Repeated rows
    score alike, an empty table gives an empty result, and very long texts take time in proportion to their length.
    The model, of bounded size, is sent to the executors; nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<begin:int,end:int,score:double,e_value:double>>"

    @F.pandas_udf(f"score double, spans {span}")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            rows = []
            for text in texts:
                x = m.tokens(text)
                found = [(a, b, s, m.bits(s, len(x))) for a, b, s in (m.segments(x) if m.rate else [])]
                real = [f for f in found if f[3] > 0]
                total = sum(f[3] for f in real)
                p = m.probability(np.array(max([0.0, *(f[3] for f in real)])), np.array(total))
                rows.append((float(p), _spans(text, real)))
            yield pd.DataFrame(rows, columns=["score", "spans"])

    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("toxic_score", "toxic_spans")]
    judged = free_name(docs, "_toxicity_")
    return docs.select(*kept, judge(F.col(text_col).cast("string")).alias(judged)).select(*kept, F.col(f"{judged}.score").alias("toxic_score"), F.col(f"{judged}.spans").alias("toxic_spans"))


def _spans(text: str | None, found: list[tuple[int, int, float, float]]) -> list[dict]:
    if not found:
        return []
    ends = {k for a, b, _, _ in found for k in (a, b - 1)}
    places = {k: m.span() for k, m in enumerate(WORD.finditer(text)) if k in ends}
    at = lambda k, end: places[k][end] if k in places else len(text)
    return [{"begin": at(a, 0), "end": at(b - 1, 1), "score": s, "e_value": float(np.exp(-e))} for a, b, s, e in found]
