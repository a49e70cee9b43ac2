"""Quality classifier by co-training.

Two logistic models see different views of a document: its content (hashed words and word shapes,
repetition) and its page metadata (source, language, length, layout). Both start from labelled rows. In each
round either model labels documents it is sure of for the other one, drawn evenly from all unlabelled
documents. At the end each view is calibrated on labelled rows that took no part in fitting, and the calibrated
log-odds are added to score every document.

Bounds: fitting takes at most ``MAX_LABELLED`` labelled rows and ``PER_ROUND`` rows of each class, view and round,
an even draw by hash. Rows are counted first and tasks send on only the share that is needed and half as many
again, so what reaches the driver (about 400 bytes a row) does not grow with documents or tasks. Candidate search
and scores cover all documents.

Defined results: null or empty text gives zero content features, null metadata zero ones; without labels of
both classes nothing can be learnt and every document scores 0.5 and is kept; repeated rows and
equal ids get a row each (labels of one id are averaged); an empty table gives no rows; other columns pass
through, and a column named like a result is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.llm.common import written
from cellcast.llm.quality_rules import SYMBOLS, UPPER, WHITE, repeated_words

MAX_LABELLED, PER_ROUND, ROUNDS, CONFIDENT = 20_000, 1_000, 3, 0.95
WORD_BUCKETS, SHAPES, SOURCES, LANGS = 128, 64, 16, 8
CONTENT, META = WORD_BUCKETS + SHAPES + 3, SOURCES + LANGS + 11
_SHAPE = bytes.maketrans(
    bytes(range(65, 91)) + bytes(range(97, 123)) + b"0123456789" + bytes(range(128, 256)),
    b"A" * 26 + b"a" * 26 + b"9" * 10 + b"a" * 128,
)
DIGITS = b"0123456789"


class _Codes(dict):
    """Bucket of a word and of its shape as one number, remembered up to a limit."""

    def __missing__(self, word: bytes) -> int:
        shape = word[:24].translate(_SHAPE)
        short = bytes(c for i, c in enumerate(shape) if i == 0 or c != shape[i - 1])
        code = xxhash.xxh32_intdigest(word.lower()) % WORD_BUCKETS * SHAPES + xxhash.xxh32_intdigest(short) % SHAPES
        if len(self) < 200_000:
            self[word] = code
        return code


def content_view(text: str, codes: dict) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    out, n = np.zeros(CONTENT, np.float32), len(words)
    if n:
        c = np.fromiter(map(codes.__getitem__, words), np.int64, n)
        out[:WORD_BUCKETS] = np.sqrt(np.bincount(c // SHAPES, minlength=WORD_BUCKETS) / n)
        out[WORD_BUCKETS:-3] = np.sqrt(np.bincount(c % SHAPES, minlength=SHAPES) / n)
        out[-3:] = len(set(words)) / n, repeated_words(words) / n, min(1.0, np.log1p(n) / 12)
    return out


def meta_view(text: str, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    lines, size = [x for x in raw.split(b"\n") if x.strip()], max(len(raw), 1)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    out = np.zeros(META, np.float32)
    if source is not None:
        out[xxhash.xxh32_intdigest(source) % SOURCES] = 1
    if lang is not None:
        out[SOURCES + xxhash.xxh32_intdigest(lang) % LANGS] = 1
    n = max(len(lines), 1)
    out[SOURCES + LANGS :] = (
        np.log1p(max(n_chars or 0, 0)) / 12, np.log1p(len(lines)) / 8, np.log1p(size / n) / 8, 1 - len(set(lines)) / n if lines else 0,
        sum(len(x) < 20 for x in lines) / n, share(SYMBOLS), share(UPPER), share(DIGITS), share(b"!?"), share(WHITE), share(b".,;:"),
    )
    return out


def _views(texts, sources, langs, sizes, codes) -> tuple[np.ndarray, np.ndarray]:
    content = np.empty((len(texts), CONTENT), np.float32)
    meta = np.empty((len(texts), META), np.float32)
    for i, row in enumerate(zip(texts, sources, langs, sizes)):  # one text at a time as Python text
        text, source, lang, n_chars = (v.as_py() for v in row)
        content[i] = content_view(text or "", codes)
        meta[i] = meta_view(text or "", source, lang, n_chars)
    return content, meta


def _inputs(df: DataFrame, text: str) -> list[Column]:
    """Text, source, lang and n_chars; metadata that the table lacks counts as null."""
    have = {c.lower() for c in df.columns}
    pick = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    return [F.col(text).cast("string"), pick("source", "string"), pick("lang", "string"), pick("n_chars", "long")]


@dataclass
class Logistic:
    """Ridge logistic model on standardised features; scale and shift calibrate its log-odds."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread @ self.weights[:-1] + self.weights[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.raw(x) * self.scale + self.shift, -30, 30)


CHUNK = 2048


def newton(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, mean: np.ndarray | float = 0.0,
    spread: np.ndarray | float = 1.0, rounds: int = 30,
) -> np.ndarray:
    """Weights of a logistic model with a constant as its last feature.

    Features are standardised and summed up in chunks, so that rows stay in memory once, in half precision.
    """
    width = x.shape[1] + 1
    beta, penalty = np.zeros(width), np.full(width, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        slope, bend = -penalty * beta, np.diag(penalty)
        for at in range(0, len(x), CHUNK):
            rows = slice(at, at + CHUNK)
            part = np.ones((len(y[rows]), width))
            part[:, :-1] = (x[rows].astype(np.float64) - mean) / spread
            p = 1 / (1 + np.exp(-np.clip(part @ beta, -30, 30)))
            slope += part.T @ (w[rows] * (y[rows] - p))
            bend += (part * (w[rows] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ part
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 5.0) -> Logistic:
    mean = x.mean(0, dtype=np.float64)
    square = sum(((x[a : a + CHUNK].astype(np.float64) - mean) ** 2).sum(0) for a in range(0, len(x), CHUNK))
    spread = np.sqrt(square / len(x))
    spread[spread < 1e-3] = 1.0
    # Both classes weigh the same, so that the rarer one is learnt too.
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    return Logistic(mean, spread, newton(x, y, weight, ridge, mean, spread))


def calibrate(model: Logistic, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on rows that took no part in the fit."""
    if len(np.unique(y)) == 2:
        model.scale, model.shift = newton(model.raw(x)[:, None], y, np.ones(len(y)), 1e-3)


def _share(order: Column, most: int, there: int) -> Column:
    """An even draw of about 1.5 times ``most`` of ``there`` rows by their hash; all rows if they are few."""
    part = min(1.0, 1.5 * most / max(there, 1))
    return F.pmod(order, F.lit(1 << 30)) < int(part * (1 << 30))


def _drawn(df: DataFrame, most: int) -> list:
    return sorted(df.collect(), key=lambda r: (r["draw"], r["content"], r["meta"], r["quality"]))[:most]


def _matrix(rows: list, name: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), np.float16).reshape(len(rows), width)


def train(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[Logistic, Logistic, float] | None:
    """Calibrated content and metadata models and the log-odds of good among labels."""

    @F.arrow_udf("struct<content:binary,meta:binary>")
    def views(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        both = _views(texts, sources, langs, sizes, _Codes())
        return pa.StructArray.from_arrays(
            [pa.array([r.tobytes() for r in v.astype(np.float16)], pa.binary()) for v in both], names=["content", "meta"]
        )

    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("quality")
    )
    key = F.xxhash64("doc_id", F.lit(7))
    seen = df.select(F.col(doc).cast("long").alias("doc_id"), views.asNondeterministic()(*_inputs(df, text)).alias("v"))
    table = written(
        seen.join(known, "doc_id", "left").select("quality", "v.*", F.xxhash64("doc_id", "v").alias("draw"), key.alias("fold")),
        "views",
    )
    labelled = table.filter("quality IS NOT NULL")
    rows = _drawn(labelled.filter(_share(F.col("draw"), MAX_LABELLED, labelled.count())), MAX_LABELLED)
    if len({r["quality"] for r in rows}) < 2:
        return None
    y = np.array([r["quality"] for r in rows], float)
    view = {"content": _matrix(rows, "content", CONTENT), "meta": _matrix(rows, "meta", META)}
    apart = np.array([r["fold"] % 5 == 0 for r in rows])
    del rows
    if min(len(np.unique(y[apart])), len(np.unique(y[~apart]))) < 2:
        apart = np.zeros(len(y), bool)
    sets = {v: (x[~apart], y[~apart]) for v, x in view.items()}
    check = apart if apart.any() else ~apart
    width = {"content": CONTENT, "meta": META}
    for turn in range(ROUNDS + 1):
        models = {v: fit(*sets[v]) for v in sets}
        for v, m in models.items():
            calibrate(m, view[v][check], y[check])
        if turn == ROUNDS:
            break
        for teacher, pupil in (("content", "meta"), ("meta", "content")):
            sure = _odds_udf(models[teacher], width[teacher])(teacher)
            edge = float(np.log(CONFIDENT / (1 - CONFIDENT)))
            pool = table.filter("quality IS NULL").withColumn("odds", sure)
            order = F.xxhash64("draw", F.lit(turn))
            tests = {1.0: F.col("odds") >= edge, 0.0: F.col("odds") <= -edge}
            counts = pool.agg(*[F.count_if(t) for t in tests.values()]).first()
            wanted = None
            for (label, test), n in zip(tests.items(), counts):
                here = F.when(test & _share(order, PER_ROUND, n), label)
                wanted = here if wanted is None else F.coalesce(wanted, here)
            few = pool.select(pupil, order.alias("draw"), wanted.alias("label")).filter("label IS NOT NULL").collect()
            for label in tests:
                picked = sorted((r for r in few if r["label"] == label), key=lambda r: (r["draw"], r[pupil]))[:PER_ROUND]
                if picked:
                    x, t = sets[pupil]
                    added = _matrix(picked, pupil, width[pupil])
                    sets[pupil] = np.vstack([x, added]), np.append(t, np.full(len(picked), label))
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    return models["content"], models["meta"], float(np.log(prior / (1 - prior)))


def _odds_udf(model: Logistic, width: int):
    @F.arrow_udf("double")
    def odds(rows: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(rows.to_pylist()), np.float16).reshape(len(rows), width)
        return pa.array(model.odds(x.astype(np.float32)))

    return odds.asNondeterministic()


def score(
    df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.5
) -> DataFrame:
    """``df`` with content_score, meta_score, score and kept."""
    names = ["content_score", "meta_score", "score", "kept"]
    df = df.drop(*[c for c in df.columns if c.lower() in names])
    models = train(df, labels, doc, text)
    if models is None:
        return df.withColumns({n: F.lit(0.5) for n in names[:3]}).withColumn("kept", F.lit(True))
    content, meta, prior = models

    @F.arrow_udf("struct<content:double,meta:double>")
    def judged(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        a, b = _views(texts, sources, langs, sizes, _Codes())
        return pa.StructArray.from_arrays([pa.array(content.odds(a)), pa.array(meta.odds(b))], names=["content", "meta"])

    chance = lambda odds: 1 / (1 + F.exp(-odds))
    out = df.withColumn("__odds", judged.asNondeterministic()(*_inputs(df, text)))
    a, b = F.col("__odds.content"), F.col("__odds.meta")
    out = out.withColumns(
        {"content_score": chance(a), "meta_score": chance(b), "score": chance(a + b - prior)}
    ).drop("__odds")
    return out.withColumn("kept", F.col("score") >= threshold)
