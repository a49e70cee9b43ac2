"""Quality rules by weak supervision.

Every rule votes good (1) or bad (-1) on a document or abstains (0). Expectation-maximisation
over the counts of vote patterns learns how far each rule can be trusted; the posterior of good
quality, not the conjunction of all rules, decides.

The only thing that reaches the driver is the table of vote patterns: at most 3 ** len(RULES)
rows whatever the corpus. Text is read once, per document, without a shuffle.

Defined results: null or empty text has no words and fails the base rule; a text of any length is
one row; repeated rows and equal ids give a row each; an empty table gives no rows; columns other
than the text are passed on, and a column that bears a result's name is replaced by the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.llm.common import full_text, written

FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
    "n_bangs", "n_stops", "n_symbol_words", "n_symbol_lines",
)
WHITE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
STOPS = (b".", b"?", b"!", b":")
TRAILING = bytes(range(128, 192))


def repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that stand at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes, v = np.fromiter(map(number.__getitem__, words), np.int64, n), len(number)
    pairs = codes[:-1] * v + codes[1:]
    if v > 2_000_000:  # three factors would leave 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * v + codes[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= twice
    return int(covered.sum())


def text_features(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split on the six ASCII white-space characters only
    dense = raw.translate(None, WHITE)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = count(SYMBOLS)
    marked = lambda parts: sum(len(x.translate(None, SYMBOLS)) < len(x) for x in parts) if symbols else 0
    return (
        len(words), len(dense.translate(None, TRAILING)), symbols, len(lines) - len(set(lines)),
        repeated_words(words), len(lines), count(UPPER), count(LETTERS), raw.count(b"!"),
        sum(w.endswith(STOPS) for w in words), marked(words), marked(lines),
    )


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts the rules look at."""

    @F.arrow_udf("struct<" + ",".join(f"{f}:bigint" for f in FEATURES) + ">")
    def features(texts: pa.Array) -> pa.Array:
        rows = [text_features(t.as_py() or "") for t in texts]
        columns = np.array(rows, np.int64).reshape(len(rows), len(FEATURES)).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(FEATURES))

    clash = [c for c in df.columns if c.lower() == "features"]
    return df.drop(*clash).withColumn("features", features.asNondeterministic()(full_text(text)))


def _share(part: str, whole: str) -> Column:
    return F.col(f"features.{part}") / F.greatest(F.col(f"features.{whole}"), F.lit(1))


def _vote(good: Column | None, bad: Column) -> Column:
    out = F.when(bad, -1)
    return (out if good is None else out.when(good, 1)).otherwise(0)


#: Rules: name to vote. A rule that only warns never votes good.
RULES: dict[str, Callable[[], Column]] = {
    "length": lambda: _vote(None, F.col("features.n_words") < 50),
    "word_length": lambda: _vote(None, ~_share("word_chars", "n_words").between(2.5, 14)),
    "symbols": lambda: _vote(_share("n_symbols", "n_words") < 0.01, _share("n_symbols", "n_words") > 0.1),
    "symbol_words": lambda: _vote(_share("n_symbol_words", "n_words") < 0.01, _share("n_symbol_words", "n_words") > 0.08),
    "symbol_lines": lambda: _vote(None, (F.col("features.n_symbols") > 5) & (_share("n_symbol_lines", "n_lines") > 0.3)),
    "repeated_lines": lambda: _vote(None, _share("n_dup_lines", "n_lines") > 0.3),
    "repeated_phrases": lambda: _vote(None, _share("n_repeat_words", "n_words") > 0.35),
    "capitals": lambda: _vote(None, _share("n_upper", "n_letters") > 0.3),
    "shouting": lambda: _vote(None, _share("n_bangs", "n_words") > 0.1),
    "sentences": lambda: _vote(
        _share("n_stops", "n_words").between(0.02, 0.25),
        (F.col("features.n_words") >= 50) & ~_share("n_stops", "n_words").between(0.002, 0.5),
    ),
}

#: Start and prior of the model: chance of each vote (bad, abstain, good) in bad and in good documents.
PRIOR_GOOD = 0.85
PRIOR_BAD_DOC = (0.35, 0.45, 0.2)
PRIOR_GOOD_DOC = (0.005, 0.295, 0.7)
PRIOR_WARNS = ((0.35, 0.65, 0.0), (0.005, 0.995, 0.0))
PRIOR_WEIGHT = 0.05
#: Rules are written so that a warning on a good document is rare: the fit keeps it at or below this.
MAX_FALSE_ALARM = 0.01


def fit_votes(patterns: np.ndarray, counts: np.ndarray, warns_only: np.ndarray, rounds: int = 200):
    """(prior of good, table[class, rule, vote + 1]) by expectation-maximisation with pseudo-counts.

    Pseudo-counts are a fixed share of the documents, so the fit does not depend on corpus size.
    """
    rules = patterns.shape[1]
    start = np.empty((2, rules, 3))
    for r in range(rules):
        start[:, r] = PRIOR_WARNS if warns_only[r] else (PRIOR_BAD_DOC, PRIOR_GOOD_DOC)
    start = np.maximum(start, 1e-4)
    start /= start.sum(axis=2, keepdims=True)
    total = counts.sum()
    if total == 0:
        return PRIOR_GOOD, start
    weight, table, good = PRIOR_WEIGHT * total, start.copy(), PRIOR_GOOD
    onehot = patterns[:, :, None] == np.arange(-1, 2)
    for _ in range(rounds):
        post = posterior(patterns, good, table)
        fresh = np.empty_like(table)
        for c, p in enumerate((1 - post, post)):
            seen = np.einsum("n,nrv->rv", p * counts, onehot)
            fresh[c] = (seen + weight * start[c]) / ((p * counts).sum() + weight)
        alarm = np.minimum(fresh[1, :, 0], MAX_FALSE_ALARM)
        fresh[1, :, 1:] *= ((1 - alarm) / (1 - fresh[1, :, 0]))[:, None]
        fresh[1, :, 0] = alarm
        prior = (float((post * counts).sum()) + weight * PRIOR_GOOD) / (total + weight)
        moved = abs(fresh - table).max() + abs(prior - good)
        table, good = fresh, prior
        if moved < 1e-9:
            break
    return good, table


def posterior(patterns: np.ndarray, good: float, table: np.ndarray) -> np.ndarray:
    pick = lambda c: np.log(table[c][np.arange(patterns.shape[1]), patterns + 1]).sum(axis=1)
    return 1 / (1 + np.exp(np.log(1 - good) + pick(0) - np.log(good) - pick(1)))


def score(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``df`` with votes, posterior, base_failed and kept (and ``features``)."""
    names = list(RULES)
    out = {"votes", "posterior", "base_failed", "kept"}
    df = df.drop(*[c for c in df.columns if c.lower() in out])
    votes = F.array(*[RULES[n]().cast("int") for n in names])
    voted = with_features(df, text).withColumn("votes", votes)
    failed = (F.col("features.n_words") < 50) | (
        100 * F.col("features.n_repeat_words") > 50 * F.col("features.n_words")
    )
    voted = written(voted.withColumn("base_failed", failed), "votes")
    seen = voted.groupBy(*[F.col("votes")[i].alias(n) for i, n in enumerate(names)]).count().collect()
    patterns = np.array([tuple(r)[:-1] for r in seen], int).reshape(len(seen), len(names))
    counts = np.array([r["count"] for r in seen], float)
    warns = np.array([n not in ("symbols", "symbol_words", "sentences") for n in names])
    good, table = fit_votes(patterns, counts, warns)
    # Naive Bayes is a sum over rules: no pattern table has to be joined.
    logit = F.lit(float(np.log(good) - np.log(1 - good)))
    weights = np.log(table[1]) - np.log(table[0])
    for i in range(len(names)):
        logit = logit + F.get(F.array(*[F.lit(float(w)) for w in weights[i]]), F.col("votes")[i] + 1)
    probability = 1 / (1 + F.exp(-logit))
    return voted.withColumn("posterior", probability).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )

