"""Preference formatting: one prompt for what two conversations share, and a masked completion for each.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once, as the
prompt. What follows is rendered per side with the spans a model may learn from: text and end mark of
assistant turns. Headers and other roles are masked. Column expressions only; turns are shuffled once, by pair.
A pair is one training record, so its turns meet in one row; nothing else is gathered.

Defined results: null text is empty, a null role is "unknown"; turns follow each other by number, then role, then
text; repeated turns stay; a side without turns is an empty conversation; equal sides give two empty
completions, and where one side is the start of the other its completion is empty; rows without a pair id or
with another side belong to no pair; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.llm.common import running_starts

LEARN = "assistant"
SIDES = ("chosen", "rejected")


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(_header(turn), turn["text"], F.lit("<|end|>\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column) -> Column:
    """Spans (start, end) of a rendered completion that a model may learn from, in code points, end exclusive."""
    placed = F.arrays_zip(
        turns.alias("turn"), running_starts(F.transform(turns, lambda t: F.length(_rendered(t)))).alias("at")
    )
    return F.transform(
        F.filter(placed, lambda p: p["turn"]["role"] == LEARN),
        lambda p: F.struct(
            (p["at"] + F.length(_header(p["turn"]))).alias("start"),
            (p["at"] + F.length(_rendered(p["turn"])) - 1).alias("end"),
        ),
    )


def format_pairs(turns: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, n_shared, prompt, chosen, rejected, chosen_spans, rejected_spans) of (pair, side, turn, role, text)."""
    turn = F.struct(
        "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sides = [F.array_sort(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in SIDES]
    rows = turns.filter(F.col(pair).isNotNull() & F.col("side").isin(*SIDES)).groupBy(pair).agg(*sides)
    # Turn numbers order the turns; only role and text are compared.
    bare = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = rows.select(pair, *[bare(F.col(s)).alias(s) for s in SIDES])
    both = F.least(F.size("chosen"), F.size("rejected"))
    index = F.when(both > 0, F.sequence(F.lit(0), both - 1)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(index, lambda i: F.get("chosen", i) != F.get("rejected", i))
    rows = rows.withColumn("n_shared", F.coalesce(F.array_min(differ), both))
    tails = {s: F.slice(F.col(s), F.col("n_shared") + 1, F.size(s)) for s in SIDES}
    rows = rows.select(
        pair, "n_shared", F.slice("chosen", F.lit(1), F.col("n_shared")).alias("shared"),
        *[F.when(F.size(s) > F.col("n_shared"), t).otherwise(F.slice(s, 1, 0)).alias(f"{s}_turns") for s, t in tails.items()],
    )
    return rows.select(
        pair, F.col("n_shared").cast("long").alias("n_shared"), _joined(F.col("shared")).alias("prompt"),
        *[_joined(F.col(f"{s}_turns")).alias(s) for s in SIDES],
        *[_spans(F.col(f"{s}_turns")).alias(f"{s}_spans") for s in SIDES],
    )


def halved_answers(conversations: DataFrame) -> DataFrame:
    """Turns of preference pairs made of plain conversations: the last answer against its first half.

    Turns follow each other by number (null first), role and text, and get their place as new number. The last answer is the one with
    the highest place, so of repeated last answers exactly one is halved. A null role is "unknown", a null text empty. Conversations
    without an answer or without id make no pair; an empty table gives no rows.
    """
    turn = F.struct(
        "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = conversations.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    places = F.sequence(F.lit(0), F.size("_t") - 1)
    rows = rows.withColumn("_last", F.array_max(F.filter(places, lambda i: F.get("_t", i)["role"] == LEARN))).filter("_last IS NOT NULL")
    both = rows.withColumn("side", F.explode(F.array(*map(F.lit, SIDES)))).select("conv_id", "side", "_last", F.posexplode("_t").alias("_i", "_r"))
    is_last = (F.col("_i") == F.col("_last")) & (F.col("side") == "rejected")
    text = F.col("_r.text")
    half = F.left(text, F.floor(F.length(text) / 2).cast("int"))
    return both.select(
        F.col("conv_id").alias("pair_id"), "side", F.col("_i").alias("turn"), F.col("_r.role").alias("role"), F.when(is_last, half).otherwise(text).alias("text")
    )


def oracle_sql() -> str:
    """Pairs of halved answers formatted by DuckDB, spans listed as start-end."""
    rendered = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"
    side = lambda name, text: f"""{name} AS (SELECT conv_id, pos, k, role, {text} AS text FROM turns JOIN final USING (conv_id))"""
    tail = lambda name: f"""{name}_out AS (SELECT conv_id, string_agg(body, '' ORDER BY pos) AS body,
        string_agg(CASE WHEN role = '{LEARN}' THEN concat(here + length(role) + 5, '-', here + length(body) - 1) END, ',' ORDER BY pos)
        AS spans FROM (SELECT conv_id, pos, role, {rendered} AS body, coalesce(sum(length({rendered})) OVER
        (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS here
        FROM {name} JOIN shared USING (conv_id) WHERE pos >= n) GROUP BY conv_id)"""  # noqa: E731
    return f"""
    WITH turns AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
    final AS (SELECT conv_id, max(pos) AS k FROM turns WHERE role = '{LEARN}' GROUP BY conv_id),
    {side("chosen", "text")}, {side("rejected", "CASE WHEN pos = k THEN left(text, length(text) // 2) ELSE text END")},
    shared AS (SELECT conv_id, min(CASE WHEN c.text = r.text THEN 1000000 ELSE pos END) AS n, count(*) AS total
        FROM chosen c JOIN rejected r USING (conv_id, pos) GROUP BY conv_id),
    prompt AS (SELECT conv_id, string_agg({rendered}, '' ORDER BY pos) AS body FROM chosen JOIN shared USING (conv_id)
        WHERE pos < n GROUP BY conv_id),
    {tail("chosen")}, {tail("rejected")}
    SELECT conv_id, CAST(least(n, total) AS BIGINT) AS n_shared, coalesce(prompt.body, '') AS prompt,
        coalesce(chosen_out.body, '') AS chosen, coalesce(rejected_out.body, '') AS rejected,
        coalesce(chosen_out.spans, '') AS chosen_spans, coalesce(rejected_out.spans, '') AS rejected_spans
    FROM shared LEFT JOIN prompt USING (conv_id) LEFT JOIN chosen_out USING (conv_id) LEFT JOIN rejected_out USING (conv_id)"""
