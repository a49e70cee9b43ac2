"""Preference formatting."""

import pytest
from oracle import compare, connect

from cellcast.llm import preference, queries

SCHEMA = "pair_id long, side string, turn int, role string, text string, prompt string"


def plain(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)

    def spans(turns):
        out, at = [], 0
        for r, t in turns:
            body = show([(r, t)])
            if r == "assistant":
                out.append((at + len(f"<|{r}|>\n"), at + len(body) - 1))
            at += len(body)
        return out

    return n, show(chosen[:n]), show(chosen[n:]), show(rejected[n:]), spans(chosen[n:]), spans(rejected[n:])


U, A = (lambda t: ("user", t)), (lambda t: ("assistant", t))
CASES = {
    1: ([U("q"), A("é𝄞 yes")], [U("q"), A("no")]),
    2: ([U("q"), A("same")], [U("q"), A("same")]),
    3: ([U("q"), A("a"), U("more"), A("b")], [U("q"), A("a")]),
    4: ([], [U("q"), A("a")]),
    5: ([U("x")], [U("y")]),
    6: ([("system", ""), U("q"), A("1"), U("2"), A("3")], [("system", ""), U("q"), A("1" * 5000), U("2"), A("")]),
}


@pytest.fixture(scope="module")
def turns(spark):
    rows = []
    for pair, sides in CASES.items():
        for side, talk in zip(preference.SIDES, sides):
            rows += [(pair, side, k, role, text, "clash") for k, (role, text) in enumerate(talk)]
    rows += [(None, "chosen", 0, "user", "no pair", ""), (1, "other", 0, "user", "no side", ""), (1, None, 0, "user", "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_pairs_equal_the_plain_form(turns):
    got = {r["pair_id"]: r for r in preference.format_pairs(turns).collect()}
    assert set(got) == set(CASES)
    for pair, sides in CASES.items():
        r = got[pair]
        spans = [[tuple(s) for s in r[f"{side}_spans"]] for side in preference.SIDES]
        assert (r["n_shared"], r["prompt"], r["chosen"], r["rejected"], *spans) == plain(*sides)


def test_nulls_ties_and_repeated_turns(spark):
    rows = [(1, "chosen", 0, None, None, ""), (1, "rejected", 0, None, "", ""), (1, "chosen", 1, "user", "b", ""), (1, "chosen", 1, "user", "a", ""),
            (1, "chosen", 1, "user", "a", ""), (1, "rejected", None, "user", "first", "")]
    r = preference.format_pairs(spark.createDataFrame(rows, SCHEMA)).first()
    want = plain([("unknown", ""), U("a"), U("a"), U("b")], [U("first"), ("unknown", "")])
    assert (r["n_shared"], r["prompt"], r["chosen"], r["rejected"]) == want[:4]


def test_query_equals_sql(spark, small_dir):
    rows, _, error = compare(queries.QUERIES["op2_preference"](spark, small_dir), connect(small_dir), queries.ORACLES["op2_preference"])
    assert rows > 0 and error is None


def test_empty_table(turns):
    assert preference.format_pairs(turns.filter("pair_id < 0")).count() == 0


def test_query_halves_one_of_repeated_answers(spark, tmp_path):
    """Repeated last answers, null turns, roles and texts, conversations without an answer: as the SQL has it."""
    import duckdb
    from oracle import compare

    from cellcast.llm.queries import ORACLES, QUERIES

    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "abcdef"), (1, 1, "assistant", "abcdef"), (2, None, "assistant", "null number"),
        (2, None, "user", "x"), (3, 0, "user", "no answer"), (4, 0, None, None), (4, 1, "assistant", None), (4, 2, "user", "after"),
        (None, 0, "assistant", "no id"), (5, 0, "assistant", "one"), (5, 0, "assistant", "two"), (5, 3, "assistant", ""), (6, 1, "assistant", "a"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    turns.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    out = QUERIES["op2_preference"](spark, str(tmp_path))
    count, inexact, error = compare(out, con, ORACLES["op2_preference"])
    assert (count, inexact, error) == (5, 0, None)
    first = out.filter("conv_id = 1").first()
    assert first["n_shared"] == 2 and "abcdef" in first["prompt"] and "abc<" in first["rejected"]
