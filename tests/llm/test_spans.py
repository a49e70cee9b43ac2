"""Operators that answer each text by itself: personal data, secrets, license scans."""

import random

import brute
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from cellcast.llm import license_scan, pii, queries, secret_ledger
from cellcast.llm.common import listed, running_starts


def kinds(row, column, base):
    return [(s["kind"], s["start"], s["end"]) for s in row[column] if s["kind"] in base]


def test_running_starts(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        a = spark.range(1).select(F.transform(F.slice(F.sequence(F.lit(0), F.lit(n)), 2, n), lambda x: x).cast("array<int>").alias("a"))
        got = a.select(running_starts(F.col("a")).alias("s"), "a").first()
        assert list(got["s"]) == [sum(got["a"][:i]) for i in range(n)]


def test_personal_data_equals_brute_force(odd, odd_rows):
    rows = pii.find(odd).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert kinds(r, "personal", pii.BASE) == brute.pii_base(r["text"]), r["text"]
    more = {s["kind"] for r in rows for s in r["personal"]} - set(pii.BASE)
    assert more == {"iban", "national_id"}


def test_checksums(spark):
    df = spark.createDataFrame([("4111111111111111", "DE89370400440532013000"), ("4111111111111112", "DE88370400440532013000")], "c string, i string")
    got = df.select(pii.passes_luhn(F.col("c")).alias("c"), pii.passes_mod97(F.col("i")).alias("i")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False)]


def test_context_raises_the_score(spark):
    df = spark.createDataFrame([(0, "my ssn 123-45-6789"), (1, "part 123-45-6789")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["personal"]] for r in pii.find(df).collect()}
    assert got == {0: [("national_id", 0.6)], 1: []}


@pytest.mark.parametrize("text", ["a" * 200_000 + "@", "1." * 20_000, "+1" + "(" * 100_000, "a@b" + ".c" * 20_000, "1 " * 50_000])
def test_long_runs_stay_linear(spark, text):
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    row = pii.find(df).first()
    want = [] if text[-1] == "@" else brute.pii_base(text)  # the plain pattern is quadratic on this one
    assert kinds(row, "personal", pii.BASE) == want


def test_secrets_equal_brute_force(odd, odd_rows):
    rows = secret_ledger.scan(odd).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert kinds(r, "secrets", secret_ledger.BASE) == brute.secret_base(r["text"]), r["text"]


def test_ledger_scans_each_pair_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([(0, "token=abcdefgh1"), (1, "token=abcdefgh1"), (2, "none")], "doc_id long, text string")
    assert [len(r["secrets"]) for r in secret_ledger.scan(one, path).orderBy("doc_id").collect()] == [1, 1, 0]
    rules = len(secret_ledger.RULES)
    assert spark.read.parquet(path).count() == 2 * rules
    two = one.unionByName(spark.createDataFrame([(3, "secret: 123456789")], "doc_id long, text string"))
    secret_ledger.scan(two, path)
    assert spark.read.parquet(path).count() == 3 * rules
    raised = tuple(secret_ledger.Rule("hex", "[0-9]{9}", "[0-9]{9}", version=2) if r.name == "hex" else r for r in secret_ledger.RULES)
    got = secret_ledger.scan(two, path, rules=raised).filter("doc_id = 3").first()
    assert spark.read.parquet(path).count() == 3 * rules + 3
    assert [s["kind"] for s in got["secrets"]] == ["assign", "hex"]


def test_redaction(spark):
    df = spark.createDataFrame([(0, 'é token="abcdefgh12" x ' + "ab" * 20), (1, None), (2, "clean")], "doc_id long, text string")
    got = secret_ledger.redact(secret_ledger.scan(df)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ['é [SECRET]" x [SECRET]', None, "clean"]


def test_license_scan_equals_sql(spark, odd, odd_rows, tmp_path):
    folder = tmp_path / "docs"
    odd.select("doc_id", "text").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    rows, inexact, error = compare(license_scan.scan(odd), con, license_scan.oracle_sql())
    assert (rows, error) == (len(odd_rows), None)


def test_license_filters_lose_nothing(spark):
    """Every template, with words missing or moved and at odd places, against plain counting over all windows."""
    rng = random.Random(3)
    rows = []
    for i, (t, *_) in enumerate(license_scan.TEMPLATES):
        words = license_scan._tokens(t)
        rows += [(10 * i, "x " * 37 * i + " ".join(words)), (10 * i + 1, " ".join(words[1:])), (10 * i + 2, " ".join(words[: len(words) // 2]))]
        rows += [(10 * i + 3, " ".join(reversed(words))), (10 * i + 4, "y " * 300 + " ".join(w for w in words if rng.random() < 0.9) + " z" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in license_scan.scan(df).collect()}
    for doc, text in rows:
        words = text.split()
        want = {lab for p, lab in license_scan.PHRASES.items() if f" {p} " in f" {text} "}
        for t, lab, telling, share in license_scan.TEMPLATES:
            tokens, stride = set(license_scan._tokens(t)), license_scan.stride_of(len(license_scan._tokens(t)))
            blocks = [set(words[at : at + 2 * stride]) for at in range(0, len(words), stride)]
            if any(len(b & tokens) >= share * len(tokens) - 1e-9 and set(telling.split()) <= b for b in blocks):
                want.add(lab)
        assert got[doc] == want, text


def test_siblings_are_told_apart(spark):
    """A notice gets the label of its own license only (and those of the fixed phrases)."""
    rows = [
        ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}), ("Licensed under CC BY 4.0.", {"cc-by"}),
        ("Licensed under CC BY-SA 4.0.", {"cc-by", "cc-by-sa-4.0"}),
        ("modify it under the terms of the GNU General Public License", {"gpl"}),
        ("under the terms of the GNU Lesser General Public License", {"gpl", "lgpl"}),
        ("under the terms of the GNU Affero General Public License", {"gpl", "agpl"}),
        ("released under the BSD license", set()), ("Released under the MIT license.", {"mit"}),
        ("Mozilla Public License version 2.0", set()), ("Subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}),
        ("Eclipse Public License version 2.0", {"epl-2.0"}), ("the license of the author; released under the terms", set()),
        ("words " * 500 + license_scan.MIT_TEXT + " more" * 90, {"mit"}), (license_scan.BSD_TEXT, {"bsd"}), (license_scan.ISC_TEXT, {"isc"}),
        ("some prose before. " + " ".join(license_scan.MIT_TEXT.split()[60:]), set()),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in license_scan.scan(df).collect()}
    for i, (text, want) in enumerate(rows):
        assert got[i] == want, text[:80]


def test_telling_words_are_words_of_their_template():
    for t, _, telling, _ in license_scan.TEMPLATES:
        assert set(telling.split()) <= set(license_scan._tokens(t))


def test_empty_tables(none):
    for out in (pii.find(none), secret_ledger.scan(none), license_scan.scan(none)):
        assert out.count() == 0


def test_queries_have_their_columns(spark, small_dir):
    out = queries.QUERIES["op6_pii"](spark, small_dir)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    out = queries.QUERIES["op7_secret_ledger"](spark, small_dir)
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    rows, _, error = compare(queries.QUERIES["op4_license_scan"](spark, small_dir), connect(small_dir), queries.ORACLES["op4_license_scan"])
    assert rows > 0 and error is None


def test_listing(spark):
    df = pii.find(spark.createDataFrame([(0, "a@b.cc 1.2.3.4")], "doc_id long, text string"))
    assert df.select(listed(F.col("personal")).alias("s")).first()["s"] == "email:0:6,ip:7:14"
