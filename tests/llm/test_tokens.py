"""Packing, byte-pair encoding and fingerprints."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest_helpers import ffd
from tokenizers import Tokenizer

from cellcast.llm import byte_bpe, packing, queries, winnowing

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_tokenizer_and_cover_each_document(odd, odd_rows):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = queries.pack(odd).collect()
    want = sorted(
        [(-1 if i is None else i, *(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in odd_rows]
    )
    # Rows of one id are told apart by their ids: pieces in order of start, then pooled.
    got: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= 1024
        got.setdefault((-1 if r["doc_id"] is None else r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    built = []
    for (doc, total), parts in got.items():
        copies = sum(s == 0 for s, _ in parts)
        assert sum(len(x) for _, x in parts) == copies * total
        starts = sorted({s for s, _ in parts})
        layers = [sorted(x for s, x in parts if s == at) for at in starts]
        assert all(len(x) == copies for x in layers)
        built += [(doc, *sum((layer[c] for layer in layers), [])) for c in range(copies)]
    assert sorted(built) == want


def test_sequences_are_gapless_and_bounded(odd):
    rows = queries.pack(odd).collect()
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= total // 1024 + 2


@pytest.mark.parametrize("seed", range(6))
def test_first_fit_decreasing_equals_the_plain_form(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1025, rng.integers(0, 300))
    number, offset = packing.first_fit_decreasing(lengths, 1024)
    assert list(zip(number, offset)) == ffd(lengths, 1024)


def test_groups_depend_on_size_only_not_on_copies(spark):
    df = spark.createDataFrame([(1, "same text")] * 3000, "doc_id long, text string")
    out = packing.pack(packing.pieces(df, RANKS, P.PATTERN, {}), 4)
    groups = [r["count"] for r in out.selectExpr("sequence_id >> 32 AS g").groupBy("g").count().collect()]
    assert len(groups) == 4 and max(groups) < 1200


def test_encoding_equals_the_library(odd, odd_rows, library):
    rows = byte_bpe.round_trip(odd.select("doc_id", "text", "ids", "decoded"), RANKS, P.PATTERN).collect()
    key = lambda i: -1 if i is None else i
    got = sorted((key(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in rows)
    want = sorted((key(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd_rows)
    assert got == want


def test_random_bytes_and_long_pieces(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab cdé日🎉'\n1") for _ in range(rng.randrange(400))) for _ in range(200)]
    texts += ["ab" * 4000, "é" * 1500, "=" * 700, "z" * 257, "the" * 900 + " x", "aaaa " * 300_000]
    encoder = byte_bpe.Encoder(RANKS, P.PATTERN)
    for text, ids in zip(texts, encoder.texts(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert byte_bpe.decode_ids(encoder.vocab, ids) == text.encode()


def test_the_cache_limit_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN", 10)
    monkeypatch.setattr(byte_bpe, "SLICE", 50)
    texts = [f"word{i} and{i} other words " * 20 for i in range(30)]
    for text, ids in zip(texts, byte_bpe.Encoder(RANKS, P.PATTERN).texts(texts)):
        assert ids.tolist() == library.encode_ordinary(text)


def test_encode_then_decode(odd):
    out = byte_bpe.decode(byte_bpe.encode(odd.select("doc_id", "text"), RANKS, P.PATTERN), RANKS)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in out.collect())




def test_next_and_edited_texts(odd, odd_rows):
    rows = winnowing.fingerprint(odd).collect()
    assert len(rows) == len(odd_rows)
    order = sorted(((i is not None, i or 0, t or "") for i, t in odd_rows))
    want: dict = {}
    for (_, i, t), (_, _, following) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want.setdefault((i, t), []).append(t[: len(t) - half] + following[:half])
    got: dict = {}
    for r in rows:
        got.setdefault((r["doc_id"] or 0, r["text"]), []).append(r["edited_text"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_prints_follow_the_definition(odd):
    for r in winnowing.fingerprint(odd, k=2, window=3).collect():
        found = [(p["hash"], p["position"]) for p in r["prints"]]
        every = winnowing_hashes(r["text"], 2)
        want = []
        for at in range(max(1, len(every) - 2) if every else 0):
            part = every[at : at + 3]
            best = max(i for i, h in enumerate(part) if h == min(part)) + at
            if (every[best], best) not in want:
                want.append((every[best], best))
        assert len(found) == len(want)
        assert [p for _, p in found] == [p for _, p in want]


def winnowing_hashes(text, k):
    import re

    words = [w for w in re.split(r"[\x00-\x20\x7f]+", text.lower()) if w]
    if not words:
        return []
    k = min(k, len(words))
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    known = HASHES.setdefault("x", {})
    missing = [g for g in grams if g not in known]
    if missing:
        known.update(zip(missing, spark_hashes(missing)))
    return [known[g] for g in grams]


HASHES: dict = {}


def spark_hashes(grams):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    words = sorted({w for g in grams for w in g})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    h = {r["w"]: r["h"] for r in df.selectExpr("w", f"pmod(xxhash64(w), {winnowing.MODULUS}L) AS h").collect()}
    out = []
    for g in grams:
        value = h[g[0]]
        for j in range(1, 2):
            value = (value * winnowing.BASE + (h[g[j]] if j < len(g) else 0)) % winnowing.MODULUS
        out.append(value)
    return out


def test_ranges_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 16)
    words = lambda i, n: " ".join(f"v{i * 1000 + j}" for j in range(n))
    rows = [(i * i, words(i, 80)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r for r in winnowing.fingerprint(df).collect()}
    assert len(got) == 200
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        assert got[i]["edited_text"] == t[: len(t) - half] + following[:half]
        # Half of the words are shared, more than the length that guarantees a common print.
        assert got[i]["near_edited"] > 0 and got[i]["near_next"] == 0
    assert abs(sum(r["near_edited"] for r in got.values()) / len(got) - 1 / 3) < 0.05
    twins = spark.createDataFrame([(0, "a b c d e f g h"), (1, "a b c d e f g h"), (2, ""), (3, None)], "doc_id long, text string")
    rows = winnowing.fingerprint(twins).orderBy("doc_id").collect()
    assert rows[0]["prints"] == rows[1]["prints"] and rows[0]["near_next"] == 1.0
    assert rows[2]["prints"] == [] and rows[2]["near_next"] == 1.0


def test_empty_tables(none):
    assert queries.pack(none).count() == 0
    assert byte_bpe.round_trip(none.select("doc_id", "text"), RANKS, P.PATTERN).count() == 0
    assert winnowing.fingerprint(none).count() == 0


def test_query_digests(spark, small_dir):
    row = queries.QUERIES["op8_winnowing"](spark, small_dir).first()
    assert len(row["edited_sha256"]) == len(hashlib.sha256(b"").hexdigest()) and row["fingerprint"]
