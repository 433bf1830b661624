"""Very long runs, clashing column names and other ids: no crash, no quadratic time, the same result."""

import base64
import random
import time

import pytest
import tiktoken
from pyspark.sql import functions as F

from triagelake.llm import line_dedup, near_dup, pii, token_counts


@pytest.fixture(scope="module")
def encoder():
    try:
        with open(token_counts.RANKS_PATH, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines() if line)}
    except FileNotFoundError:
        pytest.skip("no tokenizer files")
    return tiktoken.Encoding("flat", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_cut_out_blanks_give_the_same_tokens(encoder):
    rng = random.Random(1)
    blanks = [" ", "\n", "\t", "\r\n", "　", "\xa0", "\x1c", "\x85", "​"]
    for _ in range(300):
        text = "".join(rng.choice(["word", "7", ".", "é", "".join(rng.choice(blanks) for _ in range(rng.randrange(12)))]) for _ in range(10))
        for least in (1, 2, 5):
            assert token_counts.encode_text(encoder, text, least) == encoder.encode_ordinary(text)


def test_two_million_blanks(spark, encoder):
    texts = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("file", F.lit(1)).withColumn("ordinal", F.lit(1))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.document_tokens(df).collect()}
    assert got == {i: len(token_counts.encode_text(encoder, t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("part", ["http://", "token-", "token ", "a@", "+1 ", "1.1.", "account ", "iban DE", "x@y."])
def test_spans_of_a_megabyte_of_anchors_take_seconds(part):
    start = time.time()
    pii.find_spans(part * (1_000_000 // len(part)), pii.automaton())
    assert time.time() - start < 20


def test_account_numbers_behind_joining_words():
    found = lambda t: [t[a:b] for a, b, k in pii.find_spans(t, pii.automaton()) if k == "account"]
    assert found("account number 12345678 and account no.: 87654321") == ["12345678", "87654321"]
    assert found("IBAN is DE89 3704 0044 0532 0130 00 today") == ["DE89 3704 0044 0532 0130 00"]
    assert found("iban de89 3704 0044 0532 0130 00") == ["de89 3704 0044 0532 0130 00"]
    assert found("IBAN DE88 3704 0044 0532 0130 00") == [] and found("accountant 12345678") == []


def test_line_dedup_with_clashing_columns_and_other_ids(spark):
    line = "this line is in all of the documents"
    rows = [(f"d{i}", f"{line}\nown {i}", i, "x", 5) for i in range(4)] + [(None, line, 1, "y", 6)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _drop int, N_LINES string, drop int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_drop", "drop", "n_lines", "n_dropped"]
    assert {r["doc_id"]: (r["text"], r["_drop"], r["n_dropped"]) for r in got.collect()} == {**{f"d{i}": (f"own {i}", i, 1) for i in range(3)}, "d3": (f"{line}\nown 3", 3, 0), None: ("", 1, 1)}
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 7, 8, 9), (2, "a b c d e f g", 1, 2, 3), (3, "other words here", 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _key int, row int")
    assert sorted(map(tuple, near_dup.keep_one(df).collect())) == [rows[0], rows[2]]
