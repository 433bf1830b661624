"""Operators 1, 7 and 10 on small inputs."""

import random
import struct

import numpy as np
import pytest
import sentencepiece

from triagelake.llm import pieces, token_counts, toxicity

needs_model = pytest.mark.skipif(not __import__("os").path.exists(pieces.MODEL_PATH), reason="no tokenizer files")


# ---- 1 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separator_scan_equals_brute_force(spark, tmp_path, block):
    rng = random.Random(block)
    want = []
    for k in range(6):
        tokens = [rng.choice([9, 9, 1, 2, 3]) for _ in range(rng.choice([0, 1, 5, 23]))]
        (tmp_path / f"f{k}.bin").write_bytes(np.array(tokens, dtype="<u2").tobytes())
        start, n = 0, 0
        for i, t in enumerate(tokens):
            if t == 9:
                want.append((f"f{k}.bin", n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(tokens):
            want.append((f"f{k}.bin", n, start, len(tokens) - start, False))
    blocks, _ = token_counts.write_stage(token_counts.scan_separators(spark, str(tmp_path), 9, "<u2", block), "blocks")
    got = token_counts.document_lengths(blocks).collect()
    assert sorted((r["file"], r["ordinal"], r["start"], r["n_tokens"], r["terminated"]) for r in got) == sorted(want)


@needs_model
def test_document_tokens(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(token_counts.RANKS_PATH, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|> é\n" * 50), (1, "Hello world"), (None, "x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.document_tokens(df, block_tokens=16).collect())
    assert got == sorted((i or 0, len(enc.encode_ordinary(t or ""))) for i, t in rows)
    assert token_counts.document_tokens(df.limit(0)).count() == 0


# ---- 7 -----------------------------------------------------------------------------------------

WORDS = ("vile", "awful", "nasty")


def _texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice([0, 0, 0, 1, 2, 4, 8])
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 40)) for _ in range(40)]
        for _ in range(k):
            words.insert(rng.randrange(len(words)), rng.choice(WORDS))
        out.append((i, " ".join(words), int(k > 0), k))
    return out


def test_severity_finds_held_out_toxic_texts(spark):
    rows = _texts(500)
    docs = spark.createDataFrame([(i, t, 3) for i, t, _, _ in rows] + [(900, None, 3), (901, "", 3), (902, "VILE, awful! " * 3000, 3), (None, "nasty", 3)], "doc_id long, text string, grade int").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows[:300]] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_severity(docs, labels)
    assert set(WORDS) <= set(model.words) and (np.diff(model.cuts) > 0).all()
    out = {r["doc_id"]: r for r in toxicity.score_severity(docs, model).collect()}
    assert all(out[i]["rejected"] == bool(y) for i, _, y, _ in rows[300:])
    assert not out[900]["rejected"] and not out[901]["rejected"] and out[902]["grade"] == 3 and out[None]["rejected"]
    mean = lambda ks: np.mean([out[i]["expected_severity"] for i, _, _, k in rows[300:] if k in ks])
    assert mean({0}) < 0.5 < mean({1}) < mean({4}) < mean({8})
    kept = toxicity.keep_acceptable(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(not r["rejected"] for r in toxicity.score_severity(docs, model).collect())


def test_severity_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "vile")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not toxicity.score_severity(docs, toxicity.fit_severity(docs, none)).first()["rejected"]
    assert toxicity.score_severity(docs.limit(0), toxicity.fit_severity(docs.limit(0), none)).count() == 0


def test_fit_reaches_the_maximum_of_the_likelihood(spark):
    """The gradient of the ordinal likelihood vanishes, by finite differences on the same rows."""
    rng = np.random.default_rng(4)
    rows = [("u " * int(a) + "v " * int(b), int(np.clip(a - b + rng.integers(-2, 4), 0, 3))) for a, b in rng.integers(0, 3, (300, 2))]
    model = toxicity.fit_ordinal(spark.createDataFrame(rows, "text string, grade int"), ["u", "v"], steps=120, ridge=0.0)

    def loss(w, cuts):
        m = toxicity.Severity(model.words, w, cuts)
        return -np.mean([np.log(m.probabilities(t)[y]) for t, y in rows])

    best = loss(model.weights, model.cuts)
    for i in range(2):
        for s in (-0.1, 0.1):
            assert loss(model.weights + s * np.eye(2)[i], model.cuts) > best - 1e-4
    for i in range(3):
        for s in (-0.1, 0.1):
            assert loss(model.weights, model.cuts + s * np.eye(3)[i]) > best - 1e-4


# ---- 10 ----------------------------------------------------------------------------------------

CASES = ["", None, " ", "   ", "a", " a  b ", "▁x", "x▁ y", "é́ 漢字\U0001F600\t\n x ", "<s> </s> <unk> <0x41>", "\x00\x07", "word " * 3000, "x" * 5000]


@needs_model
def test_sentencepiece_ids_and_round_trip(spark):
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate([*CASES, "word word"])] + [(None, "a", "ids")], "doc_id long, text string, ids string").repartition(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    got = pieces.encode_decode(df).collect()
    want = dict(enumerate([*CASES, "word word"])) | {None: "a"}
    assert len(got) == len(want)
    for r in got:
        t = want[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u2").tolist() == sp.encode(t) and r["n_tokens"] == len(r["ids"]) // 2
        assert r["round_trip"] and r["parity"] and r["decoded"] == t.replace("▁", " ")
    assert pieces.encode_decode(df.limit(0)).count() == 0


def _message(*parts):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in parts:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def unigram_model():
    """A unigram model with byte fallback, written out by hand."""
    own = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    own += [(p, s, 1) for p, s in (("▁", -3.0), ("a", -4.0), ("b", -4.5), ("c", -5.0), ("ab", -4.2), ("▁a", -3.5), ("bc", -4.1), ("▁abc", -9.0), ("ca", -6.0))]
    pieces_ = [(1, _message((1, p.encode()), (2, s), (3, t))) for p, s, t in own]
    return _message(*pieces_, (2, _message((3, 1), (4, len(own)), (35, 1))), (3, _message((1, b"identity"), (3, 1), (4, 1), (5, 1))))


def test_unigram_model_with_byte_fallback():
    codec = pieces.Codec(unigram_model())
    assert codec.model.kind == pieces.UNIGRAM and codec.model.byte_fallback
    rng = random.Random(2)
    cases = ["".join(rng.choice("abc é ") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    ids = codec.encode(cases)
    assert ids == codec.other.encode(cases)
    packed, parity = codec.encode_checked(cases)
    assert all(parity) and [np.frombuffer(p, codec.dtype).tolist() for p in packed] == ids
    assert all(d == codec.normalized(t) for d, t in zip(codec.decode(ids), cases, strict=True))


@needs_model
def test_a_difference_is_reported(monkeypatch):
    data = open(pieces.MODEL_PATH, "rb").read()
    codec = pieces.Codec(data)
    right = codec.tokenizer
    codec.tokenizer = pieces.build(pieces.parse_model(data))
    assert all(codec.decode_packed(codec.packed(i)) == t for i, t in zip(codec.encode(["a b", " é\U0001F600"]), ["a b", " é\U0001F600"], strict=True))
    codec.encode = lambda batch: [[9] if t == "bad" else e.ids for t, e in zip(batch, right.encode_batch(batch), strict=True)]
    assert codec.encode_checked(["a bad day", "good", "bad ", ""])[1] == [False, True, False, True]


def test_broken_models_are_refused():
    data = unigram_model()
    with pytest.raises(ValueError):
        pieces.parse_model(data[:-3])
    with pytest.raises(ValueError):
        pieces.parse_model(_message((1, _message((1, b"x"), (2, 0.5), (3, 4)))))
