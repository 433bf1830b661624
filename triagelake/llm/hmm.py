"""A hidden Markov language model: Baum-Welch over partitions, exact likelihoods of whole texts.

The states emit word classes: the most frequent words are classes of their own, all others fall into
a fixed number of classes by their hash, and share the class's probability by their counts. So the
model has a fixed number of parameters, and the words of the corpus, whatever their number, are only
ever counted and joined by shuffle. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import only, prepared, texts, word_hashes, write_stage

STATES = 8
TOP_WORDS, RARE_CLASSES = 4096, 1024
ITERATIONS = 4
#: training sequences are the documents, cut into runs of at most so many tokens
RUN = 256
#: a long text is scored in chunks of so many tokens, side by side
CHUNK = 1024
HELD_OUT_MOD, HELD_OUT = 7, 2
#: words counted in a task before they are handed on
COUNT_AT_ONCE = 4_000_000
SEED = 7


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod 7, is 2. A null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HELD_OUT_MOD == HELD_OUT


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): occurrences of each word hash; counted inside each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            w, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], ["word", "c"])

        for b in batches:
            h, _ = word_hashes(texts(b), lower=True)
            if len(h):
                held.append(h)
                size += len(h)
            if size >= COUNT_AT_ONCE:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return train.select("text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Sorted hashes of the frequent words with their counts, and totals of the other classes."""

    top: np.ndarray
    top_counts: np.ndarray
    rare_tokens: np.ndarray
    rare_words: np.ndarray
    documents: int
    tokens: int
    distinct: int

    @property
    def classes(self) -> int:
        return len(self.top) + len(self.rare_tokens) + 1

    @property
    def denominator(self) -> float:
        """Of the base score: tokens plus one for each distinct token and for an unknown one."""
        return float(self.tokens + self.distinct + 1)

    def classify(self, h: np.ndarray) -> np.ndarray:
        """Class numbers; the last class is the end of a text."""
        n = len(self.top)
        rare = n + ((h >> np.uint64(20)) % np.uint64(len(self.rare_tokens))).astype(np.int64)
        if not n:
            return rare
        at = np.minimum(np.searchsorted(self.top, h), n - 1)
        return np.where(self.top[at] == h, at, rare)

    def class_counts(self) -> np.ndarray:
        return np.concatenate((self.top_counts, self.rare_tokens, [self.documents])).astype(float)


def fit_vocabulary(counts: DataFrame, documents: int, top_words: int = TOP_WORDS, rare_classes: int = RARE_CLASSES) -> Vocabulary:
    """``counts`` is (word, c), written. The driver gets top_words rows and one row per rare class."""
    top = counts.orderBy(F.desc("c"), "word").limit(top_words).collect()
    top = sorted((int(np.int64(r["word"]).view(np.uint64)), r["c"]) for r in top)
    hashes = np.array([w for w, _ in top], np.uint64)
    # the same class as in classify(): bits 20 and up of the unsigned hash
    sums = counts.groupBy(F.pmod(F.shiftrightunsigned("word", 20), F.lit(rare_classes)).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    tokens, words = np.zeros(rare_classes, np.int64), np.zeros(rare_classes, np.int64)
    for r in sums:
        tokens[r["k"]], words[r["k"]] = r["c"], r["v"]
    total, distinct = int(tokens.sum()), int(words.sum())
    for w, c in top:
        tokens[(w >> 20) % rare_classes] -= c
        words[(w >> 20) % rare_classes] -= 1
    return Vocabulary(hashes, np.array([c for _, c in top], np.int64), tokens, words, documents, total + documents, distinct + (documents > 0))


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes


def first_guess(vocab: Vocabulary, states: int = STATES, seed: int = SEED) -> Hmm:
    """States that stay, each with the class shares of the corpus times noise."""
    rng = np.random.default_rng(seed)
    share = vocab.class_counts() + 1
    emit = share * rng.gamma(1.0, 1.0, (states, len(share)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))


def _runs(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the pieces of ``size`` tokens of texts laid end to end."""
    per = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = (np.cumsum(lengths) - lengths)[text] + k * size
    return text, first, np.minimum(size, lengths[text] - k * size)


def expected_counts(model: Hmm, classes: np.ndarray, lengths: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(start, move, emit) counts and log likelihood by scaled forward-backward over all runs."""
    k, n_classes = model.emit.shape
    _, first, size = _runs(lengths, run)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    emit = np.ascontiguousarray(model.emit.T)
    steps = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]
    alphas, scales, tokens, total = [], [], [], 0.0
    for t in range(steps):
        n = live[t]
        c = classes[first[:n] + t]
        a = (model.start if t == 0 else alphas[-1][:n] @ model.move) * emit[c]
        s = a.sum(axis=1, keepdims=True)
        a /= s
        total += float(np.log(s).sum())
        alphas.append(a), scales.append(s), tokens.append(c)
    move, counts = np.zeros((k, k)), np.zeros((n_classes, k))
    beta = np.zeros((0, k))
    gammas = []
    for t in range(steps - 1, -1, -1):
        n = live[t]
        # runs that end here start from ones
        b = np.ones((n, k))
        if t + 1 < steps:
            m = live[t + 1]
            ahead = emit[tokens[t + 1]] * beta / scales[t + 1]
            move += alphas[t][:m].T @ ahead
            b[:m] = ahead @ model.move.T
        beta = b
        gammas.append(alphas[t] * b)
    move *= model.move
    start = gammas[-1].sum(axis=0) if steps else np.zeros(k)
    if steps:
        flat, g = np.concatenate(tokens[::-1]), np.concatenate(gammas)
        for i in range(k):
            counts[:, i] = np.bincount(flat, weights=g[:, i], minlength=n_classes)
    return start, move, counts.T, total


def with_ends(h: np.ndarray, n: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Classes of texts laid end to end, an end after each, and their lengths."""
    return np.insert(vocab.classify(h), np.cumsum(n), vocab.classes - 1), n + 1


def baum_welch(train: DataFrame, vocab: Vocabulary, states: int = STATES, iterations: int = ITERATIONS, seed: int = SEED) -> tuple[Hmm, list[float]]:
    """The trained model, and the log likelihood before each iteration.

    Each task adds up the expected counts of all its texts; the sums of the tasks are added on the
    executors, state by state. The driver gets states x classes numbers, whatever the data.
    """
    model, seen = first_guess(vocab, states, seed), []
    spark = train.sparkSession
    share = (vocab.class_counts() + 1) / (vocab.class_counts() + 1).sum()
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast((model, vocab))

        def partial(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model, vocab = sent.value
            sums = None
            for b in batches:
                h, n = word_hashes(texts(b), lower=True)
                got = expected_counts(model, *with_ends(h, n, vocab))
                sums = got if sums is None else tuple(x + y for x, y in zip(sums, got, strict=True))
            if sums is not None:
                start, move, emit, like = sums
                rows = [np.concatenate(([start[i], like if i == 0 else 0.0], move[i], emit[i])) for i in range(len(start))]
                yield pa.RecordBatch.from_pydict({"state": list(range(len(rows))), "sums": [r.tobytes() for r in rows]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for i, raw in zip(b.column("state").to_pylist(), b.column("sums").to_pylist(), strict=True):
                    sums[i] = np.frombuffer(raw) + sums[i] if i in sums else np.frombuffer(raw)
            if sums:
                yield pa.RecordBatch.from_pydict({"state": list(sums), "sums": [v.tobytes() for v in sums.values()]})

        tasks = max(1, spark.sparkContext.defaultParallelism)
        rows = train.select("text").coalesce(tasks).mapInArrow(partial, "state long, sums binary").repartition("state").mapInArrow(add, "state long, sums binary").collect()
        sent.unpersist()
        if not rows:
            break
        got = np.array([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["state"])])
        seen.append(float(got[0, 1]))
        start, move, emit = got[:, 0] + 0.1, got[:, 2 : 2 + states] + 0.1, got[:, 2 + states :] + 10 * share
        model = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    return model, seen


def log_likelihoods(model: Hmm, classes: np.ndarray, lengths: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Exact natural log probability of each text's classes, by the scaled forward recursion.

    All texts advance together, one token a step. The later chunks of a long text are run from each
    state at once, side by side with the rest, and their results are multiplied up in order: the
    same sums as the plain recursion, without its many steps.
    """
    k = len(model.start)
    emit = np.ascontiguousarray(model.emit.T)
    text, first, size = _runs(lengths, chunk)
    later = np.flatnonzero(np.concatenate(([False], text[1:] == text[:-1]))) if len(text) else np.zeros(0, np.int64)
    head = np.setdiff1d(np.arange(len(text)), later)
    piece = np.concatenate((head, np.repeat(later, k)))
    state = np.concatenate((np.full(len(head), -1), np.tile(np.arange(k), len(later))))
    order = np.argsort(-size[piece], kind="stable")
    piece, state = piece[order], state[order]
    begin, length = first[piece], size[piece]
    init = np.where(state[:, None] < 0, model.start, model.move[state])
    a, logs = np.zeros((len(piece), k)), np.zeros(len(piece))
    for t in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -t, side="left"))
        now = (init if t == 0 else a[:n] @ model.move) * emit[classes[begin[:n] + t]]
        s = now.sum(axis=1)
        a[:n] = now / s[:, None]
        logs[:n] += np.log(s)
    end, scale = np.zeros((len(text), k, k)), np.zeros((len(text), k))
    end[piece, np.maximum(state, 0)] = a
    scale[piece, np.maximum(state, 0)] = logs
    out, v = np.zeros(len(lengths)), None
    is_later = np.zeros(len(text), bool)
    is_later[later] = True
    for i in range(len(text)):
        if not is_later[i]:
            v, out[text[i]] = end[i, 0], scale[i, 0]
        else:
            top = scale[i].max()
            v = (v * np.exp(scale[i] - top)) @ end[i]
            s = v.sum()
            out[text[i]] += top + np.log(s)
            v = v / s
    return out


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def score_texts(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, top_words: int = TOP_WORDS, rare_classes: int = RARE_CLASSES, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row.

    ``base_score`` is the add-one unigram score, ``score`` the model's; both are log10 probabilities
    of the whole text with its end, learned from the rows that aren't held out. A null or empty text
    is its end alone. Counts of the frequent words go with the model (a fixed number of them); those
    of all others are joined to the words of each text by shuffle, where no word can be frequent.
    Equal rows give equal rows; without training rows nothing is known and base scores are 0.
    """
    spark = prepared(docs.sparkSession)
    rows = only(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    train = rows.filter(~F.col("held_out"))
    counts, _ = write_stage(word_counts(train), "word-counts")
    vocab = fit_vocabulary(counts, train.count(), top_words, rare_classes)
    model, _ = baum_welch(train, vocab, states, iterations, seed)
    sent = spark.sparkContext.broadcast((model, vocab))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocab = sent.value
        n_top = len(vocab.top)
        c = np.concatenate((vocab.top_counts, np.zeros(len(vocab.rare_tokens)), [vocab.documents]))
        # what a token adds to either score before the counts of rare words are known
        base = np.log10(c + 1) - np.log10(vocab.denominator)
        inside = np.zeros(vocab.classes)
        inside[n_top:-1] = -np.log10(vocab.rare_tokens + vocab.rare_words + 1)
        for b in batches:
            body = texts(b)
            h, n = word_hashes(body, lower=True)
            classes, lengths = with_ends(h, n, vocab)
            row = np.repeat(np.arange(len(body)), lengths)
            add = lambda x, row=row, m=len(body): np.bincount(row, weights=x, minlength=m)
            out = log_likelihoods(model, classes, lengths) / np.log(10) + add(inside[classes])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([_key(t) for t in body], pa.int64()), pa.array(lengths), pa.array(add((c > 0)[classes]).astype(np.int64)), pa.array(add(base[classes])), pa.array(out)],
                ["doc_id", "held_out", "key", "n_tokens", "n_known", "base_score", "score"],
            )

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vocab = sent.value
        for b in batches:
            body = texts(b)
            h, n = word_hashes(body, lower=True)
            mine = vocab.classify(h) >= len(vocab.top)
            word, at = np.unique(h[mine], return_inverse=True)
            if len(word):
                row = np.repeat(np.arange(len(body)), n)[mine]
                pair, tf = np.unique(row * len(word) + at, return_counts=True)
                keys = np.array([_key(t) for t in body], np.int64)
                r = pair // len(word)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(r)), pa.array(keys[r]), pa.array(word[pair % len(word)].view(np.int64)), pa.array(tf.astype(np.int64))], ["doc_id", "key", "word", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored, _ = write_stage(rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, key long, n_tokens long, n_known long, base_score double, score double"), "lm-scored")
    told = rows.select("doc_id", "text").mapInArrow(rare, f"doc_id {kind}, key long, word long, tf long").join(counts, "word")
    sums = told.groupBy("doc_id", "key").agg(F.sum("tf").alias("known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("logs"))
    # rows that are equal in doc_id and text were added up together
    copies = scored.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    per_text = sums.join(copies, same(sums, copies)).select(sums["doc_id"].alias("_id"), sums["key"].alias("_key"), (F.col("known") / F.col("copies")).cast("long").alias("known"), (F.col("logs") / F.col("copies")).alias("logs"))
    out = scored.join(per_text, scored["doc_id"].eqNullSafe(per_text["_id"]) & (scored["key"] == per_text["_key"]), "left")
    known, logs = F.coalesce("known", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
