"""Masked pseudo-likelihood: a window network, trained in numpy, predicts every token from both of its sides."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.text import Words, mixed, positional, raw_bytes, text_slices
from plumbline.plans.staging import scratch_path

# Token classes: 0 stands for the outside of a text, RARE hash classes for the words outside the vocabulary.
CLASSES, RARE = 256, 64
# Tokens seen on each side, and sizes of the embedding and the hidden layer.
SIDE, EMBEDDING, HIDDEN = 3, 8, 32
# Embeddings, hidden layer and its bias, last layer and its base, in the order in which a vector of weights holds them.
SHAPES = [(CLASSES, EMBEDDING), (2 * SIDE * EMBEDDING, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]
# The rounds of training share all tokens out: each is the target of one round.
ROUNDS, BATCH, RATE = 2, 1_024, 0.01
# Scores whose exponentials, sums of them and their products with weights single precision holds.
LARGEST = 60
# Rows multiplied at once, and tokens scored at once.
BLOCK, SCORED = 64, 512
# Words whose counts go to all tasks; the others meet theirs in a join.
SPREAD = 524_288
# Weights averaged in one task.
FAN_IN = 64


class Network:
    """Embeddings of the neighbours side by side, one hidden layer, softmax over the classes."""

    def __init__(self, weights: np.ndarray | None = None, seed: int = 3):
        if weights is None:
            random = np.random.default_rng(seed)
            weights = np.concatenate([(random.normal(size=int(np.prod(s))) * (0.1 if len(s) == 2 else 0)).astype(np.float32) for s in SHAPES])
        self.weights = weights.astype(np.float32)
        self.parts = _parts(self.weights)
        self.gradient, self.first, self.second = (np.zeros_like(self.weights) for _ in range(3))
        self.slopes = _parts(self.gradient)
        self.steps = 0
        self._measure()

    def _measure(self) -> None:
        """No score is larger than this sum."""
        self.largest = np.abs(_last(self.weights)).sum(0).max()

    def _forward(self, around: np.ndarray):
        """Inputs, hidden layer with a last column of ones, and scores up to a number that a row has in common."""
        table, inner, bias, _, _ = self.parts
        x = table.take(around, axis=0).reshape(len(around), -1)
        hidden = np.ones((len(x), HIDDEN + 1), np.float32)
        np.tanh(_product(x, inner) + bias, out=hidden[:, :HIDDEN])
        scores = _product(hidden, _last(self.weights))
        if self.largest > LARGEST:
            scores -= scores.max(1, keepdims=True)
        return x, hidden, scores

    def log_probabilities(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token, given its neighbours."""
        _, _, scores = self._forward(around)
        own = scores[np.arange(len(token)), token].astype(np.float64)
        return own - np.log((np.exp(scores, out=scores) @ np.ones(CLASSES, np.float32)).astype(np.float64))

    def learn(self, around: np.ndarray, token: np.ndarray) -> None:
        """One step of Adam on the mean negative log-probability."""
        _, inner, _, outer, _ = self.parts
        x, hidden, scores = self._forward(around)
        # a row of slopes still lacks its factor, which the shorter row of the hidden layer takes instead
        slope = np.exp(scores, out=scores)
        total = slope @ np.ones(CLASSES, np.float32)
        slope[np.arange(len(token)), token] -= total
        factor = (1 / len(token) / total)[:, None]
        scaled = hidden * factor
        back = _product(slope, np.ascontiguousarray(outer.T))
        back *= factor - hidden[:, :HIDDEN] * scaled[:, :HIDDEN]
        spread = _product(back, np.ascontiguousarray(inner.T)).reshape(-1, EMBEDDING)
        # the slopes of each class lie side by side once its places are sorted
        place = around.ravel()
        order = np.argsort(place, kind="stable")
        counts = np.bincount(place, minlength=CLASSES)
        met = np.flatnonzero(counts)
        self.slopes[0][...] = 0
        self.slopes[0][met] = np.add.reduceat(spread.take(order, axis=0), (np.cumsum(counts) - counts)[met], axis=0)
        self.slopes[1][...] = _crossed(x, back)
        self.slopes[2][...] = back.sum(0)
        _last(self.gradient)[...] = _crossed(scaled, slope)
        self.steps += 1
        self.first += 0.1 * (self.gradient - self.first)
        self.second += 0.001 * (self.gradient**2 - self.second)
        size = RATE * (1 - 0.999**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        self.weights -= size * self.first / (np.sqrt(self.second) + 1e-8)
        self._measure()


def _parts(vector: np.ndarray) -> list[np.ndarray]:
    """Views of what a vector of all weights holds."""
    return [p.reshape(s) for p, s in zip(np.split(vector, np.cumsum([int(np.prod(s)) for s in SHAPES])[:-1]), SHAPES)]


def _last(vector: np.ndarray) -> np.ndarray:
    """A view of the last layer, its base as the last row."""
    return vector[-(HIDDEN + 1) * CLASSES :].reshape(HIDDEN + 1, CLASSES)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b; matrices as small as blocks of rows are multiplied in place, without being packed first."""
    if len(a) % BLOCK:
        return a @ b
    return np.matmul(a.reshape(-1, BLOCK, a.shape[1]), b).reshape(len(a), b.shape[1])


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, by the same blocks."""
    if len(a) % BLOCK:
        return a.T @ b
    return np.matmul(a.reshape(-1, BLOCK, a.shape[1]).transpose(0, 2, 1), b.reshape(-1, BLOCK, b.shape[1])).sum(0)


def stretched(tokens: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A view of every token with the SIDE classes on both sides, 0 outside of its text, and the place in it of each token.

    ``doc_starts`` ends with the number of tokens.
    """
    place = np.arange(len(tokens)) + SIDE * np.repeat(np.arange(1, len(doc_starts)), np.diff(doc_starts))
    wide = np.zeros(len(tokens) + SIDE * (len(doc_starts) + 1), tokens.dtype)
    wide[place] = tokens
    return np.lib.stride_tricks.sliding_window_view(wide, 2 * SIDE + 1), place - SIDE


def neighbours(view: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The SIDE classes on both sides of each of the places of a view."""
    around = view[places]
    return np.concatenate([around[:, :SIDE], around[:, SIDE + 1 :]], axis=1)


def pseudo_likelihood(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with ``n_tokens``, ``log_likelihood`` and ``per_token``.

    Tokens are words. ``log_likelihood`` sums, over all tokens of the whole text, the log-probability of the
    token given three tokens on either side; ``per_token`` is its mean. Null texts and texts without a word
    have 0 tokens, a sum of 0 and no mean.

    The probability of a word is that of its class, by the network, times that of the word in its class. The most
    frequent words have a class each, all others share ``RARE`` classes by a hash, where a word has its share of
    the class's tokens in the corpus. All words of the corpus are counted and told apart, whatever their number:
    counts of about ``SPREAD`` frequent words go to all tasks, those of the rest are joined.

    In each round every partition trains from the common weights; each token is the target in one of the
    ``rounds``. Weights are averaged by tokens, ``FAN_IN`` at a time. What the driver receives is at most
    ``SPREAD`` words, the sums of the classes and ``FAN_IN`` sets of weights. Equal texts get equal scores. Columns of
    ``docs`` with the name of an added one are replaced.
    """
    spark = docs.sparkSession
    rest = docs.drop("n_tokens", "log_likelihood", "per_token")
    rows, (text,) = positional(rest, text)
    texts = rows.select(F.col(text).alias("text"), *_digest(text)).where(F.col("text").isNotNull())
    folder = scratch_path(spark, "words")
    _counted(texts.select("text")).write.parquet(folder)
    counts = spark.read.parquet(folder)
    top = counts.orderBy(F.desc("n"), "word").limit(CLASSES - RARE - 1).select("word").collect()
    known = np.sort(np.array([r["word"] for r in top], np.int64))
    totals = _rare_totals(counts, known)
    spread = _frequent(counts, SPREAD).select("word", "n").toArrow()
    listed = np.stack([spread.column(c).to_numpy() for c in ("word", "n")], axis=1)
    listed = listed[np.argsort(listed[:, 0])]
    sent = spark.sparkContext.broadcast((known, totals, listed))

    def encode(batches):
        known, totals, listed = sent.value
        logs = np.log(listed[:, 1])
        for batch in text_slices(batches):
            words = Words(batch.column("text"))
            hashes = words.hashes()
            coded, own, left = _looked_up(hashes, known, totals, listed[:, 0], logs)
            sums = [float(own[a:b].sum()) for a, b in zip(words.first[:-1], words.first[1:])]
            ends = np.concatenate([[0], np.cumsum(left)])[words.first].astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)[left], pa.int64()))
            yield pa.RecordBatch.from_arrays([
                batch.column("one"), batch.column("two"), pa.array([coded[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])], pa.binary()),
                pa.array(sums, pa.float64()), others,
            ], ["one", "two", "coded", "inside", "others"])

    # classes of the words, one byte each, are all that training and scoring need
    folder = scratch_path(spark, "classes")
    texts.mapInArrow(encode, "one long, two long, coded binary, inside double, others array<long>").write.option("compression", "zstd").parquet(folder)
    corpus = spark.read.parquet(folder)
    weights = Network().weights
    for number in range(rounds):
        weights = _round(corpus.select("coded"), weights, number, rounds)
    learned = spark.sparkContext.broadcast(weights)

    def score(batches):
        network = Network(learned.value)
        for batch in text_slices(batches, "coded", 1 << 18):
            tokens, starts = raw_bytes(batch.column("coded"))
            view, place = stretched(tokens, starts)
            values = np.zeros(len(tokens))
            for start in range(0, len(tokens), SCORED):
                at = slice(start, start + SCORED)
                values[at] = network.log_probabilities(neighbours(view, place[at]), tokens[at])
            sums = [float(values[a:b].sum()) for a, b in zip(starts[:-1], starts[1:])]
            sums = np.array(sums, np.float64) + batch.column("inside").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("one"), batch.column("two"), pa.array(np.ones(len(sums), np.int64)), pa.array(np.diff(starts).astype(np.int64)), pa.array(sums)],
                ["one", "two", "copies", "tokens", "value"],
            )

    # the words whose counts were not sent; a word met once adds log(1)
    shares = corpus.select("one", "two", F.explode("others").alias("word")).join(counts.where(F.col("n") > 1), "word")
    shares = shares.select("one", "two", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("tokens"), F.log(F.col("n").cast("double")).alias("value"))
    scored = corpus.select("one", "two", "coded", "inside").mapInArrow(score, "one long, two long, copies long, tokens long, value double").union(shares)
    scored = scored.groupBy("one", "two").agg(F.sum("copies").alias("copies"), F.sum("tokens").alias("tokens"), F.sum("value").alias("value"))
    folder = scratch_path(spark, "scores")
    scored.select("one", "two", (F.col("tokens") / F.col("copies")).cast("long").alias("tokens"), (F.col("value") / F.col("copies")).alias("value")).write.parquet(folder)
    scored = spark.read.parquet(folder)
    one, two = _digest(text)
    out = rows.withColumns({"__one": F.when(F.col(text).isNotNull(), one), "__two": two}).join(scored, (F.col("__one") == F.col("one")) & (F.col("__two") == F.col("two")), "left")
    tokens, value = F.coalesce("tokens", F.lit(0)).cast("long"), F.coalesce("value", F.lit(0.0))
    return out.select(*rows.columns, tokens, value, F.when(tokens > 0, value / tokens)).toDF(*rest.columns, "n_tokens", "log_likelihood", "per_token")


def _digest(text: str) -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(F.col(text)).alias("one"), F.xxhash64(F.lit(1), F.col(text)).alias("two")]


def _counted(texts: DataFrame) -> DataFrame:
    """How often each word occurs: ``word`` (its hash) and ``n``."""
    def count(batches):
        for batch in text_slices(batches):
            found, number = np.unique(Words(batch.column("text")).hashes().view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(number.astype(np.int64))], ["word", "n"])

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above a count that at most ``most`` words reach."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    least, words = None, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():
        words += r["words"]
        if words > most:
            break
        least = r["least"]
    return counts.where(F.lit(False) if least is None else F.col("n") >= least)


def _rare_totals(counts: DataFrame, known: np.ndarray) -> np.ndarray:
    """The logarithm of the tokens of each class of several words."""
    def total(batches):
        sums = np.zeros(CLASSES, np.int64)
        for batch in batches:
            classes = _classes(batch.column("word").to_numpy().view(np.uint64), known)
            np.add.at(sums, classes, batch.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, RARE + 1)), pa.array(sums[1 : RARE + 1])], ["class", "n"])

    sums = np.ones(CLASSES)
    for r in counts.mapInArrow(total, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        sums[r["class"]] = max(r["n"], 1)
    return np.log(sums)


def _found(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash among the sorted ``known``, and whether it is there."""
    signed = hashes.view(np.int64)
    place = np.searchsorted(known, signed)
    hit = place < len(known)
    hit[hit] = known[place[hit]] == signed[hit]
    return place, hit


def _looked_up(hashes: np.ndarray, known: np.ndarray, totals: np.ndarray, listed: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Class of each word, the logarithm of its share of it as far as it is listed, and whether its count is still to be met.

    Each distinct word is looked up once, in the order of the sorted lists.
    """
    distinct, at = np.unique(hashes.view(np.int64), return_inverse=True)
    classes = _classes(distinct.view(np.uint64), known)
    rare = classes <= RARE
    place, hit = _found(distinct, listed)
    own = np.zeros(len(distinct))
    own[hit] = logs[place[hit]]
    own = np.where(rare, own - totals[classes], 0)
    return classes.astype(np.uint8)[at], own[at], (rare & ~hit)[at]


def targets(places: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """Which places round ``number`` predicts; the rounds part all places among them."""
    return np.flatnonzero(mixed(places.astype(np.uint64)) % np.uint64(rounds) == number)


def _classes(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    place, hit = _found(hashes, known)
    return np.where(hit, RARE + 1 + place, 1 + (mixed(hashes) % np.uint64(RARE)).astype(np.int64))


def _round(corpus: DataFrame, weights: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """One pass of all partitions from the same weights, and the average of what they learned."""
    def train(batches):
        network, seen, held = Network(weights.copy()), 0, None
        for batch in text_slices(batches, "coded", 1 << 18):
            tokens, starts = raw_bytes(batch.column("coded"))
            view, place = stretched(tokens, starts)
            at = targets(np.arange(seen, seen + len(tokens)), number, rounds)
            seen += len(tokens)
            pairs = neighbours(view, place[at]), tokens[at]
            held = pairs if held is None else tuple(np.concatenate(p) for p in zip(held, pairs))
            while len(held[1]) >= BATCH:
                network.learn(held[0][:BATCH], held[1][:BATCH])
                held = held[0][BATCH:], held[1][BATCH:]
        if held is not None and len(held[1]):
            network.learn(*held)
        if seen:
            yield _weights_row(TaskContext.get().partitionId(), seen, network.weights)

    def average(batches):
        total, seen = None, 0
        for batch in batches:
            for tokens, raw in zip(batch.column("tokens").to_pylist(), batch.column("weights").to_pylist()):
                part = np.frombuffer(raw, "<f4").astype(np.float64) * tokens
                total, seen = part if total is None else total + part, seen + tokens
        if seen:
            yield _weights_row(TaskContext.get().partitionId(), seen, total / seen)

    layout = "part int, tokens long, weights binary"
    folder = scratch_path(corpus.sparkSession, "weights")
    corpus.mapInArrow(train, layout).write.parquet(folder)
    learned = corpus.sparkSession.read.parquet(folder)
    parts = learned.count()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        learned = learned.repartition(parts, "part").mapInArrow(average, layout)
    rows = learned.orderBy("part").collect()
    tokens = sum(r["tokens"] for r in rows)
    return weights if not tokens else sum(np.frombuffer(r["weights"], "<f4") * (r["tokens"] / tokens) for r in rows).astype(np.float32)


def _weights_row(part: int, tokens: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([tokens], pa.int64()), pa.array([weights.astype("<f4").tobytes()], pa.binary())], ["part", "tokens", "weights"]
    )
