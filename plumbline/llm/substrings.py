"""Substring deduplication: word windows that begin in an earlier document too, found by suffix automata."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.text import WORD_BASE, Words, positional, running_sums, span_hashes, text_slices
from plumbline.plans.staging import scratch_path

WINDOW = 50
# Words of the grams whose least hash routes a window to a shard.
GRAM = 10
# Passages of one gram that an automaton takes in; the windows of a commoner gram are routed one by one.
COMMON = 24
# A stretch begins where the hash of a gram is the least of so many on either side.
REACH = 4
SECOND_BASE = 0xC2B2AE3D27D4EB4F


class SuffixAutomaton:
    """All runs of words of some passages; each state knows the smallest owner of the passages that it ends in."""

    def __init__(self):
        self.steps: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, length: int, steps: dict, link: int, owner) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(owner)
        return len(self.link) - 1

    def _split(self, at: int, word, target: int) -> int:
        """The state of the longest run that ``at`` + ``word`` stands for, cut out of ``target`` if that is longer."""
        if self.length[target] == self.length[at] + 1:
            return target
        clone = self._state(self.length[at] + 1, dict(self.steps[target]), self.link[target], None)
        self.link[target] = clone
        while at >= 0 and self.steps[at].get(word) == target:
            self.steps[at][word] = clone
            at = self.link[at]
        return clone

    def add(self, words: list, owner) -> None:
        last = 0
        for word in words:
            target = self.steps[last].get(word)
            if target is not None:
                last = self._split(last, word, target)
            else:
                new, at = self._state(self.length[last] + 1, {}, 0, None), last
                while at >= 0 and word not in self.steps[at]:
                    self.steps[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    self.link[new] = self._split(at, word, self.steps[at][word])
                last = new
            if self.owner[last] is None or owner < self.owner[last]:
                self.owner[last] = owner

    def finish(self) -> None:
        """Hand the owners down: a run ends wherever a longer run with that end does."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up, owner = self.link[state], self.owner[state]
            if up > 0 and owner is not None and (self.owner[up] is None or owner < self.owner[up]):
                self.owner[up] = owner

    def owners(self, words: list, window: int) -> list:
        """Streams ``words`` and gives, for each run of ``window`` words, its smallest owner, or None if it is not there.

        The matching length is kept at ``window`` words at most, so the state is that of the window itself.
        """
        state = matched = 0
        found = []
        for i, word in enumerate(words):
            while state and word not in self.steps[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.steps[state]:
                state, matched = self.steps[state][word], matched + 1
            if matched > window:
                matched = window
            while self.length[self.link[state]] >= max(matched, 1) and state:
                state = self.link[state]
            if i + 1 >= window:
                found.append(self.owner[state] if matched == window else None)
        return found


def passages(column: pa.Array, window: int, gram: int) -> tuple[Words, np.ndarray, ...]:
    """Runs of windows of one text that share their least gram hash: the words, and row, hash, first window and windows of each."""
    words = Words(column)
    hashes = words.hashes()
    starts, grams = words.windows(hashes, gram)
    least = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    least[starts] = grams
    span = window - gram + 1
    least = _sliding_least(least, span)
    first, _ = words.windows(hashes, window)
    value, doc = least[first], words.doc[first]
    change = np.ones(len(first), bool)
    change[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    begins = np.flatnonzero(change)
    runs = np.diff(np.append(begins, len(first)))
    return words, hashes, doc[begins], value[begins], first[begins], runs


def _sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of values[i : i + span] for each i, from the running least of blocks of ``span``."""
    size = -(-max(len(values), 1) // span) * span + span
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.arange(len(values))
    return np.minimum(behind[at], ahead[at + span - 1])


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, common: int = COMMON) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``spans`` and ``kept_text``.

    A window is ``window`` consecutive words of one document; it is a repeat if the same words also stand in a
    document with a smaller ``key``. Every word of a repeat is removed: ``spans`` are the maximal runs, as
    (first word, words), and ``kept_text`` is the text without them, with its white space otherwise unchanged.
    Windows are judged on the input. Documents with a null key, and texts that are null, empty or shorter
    than a window, stay as they are; documents with equal keys do not remove from each other. Equal rows
    give equal results: their places are merged wherever rows of one key and text are gathered, so the work grows with their number and no faster.

    The reference is the table itself, in shards that follow the content: each window belongs to the least
    hash of its grams of ``gram`` words, and a passage is a run of windows with one such gram. Grams of one
    document alone are dropped. The passages of a gram are merged where equal, make one suffix automaton, and
    are streamed through it; matching statistics of ``window`` words give each window its smallest owner.
    Where a gram has more than ``common`` passages, they are cut into short stretches at places that their words
    decide, and equal stretches (128 bits of hash) are merged before the shuffle. A stretch that an earlier
    document has goes as a whole; the windows of any other are looked up one by one in the same way. The earliest document
    of a window is the earliest of its stretch, too, so none is missed, and no group is larger than ``common``.
    """
    spark = docs.sparkSession
    rest = docs.drop("n_words", "n_removed", "spans", "kept_text")
    kind = docs.schema[key].dataType
    docs, (key, text) = positional(rest, key, text)
    body = docs.select(F.col(f"`{key}`").alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row"))
    body = body.where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    doc = T.StructField("doc", kind)

    def route(batches):
        for batch in text_slices(batches):
            words, _, at, value, first, runs = passages(batch.column("text"), window, gram)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc").take(pa.array(at)), batch.column("row").take(pa.array(at)), pa.array(value.view(np.int64)),
                pa.array((first - words.first[at]).astype(np.int32)), pa.array(runs.astype(np.int32)),
            ], ["doc", "row", "gram", "first", "runs"])

    long, integer = T.LongType(), T.IntegerType()
    routes = body.mapInArrow(route, T.StructType([doc, T.StructField("row", long), T.StructField("gram", long), T.StructField("first", integer), T.StructField("runs", integer)]))
    shared = routes.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
    shared = shared.where(F.col("low") < F.col("high")).select("gram", (F.col("n") > common).alias("common"))
    spots = routes.join(shared, "gram").groupBy("doc", "row").agg(F.collect_set(F.struct("first", "runs", "gram", "common")).alias("spots"))

    def extract(batches):
        for batch in text_slices(batches):
            words = Words(batch.column("text"))
            hashes, raw = words.hashes(), words.data.tobytes()
            rows = {c: [] for c in ("at", "firsts", "runs", "key", "key2", "passage", "windows")}
            for at, spots in enumerate(batch.column("spots").to_pylist()):
                base, lone, own = words.first[at], [], {}  # what a text holds more than once is one row with all its places
                for spot in spots:
                    if spot["common"]:
                        lone.append(np.arange(spot["first"], spot["first"] + spot["runs"]))
                    else:
                        begin = base + spot["first"]
                        end = begin + spot["runs"] + window - 1
                        span = raw[words.starts[begin] : words.ends[end - 1]]
                        own.setdefault((spot["runs"], spot["gram"], 0, b" ".join(span.split()).decode(), None), []).append(spot["first"])
                if lone:
                    lone = np.sort(np.concatenate(lone))
                    begin = int(lone[0])
                    first, *stretches = _stretches(hashes[base + begin : base + int(lone[-1]) + window], lone - begin, window, gram)
                    for place, runs, one, two, windows in zip((first + begin).tolist(), *stretches):
                        own.setdefault((runs, one, two, None, windows), []).append(place)
                for (runs, one, two, passage, windows), firsts in own.items():
                    for name, value in zip(rows, (at, firsts, runs, one, two, passage, windows)):
                        rows[name].append(value)
            at, kinds = pa.array(rows.pop("at"), pa.int64()), [pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(at), batch.column("row").take(at), *(pa.array(v, k) for v, k in zip(rows.values(), kinds))], ["doc", "row", *rows]
            )

    place = [doc, T.StructField("row", long), T.StructField("firsts", T.ArrayType(integer))]
    keys = [T.StructField("key", long), T.StructField("key2", long)]
    schema = T.StructType([*place, T.StructField("runs", integer), *keys, T.StructField("passage", T.StringType()), T.StructField("windows", T.BinaryType())])
    folder = scratch_path(spark, "passages")
    found = body.join(spots, ["doc", "row"]).mapInArrow(extract, schema).withColumn("passage_id", F.xxhash64("passage"))
    found.write.option("compression", "zstd").parquet(folder)
    found = spark.read.parquet(folder)

    # passages of a gram that is not common: one automaton per gram
    merged = found.where(F.col("passage").isNotNull()).groupBy("key", "passage", "passage_id").agg(F.min("doc").alias("owner"))
    owners = T.ArrayType(T.StructType([T.StructField("runs", integer), T.StructField("owner", kind)]))
    answer = T.StructType([keys[0], T.StructField("passage_id", long), T.StructField("owners", owners)])
    owned = merged.repartition("key").sortWithinPartitions("key", "owner", "passage").mapInArrow(lambda b: _match(b, window, answer), answer)
    earlier = F.exists("owners", lambda o: o["owner"] < F.col("doc"))
    hits = found.where(F.col("passage").isNotNull()).select("doc", "row", "firsts", "key", "passage_id").join(owned, ["key", "passage_id"]).where(earlier)
    hits = hits.select("doc", "row", "firsts", F.transform("owners", lambda o: F.struct(o["runs"].alias("runs"), (o["owner"] < F.col("doc")).alias("gone"))).alias("gone"))

    # stretches of a common gram, then the windows of those that no earlier document has
    stretches = found.where(F.col("passage").isNull()).select("doc", "row", "firsts", "runs", "key", "key2", "windows")
    first = stretches.groupBy("key", "key2").agg(F.min("doc").alias("owner"))
    whole = stretches.drop("windows").join(first, ["key", "key2"]).where(F.col("owner") < F.col("doc"))
    lone = stretches.join(first.withColumnRenamed("owner", "doc"), ["key", "key2", "doc"]).select("doc", "row", "firsts", "windows")

    def single(batches):
        for batch in batches:
            pairs = [np.frombuffer(w, np.int64).reshape(-1, 2) for w in batch.column("windows").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(pairs)), [len(p) for p in pairs]))
            firsts = [[f + k for f in own] for own, p in zip(batch.column("firsts").to_pylist(), pairs) for k in range(len(p))]
            both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(at), batch.column("row").take(at), pa.array(firsts, pa.list_(pa.int32())), pa.array(both[:, 0]), pa.array(both[:, 1])],
                ["doc", "row", "firsts", "key", "key2"],
            )

    lone = lone.mapInArrow(single, T.StructType([*place, *keys]))
    lone = lone.join(lone.groupBy("key", "key2").agg(F.min("doc").alias("owner")), ["key", "key2"]).where(F.col("owner") < F.col("doc"))
    for rows, runs in ((whole, F.col("runs")), (lone, F.lit(1))):
        hits = hits.unionByName(rows.select("doc", "row", "firsts", F.array(F.struct(runs.alias("runs"), F.lit(True).alias("gone"))).alias("gone")))
    hits = hits.groupBy("doc", "row").agg(F.collect_set(F.struct("firsts", "gone")).alias("hits"))
    names = docs.columns
    same = (F.col(key) == F.col("doc")) & (F.xxhash64(F.col(text)) == F.col("row"))
    marked = docs.join(hits, same, "left").select(*names, "hits")

    def remove(batches):
        for batch in text_slices(batches, text):
            words = Words(batch.column(text))
            raw, texts = words.data.tobytes(), batch.column(text).to_pylist()
            removed, spans = [], []
            for at, hits in enumerate(batch.column("hits").to_pylist()):
                gone = np.zeros(words.counts[at] + 1, np.int64)
                for hit in hits or ():
                    for place in hit["firsts"]:
                        for run in hit["gone"]:
                            if run["gone"]:
                                gone[place] += 1
                                gone[place + run["runs"] + window - 1] -= 1
                            place += run["runs"]
                edges = np.diff(np.concatenate([[0], (np.cumsum(gone)[:-1] > 0).astype(np.int8), [0]]))
                own = list(zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist()))
                spans.append([{"first": a, "words": b - a} for a, b in own])
                removed.append(sum(b - a for a, b in own))
                if own:
                    base, kept, place = words.first[at], [], words.offsets[at]
                    for a, b in own:
                        kept.append(raw[place : words.starts[base + a]])
                        place = words.ends[base + b - 1]
                    texts[at] = b"".join([*kept, raw[place : words.offsets[at + 1]]]).decode()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(words.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, span_type), pa.array(texts, pa.string())],
                [*names, "n_words", "n_removed", "spans", "kept_text"],
            )

    span_type = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))
    span = T.ArrayType(T.StructType([T.StructField("first", integer), T.StructField("words", integer)]))
    return marked.mapInArrow(remove, T.StructType([
        *docs.schema.fields, T.StructField("n_words", long), T.StructField("n_removed", long), T.StructField("spans", span), T.StructField("kept_text", T.StringType()),
    ])).toDF(*rest.columns, "n_words", "n_removed", "spans", "kept_text")


def _stretches(hashes: np.ndarray, windows: np.ndarray, size: int, gram: int) -> tuple:
    """Runs of consecutive windows: first window, windows, two hashes of the words, and two hashes of each window as bytes.

    A run begins where the windows have a gap, and where the first gram of a window has the least hash around.
    """
    sums, more = running_sums(hashes, WORD_BASE), running_sums(hashes, SECOND_BASE)
    starts = np.arange(len(hashes) - gram + 1)
    grams = span_hashes(sums, starts, starts + gram, WORD_BASE)
    ahead = np.full(REACH, np.iinfo(np.uint64).max, np.uint64)
    least = _sliding_least(np.concatenate([ahead, grams]), 2 * REACH + 1)[: len(grams)]
    cut = grams[windows] == least[windows]
    cut[0] = True
    cut[1:] |= windows[1:] != windows[:-1] + 1
    begins = np.flatnonzero(cut)
    runs = np.diff(np.append(begins, len(windows)))
    first = windows[begins]
    one, two = (span_hashes(s, first, first + runs + size - 1, b).view(np.int64).tolist() for s, b in ((sums, WORD_BASE), (more, SECOND_BASE)))
    each = np.stack([span_hashes(s, windows, windows + size, b).view(np.int64) for s, b in ((sums, WORD_BASE), (more, SECOND_BASE))], axis=1)
    return first, runs.tolist(), one, two, [each[a : a + n].tobytes() for a, n in zip(begins, runs)]


def _match(batches, window: int, schema: T.StructType):
    """Owners of the windows of each passage, one automaton per gram; batches come ordered by gram."""
    layout, group = to_arrow_schema(schema), []

    def solve():
        if len(group) == 1:
            key, passage, number, owner = group[0]
            yield {"key": key, "passage_id": number, "owners": [{"runs": passage.count(" ") + 2 - window, "owner": owner}]}
            return
        automaton, texts = SuffixAutomaton(), [p.split(" ") for _, p, _, _ in group]
        for words, (_, _, _, owner) in zip(texts, group):
            automaton.add(words, owner)
        automaton.finish()
        for words, (key, _, number, _) in zip(texts, group):
            runs = []
            for owner in automaton.owners(words, window):
                if runs and runs[-1]["owner"] == owner:
                    runs[-1]["runs"] += 1
                else:
                    runs.append({"runs": 1, "owner": owner})
            yield {"key": key, "passage_id": number, "owners": runs}

    rows = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "passage", "passage_id", "owner"))):
            if group and group[0][0] != row[0]:
                rows.extend(solve())
                group = []
            group.append(row)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, layout)
            rows = []
    if group:
        rows.extend(solve())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, layout)
