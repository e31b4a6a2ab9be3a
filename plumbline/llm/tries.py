"""Prefix trie of conversations: a burst trie whose containers are sorted and swept by Spark tasks."""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.plans.order import running_total
from plumbline.plans.segments import small
from plumbline.plans.staging import scratch_path

# Conversations and turns of their suffixes that a container holds at most before it is burst.
LIMIT = 2_000
# Turns of a conversation that a running aggregate takes in one task, and ids that are joined to one piece before hashing.
STRETCH, PIECE = 65_536, 8_192
# Conversations of one family share first turns: family, and most of them.
FAMILY, SHARED = 20, 4

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
KEY = ["depth", "f1", "f2"]
NOTHING = hashlib.sha256().hexdigest()


def _written(df: DataFrame, label: str) -> DataFrame:
    folder = scratch_path(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def rebuilt_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each conversation c as the first h turns of conversation c - c % 20, then its own after its first h; h is crc32(c) % 4.

    Returns ``conv``, ``depth`` (0 for a row that stands for the beginning, which every conversation has; then 1, 2, ...),
    ``len`` (turns of the conversation), ``id`` (16 bytes that stand for role and text), ``words``. Remainders have the sign of c.
    Turns are ordered by ``turn``, null first, ties by ``id``. Null roles and texts are empty; rows without a conversation
    take no part; equal rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    own = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    counted = _written(own.groupBy("conv", "turn", "id").agg(F.count("*").alias("n"), F.max("words").alias("words")), "turns")
    placed = running_total(counted, ["turn", "id"], ["conv"], weight="n", name="before")
    placed = placed.select("conv", "id", "words", F.explode(F.sequence("before", F.col("before") + F.col("n") - 1)).alias("place"))
    convs = counted.groupBy("conv").agg(F.sum("n").alias("n")).select(
        "conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).alias("h")
    )
    bases = convs.where(F.col("conv") == F.col("base")).select("base", F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    first = placed.where((F.col("conv") % FAMILY == 0) & (F.col("place") < SHARED - 1)).withColumnRenamed("conv", "base")
    out = ["conv", "depth", "len", "id", "words"]
    begin = convs.select("conv", F.lit(0).cast("long").alias("depth"), "len", F.lit(b"").alias("id"), F.lit(0).cast("long").alias("words"))
    shared = convs.join(first, "base").where(F.col("place") < F.col("h")).withColumn("depth", F.col("place") + 1)
    rest = placed.join(convs, "conv").where(F.col("place") >= F.col("h")).withColumn("depth", F.col("place") - F.col("h") + F.col("taken") + 1)
    return begin.union(shared.select(out)).union(rest.select(out))


def _running(rows: DataFrame, made: dict, backwards: bool = False) -> DataFrame:
    """Aggregates ``made`` (name: (aggregate function, column)) over a conversation's rows up to each one.

    Long conversations are cut into stretches, whose totals are carried on, so that none is a task of its own.
    """
    def turned(column):
        return F.desc(column) if backwards else F.asc(column)

    rows = rows.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    long = rows.where(F.col("len") >= STRETCH)
    earlier = Window.partitionBy("conv").orderBy(turned("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = long.groupBy("conv", "stretch").agg(*[f(c).alias(n) for n, (f, c) in made.items()])
    carried = totals.select("conv", "stretch", *[f(n).over(earlier).alias(f"carried_{n}") for n, (f, _) in made.items()])
    inside = Window.partitionBy("conv", "stretch").orderBy(turned("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: f(c).over(inside) for n, (f, c) in made.items()})
    rows = rows.join(small(carried), ["conv", "stretch"], "left")
    both = {n: F.coalesce(F.col(n).bitwiseXOR(F.col(f"carried_{n}")) if f is F.bit_xor else F.col(n) + F.col(f"carried_{n}"), F.col(n)) for n, (f, _) in made.items()}
    return rows.withColumns(both).drop("stretch", *[f"carried_{n}" for n in made])


def _prefixes(turns: DataFrame) -> DataFrame:
    """Adds what names the trie head of each row: ``f1``, ``f2`` (128 bits of all its turns up to here), and its parent's ``p1``, ``p2``."""
    for n, salt in (("1", 7), ("2", 11)):
        turns = turns.withColumn(f"own{n}", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(salt), "depth", "id")))
    found = _running(turns, {"f1": (F.bit_xor, "own1"), "f2": (F.bit_xor, "own2")})
    return found.withColumn("p1", F.col("f1").bitwiseXOR(F.col("own1"))).withColumn("p2", F.col("f2").bitwiseXOR(F.col("own2"))).drop("own1", "own2")


def _burst(rows: DataFrame, limit: int) -> DataFrame:
    """The rows whose head holds more than ``limit`` conversations and turns of their suffixes: these heads are burst by their next turn.

    A round looks at so many levels below the heads burst last, twice as many as the one before.
    """
    low, levels, active, out = 0, 4, None, None
    while True:
        level = rows.where((F.col("depth") >= low) & (F.col("depth") < low + levels))
        if active is not None:
            level = level.join(active, "conv", "left_semi")
        full = level.groupBy(*KEY).agg(F.sum(F.col("len") - F.col("depth") + 1).alias("held")).where(F.col("held") > limit).drop("held")
        burst = _written(level.join(small(full), KEY), "burst")
        out = burst if out is None else out.union(burst)
        low, levels = low + levels, levels * 2
        active = burst.where((F.col("depth") == low - 1) & (F.col("len") >= low)).select("conv")
        if active.isEmpty():
            return out


def _swept(batches):
    """Nodes of containers, whose rows come one after the other, each conversation's in order."""
    nodes = {f.name: [] for f in _SWEPT}

    def emit(node, parent, last=None):
        for name, value in zip(nodes, (node.least, node.depth, parent, node.n, node.children, node.leaves, node.saved, node.digest, *(last or (None, None, None)))):
            nodes[name].append(value)

    def container(paths, above):
        paths.sort(key=lambda path: (path[1], path[0]))
        start, open_ = above[0] + 1, []

        def close():
            node = open_.pop()
            node.finish()
            for child in node.below:
                emit(child, node.least)
            if open_:
                open_[-1].take(node)
            else:
                emit(node, None, above)

        before = ()
        for conv, ids, words in paths:
            same = 0
            while same < len(before) and same < len(ids) and before[same] == ids[same]:
                same += 1
            while len(open_) > same:
                close()
            for i in range(same, len(ids)):
                open_.append(_Node(start + i, words[i]))
            open_[-1].ends.append(conv)
            before = ids
        while open_:
            close()

    def batch():
        out = pa.RecordBatch.from_pydict(nodes, _SWEPT)
        for values in nodes.values():
            values.clear()
        return out

    paths, above = [], None
    for part in batches:
        columns = [part.column(c).to_pylist() for c in ("depth", "b", "p1", "p2", "conv", "id", "words")]
        for depth, b, p1, p2, conv, turn, words in zip(*columns):
            if depth == b + 1 and (b, p1, p2) != above or paths and depth == b + 1 and paths[0][1][0] != turn:
                if paths:
                    container(paths, above)
                paths, above = [], (b, p1, p2)
            if depth == b + 1:
                paths.append((conv, [turn], [words]))
            else:
                paths[-1][1].append(turn)
                paths[-1][2].append(words)
        if len(nodes["depth"]) > 20_000:
            yield batch()
    if paths:
        container(paths, above)
    yield batch()


class _Node:
    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.ends, self.below = depth, words, [], []
        self.n = self.children = self.leaves = self.saved = 0
        self.least = None

    def take(self, child) -> None:
        self.below.append(child)
        self.children += 1
        self.n += child.n
        self.leaves += child.leaves
        self.saved += child.saved
        self.least = child.least if self.least is None else min(self.least, child.least)

    def finish(self) -> None:
        self.ends.sort()
        self.n += len(self.ends)
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.words
        if self.ends:
            self.least = self.ends[0] if self.least is None else min(self.least, self.ends[0])
        self.digest = hashlib.sha256(",".join(map(str, self.ends)).encode()).hexdigest() if self.ends else NOTHING
        self.ends = []


_SWEPT = pa.schema([
    *((n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()),
    ("b", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()),
])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined conversations of each head, in rising order: pieces of ids first, then one stream of pieces a head."""
    def pieces(batches):
        key, first, ids = None, None, []
        out = [[] for _ in range(5)]

        def add():
            for values, value in zip(out, (*key, first, ",".join(ids))):
                values.append(value)

        for batch in batches:
            for *own, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv"))):
                if own != key or len(ids) == PIECE:
                    if ids:
                        add()
                    key, first, ids = own, conv, []
                ids.append(str(conv))
            if len(out[0]) > 256:
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in out[:4]), pa.array(out[4], pa.string())], [*KEY, "first", "ids"])
                out = [[] for _ in range(5)]
        if ids:
            add()
        yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in out[:4]), pa.array(out[4], pa.string())], [*KEY, "first", "ids"])

    def hashes(batches):
        key, state, found = None, None, []
        for batch in batches:
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if own != key:
                    if key is not None:
                        found.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            found.append((*key, state.hexdigest()))
        columns = list(zip(*found)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*KEY, "digest"])

    order = [*KEY, "conv"]
    joined = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "depth long, f1 long, f2 long, first long, ids string")
    streams = joined.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return streams.mapInArrow(hashes, "depth long, f1 long, f2 long, digest string")


def prefix_trie(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see ``rebuilt_turns``): ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has ``conv``, ``depth`` (0 for the beginning), ``len``, ``id``, ``words``. A node is a distinct sequence of first turns; the
    root, the empty one, has all conversations and no parent. Conversations are held in containers under trie heads. A head whose
    container holds more than ``limit`` conversations and turns of suffixes is burst by the next turn, in rounds over more and more
    levels; what is left is dealt to shards by head, where each container's suffixes are sorted and swept into nodes. Burst heads
    get their figures from aggregates over their members: the figures of every node and container stand with their smallest
    conversation, which is a member of all heads above it, so that sums from the deep end of a conversation upwards, added
    over the members of a head, are those of its subtree. Identifiers of one ending, however many, are joined in pieces by many tasks;
    one task then hashes the pieces of a head as a stream.

    Without conversations there is no node. Repeated conversations meet at one node; long ones are cut into stretches.
    """
    rows = _written(_prefixes(turns), "prefixes")
    burst = _burst(rows, limit)
    deepest = burst.groupBy("conv").agg(F.max("depth").alias("b"))
    placed = rows.join(deepest, "conv", "left").withColumn("b", F.coalesce("b", F.lit(-1).cast("long")))
    top = placed.where(F.col("depth") == F.col("b") + 1).select("conv", "f1", "f2", "p1", "p2")
    held = placed.where(F.col("depth") > F.col("b")).select("conv", "depth", "id", "words", "b").join(top, "conv")
    shards = held.repartition("b", "f1", "f2").sortWithinPartitions("b", "f1", "f2", "conv", "depth").select("depth", "b", "p1", "p2", "conv", "id", "words")
    swept = _written(shards.mapInArrow(_swept, f"{NODE}, b long, p1 long, p2 long"), "nodes")

    heads = burst.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max(F.col("len") > F.col("depth")).alias("goes_on"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"),
    )
    heads = _written(heads, "heads")
    tops = swept.where(F.col("b") >= 0)
    children = heads.where(F.col("depth") > 0).select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).unionAll(
        tops.select(F.col("b").alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    ).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    given = heads.select(
        F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.when(F.col("goes_on"), 0).otherwise(1).cast("long").alias("leaves")
    ).unionAll(tops.select("conv_id", "b", "saved_tokens", "n_leaves")).groupBy("conv", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    gained = burst.join(given, ["conv", "depth"], "left").fillna(0, ["saved", "leaves"])
    sums = _running(gained, {"saved_up": (F.sum, "saved"), "leaves_up": (F.sum, "leaves")}, backwards=True)
    sums = sums.groupBy(*KEY).agg(F.sum("saved_up").alias("saved_tokens"), F.sum("leaves_up").alias("n_leaves"))
    parents = heads.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    digests = _end_hashes(burst.where(F.col("len") == F.col("depth")))
    columns = [f.split()[0] for f in NODE.split(", ")]
    above = (
        heads.join(sums, KEY).join(children, KEY, "left").join(digests, KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("ends_sha256", F.coalesce("digest", F.lit(NOTHING)))
    )
    hung = tops.drop("parent_conv_id").join(parents.withColumn("b", F.col("depth") - 1).drop("depth"), ["b", "p1", "p2"])
    inner = swept.where(F.col("b").isNull() | (F.col("b") < 0))
    return above.select(columns).unionAll(hung.select(columns)).unionAll(inner.select(columns))
