"""Language of whole texts in two steps: the family first, then one-versus-one linear machines inside it."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.text import mixed, positional, raw_bytes, text_slices

# Hashed n-grams of bytes: their lengths, and the number of features.
GRAMS, FEATURES = (1, 2, 3), 2_048
# Labelled texts that the machines are fitted on, over all languages together (as many of each, if there are).
SAMPLE = 4_000
UNKNOWN = "und"

_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
_letter = (((_lower >= 0x61) & (_lower <= 0x7A)) | (_lower >= 0x80))
# Everything but ASCII letters and bytes of other characters counts as a space.
PLAIN = np.where(_letter, _lower, 0x20).astype(np.uint8)


@dataclass
class Model:
    """Weights by family, and by pair of languages of one family; every row ends with its intercept."""

    languages: list[str]
    family: np.ndarray
    families: np.ndarray
    pairs: list[tuple[int, int]]
    margins: np.ndarray
    scale: float

    def predict(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each row."""
        rows = len(features)
        if len(self.languages) == 1:
            return np.zeros(rows, np.int64), np.ones(rows)
        x = np.hstack([features, np.ones((rows, 1), features.dtype)])
        score = np.ones(rows)
        group = np.zeros(rows, np.int64)
        if len(self.families) > 1:
            odds = 1 / (1 + np.exp(-self.scale * (x @ self.families.T)))
            group, score = odds.argmax(1), odds.max(1) / odds.sum(1)
        votes = np.zeros((rows, len(self.languages)))
        sure = np.zeros((rows, len(self.languages)))
        for (a, b), margin in zip(self.pairs, (x @ self.margins.T).T if self.pairs else []):
            odds = 1 / (1 + np.exp(-self.scale * margin))
            for one, won in ((a, odds), (b, 1 - odds)):
                votes[:, one] += won > 0.5
                sure[:, one] += won
        mates = self.family[None, :] == group[:, None]
        alone = mates.sum(1) == 1
        rank = np.where(mates, votes + sure / (len(self.languages) + 1), -1)
        best = rank.argmax(1)
        inside = sure[np.arange(rows), best] / np.maximum(mates.sum(1) - 1, 1)
        return best, np.clip(score * np.where(alone, 1.0, inside), 0, 1)


def gram_counts(column: pa.Array, features: int = FEATURES) -> np.ndarray:
    """Hashed counts of byte n-grams of each text: root of the counts, each row of length 1."""
    data, offsets = raw_bytes(column)
    rows = len(offsets) - 1
    data = PLAIN[data].astype(np.uint64)
    doc = np.repeat(np.arange(rows), np.diff(offsets))
    counts = np.zeros(rows * features)
    for n in GRAMS:
        if len(data) < n:
            continue
        key = np.full(len(data) - n + 1, n, np.uint64)
        for i in range(n):
            key = key * np.uint64(257) + data[i : len(data) - n + 1 + i]
        inside = doc[: len(key)] == doc[n - 1 :]
        # two or more spaces say nothing
        inside &= ~((data[: len(key)] == 0x20) & (data[n - 1 :] == 0x20))
        place = (mixed(key[inside]) % np.uint64(features)).astype(np.int64) + doc[: len(key)][inside] * features
        counts += np.bincount(place, minlength=len(counts))
    counts = np.sqrt(counts.reshape(rows, features))
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)


def linear_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights of a linear support vector machine: squared hinge, by accelerated gradient steps. y is -1 or 1.

    The last column of ``x`` is 1 in every row. No copy of ``x`` is made.
    """
    weight = weight / weight.sum()
    step = 1 / (2 * (weight @ np.einsum("ij,ij->i", x, x)) + strength)
    now = ahead = np.zeros(x.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead.astype(x.dtype)))
        slope = -2 * ((weight * slack * y).astype(x.dtype) @ x) + strength * ahead
        new = ahead - step * slope
        ahead, now = new + k / (k + 3) * (new - now), new
    return now


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that give both sides the same say."""
    return np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1))


def families_of(centres: np.ndarray) -> np.ndarray:
    """Languages grouped by likeness: average linkage down to the root of their number, rounded up."""
    groups = [[i] for i in range(len(centres))]
    unit = centres - centres.mean(0)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    alike = unit @ unit.T
    while len(groups) > int(np.ceil(np.sqrt(len(centres)))):
        ties = [(alike[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = max(ties)
        groups[-i] += groups.pop(-j)
    found = np.zeros(len(centres), np.int64)
    for number, members in enumerate(groups):
        found[members] = number
    return found


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """A model from the rows of ``labelled`` whose label is not null; None if there are none.

    At most about ``sample`` texts are used, evenly over the languages and chosen by a hash of ``key``: that
    bounds what the driver receives. Whole texts are turned into features on the executors.
    """
    known = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"), F.col(key).alias("key"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = sample // len(languages)
    order = F.xxhash64("key", "text")
    draw = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    limit = F.element_at(F.create_map(*[v for k in languages for v in (F.lit(k), F.lit(share / counts[k]))]), F.col("label"))
    chosen = known.where(draw < limit).select("label", order.alias("order"), "text")

    def features(batches):
        for batch in text_slices(batches):
            rows = gram_counts(batch.column("text")).astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("order"), pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "order", "features"]
            )

    found = chosen.mapInArrow(features, "label string, order long, features binary").toArrow()
    if not found.num_rows:
        return None
    # equal texts under one key have equal features, so the order of the rows is always the same
    place = pc.sort_indices(found.select(["label", "order"]), [("label", "ascending"), ("order", "ascending")]).to_numpy()
    labels = found.column("label").take(place).to_pylist()
    languages = sorted(set(labels))
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    x = np.ones((len(labels), FEATURES + 1), np.float32)
    for i, row in zip(rank, found.column("features")):
        x[i, :-1] = np.frombuffer(row.as_buffer(), "<f4")
    del found
    pa.default_memory_pool().release_unused()
    y = np.array([languages.index(label) for label in labels])
    family = families_of(np.stack([x[y == i, :-1].mean(0, dtype=np.float64) for i in range(len(languages))]))
    groups = range(family.max() + 1)
    machines = []
    for g in groups if len(groups) > 1 else []:
        side = np.where(family[y] == g, 1.0, -1.0)
        machines.append(linear_machine(x, side, balanced(side)))
    pairs, margins = [], []
    for a in range(len(languages)):
        for b in range(a + 1, len(languages)):
            if family[a] == family[b]:
                both = (y == a) | (y == b)
                side = np.where(y[both] == a, 1.0, -1.0)
                pairs.append((a, b))
                margins.append(linear_machine(x[both], side, balanced(side)))
    return Model(languages, family, np.array(machines), pairs, np.array(margins), scale=4.0)


def has_letter(texts: list[str | None]) -> list[bool]:
    """Whether a text has a letter of any script."""
    return [t is not None and (any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t))) for t in texts]


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from 0 to 1, from the text alone.

    A null text, one without a letter and an empty one are ``und`` with score 0, as is every text if there
    is no model. The score is the family's share times the mean share won against the other languages of the
    family. Rows are judged one by one; the model (a few hundred kilobytes per language) goes along with the
    tasks. Columns of ``docs`` with the name of an added one are replaced.
    """
    rest = docs.drop("lang_pred", "score")
    rows, (text,) = positional(rest, text)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = sent.value
        for batch in text_slices(batches, text, 1 << 20):
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                usable = np.array(has_letter(part.column(text).to_pylist()), bool)
                names, scores = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if known is not None and usable.any():
                    best, score = known.predict(gram_counts(part.column(text)))
                    names[usable] = np.array(known.languages, object)[best[usable]]
                    scores[usable] = score[usable]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names.tolist(), pa.string()), pa.array(scores, pa.float64())],
                    [*part.schema.names, "lang_pred", "score"],
                )

    return rows.mapInArrow(run, schema).toDF(*rest.columns, "lang_pred", "score")
