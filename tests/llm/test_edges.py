"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bytebpe, jaccard, language, maskedlm, nearest, packing, repetition, shards, substrings, tokencounts
from plumbline.llm.text import Words

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, shard string, doc string, row long, "
    "`a.b` string, class_id string, n_tokens string, score string, text_md5 string, size long, spans int, ids int, __place int"
)
_random = random.Random(5)
WORDS = ["".join(_random.choices("abcdefghij", k=_random.randint(2, 7))) for _ in range(3000)]
PASSAGE = " ".join(_random.choices(WORDS, k=120))
LONG = " ".join(_random.choices(WORDS, k=60_000))


def rows():
    other = " ".join(_random.choices(WORDS, k=40))
    texts = [
        (None, PASSAGE), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, PASSAGE), (5, PASSAGE), (5, other), (6, PASSAGE), (7, "naïve Σας 漢字 ́ x\x00y"),
        (8, "1234 !!"), (9, PASSAGE + "\n" + PASSAGE), (10, other + " " + PASSAGE), (None, None), (11, "a"), (12, "a"), (13, "x" * 50_000),
    ]
    full = [(i, t, "en", "s", None, "w", "k", "s", "d", 1, "ab", "c", "n", "s", "m", 3, 4, 5, 6) for i, t in texts]
    return [*full, (20, "left blank", *[None] * 17)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


ROWWISE = {
    "repetition": repetition.repetition,
    "tokens": tokencounts.count_tokens,
    "bytes": lambda d: bytebpe.decode(bytebpe.encode(d, offsets=True)),
    "language": lambda d: language.predict(d, language.fit(d)),
    "jaccard": jaccard.similarity_classes,
    "likelihood": maskedlm.pseudo_likelihood,
    "substrings": substrings.repeated_spans,
    "shards": lambda d: shards.shard_by_bytes(d.withColumn("size", shards.text_bytes()).withColumn("text_md5", F.md5("text")), 4),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_every_row_comes_back(docs, name):
    found = ROWWISE[name](docs)
    back = found.select("doc_id", F.xxhash64("text").alias("t"), F.col("`a.b`").alias("other")).collect()
    assert sorted(map(str, back)) == sorted(map(str, docs.select("doc_id", F.xxhash64("text").alias("t"), F.col("`a.b`").alias("other")).collect()))


@pytest.mark.parametrize("name", ROWWISE)
def test_empty_table(docs, name):
    assert ROWWISE[name](docs.where("false")).collect() == []


def test_words_of_nothing(docs):
    found = {r.doc_id: r for r in repetition.repetition(docs).where("doc_id in (1, 2, 3)").collect()}
    assert all(r.n_words == r.word_chars == r.n_dup_lines == 0 and r.base_failed and not r.kept for r in found.values())
    assert {r.n_tokens for r in tokencounts.count_tokens(docs).where("doc_id in (1, 2, 3)").collect()} == {0}
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs)).where("doc_id in (1, 2, 3, 8)").collect()} == {"und"}
    scored = maskedlm.pseudo_likelihood(docs).where("doc_id in (1, 2, 3)").collect()
    assert all(r.n_tokens == 0 and r.log_likelihood == 0 and r.per_token is None for r in scored)


def test_classes_of_copies(docs):
    found = jaccard.similarity_classes(docs).select("doc_id", "class_id", "n_links", "is_kept", F.length("text").alias("n")).collect()
    copies = [r for r in found if r.n == len(PASSAGE) and r.doc_id is not None]
    # both rows of 5, and 6; 9 says the same twice, which adds few shingles
    assert {r.class_id for r in copies} == {5} and {r.n_links for r in copies} == {3}
    assert [r.is_kept for r in sorted(copies, key=lambda r: r.doc_id)] == [True, True, False]
    assert {(r.doc_id, r.class_id, r.n_links) for r in found if r.doc_id in (11, 12)} == {(11, 11, 1), (12, 11, 1)}
    assert all(r.class_id is None and r.n_links == 0 and r.is_kept for r in found if r.doc_id is None)


def test_repeats_of_earlier_documents(docs):
    found = substrings.repeated_spans(docs).collect()
    gone = {(r.doc_id, len(r.text or "")): r.n_removed for r in found}
    assert gone[6, len(PASSAGE)] == 120 and gone[5, len(PASSAGE)] == 0 and gone[None, len(PASSAGE)] == 0
    nine = next(r for r in found if r.doc_id == 9)
    assert nine.n_removed == 240 and nine.kept_text.split() == []
    ten = next(r for r in found if r.doc_id == 10)
    assert ten.n_removed == 160 - 40 and ten.kept_text.split() == ten.text.split()[:40]


def test_pieces_of_nothing(spark, docs):
    assert packing.pack(docs.where("false")).collect() == []
    found = packing.pack(docs).collect()
    assert sorted(r.length for r in found if r.doc_id in (1, 2, 3)) == [1, 1, 1]
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found) and sum(r.doc_id is None for r in found) == 2


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "")
    assert name == "packing" or out.columns == docs.columns
    assert stage(spark, docs.where("false"), "").collect() == []
    kept = {r.doc_id for r in out.collect()}
    if name == "language_id":
        assert kept.isdisjoint({1, 2, 3, 8}) and kept >= {4, 5, 6, 9, 10}
    elif name == "near_duplicates":
        assert 6 not in kept and kept >= {1, 2, 3, 4, 5, 10, 11, None}
        assert out.where("doc_id = 5").count() == 2
    elif name == "substring_dedup":
        assert kept.isdisjoint({6, 9}) and out.where("doc_id = 10").first().n_chars < 400


def test_vectors_that_take_no_part(spark):
    points = [(i, [float(i % 7), float(i // 7), 1.0]) for i in range(70)]
    odd = [(100, None), (200, [0.0, 0.0, 0.0]), (300, [1.0, None, 1.0]), (400, [float("nan"), 1.0, 1.0]), (500, [1.0, float("inf"), 1.0]), (600, [1.0]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([*points, *odd, *((700 + i, [0.0, 0.0, 1.0]) for i in range(40))], "vec_id long, embedding array<float>")
    found = nearest.nearest(table, F.col("vec_id") % 100 == 0, k=5).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in found} == {0, 700}
    assert [r.vec_id for r in found if r.query_id == 0] == [700, 701, 702, 703, 704]
    assert [r.vec_id for r in found if r.query_id == 700] == [0, 701, 702, 703, 704] and {r.score for r in found} == {0.0}
    assert nearest.nearest(table.where("false"), F.col("vec_id") >= 0).collect() == []
    assert nearest.nearest(table.where("vec_id = 7"), F.col("vec_id") >= 0).collect() == []


@pytest.mark.parametrize("size", [8, 11, 1_500])
def test_lone_vectors_have_all_their_neighbours(spark, size):
    """Dense groups make the learned radius small; what lies outside of them, and tiny tables, still get 10 rows or all."""
    draw = np.random.default_rng(size)
    centres = draw.normal(size=(7, 24))
    lone = range(0, size, 30) if size > 100 else range(size)
    points = [(i, (draw.normal(size=24) if i in lone else centres[i % 7] + 1e-4 * draw.normal(size=24)).tolist()) for i in range(size)]
    table = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    asked = [i for i in range(size) if i % 2 == 0]
    found = nearest.nearest(table, F.col("vec_id") % 2 == 0).collect()
    ranks = {i: sorted(r["rank"] for r in found if r.query_id == i) for i in asked}
    assert all(ranks[i] == list(range(1, min(10, size - 1) + 1)) for i in asked)
    assert all(r.query_id != r.vec_id for r in found)
    vectors = np.array([v for _, v in points])
    hits = sum(
        len(set(np.argsort(((vectors - vectors[i]) ** 2).sum(1), kind="stable")[1:11]) & {r.vec_id for r in found if r.query_id == i})
        for i in asked if i in lone
    )
    assert hits >= 0.8 * min(10, size - 1) * sum(i in lone for i in asked)


@pytest.mark.parametrize("spread", [0.3, 0.05])
def test_recall_of_lone_queries(spark, spread):
    """Lone vectors among dense groups are searched as well as the others."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(10, 32))
    vectors = np.concatenate([draw.normal(size=(100, 32)), centres[np.arange(2_900) % 10] + spread * draw.normal(size=(2_900, 32))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = nearest.nearest(table, (F.col("vec_id") < 100) | (F.col("vec_id") % 50 == 0)).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = {i: len(got[i] & set(np.argsort(((vectors - vectors[i]) ** 2).sum(1), kind="stable")[1:11].tolist())) for i in got}
    assert sum(n for i, n in hits.items() if i < 100) >= 0.9 * 1_000 and sum(n for i, n in hits.items() if i >= 100) >= 0.9 * 580


def test_many_equal_rows_of_repeated_passages(spark):
    """A thousand equal rows cost little more than one: nothing is multiplied by their number."""
    table = spark.createDataFrame([(1, PASSAGE)] + [(2, PASSAGE)] * 1_000 + [(3, "x " + PASSAGE)] * 3, "doc_id long, text string")
    found = substrings.repeated_spans(table).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(r) for r in found} == {(1, 0, 1), (2, 120, 1_000), (3, 120, 3)}


def test_words_of_one_class_have_their_own_probability(spark):
    words = [f"w{i}" for i in range(400)]
    classes = maskedlm._classes(Words(pa.array(words, pa.large_string())).hashes(), np.zeros(0, np.int64))
    common, seldom = next((a, b) for i, a in enumerate(words) for j, b in enumerate(words[:i]) if classes[i] == classes[j])
    filler = " ".join(f"f{i}" for i in range(maskedlm.CLASSES))
    texts = [*[filler] * 30, *[f"f1 f2 {common} f3 f4"] * 12, *[f"f1 f2 {seldom} f3 f4"] * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for spread in (maskedlm.SPREAD, maskedlm.CLASSES - 1):  # counts at hand, and joined
        maskedlm.SPREAD, before = spread, maskedlm.SPREAD
        found = {r.text: r.log_likelihood for r in maskedlm.pseudo_likelihood(docs).collect()}
        maskedlm.SPREAD = before
        assert found[texts[30]] - found[texts[-1]] == pytest.approx(np.log(12 / 3), abs=1e-4)


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_every_token_is_a_target_once(rounds):
    parts = [maskedlm.targets(np.arange(7_000), number, rounds) for number in range(rounds)]
    assert sorted(np.concatenate(parts).tolist()) == list(range(7_000))


def test_many_short_texts_of_one_template_in_bounded_memory():
    size, template = 3_000, " ".join(f"w{i}" for i in range(19))
    cell = [(1, 0, 0, 0, i, 1 + i % 2, f"{template} end{i}" if i < size - 5 else " ".join(f"x{i}y{j}" for j in range(20))) for i in range(size)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cell)], ["cluster", "one", "two", "own", "node", "copies", "text"])
    tracemalloc.start()
    found = pa.Table.from_batches(jaccard._verified(iter([batch]), jaccard.THRESHOLD, jaccard.SHINGLE)).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    copies = sum(1 + i % 2 for i in range(size - 5))
    assert {r["node"]: r["links"] for r in found} == {i: copies - 1 - i % 2 for i in range(size - 5)} and {r["root"] for r in found} == {0}
    assert peak < 100e6


def test_short_texts_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 50)
    template = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(i, f"{template} end{i}") for i in range(220)], "doc_id long, text string")
    assert {(r.class_id, r.n_links) for r in jaccard.similarity_classes(docs).collect()} == {(0, 219)}
