"""License notices against plain Python."""

import random
import re
from math import ceil

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from plumbline.llm import licenses

SCHEMA = "doc_id long, text string, labels string, score int, n_words string, _0 int, `a.b` int"


def words_of(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def plain(text, templates=licenses.TEMPLATES):
    words, places, blocks, best = words_of(text), [], [], 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    for number, (label, notice) in enumerate(templates):
        own = words_of(notice)
        length = ceil(len(own) * licenses.STRETCH)
        for i in range(max(len(words) - length, 0) + 1 if words and own else 0):
            share = len(set(own) & set(words[i : i + length])) / len(set(own))
            if share >= licenses.CONTAINMENT - 1e-9:
                blocks.append((number, i))
                best = max(best, share)
    base = sorted({label for _, label in places})
    every = sorted({*base, *(templates[number][0] for number, _ in blocks)})
    runs = {(n, i) for n, i in blocks if not any(m == n and i - licenses.STRETCH * len(words_of(templates[n][1])) < j < i for m, j in blocks)}
    return len(words), sorted(places), ",".join(base), ",".join(every), 1.0 if places else best, len(runs)


def texts():
    random_ = random.Random(11)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in words_of(t)})
    out = [None, "", " \n\t ", "Apache", "APACHE-License apache license", "cc\nby cc by\x00by", "ünder the MIT Licensé mit license", "all RIGHTS reserved", "reserved all"]
    for _, notice in licenses.TEMPLATES:
        words = notice.split()
        for change in (0, 1, len(words) // 6, len(words) // 4):
            kept = [w for i, w in enumerate(words) if i not in random_.sample(range(len(words)), change)]
            for _ in range(change):
                kept.insert(random_.randint(0, len(kept)), random_.choice(["other", *vocabulary]))
            out.append(" ".join([*random_.choices(vocabulary, k=random_.randint(0, 30)), *kept, *random_.choices(vocabulary, k=random_.randint(0, 30))]))
    out += [" ".join(random_.choices(vocabulary, k=300)) for _ in range(20)]
    return out + ["x" * 60_000 + " " + " ".join(random_.choices(vocabulary, k=20_000))] + out[:6]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


def test_notices(spark, rows):
    table = spark.createDataFrame([(None if i == 4 else i, t, "x", 3, "y", 5, 6) for i, t in rows], SCHEMA).repartition(4)
    got = licenses.license_notices(table)
    assert {"doc_id", "_0", "a.b"} < set(got.columns) and len(got.columns) == len(set(got.columns)) == 10
    got = {(r.doc_id if r.doc_id is not None else 4): r for r in got.collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        if len(text or "") < 50_000:
            r = got[i]
            assert (r.n_words, [tuple(p) for p in r.places], r.base_labels, r.labels, r.score, len(r.blocks)) == plain(text), (i, text)
            assert all(b.share >= licenses.CONTAINMENT - 1e-9 for b in r.blocks)


def test_tables_and_templates_of_nothing(spark):
    table = spark.createDataFrame([(1, "mit license", "x", 3, "y", 5, 6)], SCHEMA)
    assert licenses.license_notices(table.where("false")).collect() == []
    row = licenses.license_notices(table, templates=()).first()
    assert (row.labels, row.score, row.blocks) == ("mit", 1.0, [])
    assert licenses.license_notices(table, phrases={}, templates=[("none", "?!")]).first().labels == ""


@settings(max_examples=150, deadline=None)
@given(text=st.lists(st.sampled_from("a b c d e f g h".split()), max_size=40), notice=st.lists(st.sampled_from("a b c d e x".split()), min_size=1, max_size=12), share=st.sampled_from([0.5, 0.8, 1.0]))
def test_filters_lose_nothing(text, notice, share):
    [template] = licenses.read_templates([("t", " ".join(notice))], share)
    words = licenses.words_of(pa.array([" ".join(text), "", "a b"], pa.large_string()))
    ranks = [template.tokens.tolist().index(h) if h in template.tokens else -1 for h in words.hashes()]
    ranks = licenses.np.array(ranks, int)
    starts = licenses.candidates(ranks, words.first, template)
    shared = dict(zip(starts.tolist(), licenses.shared_words(ranks, words.first, starts, template).tolist())) if len(starts) else {}
    need = ceil(len(set(notice)) * share - 1e-9)
    for low, row in ((0, text), (len(text), ["a", "b"])):
        for i in range(max(len(row) - template.length, 0) + 1 if row else 0):
            n = len(set(row[i : i + template.length]) & set(notice))
            assert n < need or shared[low + i] == n
