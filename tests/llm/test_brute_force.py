"""The queries that SQL cannot express against plain Python, the libraries, or held-out labels."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import maskedlm, packing, queries
from plumbline.llm.bytebpe import ByteBpe
from plumbline.llm.jaccard import fewest_matches
from plumbline.llm.substrings import SuffixAutomaton
from plumbline.llm.text import Words
from plumbline.llm.tokencounts import chunked_count
from plumbline.llm.wordtokens import WordTokens

FOLDER = "/root/testdata/sf0.001"
WORD, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = st.text(alphabet=st.one_of(st.sampled_from("aBcé \n\t.'’sLl<|>1́ẞİΣ \x1c"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def words():
    return WordTokens(WORD)


@pytest.fixture(scope="module")
def coder():
    return ByteBpe(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts(spark, texts, words):
    found = queries.token_counts(spark, FOLDER).collect()
    for r in found:
        assert r.n_tokens == len(words.library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048)


@settings(max_examples=400, deadline=None)
@given(text=ODD | st.just("<|endoftext|> <|ENDOFTEXT|>x"), chunk=st.integers(2, 20), overlap=st.integers(1, 5))
def test_chunks_meet_at_stable_boundaries(words, text, chunk, overlap):
    whole = words.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.ids(words.words(text.encode())), "<u2").tolist() == whole
    assert chunked_count(words, text.encode(), chunk, overlap) == len(whole)


def test_byte_bpe(spark, texts, reference):
    for r in queries.byte_bpe(spark, FOLDER).collect():
        ids = np.array(reference.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(text=ODD)
def test_byte_bpe_of_odd_texts(coder, reference, text):
    ids = np.frombuffer(coder.encode(text), "<u4")
    assert ids.tolist() == reference.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()
    tokens = [reference.decode_single_token_bytes(i) for i in ids.tolist()]
    begins = np.cumsum([0, *map(len, tokens)])[:-1]
    heads = [sum((c & 0xC0) != 0x80 for c in text.encode()[: b + 1]) - 1 for b in begins]
    assert coder.offsets(ids, text.encode()).tolist() == heads


def check_pieces(pieces, texts, words):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for key, own in by_doc.items():
        ids, at = np.array([*words.library.encode(texts[key] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    room = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        room += 4096 - at
    return room / (4096 * len(by_sequence))


def test_packing(spark, texts, words):
    assert check_pieces(queries.length_packing(spark, FOLDER).collect(), texts, words) < 0.03


def test_least_squares_plan():
    counts = Counter({8: 3, 7: 4, 1: 4, 4: 10, 2: 3, 3: 1})
    used = Counter()
    for way, times in packing.plan(counts, 8):
        assert sum(way) == 8 and len(way) <= packing.DEPTH and times > 0
        for u in way:
            used[u] += times
    assert all(used[u] <= counts[u] for u in used) and used[8] == 3 and used[7] == 4 and used[4] >= 8


@settings(max_examples=60, deadline=None)
@given(data=st.lists(st.lists(st.floats(-3, 3), min_size=3, max_size=3), min_size=4, max_size=6), b=st.lists(st.floats(0, 5), min_size=6, max_size=6))
def test_non_negative_least_squares(data, b):
    a, b = np.array(data), np.array(b[: len(data)])
    x = packing.non_negative_least_squares(a, b)
    slope = a.T @ (b - a @ x)
    scale = 1e-5 * (1 + np.abs(a).max() ** 2) * (1 + np.abs(x).max()) + 1e-6
    assert x.min() >= 0 and slope.max() <= scale * 10


def test_language_of_held_out_documents(spark):
    labels = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = [r for r in queries.language_id(spark, "/root/testdata/sf0.01").collect()]
    assert {r.doc_id for r in found if r.held_out} == {i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [r.lang_pred == labels[r.doc_id] for r in found if r.held_out]
    assert len(found) == len(labels) and np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in found)


def test_nearest_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    found = defaultdict(list)
    for r in queries.multi_index_search(spark, "/root/testdata/sf0.1").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 100 == 0):
        away = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
        best = [j for j in np.lexsort((ids, away)) if j != i][:10]
        own = sorted(found[ids[i]])
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and all(s == away[np.searchsorted(ids, v)] for _, v, s in own)
        assert own == sorted(own, key=lambda x: (x[2], x[1]))
        hits += len({v for _, v, _ in own} & set(ids[best]))
    assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()


def test_window_network():
    random = np.random.default_rng(0)
    tokens = np.tile(random.integers(1, 30, 40), 60)
    starts = np.array([0, 1000, 2400])
    view, place = maskedlm.stretched(tokens, starts)
    around = maskedlm.neighbours(view, place[[0, 999, 1000, 1001]])
    assert around[0].tolist() == [0, 0, 0, *tokens[1:4]] and around[1].tolist() == [*tokens[996:999], 0, 0, 0]
    assert around[2].tolist() == [0, 0, 0, *tokens[1001:1004]] and around[3].tolist() == [0, 0, tokens[1000], *tokens[1002:1005]]
    network, at = maskedlm.Network(), np.arange(2400)
    before = network.log_probabilities(maskedlm.neighbours(view, place[at]), tokens).mean()
    for _ in range(150):
        pick = random.integers(0, 2400, 256)
        network.learn(maskedlm.neighbours(view, place[pick]), tokens[pick])
    after = network.log_probabilities(maskedlm.neighbours(view, place[at]), tokens).mean()
    assert before < -5 and after > -2.5
    scores = np.array([network.log_probabilities(around[:1], np.array([c]))[0] for c in range(maskedlm.CLASSES)])
    assert abs(np.exp(scores).sum() - 1) < 1e-5


class Counted(np.ndarray):
    """Notes every function that writes a value for each class of 128 tokens."""

    noted = []

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **named):
        plain = [np.asarray(i) if isinstance(i, Counted) else i for i in inputs]
        if out is not None:
            named["out"] = tuple(np.asarray(o) for o in out)
        found = getattr(ufunc, method)(*plain, **named)
        if np.size(found) == 128 * maskedlm.CLASSES:
            Counted.noted.append(ufunc.__name__)
        return out[0] if out is not None else np.asarray(found).view(Counted)


@pytest.mark.parametrize("rows", [128, 75])
@pytest.mark.parametrize("spread", [1, 60])
def test_a_step_follows_the_gradient(rows, spread):
    """The first step of Adam, from slopes in double precision; wide weights need their scores shifted."""
    random = np.random.default_rng(rows)
    around = random.integers(0, 40, (rows, 2 * maskedlm.SIDE)).astype(np.uint8)
    token = random.integers(1, 40, rows).astype(np.uint8)
    network = maskedlm.Network(maskedlm.Network().weights * np.float32(spread))
    before = network.weights.astype(float)
    table, inner, bias, outer, base = (p.astype(float) for p in maskedlm.Network(network.weights).parts)
    x = table[around].reshape(rows, -1)
    hidden = np.tanh(x @ inner + bias)
    scores = hidden @ outer + base
    slope = np.exp(scores - scores.max(1, keepdims=True))
    slope /= slope.sum(1, keepdims=True)
    slope[np.arange(rows), token] -= 1
    slope /= rows
    back = (slope @ outer.T) * (1 - hidden**2)
    embedded = np.zeros_like(table)
    np.add.at(embedded, around.ravel(), (back @ inner.T).reshape(-1, maskedlm.EMBEDDING))
    gradient = np.concatenate([g.ravel() for g in (embedded, x.T @ back, back.sum(0), hidden.T @ slope, slope.sum(0))])
    network.learn(around, token)
    assert network.first == pytest.approx(0.1 * gradient, rel=2e-3, abs=2e-6 * spread**0.5)
    clear = np.abs(gradient) > 1e-4
    assert (before - network.weights)[clear] == pytest.approx(maskedlm.RATE * np.sign(gradient[clear]), rel=2e-2)


def test_a_step_passes_over_the_scores_once():
    """Beside the products, only the exponential is taken for every class of every token."""
    random = np.random.default_rng(1)
    network = maskedlm.Network()
    network.weights = network.weights.view(Counted)
    network.parts = [p.view(Counted) for p in network.parts]
    Counted.noted = []
    network.learn(random.integers(0, 256, (128, 2 * maskedlm.SIDE)).astype(np.uint8), random.integers(0, 256, 128))
    assert [n for n in Counted.noted if n != "matmul"] == ["exp"]


def test_each_distinct_word_is_looked_up_once(monkeypatch):
    random = np.random.default_rng(2)
    words = random.integers(-(2**63), 2**63 - 1, 500)
    known, listed, logs, totals = np.sort(words[:100]), np.sort(words[:400]), random.random(400), random.random(maskedlm.CLASSES)
    hashes = words[random.integers(0, 500, 20_000)].view(np.uint64)
    asked, found = [], maskedlm._found
    monkeypatch.setattr(maskedlm, "_found", lambda h, k: asked.append(len(h)) or found(h, k))
    coded, own, left = maskedlm._looked_up(hashes, known, totals, listed, logs)
    assert max(asked) <= 500
    log = dict(zip(listed.tolist(), logs))
    for h, c, o, l in zip(hashes.view(np.int64).tolist(), maskedlm._classes(hashes, known), own, left):
        assert o == (log[h] - totals[c] if c <= maskedlm.RARE and h in log else -totals[c] if c <= maskedlm.RARE else 0) and l == (c <= maskedlm.RARE and h not in log)
    assert (coded == maskedlm._classes(hashes, known)).all()


def test_scores_in_plain_python(spark, monkeypatch):
    """Scores from the learned weights and the counts, token by token."""
    weights = []
    learned = maskedlm._round
    monkeypatch.setattr(maskedlm, "_round", lambda *a: weights.append(learned(*a)) or weights[-1])
    draw = np.random.default_rng(6)
    words = [f"w{i}" for i in range(320)]
    docs = [" ".join(words[min(int(x), 319)] for x in draw.exponential(60, int(draw.integers(1, 60)))) for _ in range(60)]
    found = {r.text: r for r in maskedlm.pseudo_likelihood(spark.createDataFrame([(d,) for d in docs], "text string")).collect()}
    counts = Counter(w for d in docs for w in d.split())
    hashed = dict(zip(words, Words(pa.array(words, pa.large_string())).hashes().view(np.int64).tolist()))
    top = sorted(counts, key=lambda w: (-counts[w], hashed[w]))[: maskedlm.CLASSES - maskedlm.RARE - 1]
    known = sorted(hashed[w] for w in top)
    place = {w: maskedlm.RARE + 1 + known.index(hashed[w]) for w in top}
    for w in counts:
        if w not in place:
            place[w] = 1 + int(maskedlm.mixed(np.array([hashed[w]], np.int64).view(np.uint64))[0] % np.uint64(maskedlm.RARE))
    size = Counter()
    for w, n in counts.items():
        size[place[w]] += n
    table, inner, bias, outer, base = (p.astype(float) for p in maskedlm.Network(weights[-1]).parts)
    for d in docs:
        own, total = [place[w] for w in d.split()], 0.0
        for i, w in enumerate(d.split()):
            around = [own[j] if 0 <= j < len(own) else 0 for j in (*range(i - 3, i), *range(i + 1, i + 4))]
            scores = np.tanh(np.concatenate([table[a] for a in around]) @ inner + bias) @ outer + base
            total += scores[own[i]] - np.log(np.exp(scores).sum()) + (np.log(counts[w] / size[own[i]]) if own[i] <= maskedlm.RARE else 0.0)
        assert found[d].log_likelihood == pytest.approx(total, rel=1e-4, abs=1e-3) and found[d].n_tokens == len(own)


def test_likelihood_of_documents(spark, texts):
    found = queries.lm_scoring(spark, FOLDER).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(t.encode().split()) for i, t in texts.items()}
    by_text = defaultdict(set)
    for r in found:
        by_text[texts[r.doc_id]].add(r.log_likelihood)
        assert r.log_likelihood < 0
    assert all(max(s) - min(s) <= 1e-5 * -min(s) for s in by_text.values())  # single precision


@settings(max_examples=200, deadline=None)
@given(passages=st.lists(st.text(alphabet="ab", min_size=1, max_size=15), min_size=1, max_size=5), size=st.integers(1, 5))
def test_suffix_automaton(passages, size):
    automaton = SuffixAutomaton()
    for owner, passage in enumerate(passages):
        automaton.add(list(passage), owner)
    automaton.finish()
    for stream in [*passages, "abbaabab"]:
        want = [min((o for o, p in enumerate(passages) if stream[i : i + size] in p), default=None) for i in range(len(stream) - size + 1)]
        assert automaton.owners(list(stream), size) == want


def test_pruning_bound():
    for n, least in fewest_matches(0.8):
        draws = np.random.default_rng(1).beta(least + 1, n - least + 1, 200_000)
        assert (draws >= 0.8).mean() < 0.01 and 0 < least < n


def test_pipeline(spark, words):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    languages, quality, unique, clean = [], [], [], []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, FOLDER).cache()
        assert docs.columns == before.columns
        {"language_id": languages, "quality_rules": quality, "near_duplicates": unique, "substring_dedup": clean}[name].extend(docs.orderBy("doc_id").collect())

    def shingles(text):
        w = text.encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    # near duplicates: union of all pairs at 0.8, and the smallest id of each
    root, sets = {r.doc_id: r.doc_id for r in quality}, {r.doc_id: shingles(r.text) for r in quality}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert [r.doc_id for r in unique] == [i for i in sorted(root) if root[i] == i]
    # repeated passages: windows of fifty words of earlier documents
    seen, want = {}, {}
    for r in unique:
        w = r.text.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), r.doc_id) < r.doc_id:
                gone[i : i + 50] = [True] * 50
        if not all(gone) or not any(gone):
            want[r.doc_id] = [x for x, g in zip(w, gone) if not g]
    assert {r.doc_id: r.text.encode().split() for r in clean} == want
    assert all(r.n_chars == len(r.text) for r in clean)
    pieces = corpus_pipeline.pack_sequences(spark, docs, FOLDER).collect()
    assert check_pieces(pieces, {r.doc_id: r.text for r in clean}, words) < 0.05
    assert Counter((p.doc_id, p.start, p.length) for p in corpus_pipeline.run(spark, FOLDER).collect()).total() == len(pieces)
