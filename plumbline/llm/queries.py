"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import bytebpe, jaccard, language, licenses, maskedlm, nearest, packing, repetition, rtree, shards, substrings, tokencounts, tries


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def substring_dedup(spark, folder):
    found = substrings.repeated_spans(table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def length_packing(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def held_out():
    """One document in five, which no language is learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out()))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def byte_shards(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = docs.select(
        "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), shards.text_bytes().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shards.shard_by_bytes(rows, 16, size="size", order="text_md5")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def ngram_jaccard(spark, folder):
    found = jaccard.similarity_classes(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "n_shingles")


def lm_scoring(spark, folder):
    return maskedlm.pseudo_likelihood(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def token_counts(spark, folder):
    return tokencounts.count_tokens(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def multi_index_search(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(rows, F.col("vec_id") % 100 == 0)


def byte_bpe(spark, folder):
    coded = bytebpe.encode(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return bytebpe.decode(coded).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def repetition_rules(spark, folder):
    return repetition.repetition(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def conversation_trie(spark, folder):
    return tries.prefix_trie(tries.rebuilt_turns(table(spark, folder, "conversations")))


def license_scan(spark, folder):
    found = licenses.license_notices(table(spark, folder, "documents").select("doc_id", "text"))
    word = F.transform("places", lambda p: p["word"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        "base_labels", "labels", "score", F.size("blocks").cast("long").alias("n_blocks"),
    )


QUERIES = {
    "op1_substring_dedup": substring_dedup,
    "op2_length_packing": length_packing,
    "op3_language_id": language_id,
    "op4_byte_shards": byte_shards,
    "op5_ngram_jaccard": ngram_jaccard,
    "op6_lm_scoring": lm_scoring,
    "op7_token_counts": token_counts,
    "op8_multi_index_search": multi_index_search,
    "op9_byte_bpe": byte_bpe,
    "op10_repetition_rules": repetition_rules,
    "op11_hard_negatives": hard_negatives,
    "op12_conversation_trie": conversation_trie,
    "op13_license_scan": license_scan,
    "pipeline": corpus_pipeline.run,
}

# Words of each document, in order, as the operators split them.
_WORDS = r"""words AS (
    SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
)"""

def _crc(texts: str) -> str:
    """CRC-32 of the bytes of the texts ``t`` that a query gives, by the usual table."""
    return f"""
codes AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS codes
),
texts AS ({texts}),
crcs AS (
    SELECT t, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        list_filter(regexp_split_to_array(regexp_replace(hex(encode(t)), '(..)', '\\1 ', 'g'), ' '), lambda h: h <> ''),
        lambda h: CAST('0x' || h AS BIGINT))),
        lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1]))) AS crc
    FROM texts, codes
)"""


def _repeated(n: int) -> str:
    """Places of words inside windows of n words that their document holds twice or more."""
    return f"""repeated_{n} AS (
    SELECT DISTINCT doc_id, i + unnest(range(0, {n})) AS i
    FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS times
        FROM (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words))
    ) WHERE times > 1
),
covered_{n} AS (
    SELECT doc_id, count(*) AS repeated_words_{n}, sum(length(word)) AS repeated_chars_{n}
    FROM repeated_{n} JOIN each USING (doc_id, i) GROUP BY doc_id
)"""


_LENGTHS = sorted({repetition.WINDOW, *repetition.NGRAM_SHARES})
_KEPT = " AND ".join([
    f"dup_line_chars <= line_chars * CAST({repetition.LINE_SHARE} AS DOUBLE)",
    *(f"repeated_chars_{n} <= word_chars * CAST({share} AS DOUBLE)" for n, share in repetition.NGRAM_SHARES.items()),
])
_FAILED = f"n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.REPEATED_PERCENT} * n_words"

def _license_words(text: str) -> str:
    small = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(regexp_split_to_array({small}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLES = {
    "op1_substring_dedup": f"""
WITH {_WORDS},
windows AS (
    SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)
),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (
    SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS i FROM windows JOIN firsts USING (h) WHERE first < doc_id
),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
""",
    "op4_byte_shards": f"""
WITH {_crc("SELECT DISTINCT coalesce(text, '') AS t FROM documents")},
sized AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS h, coalesce(strlen(text), 0) + 1 AS size FROM documents),
placed AS (
    SELECT doc_id, t, h, size,
           CAST((sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size) * 16 // sum(size) OVER () AS INTEGER) AS shard
    FROM sized
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed JOIN crcs USING (t)
""",
    "op5_ngram_jaccard": f"""
WITH RECURSIVE {_WORDS},
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
    ) JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
    WHERE common >= {jaccard.THRESHOLD} * (p.n + q.n - common) - 1e-9
),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
),
classes AS (SELECT a, min(b) AS class_id FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT documents.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n, 0) AS n_shingles
FROM documents JOIN classes ON classes.a = documents.doc_id
LEFT JOIN counts ON counts.a = documents.doc_id LEFT JOIN sizes ON sizes.doc_id = documents.doc_id
""",
    "op10_repetition_rules": f"""
WITH {_WORDS},
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
{", ".join(_repeated(n) for n in _LENGTHS)},
chars AS (SELECT doc_id, sum(length(word)) AS word_chars FROM each GROUP BY doc_id),
copies AS (
    SELECT doc_id, line, count(*) AS times FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
),
lines AS (
    SELECT doc_id, sum(times - 1) AS n_dup_lines, sum(times * length(line)) AS line_chars, sum((times - 1) * length(line)) AS dup_line_chars
    FROM copies GROUP BY doc_id
),
counted AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ["word_chars", "n_dup_lines", "line_chars", "dup_line_chars", *(f"repeated_chars_{n}" for n in repetition.NGRAM_SHARES)])},
        coalesce(repeated_words_{repetition.WINDOW}, 0) AS n_repeat_words
    FROM words LEFT JOIN chars USING (doc_id) LEFT JOIN lines USING (doc_id) {" ".join(f"LEFT JOIN covered_{n} USING (doc_id)" for n in _LENGTHS)}
)
SELECT *, {_FAILED} AS base_failed, NOT ({_FAILED}) AND {_KEPT} AS kept FROM counted
""",
    "op11_hard_negatives": """
WITH valid AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
    SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS score
    FROM (SELECT * FROM valid WHERE id % 100 = 0) a JOIN valid b ON a.id <> b.id AND len(a.v) = len(b.v)
),
positives AS (
    SELECT anchor, id, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, CAST(p.score AS BIGINT) AS positive_score, CAST(n.score AS BIGINT) AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
""",
    "op12_conversation_trie": f"""
WITH {_crc("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS t FROM conversations WHERE conv_id IS NOT NULL")},
convs AS (SELECT CAST(t AS BIGINT) AS c, crc % 4 AS h FROM crcs),
turns AS (
    SELECT conv_id AS c, id, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS place FROM (
        SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
               len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n
        FROM conversations WHERE conv_id IS NOT NULL
    )
),
rebuilt AS (
    SELECT convs.c, 0 AS part, place, id, n FROM convs JOIN turns ON turns.c = convs.c - convs.c % 20 AND place < h
    UNION ALL
    SELECT convs.c, 1 AS part, place, id, n FROM convs JOIN turns ON turns.c = convs.c AND place >= h
),
paths AS (
    SELECT convs.c, coalesce(ids, []) AS ids, coalesce(ns, []) AS ns FROM convs
    LEFT JOIN (SELECT c, list(id ORDER BY part, place) AS ids, list(n ORDER BY part, place) AS ns FROM rebuilt GROUP BY c) USING (c)
),
members AS (
    SELECT c, d, len(ids) = d AS over, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, md5(array_to_string(ids[1:d], ',')) AS k, md5(array_to_string(ids[1:d - 1], ',')) AS up
    FROM (SELECT c, ids, ns, unnest(range(0, len(ids) + 1)) AS d FROM paths)
),
nodes AS (
    SELECT d, k, min(up) AS up, min(c) AS c, count(*) AS n_convs, max(n) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (over), '')) AS ends
    FROM members GROUP BY d, k
),
children AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
figures AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (d, k)),
sums AS (
    SELECT members.d, members.k, sum((n_convs - 1) * figures.n) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves
    FROM figures JOIN members ON members.c = figures.c AND members.d <= figures.d GROUP BY ALL
)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, p.c AS parent_conv_id, f.n_convs, f.n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM figures f JOIN sums USING (d, k) LEFT JOIN nodes p ON p.d = f.d - 1 AND p.k = f.up AND f.d > 0
""",
    "op13_license_scan": f"""
WITH parsed AS (SELECT doc_id, {_license_words("coalesce(text, '')")} AS w FROM documents),
each AS (SELECT doc_id, len(w) AS n_words, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM parsed),
phrases(phrase, label) AS (VALUES {", ".join(f"({_quoted(p)}, {_quoted(l)})" for p, l in licenses.PHRASES.items())}),
places AS (
    SELECT doc_id, i - 1 AS word, label FROM (
        SELECT doc_id, w, label, {_license_words("phrase")} AS p, unnest(range(1, len(w) + 1)) AS i FROM parsed, phrases
    ) WHERE w[i:i + len(p) - 1] = p
),
templates AS (
    SELECT t, label, {_license_words("notice")} AS w, CAST(ceil(len(w) * {licenses.STRETCH}) AS BIGINT) AS length, len(list_distinct(w)) AS m
    FROM (VALUES {", ".join(f"({i}, {_quoted(l)}, {_quoted(n)})" for i, (l, n) in enumerate(licenses.TEMPLATES))}) AS v(t, label, notice)
),
tokens AS (SELECT t, label, length, m, unnest(list_distinct(w)) AS word FROM templates),
blocks AS (
    SELECT doc_id, t, label, m, s, count(DISTINCT word) AS n FROM (
        SELECT doc_id, t, label, m, word, length, n_words, unnest(range(greatest(i - length + 1, 1), i + 1)) AS s FROM each JOIN tokens USING (word)
    ) WHERE s <= greatest(n_words - length + 1, 1) GROUP BY doc_id, t, label, m, s HAVING n >= ceil(m * {licenses.CONTAINMENT} - 1e-9)
),
runs AS (
    SELECT doc_id, count(*) AS n_blocks FROM (
        SELECT doc_id, t, s - lag(s) OVER (PARTITION BY doc_id, t ORDER BY s) AS step FROM blocks
    ) JOIN templates USING (t) WHERE step IS NULL OR step >= length GROUP BY doc_id
),
base AS (
    SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id
),
every AS (
    SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM blocks) GROUP BY doc_id
),
best AS (SELECT doc_id, max(n / m) AS share FROM blocks GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base.labels, '') AS base_labels,
       coalesce(every.labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM parsed LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN runs USING (doc_id)
""",
}
