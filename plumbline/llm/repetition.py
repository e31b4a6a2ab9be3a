"""Quality rules by repetition coverage: characters inside repeated word n-grams and repeated lines."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.text import BASE, Words, covered, mixed, positional, span_hashes, sums_between, text_slices

# Words of an n-gram, and the largest share of a text's word characters that repeated ones may cover.
NGRAM_SHARES = {5: 0.40, 8: 0.30, 10: 0.30}
# The largest share of the characters in lines that may stand in copies of earlier lines.
LINE_SHARE = 0.30
LEAST_WORDS, WINDOW, REPEATED_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"


def repetition(
    docs: DataFrame, text: str = "text", shares: dict[int, float] | None = None, line_share: float = LINE_SHARE
) -> DataFrame:
    """``docs`` with counts of repetition and the verdict ``kept``.

    Added columns: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` (lines with a word that
    equal an earlier line), ``n_repeat_words`` (words in windows of eight that occur twice or more),
    ``line_chars`` and ``dup_line_chars`` (characters of lines with a word, and of the repeated ones),
    ``repeated_chars_<n>`` per n-gram length (word characters inside n-grams that occur twice or more, the
    first included), ``base_failed`` (under 20 words, or over 30 % of the words repeated) and ``kept``.
    Every text is judged by itself and as a whole, so nothing is shuffled. A null or empty text has no
    words: all counts 0, base failed. Equal rows get equal results. Columns of ``docs`` with the name of
    an added one are replaced.
    """
    shares = NGRAM_SHARES if shares is None else shares
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "dup_line_chars"]
    added = [*counts, *(f"repeated_chars_{n}" for n in shares)]
    rest = docs.drop(*added, "base_failed", "kept")
    rows, (text,) = positional(rest, text)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])

    def measure(batches):
        for batch in text_slices(batches, text):
            columns = coverage(batch.column(text), list(shares))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(columns[c], pa.int64()) for c in added)], [*batch.schema.names, *added]
            )

    measured = rows.mapInArrow(measure, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    fine = F.col("dup_line_chars") <= F.col("line_chars") * line_share
    for n, share in shares.items():
        fine &= F.col(f"repeated_chars_{n}") <= F.col("word_chars") * share
    out = measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
    return out.toDF(*rest.columns, *added, "base_failed", "kept")


def coverage(column: pa.Array, lengths: list[int]) -> dict[str, np.ndarray]:
    """The counts of ``repetition`` for each text of an Arrow column."""
    words = Words(column)
    hashes = words.hashes()
    letters = (words.data & 0xC0) != 0x80  # the first byte of each character
    chars = sums_between(letters, words.starts, words.ends)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {
        "n_words": words.counts,
        "word_chars": words.per_row(chars),
        "n_symbols": sums_between(symbol[words.data], words.offsets[:-1], words.offsets[1:]),
        "n_repeat_words": words.per_row(repeated(words, hashes, WINDOW)),
    }
    for n in lengths:
        out[f"repeated_chars_{n}"] = words.per_row(np.where(repeated(words, hashes, n), chars, 0))

    breaks = words.data == 0x0A
    starts = np.union1d(np.flatnonzero(breaks) + 1, words.offsets[:-1])
    starts = starts[starts < len(words.data)]
    ends = np.append(starts[1:], len(words.data))
    ends = np.where((ends > starts) & breaks[ends - 1], ends - 1, ends) if len(ends) else ends
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    doc = np.searchsorted(words.offsets, starts, "right") - 1
    keys = span_hashes(words.sums, starts, ends, BASE) ^ mixed(doc.astype(np.uint64) + np.uint64(1))
    again = pd.Series(keys).duplicated().to_numpy()
    chars = sums_between(letters, starts, ends)
    rows = len(words.counts)
    out["n_dup_lines"] = np.bincount(doc[again], minlength=rows)
    out["line_chars"] = np.bincount(doc, chars, rows).astype(np.int64)
    out["dup_line_chars"] = np.bincount(doc[again], chars[again], rows).astype(np.int64)
    return out


def repeated(words: Words, hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that occurs twice or more in their text."""
    starts, grams = words.windows(hashes, n)
    keys = grams ^ mixed(words.doc[starts].astype(np.uint64) + np.uint64(1))
    twice = pd.Series(keys).duplicated(keep=False).to_numpy()
    return covered(starts[twice], n, len(hashes))
