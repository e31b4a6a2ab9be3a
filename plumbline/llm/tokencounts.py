"""Token counts of whole texts, huge ones by overlapping chunks that are joined at stable boundaries."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.text import WHITE, positional, text_slices
from plumbline.llm.wordtokens import WordTokens, word_tokens

TOKENIZER = "word_bpe_49k.json"
# Bytes of a chunk of a long text, and of the part that it shares with the next one.
CHUNK, OVERLAP = 16_384, 256
SPACES = bytes(b for b in range(256) if WHITE[b])


def count_tokens(
    docs: DataFrame, text: str = "text", path: str | None = None, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    The tokens are those of the tokenizers library for the file ``path``, without special tokens added.
    A text longer than ``chunk`` bytes is encoded in chunks that overlap; see ``chunked_count``. The memory
    of a task is bounded by a chunk, or by the longest run without white space. Null and empty texts have
    0 bytes and 0 tokens. Every row is counted by itself; columns of ``docs`` with the name of an added
    one are replaced.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    rest = docs.drop("n_bytes", "n_tokens", "over_limit")
    rows, (text,) = positional(rest, text)
    schema = T.StructType([*rows.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches):
        tokens = word_tokens(path)
        for batch in text_slices(batches, text):
            texts = batch.column(text).cast(pa.large_binary()).to_pylist()
            sizes = [len(t or b"") for t in texts]
            counts = [chunked_count(tokens, t or b"", chunk, overlap) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                [*batch.schema.names, "n_bytes", "n_tokens"],
            )

    counted = rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
    return counted.toDF(*rest.columns, "n_bytes", "n_tokens", "over_limit")


def chunked_count(tokens: WordTokens, raw: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, encoded chunk by chunk.

    Neighbouring chunks share ``overlap`` bytes. The first white space there is a boundary that the
    tokenizer never crosses, whatever stands around it: a chunk's tokens up to it are final, and those after it
    must be the next chunk's first ones. Without such a boundary, or if the tokens differ, the shared part
    is doubled, up to the end of the text.
    """
    start = total = 0
    while len(raw) - start > chunk:
        cut, shared = start + chunk, overlap
        while True:
            end = min(cut + shared, len(raw))
            boundary = first_space(raw, cut, end)
            if boundary is not None and aligned(tokens, raw, start, boundary, end):
                break
            if end == len(raw):
                return total + tokens.count(tokens.words(raw[start:]))
            shared *= 2
        total += tokens.count(tokens.words(raw[start:boundary]))
        start = boundary
    return total + tokens.count(tokens.words(raw[start:]))


def first_space(raw: bytes, start: int, end: int) -> int | None:
    """Where the first white space of raw[start:end] stands."""
    rest = raw[start:end]
    kept = len(rest) - len(rest.lstrip(SPACES))
    if kept:
        return start
    words = rest.split(None, 1)
    return start + len(words[0]) if words and len(words[0]) < len(rest) else None


def aligned(tokens: WordTokens, raw: bytes, start: int, boundary: int, end: int) -> bool:
    """Whether the chunk's tokens after the boundary are the ones that an encoding from there begins with.

    The last word is left out: the chunk may end inside it.
    """
    tail = tokens.words(raw[boundary:end])[:-1]
    chunk = tokens.words(raw[start:end])[:-1]
    return not tail or tokens.ids(chunk[-len(tail):]) == tokens.ids(tail)
