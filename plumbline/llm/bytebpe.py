"""Byte-level BPE: texts to ids with the tokenizers library over Arrow batches, and ids back to bytes."""

import base64
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from plumbline.llm.text import positional, text_slices

RANKS = "byte_bpe_50k.tiktoken"
# Units that a worker remembers, the ones met first (about 250 bytes each), and the longest of them in characters.
KEPT_UNITS, KEPT_CHARS = 500_000, 48
# Fixed value: the characters with the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A word with the space before it, or white space. The pattern's matches never reach across two units.
UNITS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
UNEVEN = re.compile(f"[{SPACE}][{SPACE}]|[{SPACE.replace(' ', '')}](?<!\n)|\0")
# One match of the pattern, or two: letters, and marks without an apostrophe behind them.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@[-`{-~]*)")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it can be seen, else the next one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    table = {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that make ``token`` when all merges of lower rank are done."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        joined = [ranks.get(a + b, own) for a, b in zip(parts, parts[1:])]
        best = min(joined)
        if best >= own:
            return None
        at = joined.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class ByteBpe(dict):
    """Encoder and decoder for a file of ranks; as a dictionary, the ids of each unit."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        ranks = read_ranks(path)
        table = byte_characters()
        shown = {token: "".join(table[b] for b in token) for token in ranks}
        merges = [(shown[m[0]], shown[m[1]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (m := merge_of(t, ranks))]
        self.library = Tokenizer(models.BPE({shown[t]: rank for t, rank in ranks.items()}, merges))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.table = table
        # decoding: the byte behind each character of each id's token, all in one run
        back = {c: b for b, c in enumerate(table)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for id_ in ranks.values():
            tokens[id_] = bytes(back[c] for c in self.library.id_to_token(id_))
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def units(self, text: str) -> list[str]:
        """The text cut where the pattern always cuts: before a word's space, and around white space."""
        if UNEVEN.search(text):
            return UNITS.findall(text)
        return [u for u in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if u]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.units(text)))

    def __missing__(self, unit: str) -> bytes:
        plain = PLAIN.fullmatch(unit) if len(unit) <= KEPT_CHARS else None
        if plain:
            parts = [plain[1], plain[2]] if plain[2] else [plain[1]]
            ids = [t.id for p in parts for t in self.library.model.tokenize("".join([self.table[b] for b in p.encode()]))]
        else:
            ids = self.library.encode(unit, add_special_tokens=False).ids
        ids = array("I", ids).tobytes()
        if len(self) < KEPT_UNITS and len(unit) <= KEPT_CHARS:
            self[unit] = ids
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids. A character whose bytes are split over tokens is whole again here."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at + np.repeat(self.places[ids] - (ends - sizes), sizes)].tobytes()

    def offsets(self, ids: np.ndarray, raw: bytes) -> np.ndarray:
        """The character of the text in which each token begins; a token may begin inside one."""
        begins = np.cumsum(self.sizes[ids]) - self.sizes[ids]
        heads = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        return heads[begins] if len(begins) else begins


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The encoder of this worker process."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids``, binary: unsigned 32-bit integers, little-endian.

    Each match of ``pattern`` is merged by itself by the ranks of the file ``path``; no special tokens.
    ``offsets=True`` adds an array with the character in which each token begins. Null and empty texts give
    no ids. Rows are encoded one by one, in slices of bounded bytes; nothing is shuffled. Columns of ``docs``
    with the name of an added one are replaced.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if offsets:
        added.append(T.StructField("offsets", T.ArrayType(T.IntegerType())))
    rest = docs.drop("n_tokens", "ids", "offsets")
    rows, (text,) = positional(rest, text)

    def run(batches):
        coder = byte_bpe(path, pattern)
        for batch in text_slices(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            ids = [coder.encode(t) for t in texts]
            columns = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if offsets:
                columns.append(pa.array([coder.offsets(np.frombuffer(i, "<u4"), t.encode()).tolist() for i, t in zip(ids, texts)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f.name for f in added)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added])).toDF(*rest.columns, *(f.name for f in added))


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None, as_text: bool = False) -> DataFrame:
    """``rows`` with ``decoded``: the bytes of the ids, or with ``as_text`` the text.

    A run of ids may begin or end inside a character; as text, such bytes become U+FFFD. Null ids
    give no bytes. An id beyond the vocabulary is an error.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    names = rows.drop("decoded").columns
    rows, (ids,) = positional(rows.drop("decoded"), ids)
    field = T.StructField("decoded", T.StringType() if as_text else T.BinaryType())

    def run(batches):
        coder = byte_bpe(path, pattern)
        for batch in text_slices(batches, ids):
            found = [coder.decode(np.frombuffer(i or b"", "<u4")) for i in batch.column(ids).to_pylist()]
            column = pa.array([f.decode(errors="replace") for f in found], pa.string()) if as_text else pa.array(found, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, field])).toDF(*names, "decoded")
