"""Token ids of texts by a tokenizer that never joins white space, one encoding per distinct word.

Such a tokenizer drops white space and treats every run between white space by itself, so a text's ids
are those of its words in turn. A worker remembers the words that it met first, which hold the frequent
ones; any other is encoded whenever it comes.
"""

import json
import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

# Words that a worker remembers (about 200 bytes each), and the longest of them in bytes.
KEPT_WORDS, KEPT_BYTES = 600_000, 48
# Letters whose lower case and composed form are plain, then marks without an apostrophe: two matches of the
# pattern. The library's model gets them directly, which saves its normaliser and its pattern.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ſ]*)([!-&(-/:-@[-`{-~]*)")


class WordTokens(dict):
    """The ids of each word, as little-endian unsigned 16-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        setup = json.loads(self.library.to_str())
        steps = [s["type"] for s in (setup["normalizer"] or {}).get("normalizers", [])]
        cuts = json.dumps(setup["pre_tokenizer"], ensure_ascii=False)
        if steps != ["NFC", "Replace", "Lowercase"] or '"Removed"' not in cuts or "[\\\\p{L}]+" not in cuts:
            raise ValueError(f"{path} does not drop white space between lower-case words")
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} has ids beyond 16 bits")
        # a lower-case start of a special string must not become one
        self.special = [t["content"][:2].encode() for t in setup["added_tokens"]]
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)

    def words(self, raw: bytes) -> list[bytes]:
        """The words of a text. ASCII letters are lowered first, which the library would do itself.

        That changes nothing unless a combining mark (U+0300-U+033F) follows, for which some capitals
        have no composed form, or a special string appears.
        """
        if b"\xcc" not in raw and not any(s in raw for s in self.special):
            raw = raw.lower()
        return raw.split()

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, words))

    def count(self, words: list[bytes]) -> int:
        return len(self.ids(words)) // 2

    def __missing__(self, word: bytes) -> bytes:
        plain = PLAIN.fullmatch(word.decode()) if len(word) <= KEPT_BYTES else None
        if plain and plain[1] and plain[2]:
            ids = self[plain[1].encode()] + self[plain[2].encode()]
        elif plain:
            ids = self._packed(t.id for t in self.library.model.tokenize(self._shown(plain[0].lower())))
        else:
            ids = self._packed(self.library.encode(word.decode(), add_special_tokens=False).ids)
        if len(self) < KEPT_WORDS and len(word) <= KEPT_BYTES:
            self[word] = ids
        return ids

    def _shown(self, text: str) -> str:
        return text if text.isascii() else self.bytes.pre_tokenize_str(text)[0][0]

    @staticmethod
    def _packed(ids) -> bytes:
        return array("H", ids).tobytes()


@lru_cache(maxsize=4)
def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this worker process."""
    return WordTokens(path)
