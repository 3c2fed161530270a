"""Splitting texts into the pre-tokens of a word-end BPE file of the tokenizers library.

Texts made only of characters on which all Unicode versions and regex engines agree are split here,
by one regular expression; any other text goes through the library's own normalizer and pre-tokenizer.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import regex
from tokenizers import Tokenizer

from .common import kept

# The pre-token pattern of the vocabulary file and the characters that the short way takes:
# white space and printable ASCII, Latin letters and signs up to U+024F, common punctuation, the euro sign.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
OTHER = r"[^\t\n\x0b\x0c\r\x20-\x7e¡-įı-ɏ‐-‧‰-⁞€]"

_pre_tokens = regex.compile(PRE_TOKEN)
_other = regex.compile(OTHER)


class WordBPE:
    """A loaded vocabulary file: the library's tokenizer and what the array merging needs of it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self._special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        #: finds what keeps a text from the short way, for Arrow's matcher
        self.hinders = "|".join([OTHER, *(x.replace("|", "[|]") for x in self.specials)]) if self.is_known(spec) else ""
        self._short = self.is_known(spec)

    @staticmethod
    def is_known(spec: dict) -> bool:
        return spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == PRE_TOKEN

    def is_plain(self, text: str) -> bool:
        """Whether the short way gives the library's pre-tokens for certain."""
        return self._short and not _other.search(text) and not (self._special and self._special.search(text))

    def chunks(self, text: str) -> list[str]:
        """A plain text's lower-cased runs between white space. No pre-token crosses them."""
        return text.lower().split()

    def words(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk, before the mapping of bytes to characters."""
        return [chunk] if chunk.isalpha() else _pre_tokens.findall(chunk)

    def library_words(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of any text, as byte-mapped characters, and the number of special tokens in it."""
        parts = self._special.split(text) if self._special else [text]
        out = []
        for part in parts:
            normal = self.library.normalizer.normalize_str(part)
            out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out, len(parts) - 1


@kept
@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    """The vocabulary of a file, loaded once in each Python worker."""
    return WordBPE(path)


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]
