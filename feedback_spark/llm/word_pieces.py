"""How a word-end BPE vocabulary file cuts a text before merging.

The file's own rules are applied: special strings are cut out first, then each
text is composed (NFC), split at white space, lower-cased character by
character and cut into pre-tokens by the file's pattern. A word between white
space never depends on its neighbours, so every step runs once per distinct
word.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex

# Fixed value: the characters that the file's \s stands for.
SPACES = "\t-\r \x85\xa0  -     　"
NOT_SPACES = re.compile(f"[^{SPACES}]+")
# str.split() also cuts at these four, which are no white space to the file.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def split_words(text: str) -> list[str]:
    return NOT_SPACES.findall(text) if SEPARATORS.search(text) else text.split()


class Vocabulary:
    """Vocabulary, merges and cutting rules of one tokenizer file."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.strings = [""] * (1 + max(max(self.ids.values()), *self.special.values()))
        for text, number in {**self.ids, **self.special}.items():
            self.strings[number] = text

    def words(self, text: str) -> list[str]:
        """Words between white space; a special string is a word of its own."""
        if "<|" not in text or not self.special_pattern.search(text):
            return split_words(text)
        found: list[str] = []
        for i, part in enumerate(self.special_pattern.split(text)):
            found.extend([part] if i % 2 else split_words(part))
        return found

    def plain(self, text: str) -> str | None:
        """The composed lower-case form of a text that needs no care, else None.

        Special strings, characters that this Python's Unicode tables do not know, spaces that they see differently than
        the file and a sigma, whose small form depends on its neighbours, need care.
        """
        spaced = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if "<|" in spaced or not spaced.isprintable():
            return None
        composed = unicodedata.normalize("NFC", spaced)
        return None if "Σ" in composed else composed.lower()

    def cut(self, text: str) -> list[str]:
        """Pre-tokens and special strings of a whole text, word by word."""
        return [p for w in self.words(text) for p in ([w] if w in self.special else self.pre_tokens(w))]

    def pre_tokens(self, word: str) -> list[str]:
        """Pre-tokens of a word that is no special string."""
        if not word.isprintable() and any(unicodedata.category(c) == "Cn" for c in word):
            return self._by_library(word)
        composed = unicodedata.normalize("NFC", word)
        lower = composed.lower() if "Σ" not in composed else "".join(c.lower() for c in composed)
        # A word of letters alone is one pre-token, as the pattern has no longer match for it.
        return [lower] if lower.isalpha() else self.pattern.findall(lower)

    def _by_library(self, word: str) -> list[str]:
        """Pre-tokens of a word with code points that this Python's Unicode tables do not know, while the library's may."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
        numbers = {letter: byte for byte, letter in enumerate(self.letters)}
        return [bytes(numbers[c] for c in piece).decode() for piece, _ in cut]
