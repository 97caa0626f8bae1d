"""Token counts by the whole-token shortcut.

A vocabulary string is "whole" if the tokenizer turns it, standing alone as a pre-token, into exactly its own
id. Which strings are whole is proved offline, when the tokenizer is loaded: every vocabulary string that is
one pre-token is put through the merges once. Counting then splits a text into pre-tokens, counts each whole
one as one token without any merge, and merges only the rest.

Defined cases: a null text is an empty one with no tokens; special strings inside a text count as the library
counts them by default; very long texts are counted whole; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored. Tokenizers that aren't byte-level BPE, and texts with
characters on whose class libraries differ, go through the library itself.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import per_text

#: Fixed value: how byte-level BPE files with use_regex split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks of Unicode whose letters, digits and blanks all libraries agree on. Other texts take the library.
AGREED = "\x00-ԯḀ-⁯₠-₿℀-⅏←-⏿─-⟿　-〿ぁ-ゖァ-ヾ一-龿가-힣"
#: Merged pre-tokens that a task remembers; it starts anew beyond that.
MEMORY = 400_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE file with its whole strings."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in self.letters.items()}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split = regex.compile(SPLIT)
        self.odd = regex.compile(f"[^{AGREED}]")
        self.parts = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.whole = self.proved()

    def proved(self) -> dict[str, int]:
        """Vocabulary strings that are one pre-token and that the merges give back as one token, with their ids."""
        found = []
        for letters, i in self.library.get_vocab(with_added_tokens=False).items():
            try:
                text = bytes(self.bytes_of[c] for c in letters).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if not self.odd.search(text) and self.split.findall(text) == [text]:
                found.append((text, i))
        encoded = self.plain.encode_batch([t for t, _ in found], add_special_tokens=False)
        return {t: i for (t, i), e in zip(found, encoded) if e.ids == [i]}

    def merged(self, pre_token: str) -> int:
        """Tokens of one pre-token that isn't whole, by the file's merges."""
        return len(self.plain.model.tokenize("".join(map(self.letters.__getitem__, pre_token.encode()))))

    def counter(self) -> Counts:
        return Counts(self)

    def count(self, text: str, counts: Counts) -> int:
        if not text:
            return 0
        if not text.isascii() and self.odd.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.parts is None or not self.parts.search(text):
            return counts.of(self.split.findall(text))
        pieces = self.parts.split(text)
        return sum(counts.of(self.split.findall(p)) for p in pieces) + len(pieces) - 1


class Counts(dict):
    """Tokens by pre-token: 1 for whole ones, merged on first sight for the rest."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self.vocabulary = vocabulary
        self.most = len(self) + MEMORY

    def __missing__(self, pre_token: str) -> int:
        n = self.vocabulary.merged(pre_token)
        if len(pre_token) <= 64:
            self[pre_token] = n
        return n

    def of(self, pre_tokens: list[str]) -> int:
        n = sum(map(self.__getitem__, pre_tokens))
        if len(self) > self.most:
            self.clear()
            self.update(dict.fromkeys(self.vocabulary.whole, 1))
        return n


@functools.lru_cache(maxsize=2)
def byte_level(path: str) -> Vocabulary | None:
    """The vocabulary of a byte-level BPE file that splits by SPLIT; None for files of another kind."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    fits = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
    simple = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    return Vocabulary(path) if model.get("type") == "BPE" and plain and fits and simple else None


def counting(path: str):
    """A function from texts to token counts, for one task."""
    if vocabulary := byte_level(path):
        counts = vocabulary.counter()
        return lambda text: vocabulary.count(text, counts)
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text)) if text else 0
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: len(library.encode(text, add_special_tokens=False).ids) if text else 0


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; one narrow pass, no shuffle.

    tokenizer: path of a file that every executor can open."""

    def make():
        count = counting(tokenizer)

        def score(texts: Iterable[str | None]):
            for t in texts:
                n = count(t or "")
                yield len((t or "").encode()), n, n > limit

        return score

    return per_text(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", "n_bytes long, n_tokens long, over_limit boolean", make)
