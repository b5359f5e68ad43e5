"""Token ids of a white-space-dropping BPE vocabulary (a `tokenizers` JSON file), fast.

Such a vocabulary never lets a token cross white space, so a text's ids are the
ids of its words in a row. Words repeat; each process works a word out once and keeps
its ids. Words of ASCII and Latin-1 characters go through a merge engine for bytes,
over a table read from the same file; all others (other scripts, control characters,
special strings, very long words) go to the library itself, whose encode() takes some
twenty times as long for a word. The caches are bounded and emptied when full; they
never change a result.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

assert sys.byteorder == "little"

#: str.split() parts words at these too, but the vocabulary's pattern does not.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Characters whose NFC form, case and class are the same everywhere.
_PLAIN = re.compile("[\x21-\x7e\xa1-ÿ]+").fullmatch
LONGEST_KEPT = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """encode(texts): the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None, cache_words: int = 500_000):
        import regex
        from tokenizers import Tokenizer

        path = path or default_path()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.suffix = model["model"]["end_of_word_suffix"]
        vocab = model["model"]["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
        self._merge_engine(vocab, merges)
        self.pieces = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = tuple(t["content"] for t in model["added_tokens"])
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge_engine(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        """A byte engine over this vocabulary: one byte for each symbol of a plain word.

        A symbol is a UTF-8 byte, or the last one with the end-of-word suffix. Lower-case
        plain words (digits are pre-tokens of their own) have fewer than 256 of them.
        """
        import tiktoken

        shown = byte_characters()
        inner = [b for b in range(0x21, 0x7F) if not chr(b).isdigit() and not chr(b).isupper()] + [*range(0x80, 0xC0)]
        codes = {shown[b]: i for i, b in enumerate(inner + [0xC2, 0xC3])}
        codes |= {shown[b] + self.suffix: len(codes) + i for i, b in enumerate(inner)}
        self.inner = {b: codes[shown[b]] for b in inner + [0xC2, 0xC3]}
        self.inner = bytes(self.inner.get(b, 0) for b in range(256))
        self.last = bytes(codes.get(shown[b] + self.suffix, 0) for b in range(256))
        spelled = {token: bytes([code]) for token, code in codes.items()}
        self.ids, ranks = [], {}
        for token in codes:
            ranks[spelled[token]] = len(self.ids)
            self.ids.append(vocab[token])
        for a, b in merges:
            if a in spelled and b in spelled:
                spelled[a + b] = spelled[a] + spelled[b]
                ranks[spelled[a + b]] = len(self.ids)
                self.ids.append(vocab[a + b])
        self.engine = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.single = {chr(d): array("I", [vocab[chr(d) + self.suffix]]).tobytes() for d in range(0x30, 0x3A)}

    def _merged(self, piece: str) -> bytes:
        if piece in self.single:
            return self.single[piece]
        raw = piece.encode()
        ids = self.engine(raw[:-1].translate(self.inner) + raw[-1:].translate(self.last))
        return array("I", map(self.ids.__getitem__, ids)).tobytes()

    def word(self, word: str) -> bytes:
        if len(word) > LONGEST_KEPT or not _PLAIN(word) or any(s in word for s in self.special):
            return self._library(word)
        out = []
        word = word.lower()
        for piece in (word,) if word.isalpha() else self.pieces(word):
            ids = self.parts.get(piece)
            if ids is None:
                ids = self.parts[piece] = self._merged(piece)
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if any(c in text for c in _SEPARATORS):
                out.append(self._library(text))
                continue
            words = text.split()
            try:
                out.append(b"".join(map(self.words.__getitem__, words)))
                continue
            except KeyError:
                pass
            if len(self.words) > self.cache_words:
                self.words.clear()
            if len(self.parts) > self.cache_words:
                self.parts.clear()
            known, long = self.words, {}
            for w in words:
                if w not in known:
                    (known if len(w) <= LONGEST_KEPT else long)[w] = self.word(w)
            get = (lambda w, known=known, long=long: long[w] if len(w) > LONGEST_KEPT else known[w]) if long else known.__getitem__
            out.append(b"".join(map(get, words)))
        return out


_ENCODERS: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """The process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
