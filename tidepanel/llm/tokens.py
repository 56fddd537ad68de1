"""Encoding with the ``tokenizers`` library, once for each new word.

Byte-level and word BPE never merge across the start of a white-space run, so a
text's ids are its words' ids in order. Words repeat, so a bounded table of words
already encoded saves most calls. A new word of letters with punctuation behind
it goes to the library's BPE model as the two pieces its pre-tokenizer makes of
it; any other word, and any text where the cut at white space isn't certain,
goes to ``encode`` whole.
"""

import json
import unicodedata
from array import array

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Words and word stems held at once by one worker; a table is emptied beyond that, which changes no result.
TABLE_WORDS, TABLE_STEMS = 150_000, 350_000
#: Longer words are encoded anew each time.
KEPT_CHARS = 64

#: Separators to str.split that the tokenizers don't see as white space, and the start of special tokens.
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Where a cut before each space and at each line end could differ from the tokenizer's own cuts.
_RUNS = ("  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
#: ASCII punctuation that no contraction starts with.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes printable bytes as themselves and the rest as U+0100 onwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


# Fixed value: how byte-level BPE parts a text before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def by_rank(tokenizer: Tokenizer, kind: dict) -> tiktoken.Encoding | None:
    """A faster encoder of a byte-level vocabulary; None where it isn't certain to give the same ids.

    Merging by rank of the merged token is the same as merging by order of the rules if
    the ids rise with the rules, and every token is what its own rules make of it.
    ``kind`` is the tokenizer's file.
    """
    model, before = kind["model"], kind.get("pre_tokenizer") or {}
    vocabulary = model.get("vocab")
    if before.get("type") != "ByteLevel" or not before.get("use_regex") or kind.get("normalizer") is not None:
        return None
    if model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout") or not isinstance(vocabulary, dict):
        return None
    made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in model["merges"]]
    special = {k for k, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    own = {t: k for t, k in vocabulary.items() if k not in special}
    if any(x >= y for x, y in zip(made, made[1:])) or any([x.id for x in tokenizer.model.tokenize(t)] != [k] for t, k in own.items()):
        return None
    letters = {chr(c): b for b, c in _LETTERS.items()}
    ranks = {bytes(letters[c] for c in t): k for t, k in own.items()}
    return tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Words(dict):
    """Ids of words as bytes; a missing word is encoded and kept."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        out = self.encode(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out


class Encoder:
    """``ids(text)``: the text's ids, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before, normalizer = kind.get("pre_tokenizer") or {}, kind.get("normalizer")
        byte = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normalizer is None
        parts = [x.get("type") for x in before.get("pretokenizers", [])]
        word = parts == ["Split", "ByteLevel"] and before["pretokenizers"][0].get("behavior") == "Removed" and [
            x.get("type") for x in (normalizer or {}).get("normalizers", [])
        ] == ["NFC", "Replace", "Lowercase"]
        self.kind = "byte" if byte else "word" if word else "whole"
        self.model = self.tokenizer.model
        self.ranked = by_rank(self.tokenizer, kind) if self.kind == "byte" else None
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.tails = _Words(self._whole, TABLE_WORDS)
        self.stems = _Words(self._piece, TABLE_STEMS)
        self.heads = _Words(lambda word: self._word(word, ""), TABLE_WORDS)
        self.words = _Words(lambda word: self._word(word, " " if self.kind == "byte" else ""), TABLE_WORDS)
        self.line_end = self._whole("\n") if self.kind == "byte" else b""
        self.line = self.ids("\n")
        self.pieces: list[bytes] | None = None

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Of what the library's pre-tokenizer would hand to its model as one piece."""
        if self.ranked is not None:
            return array("I", self.ranked.encode_ordinary(piece)).tobytes()
        if not piece.isascii() or piece[0] == " ":
            piece = piece.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: str, before: str) -> bytes:
        stem = word.rstrip(_TAIL)
        if not stem.isalpha():
            return self._whole(before + word)
        tail = word[len(stem) :]
        if self.kind == "word":
            if not (stem.isascii() or max(stem) < "ɐ" and "İ" not in stem and unicodedata.is_normalized("NFC", stem)):
                return self._whole(before + word)
            stem = stem.lower()
        out = self.stems[before + stem]
        return out + self.tails[tail] if tail else out

    def _by_line(self, text: str) -> bytes:
        """Byte-level ids: a word takes the space before it, a line end stands alone."""
        lines, head, word = [], self.heads.__getitem__, self.words.__getitem__
        for line in text.split("\n"):
            first, _, rest = line.partition(" ")
            lines.append(head(first) + b"".join(map(word, rest.split(" "))) if rest else head(first))
        return self.line_end.join(lines)

    def ids(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids; a null text has none."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if self.kind != "whole" and not any(x in text for x in _ODD):
            if self.kind == "word":
                return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), dtype=np.uint32)
            if not (text[0].isspace() or text[-1].isspace() or any(x in text for x in _RUNS)):
                return np.frombuffer(self._by_line(text), dtype=np.uint32)
        return np.frombuffer(self._whole(text), dtype=np.uint32)


    def text(self, ids: np.ndarray) -> str:
        """What the ids say, as ``decode(ids, skip_special_tokens=False)`` gives it."""
        if self.kind != "byte":
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        if self.pieces is None:
            letters, added = {c: b for b, c in _LETTERS.items()}, self.tokenizer.get_added_tokens_decoder()
            self.pieces = [
                added[k].content.encode() if k in added else bytes(
                    letters[ord(c)] for c in self.tokenizer.id_to_token(k) or ""
                ) for k in range(self.vocabulary)
            ]
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for the tokenizer file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
