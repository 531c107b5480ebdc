"""Tokenizing whole texts with the tokenizers library, a pre-token at a time.

A byte-level BPE never merges across pre-tokens.  A Latin text is cut into them
here, by the pattern that the library itself uses; a bounded cache holds their
ids, and only new ones go to the library's model.  A text with other characters
is cut before every space that a non-space follows, which is always a border of
pre-tokens, and its pieces are cached; Latin pieces are cut further, any other
piece, and any that holds a special token's string, goes through the whole
library.  ``tests/llm`` holds the result against whole-text encoding.
"""

import json
import os
import re
from array import array
from itertools import chain

import numpy as np

from .shared import held

_CUT = re.compile(r" (?=\S)")
_RUN = re.compile(r" (?!\S)")
# The pre-token pattern of byte-level BPE, on Latin text.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LATIN = re.compile(rf"[\t\n\r\x20-\x7e{_LETTER}]*")
_PRETOKEN = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")
CACHED = 400_000  # pre-tokens, and as many pieces of texts that aren't Latin: about 80 MB each


class PreTokens(dict):
    """Ids of pre-tokens; a new one is asked of the model."""

    def __init__(self, model, letters: dict[int, str]):
        super().__init__()
        self.model, self.letters, self.space = model, letters, letters[32]

    def __missing__(self, part: str) -> bytes:
        if part.isascii() and not part[-1].isspace():  # only a space in front is spelled otherwise
            shown = self.space + part[1:] if part[0] == " " else part
        else:
            shown = part.encode().decode("latin-1").translate(self.letters)
        ids = self[part] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``plain`` makes the strings of special tokens ordinary text; otherwise they
    are encoded as the tokenizer file says.  A null text is empty.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if plain:
            self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.by_byte = spec["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [] if plain else [t["content"] for t in spec.get("added_tokens", [])]
        self.letters = _byte_letters()
        self.heads: dict[str, bytes] = {"": b""}
        self.rest: dict[str, bytes] = {}
        self.pretokens = PreTokens(self.tokenizer.model, self.letters)
        self.spelled: tuple[list[bytes], np.ndarray] | None = None

    def _latin(self, text: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, _PRETOKEN.findall(text)))

    def _learn(self, cache: dict[str, bytes], new: list[str], before: str) -> None:
        hard = []
        for piece in new:
            text = before + piece
            if not _LATIN.fullmatch(piece) or any(s in text for s in self.special):
                hard.append(piece)
                continue
            cache[piece] = self._latin(text)
        for i in range(0, len(hard), 5000):
            some = hard[i : i + 5000]
            for piece, e in zip(some, self.tokenizer.encode_batch_fast([before + p for p in some], add_special_tokens=False)):
                cache[piece] = array("I", e.ids).tobytes()

    def spell(self, ids: np.ndarray, base: int) -> tuple[bytes, list[int]]:
        """The UTF-8 bytes that ids below ``base`` stand for, one after the other, and where each id's begin (and the last's end)."""
        if self.spelled is None:
            table = [b""] * base
            back = {ord(c): b for b, c in self.letters.items()}
            added = {t["id"]: t["content"].encode() for t in json.loads(self.tokenizer.to_str()).get("added_tokens", [])}
            for token, i in self.tokenizer.get_vocab().items():
                table[i] = added.get(i) or (bytes(map(back.__getitem__, map(ord, token))) if self.by_byte else self.tokenizer.decode([i], skip_special_tokens=False).encode())
            self.spelled = (table, np.array([*map(len, table)], dtype=np.int64))
        table, length = self.spelled
        plain = ids < base
        size = np.where(plain, length[np.where(plain, ids, 0)], 0)
        return b"".join(map(table.__getitem__, ids[plain].tolist())), [0, *np.cumsum(size).tolist()]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_byte:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self.pretokens) > CACHED:
            self.pretokens.clear()
        out = [self._latin(t) if _LATIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in (t or "" for t in texts)]
        odd = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(odd, self._by_pieces([texts[i] for i in odd])):
            out[i] = ids
        return out

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        cut = [_CUT.split(t) if _RUN.search(t) else t.split(" ") for t in texts]
        heads = {p[0] for p in cut}.difference(self.heads)
        rest = set(chain.from_iterable(p[1:] for p in cut)).difference(self.rest)
        if len(self.heads) + len(heads) > CACHED or len(self.rest) + len(rest) > CACHED:
            self.heads, self.rest = {"": b""}, {}
            heads = {p[0] for p in cut} - {""}
            rest = set(chain.from_iterable(p[1:] for p in cut))
        self._learn(self.heads, list(heads), "")
        self._learn(self.rest, list(rest), " ")
        get = self.rest.__getitem__
        return [self.heads[p[0]] + b"".join(map(get, p[1:])) for p in cut]


def encoder(path: str, plain: bool = False) -> PieceEncoder:
    """The process's encoder for a tokenizer: its cache outlives a task where workers are reused."""
    return held(("tokens", path, plain), lambda: PieceEncoder(path, plain))
