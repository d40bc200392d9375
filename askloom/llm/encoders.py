"""Token ids of texts by public tokenizer files.

``Encoder`` reads a file of the tokenizers library.  If it is a plain byte-level
BPE whose ids are in the order of its merges, tiktoken makes the same ids from
the same vocabulary in a quarter of the time; what tiktoken can't take (a very
long run of white space, on which its pattern gives up) and other tokenizers go
to the library.  ``Pieces`` reads a sentencepiece model.

Very long texts are encoded in pieces of some ``PIECE_CHARS``, so that what the
libraries hold for each token stays bounded.  Pieces end before a space between
two ASCII letters.  A byte-level BPE starts a new word there, and a sentencepiece
model merges nothing across it unless its vocabulary says otherwise, which is
checked; so the ids are those of the whole text.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np

#: Characters of a piece, about, and the longest run of white space that tiktoken is given.
PIECE_CHARS = 1 << 20
LONG_RUN = 50_000

_BREAK = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_WHITE = re.compile(r"\s{%d}" % LONG_RUN)


def pieces_of(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts of at least ``size`` characters that end where every tokenizer here ends a word."""
    start = 0
    while len(text) - start > 2 * size:
        found = _BREAK.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


#: How byte-level tokenizers cut a text into words before the merges.
_BYTE_LEVEL_WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _as_ranks(spec: dict) -> dict[bytes, int] | None:
    """A byte-level BPE's vocabulary as bytes with ranks, if its ids are in the order of its merges."""
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = (
        before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and spec.get("normalizer") is None
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
        and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
    )
    if not plain:
        return None
    symbols, special = _byte_symbols(), {x["content"] for x in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    if any(c not in symbols for t in vocab for c in t):
        return None
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    made = [vocab.get("".join(m), -1) for m in pairs]
    singles = [i for t, i in vocab.items() if len(t) == 1]
    in_order = made == sorted(made) and len(singles) == 256 and made and max(singles) < made[0]
    if not in_order or len(made) + 256 != len(vocab):
        return None
    return {bytes(symbols[c] for c in t): i for t, i in vocab.items()}


class Encoder:
    """Token ids of texts, by the tokenizer in a file of the tokenizers library."""

    def __init__(self, path: str, plain: bool = False):
        """``plain``: the strings of special tokens are ordinary text."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [x["content"] for x in spec.get("added_tokens", [])]
        ranks = _as_ranks(spec)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding(
                "file", pat_str=_BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={}
            )

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or len(text) <= 2 * PIECE_CHARS:
            return self._whole(text)
        return np.concatenate([self._whole(x) for x in pieces_of(text)])

    def _whole(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            if len(text) < LONG_RUN or not _WHITE.search(text):
                return self.fast.encode_to_numpy(text, disallowed_special=())
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=np.uint32)

    def vocabulary(self) -> list[bytes]:
        """The bytes of each token of a byte-level tokenizer."""
        symbols = _byte_symbols()
        out = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        return out


class Pieces:
    """Token ids of texts by a sentencepiece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.names = names
        tokens = self.vocabulary()
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in tokens])
        self.places = np.cumsum(self.sizes) - self.sizes
        # a piece that goes on after a space would be lost at a cut
        self.cuts = not any("\u2581" in x.lstrip("\u2581") for x in names)

    def encode(self, text: str) -> np.ndarray:
        if not self.cuts or len(text) <= 2 * PIECE_CHARS:
            return np.array(self.model.encode(text), dtype=np.uint32)
        # the model puts a space before each text: that of the cut
        parts = [x if i == 0 else x[1:] for i, x in enumerate(pieces_of(text))]
        return np.concatenate([np.array(self.model.encode(x), dtype=np.uint32) for x in parts])

    def faithful(self, text: str) -> np.ndarray | None:
        """The ids, or None if their joined bytes aren't the text with a space before it."""
        ids = self.encode(text)
        want = np.frombuffer((" " + text).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or ends[-1] != len(want):
            return None
        at = np.arange(len(want)) + np.repeat(self.places[ids] - (ends - sizes), sizes)
        return ids if np.array_equal(self.flat[at], want) else None

    def vocabulary(self) -> list[bytes]:
        """The bytes of each token: the byte of a byte piece, else the piece with its mark as a space."""
        one = re.compile(r"<0x([0-9A-F]{2})>\Z")
        return [
            bytes([int(m[1], 16)]) if self.model.is_byte(i) and (m := one.match(x)) else x.replace("\u2581", " ").encode()
            for i, x in enumerate(self.names)
        ]


@functools.lru_cache(maxsize=4)
def encoder(path: str, plain: bool = False) -> Encoder | Pieces:
    """One encoder for a worker, however many tasks it runs."""
    return Pieces(path) if path.endswith(".model") else Encoder(path, plain)
