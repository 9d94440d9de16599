"""Token ids of whole texts, run by run.

The tokenizer cuts a text at white space and then into pieces (a word, a digit, marks) and
encodes each on its own, so the ids of a run between white space are looked up once per
worker and kept. Texts with characters outside the plain range, or holding a special
token's string, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex

KEPT_RUNS = 500_000  # runs a worker remembers; above it starts afresh, with equal results

# Fixed value: the piece pattern of the tokenizer file.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Characters that normalization leaves alone but for case, and whose classes are undisputed.
PLAIN = re.compile("[\\t\\n\\r -~¡-¬®-įı-ɏ‐-―‘-‟…]*")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, others above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


_LETTERS = _byte_letters()


class _Letters(dict):
    """For str.translate: a character becomes the letters of its UTF-8 bytes."""

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(_LETTERS[b] for b in chr(code).encode("utf-8", "surrogatepass"))
        return out


class Encoder(dict):
    """Ids of runs as little-endian 32-bit values; unknown runs are encoded on first use."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path = path
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.special = [t["content"] for t in config["added_tokens"]]
        cut = json.dumps(config["pre_tokenizer"])
        # Runs are cut as one known tokenizer does; any other file is left to the library.
        self.by_run = json.dumps(PIECE.pattern.replace(r"\p{L}+", r"[\p{L}]+").replace(r"|\p{N}|", r"|[\p{N}]|"))[1:-1] in cut
        self.by_run &= config["model"]["type"] == "BPE" and config["normalizer"] is not None
        self.letters = _Letters()
        self.piece_ids: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        out = self.piece_ids.get(piece)
        if out is None:
            ids = [t.id for t in self.model.tokenize(piece.translate(self.letters))]
            self.piece_ids[piece] = out = np.array(ids, "<u4").tobytes()
        return out

    def __missing__(self, run: str) -> bytes:
        out = self._piece(run) if run.isalpha() else b"".join(map(self._piece, PIECE.findall(run)))
        self[run] = out
        return out

    def runs(self, text: str) -> list[str] | None:
        """Lower-cased runs between white space, or None if the library must do the text."""
        if not self.by_run or not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return None
        if len(self) > KEPT_RUNS or len(self.piece_ids) > KEPT_RUNS:
            self.clear()
            self.piece_ids.clear()
        return text.lower().split()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit values."""
        runs = self.runs(text)
        if runs is None:
            ids = self.library.encode(text, add_special_tokens=False).ids
            return np.asarray(ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, runs))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
