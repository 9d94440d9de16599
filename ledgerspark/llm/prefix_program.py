"""Exact token counts of every prefix of a text, by a dynamic programme over byte-pair merges.

A byte-pair encoding is valid exactly if each pair of neighbours in it is: encoding the two
tokens' letters gives the two tokens again. So the last token of a prefix is the one vocabulary
entry that ends there and fits the last token of the prefix before it, and

    count(prefix) = count(prefix without its last token) + 1.

The programme runs once over a piece; pieces are counted on their own, as the tokenizer does.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np
import regex

from .pieces_bpe import KEPT_RUNS, PIECE, PLAIN, Encoder

_CLUSTER = regex.compile(r"\X")
# Characters that may be white space; the tokenizer's own normalization decides.
_BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0                　"
_NEVER = sys.maxsize
SHARED = 16  # letters of a piece's beginning whose state is remembered


class Merges:
    """The merges of a vocabulary, and which tokens may stand next to each other."""

    def __init__(self, model: dict):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.made = {}
        for p in pairs:
            self.made.setdefault("".join(p), p)
        self.vocab = model["vocab"]
        self.spines: dict[tuple[str, bool], list[tuple[str, int]]] = {}
        self.fit: dict[tuple[str, str], bool] = {}
        self.sound: dict[str, bool] = {}
        self.known: dict[str | None, tuple[str, int, int]] = {}
        sound = [t for t in self.vocab if self.is_sound(t)]
        self.open = set(sound) if not self.end else {t for t in sound if not t.endswith(self.end)}
        self.closing = {t.removesuffix(self.end): t for t in sound if t.endswith(self.end)}
        self.longest = max((len(t.removesuffix(self.end)) for t in self.vocab), default=1)

    def spine(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The symbols at one edge of a token while it is merged, first to last, each with the
        rank of the merge that takes it up."""
        out = self.spines.get((token, right))
        if out is None:
            out, t, taken = [(token, _NEVER)], token, _NEVER
            while t in self.made:
                taken = self.rank[self.made[t]]
                t = self.made[t][right]
                out.append((t, taken))
            out.reverse()
            self.spines[token, right] = out
        return out

    def meet(self, a: str, b: str) -> tuple[str, str] | None:
        """The first symbols that merge across the border of ``a`` and ``b``, if any do. Of equal
        merges the left one goes first."""
        left, right = self.spine(a, True), self.spine(b, False)
        i = k = 0
        while True:
            (x, x_taken), (y, y_taken) = left[i], right[k]
            r = self.rank.get((x, y), _NEVER)
            if r < x_taken and r <= y_taken and r != _NEVER:
                return x, y
            if x_taken == y_taken == _NEVER:
                return None
            if x_taken <= y_taken:
                i += 1
            else:
                k += 1

    def is_sound(self, token: str) -> bool:
        """Whether the letters of a vocabulary entry are encoded as that entry."""
        out = self.sound.get(token)
        if out is None:
            if token not in self.made:
                out = token in self.vocab and len(token.removesuffix(self.end)) == 1
            else:
                a, b = self.made[token]
                out = token in self.vocab and self.is_sound(a) and self.is_sound(b) and self.meet(a, b) == (a, b)
            self.sound[token] = out
        return out

    def fits(self, a: str | None, b: str) -> bool:
        """Whether the sound token ``b`` may follow ``a``, or begin a piece."""
        if a is None:
            return True
        out = self.fit.get((a, b))
        if out is None:
            if len(self.fit) > 4 * KEPT_RUNS:
                self.fit.clear()
            self.fit[a, b] = out = self.meet(a, b) is None
        return out

    def counts(self, letters: str) -> list[int]:
        """Tokens of ``letters[:1]``, ``letters[:2]``, .., each taken as a whole piece."""
        known, whole = self.known, []
        last: list[str | None] = [None]
        opened = [0]
        for i in range(1, len(letters) + 1):
            # Words share their beginnings; a long piece's are its own.
            key = letters[:i] if i <= SHARED else None
            state = known.get(key)
            if state is None:
                state = self._step(letters, i, last, opened)
                if key is not None:
                    if len(known) > 2 * KEPT_RUNS:
                        known.clear()
                    known[key] = state
            token, count, closed = state
            last.append(token)
            opened.append(count)
            whole.append(closed)
        return whole

    def _step(self, letters: str, i: int, last: list, opened: list) -> tuple[str, int, int]:
        """Last token and count of ``letters[:i]`` within a longer piece, and its count as a whole one."""
        open, closing, fits = self.open, self.closing, self.fits
        token = closed = None
        for j in range(max(0, i - self.longest), i):
            t = letters[j:i]
            if closed is None and t in closing and fits(last[j], closing[t]):
                closed = opened[j] + 1
            if token is None and t in open and fits(last[j], t):
                token, count = t, opened[j] + 1
            if token is not None and closed is not None:
                return token, count, closed
        raise ValueError(f"the vocabulary cannot spell {letters[:i]!r}")


class Prefixes(dict):
    """Lower-cased plain run -> tokens of each of its prefixes by characters, as 32-bit values."""

    def __init__(self, enc: Encoder, path: str):
        super().__init__()
        self.enc = enc
        self.pieces: dict[str, list[int]] = {}
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.norm = enc.library.normalizer.normalize_str
        self.split = enc.library.pre_tokenizer.pre_tokenize_str
        blank = "".join(c for c in _BLANKS if self.norm(c) == " ")
        self.run = re.compile(f"[^{re.escape(blank)}]+")
        self.special = re.compile("|".join(map(re.escape, enc.special)) or "(?!)")

    def _piece(self, piece: str) -> list[int]:
        """Tokens of a piece's prefixes by characters."""
        out = self.pieces.get(piece)
        if out is None:
            if len(self.pieces) > KEPT_RUNS:
                self.pieces.clear()
            self.pieces[piece] = out = self._count_piece(piece)
        return out

    def _count_piece(self, piece: str) -> list[int]:
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            # A contraction is one piece only when whole.
            before = self._piece("'")
            if len(piece) == 3:
                before = [*before, before[0] + self._piece(piece[1])[0]]
            return [*before, self.merges.counts(piece.translate(self.enc.letters))[-1]]
        by_letter = self.merges.counts(piece.translate(self.enc.letters))
        if len(by_letter) == len(piece):
            return by_letter
        at = np.cumsum([len(c.encode()) for c in piece]) - 1
        return [by_letter[k] for k in at.tolist()]

    def _run(self, pieces: list[tuple[str, int]], size: int) -> np.ndarray:
        """Counts of the prefixes of ``size`` characters that hold ``(piece, place)``."""
        out, base, done = np.zeros(size, np.int32), 0, 0
        for piece, at in pieces:
            counts = self._piece(piece)
            out[done:at] = base  # characters of no piece add nothing
            done = at + len(piece)
            out[at:done] = counts
            out[at:done] += base
            base += counts[-1]
        out[done:] = base
        return out

    def __missing__(self, run: str) -> bytes:
        if len(self) > KEPT_RUNS:
            self.clear()
        if run.isalpha():
            counts = self._piece(run)
        else:
            # The pieces of a run leave nothing out.
            counts, base = [], 0
            for piece in PIECE.findall(run):
                counts += [base + c for c in self._piece(piece)]
                base = counts[-1]
        self[run] = out = array("i", counts).tobytes()
        return out

    def _ordinary(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a text without white space and special strings. The tokenizer's
        own normalization and cutting decide; a cut inside a cluster is the cut before it."""
        clusters = _CLUSTER.findall(text)
        shown = [self.norm(c) for c in clusters]
        whole = self.norm(text)
        if "".join(shown) != whole:
            clusters, shown = [text], [whole]
        counts = np.append(0, self._run([(whole[a:b], a) for _, (a, b) in self.split(whole)], len(whole)))
        at = np.cumsum([len(s) for s in shown])
        sizes = np.array([len(c) for c in clusters])
        ends = np.append(0, counts[at])
        # The last character of a cluster has its count, the others that of the cluster before.
        out = np.repeat(ends[:-1], sizes)
        out[np.cumsum(sizes) - 1] = ends[1:]
        return out

    def odd_run(self, run: str) -> np.ndarray:
        """Counts of a run's prefixes by characters, special strings and all."""
        parts, base, at = [], 0, 0
        for m in self.special.finditer(run):
            before = self._ordinary(run[at : m.end() - 1])
            parts.append(base + before)
            base += (int(before[m.start() - at - 1]) if m.start() > at else 0) + 1
            parts.append([base])
            at = m.end()
        if at < len(run):
            parts.append(base + self._ordinary(run[at:]))
        return np.concatenate(parts).astype(np.int32)

    def char_counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte lengths of the prefixes that end with a character other than white space, rising,
        and their tokens. White space at the end of a prefix adds none."""
        data = np.frombuffer(text.encode(), np.uint8)
        first = np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.append(first[1:], len(data))
        runs = self.enc.runs(text)
        if runs is not None:
            inside = ~np.isin(data[first], [9, 10, 13, 32])
            sizes = np.fromiter(map(len, runs), np.int64, len(runs))
            rel = np.frombuffer(b"".join(map(self.__getitem__, runs)), np.int32)
        else:
            inside, sizes, parts = np.zeros(len(first), bool), [], []
            for m in self.run.finditer(text):
                run = m[0]
                inside[m.start() : m.end()] = True
                sizes.append(len(run))
                plain = PLAIN.fullmatch(run) and not self.special.search(run)
                parts.append(np.frombuffer(self[run.lower()], np.int32) if plain else self.odd_run(run))
            sizes = np.array(sizes, np.int64)
            rel = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        if not len(sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = rel[np.cumsum(sizes) - 1].astype(np.int64)
        return ends[inside], rel + np.repeat(np.cumsum(total) - total, sizes)


_programs: dict[int, Prefixes] = {}


def prefixes(enc: Encoder) -> Prefixes:
    """One programme per worker and encoder."""
    if id(enc) not in _programs:
        _programs[id(enc)] = Prefixes(enc, enc.path)
    return _programs[id(enc)]
