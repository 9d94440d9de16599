"""URL filter rules as one bit-parallel automaton.

A rule is a glob over the canonical URL ``.host/path`` (lower-case host, no query, no
fragment): ``*`` stands for any bytes but ``/``, ``**`` for any bytes, ``?`` for one byte but
``/``, a backslash makes the next character plain. The leading dot lets ``*.example.com/**``
fit a host and all its subdomains, and no others.

All rules are packed side by side into words of 64 states. A byte moves every state of every
rule at once: states shift into the next one where the byte fits (``step``), and stay where a
star takes it (``stay``). Rules lie in the order of their precedence, so the first final state
that is set names the rule that wins. The URLs of a batch advance together, byte by byte, and
leave once only states that nothing can change any more are set, so a long path costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import pieces

ALLOW, BLOCK = "allow", "block"
DEFAULT = ALLOW            # the verdict where no rule fits
STATES = 8_192             # states of one automaton; more rules are more automata, one after the other
RULE_BYTES = 8 << 20       # bound on the rules, which go to every task
CELLS = 1 << 20            # state words that a batch of URLs may hold
_SETTLE = 4                # steps after which settled URLs leave

_SLASH = ord("/")


@dataclass(frozen=True)
class Rule:
    """``action`` for the URLs that ``glob`` fits; ``name`` is how results call it."""

    action: str
    glob: str
    name: str
    rank: int  # the higher one wins, then the earlier rule


def _plain(text: str) -> str:
    return "".join(f"\\{c}" if c in "*?\\" else c for c in text)


def host_rule(action: str, host: str, path: str = "/") -> Rule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``; the longest wins."""
    host = host.translate(str.maketrans(ascii_uppercase, ascii_lowercase))
    return Rule(action, f"*.{_plain(host)}{_plain(path)}**", host + path, len((host + path).encode()))


def glob_rule(action: str, glob: str) -> Rule:
    """A glob over the canonical URL; the one with the most plain and ``?`` bytes wins."""
    return Rule(action, glob, glob, len(parse_glob(glob)[0]))


def parse_glob(glob: str) -> tuple[list[int], list[int]]:
    """What each step takes (a byte, or -1 for any but ``/``) and, for each state, whether it
    stays on nothing (0), on any byte but ``/`` (1) or on any byte (2)."""
    takes: list[int] = []
    stays = [0]
    text, i = glob.encode(), 0
    while i < len(text):
        c = text[i : i + 1]
        if c == b"*":
            wide = text[i + 1 : i + 2] == b"*"
            stays[-1] = max(stays[-1], 2 if wide else 1)
            i += 1 + wide
            continue
        plain = c == b"\\" and i + 1 < len(text)
        i += plain
        takes.append(-1 if c == b"?" else text[i])
        stays.append(0)
        i += 1
    return takes, stays


class Automaton:
    """The rules ``first`` to ``first + len(rules) - 1`` of a list in order of precedence."""

    def __init__(self, rules: Sequence[Rule], first: int = 0):
        parsed = [parse_glob(r.glob) for r in rules]
        size = np.array([len(stays) for _, stays in parsed])
        starts = np.cumsum(size) - size
        self.words = -(-int(size.sum()) // 64)
        step = np.zeros((256, self.words * 64), bool)
        stay = np.zeros_like(step)
        for at, (takes, stays) in zip(starts.tolist(), parsed):
            for k, byte in enumerate(takes):
                step[slice(None) if byte < 0 else byte, at + k + 1] = True
                if byte < 0:
                    step[_SLASH, at + k + 1] = False
            for k, kind in enumerate(stays):
                stay[:, at + k] = kind > 0
                stay[_SLASH, at + k] = kind > 1
        final = np.zeros(self.words * 64, bool)
        final[starts + size - 1] = True
        begin = np.zeros_like(final)
        begin[starts] = True
        # Bytes that move all states alike share a row of the tables.
        both, self.kind = np.unique(np.concatenate([step, stay], 1), axis=0, return_inverse=True)
        self.kind = self.kind.reshape(-1).astype(np.int32)
        self.step, self.stay = self._pack(both[:, : len(final)]), self._pack(both[:, len(final) :])
        self.begin, self.final = self._pack(begin[None])[0], self._pack(final[None])[0]
        self.open = ~self._pack((final & stay.all(0))[None])[0]  # all states but those that stay set for good
        self.rule = np.zeros(len(final), np.int32)
        self.rule[starts + size - 1] = first + np.arange(len(rules))

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def first_rule(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rule of the highest precedence that fits each text, or -1."""
        n = len(offsets) - 1
        out = np.full(n, -1, np.int32)
        block = max(1, CELLS // self.words)
        for lo in range(0, n, block):
            hi = min(n, lo + block)
            self._advance(data, offsets[lo:hi], offsets[lo + 1 : hi + 1], out[lo:hi])
        return out

    def _advance(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, out: np.ndarray) -> None:
        row, at = np.arange(len(at)), at.copy()
        state = np.repeat(self.begin[None], len(at), 0)
        steps = 0
        while len(row):
            done = at >= end
            if steps % _SETTLE == 0:
                done |= ~(state & self.open).any(1)
            if done.any():
                self._name(row[done], state[done], out)
                left = ~done
                row, at, end, state = row[left], at[left], end[left], state[left]
                if not len(row):
                    return
            kind = self.kind[data[at]]
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.step[kind]) | (state & self.stay[kind])
            at += 1
            steps += 1

    def _name(self, row: np.ndarray, state: np.ndarray, out: np.ndarray) -> None:
        found = state & self.final
        some = found.any(1)
        word = (found != 0).argmax(1)[some]
        bits = found[some, word]
        lowest = np.log2((bits & (~bits + np.uint64(1))).astype(np.float64)).astype(np.int64)  # exact for powers of two
        out[row[some]] = self.rule[word * 64 + lowest]


def automata(rules: Sequence[Rule], states: int = STATES) -> list[Automaton]:
    """Automata of at most ``states`` states (or one rule) each, over ``rules`` in their order."""
    out, first, held = [], 0, 0
    for k, rule in enumerate(rules):
        need = len(parse_glob(rule.glob)[1])
        if k > first and held + need > states:
            out.append(Automaton(rules[first:k], first))
            first, held = k, 0
        held += need
    return [*out, Automaton(rules[first:], first)] if len(rules) else []


def split_url(url) -> tuple:
    """Host and path Columns: the host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    with A-Z in lower case; the path goes on up to ``?``, ``#`` or the end. Both are empty for a
    null and for a URL without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Iterable[Rule], id: str = "page_id", url: str = "url", default: str = DEFAULT, states: int = STATES) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule`` (its name, null where none fits), ``verdict``.

    One row per row of ``pages``, in one pass without a shuffle; other columns are not read.
    Among the rules that fit, the highest rank wins, among equal ranks the earlier one. A URL that
    none fits gets ``default``. A null URL, and one without ``://``, has an empty host and path, and
    is judged as such. Invalid: rules of more than ``RULE_BYTES`` in all, as they go to every task.
    """
    ordered = sorted(rules, key=lambda r: -r.rank)
    if sum(len(r.glob.encode()) + len(r.name.encode()) for r in ordered) > RULE_BYTES:
        raise ValueError(f"rules of more than {RULE_BYTES} bytes")
    host, path = split_url(F.col(url))
    slim = pages.select(F.col(id).alias("id"), host.alias("host"), path.alias("path"))
    id_type = slim.schema["id"].dataType.simpleString()
    names, actions = [r.name for r in ordered], [r.action for r in ordered]

    def run(batches):
        machines = automata(ordered, states)
        name_of, action_of = pa.array([*names, None], pa.string()), pa.array([*actions, default], pa.string())
        for batch in batches:
            host, path = batch.column(1), batch.column(2)
            whole = pc.binary_join_element_wise(".", host, path, "")
            best = np.full(len(whole), -1, np.int32)
            for lo, hi, data, offsets in pieces(whole):
                for machine in machines:  # in the order of precedence
                    best[lo:hi] = np.where(best[lo:hi] < 0, machine.first_rule(data, offsets), best[lo:hi])
            pick = pa.array(np.where(best < 0, len(names), best))
            yield pa.RecordBatch.from_arrays([batch.column(0), host, path, name_of.take(pick), action_of.take(pick)], [id, "host", "path", "rule", "verdict"])

    return slim.mapInArrow(run, f"`{id}` {id_type}, host string, path string, rule string, verdict string")
