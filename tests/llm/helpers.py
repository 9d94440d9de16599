"""Rows with every awkward case, and plain re-statements of the operators to compare with."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start int, score string, key string, h int"

_SYLLABLES = "ka lo mi re tu van os pel dri un eh çö".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def awkward_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, near copies, and clashing columns."""
    base = prose(1, 300)
    words = base.split()
    near = " ".join([*words[:150], "andere", *words[151:]])
    rows = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "!!! ???"), (7, "one two"), (8, "One, TWO!"), (9, prose(2, 20000)),
        (10, "ab" * 700), (11, prose(3, 400)), (11, prose(3, 400)), (12, prose(4, 80) + " " + base[:900]), (None, prose(5, 90)), (None, None),
        (13, "<|endoftext|> x <|im_end|>"), (14, "é\u0085日本 語 İ x²"), (15, prose(6, 100)), (16, "!!! ???"), (17, prose(9, 60) + base[300:1300]),
    ]
    sources = ["web", "web", "web", None, "book"]
    return spark.createDataFrame([(i, t, "xx", sources[k % 5], None, 7, "s", "k", 3) for k, (i, t) in enumerate(rows)], DOCS).repartition(4)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
