"""Small hand-made documents: every odd case once, and brute-force helpers."""

from __future__ import annotations

import random
import re

#: Columns named like results, beside those of documents.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words long, shard int, slot long, "
    "size long, kept boolean, key long, bucket string, word string, tokens long"
)
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text: str | None) -> str:
    return (text or "").translate(_UPPER)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


def frame(spark, rows):
    """Of (doc_id, text) or (doc_id, text, lang, source); the other columns hold junk."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r
        full.append((doc_id, text, lang, source, None, -1, -1, -1, -1, None, 7, "x", None, 3))
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    long = " ".join(words(random.Random(1), 30_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, long), (6, "twice the same row"), (6, "twice the same row"),
        (None, "no id here"), (7, "ÀÉ ñ 漢字 \U0001f600 x"), (8, "#$%^&*"),
    ]
