"""Small tables and brute-force versions for the training-data operators' tests."""

from __future__ import annotations

import re

#: Columns beside doc_id, text, lang, source, n_chars, with names that operators might use themselves.
EXTRA = "_searched string, _k1 long, slice int, h long, id long, k int, block int, start long, pos int, root string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
TEXT = ("The quick brown fox jumps over the lazy dog while seven grey geese fly south over a quiet lake. "
        "Nobody in the old village had seen such a thing before, and nobody has seen it since then.")


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    made = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 7, 1, 2, 3, 4, 5, 6, 7, "y") for r in rows]
    return spark.createDataFrame(made, DOCS)


#: Nulls, empty and blank texts, ties, repeated rows, a long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, TEXT), (4, TEXT), (None, TEXT), (5, TEXT, None), (6, "é 中文 👍 \x00x"),
       (None, None, None), (7, "word " * 30_000), (8, "one"), (9, "a\nb\n\n a \nb")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
