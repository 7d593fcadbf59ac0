import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

EXTRA = ("n_words", "pos", "id", "k", "th", "spans", "node", "key", "ids", "kept")


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) rows to documents with columns whose names operators use as well."""

    def make(rows):
        full = [(i, t, "en" if i is None or i % 3 else None, "s", None if t is None else len(t), *(["x"] * len(EXTRA))) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, very long, tied and repeated texts."""
    passage = " ".join(f"shared{k} word{k * k}" for k in range(40))
    line = "This line is common to many of the documents, longer than forty."
    return [
        (1, None), (2, ""), (3, "\n\n \t\n"), (4, "one"), (5, "A b c d e"), (6, passage), (7, "before\n" + passage + " after it"), (8, passage.upper()),
        (9, "loop " * 3000), (10, "x" * 200_000), (10, "x" * 200_000), (11, "same id"), (11, "but another text " + passage), (None, passage), (None, None),
        *[(20 + k, f"{line}\nown {k}\n  {line.upper()}  \nend") for k in range(6)], (40, "\u0085    wide"), (41, "café \U0001f600 " * 50),
    ]
