"""Awkward tables, and the small data folder."""

from __future__ import annotations

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size string, key string, "
          "label int, score double, kept boolean")


def rows(*texts, **fixed):
    """Rows of a documents table that has extra columns with common names."""
    return [{"doc_id": i, "text": t, "lang": "en", "source": "src0", "n_chars": len(t or ""), "size": "x",
             "key": None, "label": 7, "score": 0.5, "kept": None, **fixed} for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda data: spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, long and repeated texts, null keys, null sources and languages."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    data = rows(None, "", "  \t\n", "one", "Two words", long, "a b c d e f g h", "A  b\tc d E f g h", "a b c d e f g h",
                "é ñ <|endoftext|> x y", "… — ! 123", "the the the the the the")
    data += [dict(data[4]), dict(data[4]), {**data[6], "doc_id": None}, {**data[3], "source": None, "lang": None},
             {**data[3], "doc_id": None, "text": None, "source": None, "lang": None}]
    return data


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("test tables are absent")
    return SF


def pytest_configure(config):
    config.addinivalue_line("markers", "llm: training-data operators")
