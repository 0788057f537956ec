import re
from pathlib import Path

import pytest

import rillmark.llm

ODD_ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.", "en", "s0"),
    (2, "alpha  BETA gamma delta epsilon zeta eta\ntheta.", "en", "s0"),
    (3, None, None, None),
    (4, "", "de", ""),
    (5, " \t\n\x0b\f\r ", "de", "s1"),
    (6, "one", None, "s1"),
    (7, "one", "fr", "s1"),
    (7, "one", "fr", "s1"),
    (None, "one two", "fr", "s2"),
    (8, "ünïcödé 日本語 \U0001f600 text with nbsp", "es", "s2"),
    (9, "word " * 30_000, "en", "s0"),
    (10, "x" * 200_000, "en", "s0"),
    (11, "1234 5678 !!!", "en", "s0"),
    (12, "a b c d\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "en", "s0"),
]
#: Columns that operators add to those of the user, and refuse if they are there.
RESULTS = {"__n_lines", "__n_dropped", "__tokens", "__p", "__residual", "__base_failed", "__rule", "__kept"}


def own_names() -> list[str]:
    """The names that the operators' code gives to columns, read from it."""
    found: set[str] = set()
    for path in [*Path(rillmark.llm.__file__).parent.glob("*.py"), Path(rillmark.llm.__file__).parents[1] / "operators" / "scan.py"]:
        code = path.read_text()
        found |= set(re.findall(r'(?:alias|withColumn|withColumnRenamed|struct)\((?:"\w+", )*"(\w+)"', code)) | set(re.findall(r'alias\("(\w+)"', code)) | set(re.findall(r'"(\w+)": F\.', code))
    return sorted(n for n in found - RESULTS - {"doc_id", "text", "lang", "source"} if not n.startswith("__c_"))


CLASHES = own_names()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [(*r, *(["x"] * len(CLASHES))) for r in ODD_ROWS]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
