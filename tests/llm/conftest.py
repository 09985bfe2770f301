from __future__ import annotations

import hashlib
import re
import tempfile

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER_TO_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Extra columns whose names the operators use inside or return.
CLASHES = "id long, a long, b long, n long, kept boolean, score double, digest string, chunk long, size long, target double, taken long, g long, p long, of long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def normal(text: str | None) -> str:
    return (text or "").translate(UPPER_TO_LOWER)


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with clashing extra columns, read from Parquet."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *([None] * 14)) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES
        path = tempfile.mkdtemp(prefix="docs-") + "/documents.parquet"
        spark.createDataFrame(full, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make
