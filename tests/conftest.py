"""Shared session and small tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TEXT, LONG, DOUBLE = pa.string(), pa.int64(), pa.float64()
SCHEMAS = {
    "books": {"id": TEXT, "title": TEXT, "expected": LONG, "source_url": TEXT},
    "chapters": {"book_id": TEXT, "number": LONG, "url": TEXT, "title": TEXT, "source": TEXT, "source_hash": TEXT, "translated": TEXT, "edited": TEXT, "summary": TEXT, "state": TEXT, "error": TEXT},
    "sources": {"id": TEXT, "name": TEXT, "source_url": TEXT, "encoding": TEXT},
    "source_candidates": {"id": LONG, "book_id": TEXT, "source_id": TEXT, "url": TEXT, "source_number": LONG, "title": TEXT, "canonical_number": LONG, "state": TEXT},
    "book_terms": {"book_id": TEXT, "source": TEXT, "translation": TEXT, "chapter": LONG, "kind": TEXT},
    "documents": {"doc_id": LONG, "text": TEXT, "lang": TEXT, "source": TEXT, "n_chars": LONG, "kind": TEXT},
    "lang_codes": {"label": TEXT, "lang": TEXT},
    "pack_specs": {"spec_id": LONG, "tokenizer": TEXT, "capacity": LONG},
}


@pytest.fixture(scope="session")
def spark():
    from inkloom.session import session, ship

    spark = session(4, 4)
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    yield spark
    spark.stop()


@pytest.fixture
def tables(tmp_path):
    """``write(name=rows, ...)`` puts tables into a folder; missing columns are null, all other tables empty."""

    def write(extra: dict | None = None, **given) -> str:
        for name, schema in SCHEMAS.items():
            rows = given.get(name, [])
            columns = dict(schema)
            for row in rows:
                for c in row:
                    columns.setdefault(c, TEXT if isinstance(row[c], str) else LONG)
            columns |= (extra or {}).get(name, {})
            table = pa.table({c: pa.array([r.get(c) for r in rows], t) for c, t in columns.items()})
            pq.write_table(table, tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture(scope="session")
def data():
    """The smallest given tables, if they are there."""
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no given tables")
    return str(folder)
