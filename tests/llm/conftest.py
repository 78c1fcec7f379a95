from __future__ import annotations

import pyarrow as pa
import pytest


@pytest.fixture()
def batch():
    return lambda **cols: pa.RecordBatch.from_pydict(cols)
