from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql.types import _parse_datatype_string  # noqa: E402

from escrowlens.session import build_session  # noqa: E402
from escrowlens.sources.schemas import SCHEMAS  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="escrowlens-test-")
    s = build_session(cores="*", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    s.stop()


def table(spark, name, rows, schema=None):
    """A micro table in a marketplace schema; missing columns are null."""
    ddl = schema or SCHEMAS[name]
    st = _parse_datatype_string(ddl)
    full = [tuple(r.get(f.name) for f in st.fields) for r in rows]
    return spark.createDataFrame(full, st)


def ts(text):
    import datetime as dt
    return dt.datetime.fromisoformat(text)
