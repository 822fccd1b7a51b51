from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from pipekit.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(base / "shared"),
            "spark.sql.warehouse.dir": str(base / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def users(spark):
    # The stated input of the e-mail rule's example.
    rows = [(1, "user1@example.com", "2023-01-01"), (2, "user2@example.com", "2023-01-02"), (3, "invalid-email", "2023-01-03")]
    return spark.createDataFrame(rows, "id bigint, email string, created_date string")


@pytest.fixture
def empty(users):
    return users.limit(0)


@pytest.fixture
def nulls_nan(spark):
    rows = [(1, None, float("nan")), (1, None, 1.0), (2, "b", None), (2, "b", 2.0)]
    return spark.createDataFrame(rows, "a int, b string, x double")


def day(number: int) -> datetime:
    return datetime(2024, 1, number)


def rows(df) -> list[tuple]:
    """Rows as sorted tuples, NULLs first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def plan_text(df) -> str:
    """The physical plan as text, before anything ran."""
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()
