from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from episodica import schema as S  # noqa: E402
from episodica.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def ts(text: str | None) -> dt.datetime | None:
    return dt.datetime.fromisoformat(text) if text else None


RAW_TYPES = ", ".join(f"{n} string" for n in S.RAW_SCHEMAS["hospitalizations"].fieldNames())
BILLING_TYPES = ", ".join(f"{n} string" for n in S.RAW_SCHEMAS["billing"].fieldNames())
EPISODE_TYPES = (
    f"{S.ID} string, {S.ADMISSION_TEXT} string, {S.DISCHARGE_TEXT} string, last_update date, "
    + ", ".join(f"{a} string" for a in S.ATTRIBUTES)
    + f", {S.ADMISSION} timestamp_ntz, {S.DISCHARGE} timestamp_ntz"
)


@pytest.fixture(scope="session")
def make(spark):
    """Builders for small tables; columns not given are NULL."""

    class Make:
        @staticmethod
        def _frame(rows, types):
            names = [t.strip().split(" ")[0] for t in types.split(",")]
            return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], types)

        def raw(self, *rows):
            return self._frame(rows, RAW_TYPES)

        def billing(self, *rows):
            return self._frame(rows, BILLING_TYPES)

        def episodes(self, *rows):
            """Rows (id, admission, discharge[, attributes]); times as ISO text."""
            shaped = []
            for key, admission, discharge, *more in rows:
                attributes = dict(more[0]) if more else {}
                text = attributes.pop("text", admission or "none")
                shaped.append(
                    {S.ID: key, S.ADMISSION_TEXT: text, S.ADMISSION: ts(admission), S.DISCHARGE: ts(discharge), **attributes}
                )
            return self._frame(shaped, EPISODE_TYPES)

    return Make()
