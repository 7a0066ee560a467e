"""One small session for all tests."""

import pytest

from tessera.plans.session import build_session, importable


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__default__parallelism="4")
    session.sparkContext.setLogLevel("OFF")
    yield importable(session)
    session.stop()
