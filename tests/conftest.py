from __future__ import annotations

import tempfile

import pytest

from tests.compare import duck, session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session("4")


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-")
