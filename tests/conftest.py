import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def rows(df, *columns):
    columns = columns or df.columns
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())
