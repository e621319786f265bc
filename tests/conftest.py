import tempfile

import pytest

from pricemill.session import local_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="warehouse-")
    session = local_session(
        8, 4, **{
            "spark.sql.warehouse.dir": warehouse,
            "spark.driver.extraJavaOptions": f"-Dderby.system.home={warehouse}",
        }
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def rows(df, *order):
    """Rows as plain tuples, sorted."""
    found = [tuple(r) for r in (df.select(*order) if order else df).collect()]
    return sorted(found, key=lambda r: tuple((v is not None, v) for v in r))
