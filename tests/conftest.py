import pytest

from claimweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    # On a few rows most of the time would go into compiling plans; queries and the check run them compiled.
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    s.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield s
    s.stop()
