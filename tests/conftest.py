import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from phenoweave.session import local_session

    return local_session(8, "phenoweave-tests")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    from phenoweave.registry.tables import Tables

    return Tables(spark, SF)
