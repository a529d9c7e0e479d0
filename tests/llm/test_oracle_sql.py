import pytest

import __spark_entry__ as E
from oracle.check import compare, duck
from propval.llm.catalog import ORACLE
from tests.conftest import SF_ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    ok, msg = compare(E.queries()[name](spark, SF_ORACLE), E.oracle_sql()[name], SF_ORACLE, con=duck(SF_ORACLE))
    assert ok, msg
