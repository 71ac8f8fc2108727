import pytest

from readloom.llm import registry
from tests import oracle


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf, name):
    oracle.compare(spark, oracle.connect(sf), sf, registry.queries()[name], registry.oracle_sql()[name])
