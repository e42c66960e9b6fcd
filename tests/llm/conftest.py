import pytest


@pytest.fixture(scope="session")
def llm_spark(spark):
    from sextant.llm import base

    base.prepare(spark)
    return spark
