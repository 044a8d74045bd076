import re

import __spark_entry__
import pytest

from tapeloom.llm import catalog
from tapeloom.llm.common import table
from tests.compare import compare, oracle_connection

from .conftest import SF

INPUTS = {"op4_warc_round_trip": "pages", "op7_html_main_text": "pages"}


def test_all_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))
    assert "pipeline" in names and set(catalog.ORACLES) <= set(catalog.QUERIES)


#: Queries with rows of their own instead of one for each row of a table.
REPORTS = {"op12_source_audit"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - REPORTS))
def test_every_row_of_the_table_has_a_result(spark, name):
    rows = table(spark, SF, INPUTS.get(name, "documents"))
    key = rows.columns[0]
    out = catalog.QUERIES[name](spark, SF)
    assert sorted(r[0] for r in out.select(key).collect()) == sorted(r[0] for r in rows.select(key).collect())
    assert catalog.QUERIES[name](spark, SF).schema == out.schema


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    columns, names, ours, theirs = compare(spark, oracle_connection(SF), catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert columns == names and ours == theirs and ours
