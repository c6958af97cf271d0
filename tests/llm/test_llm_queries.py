"""The p queries on the smallest tables, and beside their SQL where there is one."""

import pytest
from oracle import connect, difference

from corpusloom.llm import oracles, queries

COLUMNS = {"p1_found": "pair_id field defect", "p2_found": "row_id_a row_id_b", "p3_found": "row_id field", "p4_found": "row_id line_no", "p5_found": "row_id_a row_id_b split", "p6_found": "epoch type_document", "p7_found": "row_id kind", "p8_ids": "doc_id ids", "p9_found": "doc_id row_id", "p10_found": "doc_id subject"}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_without_repeated_rows(spark, data, name):
    df = queries.queries()[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
    got = df.collect()
    assert len(got) == len(set(map(repr, got)))


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_equals_sql(spark, data, name):
    assert difference(queries.queries()[name](spark, data), oracles.oracle_sql()[name], connect(data)) is None
