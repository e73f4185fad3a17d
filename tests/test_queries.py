import os

import duckdb
import pytest

from siftline.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
QUICK = ["term_contains", "keyword_channel", "maxsim_topk", "chunk_windows", "jaccard_pairs", "slot_union", "missing_keyword_stats", "variant_stats", "compare_runs", "clusters", "token_stopword_filter", "page_overflow"]


def normal(frame):
    rows = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).values.tolist()
    return sorted([f"{v:.6g}" if isinstance(v, float) else str(v) for v in row] for row in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    assert normal(QUERIES[name](spark, DATA).toPandas()) == normal(con.execute(SQL[name]).df())


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
