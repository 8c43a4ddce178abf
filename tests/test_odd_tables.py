"""Registered queries against their SQL over small tables that hold what the given ones lack."""

import datetime

import duckdb

from larkspur.plans import features_catalogue, rules_catalogue  # noqa: F401  they register their queries
from larkspur.plans.registry import QUERIES, SQL


def both(spark, folder, name, **tables):
    """The query's rows and those of its SQL; tables: of each the schema and the rows."""
    con = duckdb.connect()
    for table, (schema, content) in tables.items():
        spark.createDataFrame(content, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    theirs = con.execute(SQL[name])
    columns = [c[0] for c in theirs.description]
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*columns).collect()), key=repr), sorted(theirs.fetchall(), key=repr)


def test_a_customer_without_orders_has_no_count_of_a_status(spark, tmp_path):
    ours, theirs = both(
        spark, tmp_path, "dfs_where",
        customer=("c_custkey long, c_acctbal double", [(1, 5.0), (2, 6.0), (3, 7.0)]),
        orders=("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", [(1, 1, "F", 10.0), (2, 1, "O", 20.0), (3, 2, "O", 30.0)]),
        lineitem=("l_orderkey long, l_quantity double, l_shipdate timestamp", [(1, 2.0, datetime.datetime(2024, 1, 1))]),
    )
    assert ours == theirs
    assert (3, None, None) in ours and (2, 0, None) in ours


def test_vectors_of_documents_without_words_and_of_repeated_keys(spark, tmp_path):
    texts = ["some words", "more words 12 here", None, "", " 7 -- ", "some"]
    wordless, repeated = [(k, t) for k, t in enumerate(texts)], [(k, t) for k, t in zip([0, 0, 1, 2, None, None, 3], [*texts, "here some"], strict=True)]
    for name, content in (("wordless", wordless), ("repeated", repeated)):
        ours, theirs = both(spark, tmp_path / name, "document_vectors", documents=("doc_id long, text string", content))
        assert ours == theirs
    assert (2, 0.0, 0.0, 0.0, 0.0) in ours
