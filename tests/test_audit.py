from tidemark.operators import marts
from tidemark.operators.audit import candidate_pairs, key_checks, lineage_edges, reconcile
from tidemark.operators.cleaning import clean


def test_key_checks_measure_containment(spark):
    sales = spark.createDataFrame([("N", 10.0), ("N", 5.0), ("S", 3.0), (None, 1.0)], "region string, sales double")
    costs = spark.createDataFrame([("N", 4.0), ("E", 2.0)], "region string, costs double")
    assert candidate_pairs({"sales": sales, "costs": costs}) == [("sales", "costs", "region")]
    row = key_checks({"sales": sales, "costs": costs}).collect()[0].asDict()
    assert row["from_keys"] == 2 and row["from_rows"] == 3 and row["from_duplicate_keys"] == 1
    assert row["to_keys"] == 2 and row["to_duplicate_keys"] == 0
    assert row["from_keys_missing_in_to"] == 1 and row["to_keys_missing_in_from"] == 1
    assert row["cardinality"] == "many-to-one"


def test_lineage_and_reconciliation(spark):
    raw = spark.createDataFrame([("10.5", "N"), ("", "S"), ("7", "N")], "Revenue string, region string")
    res = clean(raw)
    mart = marts.catalog_summary_mart(res.df, "region", "revenue")
    edges = {(r["from_node"], r["to_node"]): r for r in lineage_edges(res, {"mart_region": mart}).collect()}
    assert edges[("raw::Revenue", "staging::revenue")]["edge_type"] == "type_cast"
    assert edges[("raw::Revenue", "staging::revenue")]["blanks_nulled"] == 1
    assert edges[("raw::region", "staging::region")]["edge_type"] == "passthrough"
    assert edges[("staging::revenue", "mart::mart_region::total_revenue")]["edge_type"] == "aggregated"
    assert edges[("staging::region", "mart::mart_region::region")]["edge_type"] == "passthrough"
    checks = {r["check"]: r["matches"] for r in reconcile(res.df, mart, "revenue").collect()}
    assert checks == {"record_count": True, "metric_total": True}
