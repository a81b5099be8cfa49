import importlib.util
from pathlib import Path

SPEC = importlib.util.spec_from_file_location("entry_module", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
ENTRY = importlib.util.module_from_spec(SPEC)
SPEC.loader.exec_module(ENTRY)


def test_entry_and_names(spark):
    assert ENTRY.entry(spark).count() > 0
    assert set(ENTRY.oracle_sql()) <= set(ENTRY.queries())


def test_found_queries_have_the_stated_columns(spark, sf):
    stated = {
        "p1_found": [("kind", "string"), ("file_id", "bigint")], "p2_found": [("cell_id_a", "bigint"), ("cell_id_b", "bigint")], "p3_found": [("first_cell_id", "bigint"), ("cell_id", "bigint")],
        "p4_found": [("file_id", "bigint"), ("change", "string"), ("old_field", "string"), ("new_field", "string")], "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")],
        "p8_found": [("doc_id", "bigint"), ("sent_start", "int"), ("sent_end", "int")],
    }
    queries = ENTRY.queries()
    for name, columns in stated.items():
        if name in queries:
            assert queries[name](spark, sf).dtypes == columns
