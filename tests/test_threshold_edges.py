"""Values that lie on a rule's threshold."""

import pyarrow as pa
import pyarrow.parquet as pq


def test_isolated_faults_at_the_threshold(spark, tmp_path):
    import __spark_entry__ as entry
    from oracle import differences

    keys = range(1, 60)
    pq.write_table(pa.table({"c_custkey": pa.array(keys, pa.int64()), "c_acctbal": [(100.0, 99.99, 100.01, 0.0, -100.0, 900.0 * (k % 7), None)[k // 9] for k in keys]}), f"{tmp_path}/customer.parquet")
    assert not differences(entry.queries()["isolated_faults"](spark, str(tmp_path)), entry.oracle_sql()["isolated_faults"], str(tmp_path))
