import pytest
from conftest import plain

import __spark_entry__ as entry
from logveil.operators import kernel
from logveil.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_gives_what_sql_gives(spark, small, duck, name):
    assert plain(plans.QUERIES[name](spark, small).toPandas()) == plain(duck.sql(plans.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_everything_masked_is_restored(spark, small):
    assert plans.QUERIES["mask_documents"](spark, small).where("not restored").count() == 0


def test_stream_of_turns_gives_what_the_batch_gives(spark, small):
    batch = plans.QUERIES["conversation_masking"](spark, small)
    stream = plans.QUERIES["conversation_stream"](spark, small)
    assert batch.exceptAll(stream).count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_vault_ordered_against_a_sequential_version(spark, tmp_path):
    rows = [(c, t, "user", f"login user=person{c * t % 7} from 10.0.{c % 5}.{t}") for c in range(45, 60) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    mapping, want = {}, []
    for c, t, _, text in rows:
        masked, mapping, _ = kernel.mask(text, kernel.MaskConfig(base_mapping=mapping))
        want.append((f"c{c}", c * 1000 + t, masked))
    got = [(r.incident_id, r.ord, r.masked) for r in plans.QUERIES["vault_ordered"](spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == want
