"""Every query of the subpackage on empty tables with the schemas of the data."""

import pytest

from spanwork.llm import queries as llm

# The columns that TESTDATA.md gives.
TABLES = {
    "task": "rec_id long, task_id string, operation string, category string, edit_kind string, tier string, split string, building_id string, ifc_version string, origin string, run_id string, generator_version string, prompt string, instruction string, input_ifc string, target struct<entity_type:string,guids:array<string>>, families array<string>, created_at timestamp_ntz, loaded_at timestamp_ntz",
    "request_props": "task_id string, base_task_id string, writer string, operation string, building_id string, ifc_version string, input_ifc string, split string, loaded_at timestamp_ntz",
    "mix_target": "mix_id long, pool_table string, dims string, stratum string, target_permille int, sample_size long, min_rows long",
    "funnel": "run_id string, n_accepted long, n_train long, n_validation long",
    "documents": "doc_id long, text string, lang string, source string",
    "doc_label": "doc_id long, offensive int, reviewer string",
    "eval_item": "item_id long, text string, split string, suite string",
    "container_spec": "spec_id int, capacity_tokens int, purpose string",
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert llm.queries()[name](spark, empty).count() == 0


def test_every_oracle_has_a_query():
    assert set(llm.oracle_sql()) <= set(llm.queries())
