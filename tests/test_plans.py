"""What the physical plans must and must not contain."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FIT = {"train_cav", "train_cavs", "mauve", "project_2d"}  # train before they return


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - FIT))
def test_no_cross_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_taxonomy_is_broadcast(spark):
    assert "BroadcastHashJoin" in plan(spark, "tag_category_join")


@pytest.mark.parametrize("name", ["caption_lengths", "parse_judge", "mask_labels", "l2_normalize", "score_decoder"])
def test_row_work_is_not_shuffled_by_key(spark, name):
    assert "hashpartitioning" not in plan(spark, name)


def test_only_used_columns_are_read(spark):
    text = plan(spark, "latest_metrics")
    assert "props" not in text and "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan(spark, "best_run")


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(spark, "head_per_model")
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")
