"""Known generic tests: what quality dimension they look at and how their failed rows are counted."""

from __future__ import annotations

ROWS, RECORDS = "count(*)", "sum(n_records)"

# Tests by package, with their quality dimension and, where a result holds the failed rows or
# their number, the aggregate that counts them.
KNOWN_TESTS: dict[str, dict[str, tuple[str | None, str | None]]] = {
    "dbt": {
        "not_null": ("completeness", ROWS),
        "relationships": ("consistency", ROWS),
        "unique": ("uniqueness", RECORDS),
        "accepted_values": ("validity", RECORDS),
    },
    "dbt_expectations": {
        "expect_column_values_to_not_be_null": ("completeness", ROWS),
        "expect_column_values_to_be_null": ("completeness", ROWS),
        "expect_column_values_to_be_in_set": ("validity", ROWS),
        "expect_column_values_to_be_between": ("validity", ROWS),
        "expect_column_values_to_not_be_in_set": ("validity", ROWS),
        "expect_column_values_to_be_increasing": ("accuracy", ROWS),
        "expect_column_values_to_be_decreasing": ("accuracy", ROWS),
        "expect_column_value_lengths_to_be_between": ("validity", ROWS),
        "expect_column_value_lengths_to_equal": ("validity", ROWS),
        "expect_column_values_to_match_regex": ("validity", ROWS),
        "expect_column_values_to_not_match_regex": ("validity", ROWS),
        "expect_column_values_to_match_regex_list": ("validity", ROWS),
        "expect_column_values_to_not_match_regex_list": ("validity", ROWS),
        "expect_column_values_to_match_like_pattern": ("validity", ROWS),
        "expect_column_values_to_not_match_like_pattern": ("validity", ROWS),
        "expect_column_values_to_match_like_pattern_list": ("validity", ROWS),
        "expect_column_values_to_not_match_like_pattern_list": ("validity", ROWS),
        "expect_column_pair_values_A_to_be_greater_than_B": ("accuracy", ROWS),
        "expect_column_pair_values_to_be_equal": ("accuracy", ROWS),
        "expect_column_pair_values_to_be_in_set": ("validity", ROWS),
        "expect_select_column_values_to_be_unique_within_record": ("validity", ROWS),
        "expect_column_values_to_be_unique": ("uniqueness", None),
        "expect_compound_columns_to_be_unique": ("uniqueness", None),
        "expect_column_to_exist": ("validity", None),
        "expect_row_values_to_have_recent_data": ("freshness", None),
        "expect_grouped_row_values_to_have_recent_data": ("freshness", None),
        "expect_table_column_count_to_be_between": ("consistency", None),
        "expect_table_column_count_to_equal_other_table": ("consistency", None),
        "expect_table_columns_to_not_contain_set": ("validity", None),
        "expect_table_columns_to_contain_set": ("consistency", None),
        "expect_table_column_count_to_equal": ("consistency", None),
        "expect_table_columns_to_match_ordered_list": ("validity", None),
        "expect_table_columns_to_match_set": ("validity", None),
        "expect_table_row_count_to_be_between": ("accuracy", None),
        "expect_table_row_count_to_equal_other_table": ("consistency", None),
        "expect_table_row_count_to_equal_other_table_times_factor": ("consistency", None),
        "expect_table_row_count_to_equal": ("completeness", None),
        "expect_column_values_to_be_of_type": ("validity", None),
        "expect_column_values_to_be_in_type_list": ("validity", None),
        "expect_column_values_to_have_consistent_casing": ("validity", None),
        "expect_column_distinct_count_to_equal": ("accuracy", None),
        "expect_column_distinct_count_to_be_greater_than": ("accuracy", None),
        "expect_column_distinct_count_to_be_less_than": ("accuracy", None),
        "expect_column_distinct_values_to_be_in_set": ("validity", None),
        "expect_column_distinct_values_to_contain_set": ("validity", None),
        "expect_column_distinct_values_to_equal_set": ("validity", None),
        "expect_column_distinct_count_to_equal_other_table": ("accuracy", None),
        "expect_column_mean_to_be_between": ("validity", None),
        "expect_column_median_to_be_between": ("validity", None),
        "expect_column_quantile_values_to_be_between": ("validity", None),
        "expect_column_stdev_to_be_between": ("validity", None),
        "expect_column_unique_value_count_to_be_between": ("validity", None),
        "expect_column_proportion_of_unique_values_to_be_between": ("uniqueness", None),
        "expect_column_most_common_value_to_be_in_set": ("accuracy", None),
        "expect_column_max_to_be_between": ("validity", None),
        "expect_column_min_to_be_between": ("validity", None),
        "expect_column_sum_to_be_between": ("validity", None),
        "expect_multicolumn_sum_to_equal": ("consistency", None),
        "expect_column_values_to_be_within_n_moving_stdevs": ("accuracy", None),
        "expect_column_values_to_be_within_n_stdevs": ("accuracy", None),
        "expect_row_values_to_have_data_for_every_n_datepart": ("completeness", None),
        "expect_column_values_to_be_of_type_list": ("validity", None),
        "expect_table_aggregation_to_equal_other_table": ("consistency", None),
    },
    "dbt_utils": {
        "equal_rowcount": ("consistency", "sum(diff_count)"),
        "fewer_rows_than": ("consistency", "sum(row_count_delta)"),
        "expression_is_true": ("accuracy", ROWS),
        "not_empty_string": ("completeness", ROWS),
        "cardinality_equality": ("consistency", "sum(num_rows)"),
        "sequential_values": ("accuracy", ROWS),
        "accepted_range": ("validity", ROWS),
        "unique_combination_of_columns": ("uniqueness", ROWS),
        "at_least_one": ("completeness", None),
        "equality": ("consistency", None),
        "mutually_exclusive_ranges": ("accuracy", None),
        "not_accepted_values": ("validity", None),
        "not_constant": ("validity", None),
        "not_null_proportion": ("completeness", None),
        "recency": ("freshness", None),
        "relationships_where": ("consistency", None),
    },
    "own": {
        "schema_changes": ("validity", None),
        "schema_changes_from_baseline": ("validity", None),
        "json_schema": ("validity", ROWS),
        "volume_anomalies": ("completeness", None),
        "freshness_anomalies": ("freshness", None),
        "event_freshness_anomalies": ("freshness", None),
        "dimension_anomalies": ("completeness", None),
        "all_columns_anomalies": (None, None),
        "column_anomalies": (None, None),
        "exposure_schema_validity": ("validity", None),
        "collect_metrics": (None, None),
        "not_null_with_context": ("completeness", ROWS),
        "accepted_range_with_context": ("validity", ROWS),
        "expect_column_values_to_not_be_null_with_context": ("completeness", ROWS),
        "expect_column_values_to_be_unique_with_context": ("uniqueness", ROWS),
        "expect_column_values_to_match_regex_with_context": ("validity", ROWS),
        "relationships_with_context": ("consistency", ROWS),
    },
}


def known(test: str, package: str | None = None) -> tuple[str | None, str | None] | None:
    """(quality dimension, failed-row calculation) of a test; without a package the built-in ones."""
    return KNOWN_TESTS.get(package or "dbt", {}).get(test)


def describe(test: str) -> str:
    """A test's name as a sentence."""
    return test.replace("_", " ").capitalize() + "."
