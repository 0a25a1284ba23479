"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES``
a comma-separated choice (``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time

from dialoom.plans.registry import load_all
from dialoom.session import local_session

HEADLINE = (
    "corpus_token_targets",
    "strip_sql_comments",
    "token_columns",
    "clean_code_fence",
    "classify_objects",
    "lint_scripts",
    "check_python_scripts",
    "extract_sql_statements",
    "check_sql_statements",
    "split_cells",
    "compose_documents",
    "unique_output_paths",
    "number_files_by_path",
    "batch_responses",
    "join_continuations",
    "merge_responses",
    "merge_exports",
    "migration_report",
    "report_metrics",
    "conversion_summary",
    "judge_scores",
    "star_join_totals",
    "gold_sales_summary",
    "gold_top_city_sales",
    "top_recent_spenders",
    "customer_sales",
    "layered_customer_revenue",
    "rank_orders",
    "string_aggregation",
    "upsert_customers",
    "update_lines_from_orders",
    "delete_lines_of_urgent_orders",
    "consumption_periods",
    "date_add_units",
    "format_dates",
    "regular_expressions",
    "map_schema_snowflake",
    "run_history",
    "upload_progress",
    "refresh_layers",
    "check_and_fix",
    "corpus_run_documents",
    "judge_rounds",
    "rank_large_groups",
    "batch_responses_distinct",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry = load_all()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(registry) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # One small query starts the workers, so that the first timing is not the start-up.
    registry["check_python_scripts"].run(spark, sf_dir).limit(1).collect()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
