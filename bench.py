"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The stages are those the baseline times: load, clean, categorise, optimise (type narrowing), series
features and recommendations, followed by reports and forecasts. Every query is warmed up once on
the smallest tables, then timed from building the plan to the last row of its result.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import QUERIES
from checks.base import table, tx_raw
from tallyframe.operators.categorize import keyword_categorize
from tallyframe.operators.cleaning import clean_transactions
from tallyframe.session import get_session


def digest(df: DataFrame) -> DataFrame:
    """Touch every column of every row and return one row."""
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest"))


STAGES = {
    "load": lambda s, d: digest(table(s, d, "lineitem")),
    "clean": lambda s, d: digest(clean_transactions(tx_raw(s, d))),
    "clean_categorize": lambda s, d: digest(keyword_categorize(clean_transactions(tx_raw(s, d)))),
}
NAMES = (
    "narrow_types",
    "category_breakdown",
    "transaction_summary",
    "monthly_summary",
    "dedupe_transactions",
    "profile_table",
    "time_series_features",
    "fill_gaps",
    "outliers_iqr",
    "spending_patterns",
    "recurring_charges",
    "recommendations",
    "report_summary",
    "financial_report",
    "forecast_trend_seasonal",
    "forecast_arima",
    "ensemble_forecast_weighted_average",
    "train_categorizer",
    "tfidf_features",
    "word_frequency_documents",
)
QUERY_SET = {**STAGES, **{n: QUERIES[n] for n in NAMES}}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = small if os.path.isdir(small) else sf_dir
    times = {}
    for name, query in QUERY_SET.items():
        query(spark, warm).collect()
        start = time.perf_counter()
        query(spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - start, 3)
    rows = table(spark, sf_dir, "lineitem").count()
    stages = ("load", "clean", "clean_categorize", "narrow_types")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_second": {s: round(rows / times[s]) for s in stages},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
