"""Wall time of the headline queries; prints one JSON line.

`BENCH_SF_DIR` (default /root/testdata/sf0.1) and `BENCH_CPUS` (default 8) choose
the data and the cores. Each query runs once after a warm-up of the session and
is written to a sink that keeps every column.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpuslens.plans.catalog import QUERIES  # noqa: E402
from corpuslens.session import get_spark  # noqa: E402

HEADLINE = [
    "linguistic_features_raw",
    "linguistic_features_scaled",
    "part_of_speech_counts",
    "tfidf",
    "tfidf_min_df",
    "tfidf_max_abs",
    "chi2_numeric",
    "min_max_numeric",
    "stratified_train_test",
    "stratified_folds",
    "under_sampled",
    "smote_2d",
    "cosine_top1",
    "knn_confusion",
    "confusion_matrix",
    "class_report",
    "multilabel_metrics",
    "fixed_length_encoding",
    "shap_summary",
    "decision_path",
    "svd_projection",
    "linear_svm",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench")
    spark.read.parquet(os.path.join(folder, "documents.parquet")).selectExpr(
        "md5(text) AS h", "length(text) AS n"
    ).groupBy("n").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
