"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8),
BENCH_QUERIES (comma-separated names or "all"), BENCH_RUNS (2; best counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fluxframe.queries import QUERIES
from fluxframe.session import build_session

HEADLINE = (
    "flagship", "sample_index_grid", "sample_index_site", "trailing_rows_stats", "trailing_id_range_stats",
    "asof_latest", "first_image_in_window", "grid_samples_full", "global_order", "rebuild_ids", "rolling_meter",
    "segment_split", "rmse_nse_site_total", "class_macro_mean", "masked_mse", "dedup_first", "dedup_mean",
    "upsert_update", "relabel_apply", "nullsafe_attach", "cube_long_roundtrip", "stencil_neighbours",
    "bilinear_resample", "pixel_bins", "minmax_norm", "calendar_fields", "raster_clean", "fourier_features",
    "format_predictions", "score_network",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    asked = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()

    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(min(taken), 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
