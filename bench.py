"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from heightfield.suite import load  # noqa: E402

HEADLINE = [
    "a1_moments_unordered", "a2_histogram", "a3_image_statistics", "a4_areal_roughness", "a6_curve_roughness", "a7_range_statistics",
    "a8_point_average", "p1_pixel_math_invert", "p2_crop", "p4_geometry_rotate90cw", "p12_unit_conversion", "p14_quicklook_gold",
    "j1_line_profiles", "j2_region_roughness", "w1_gaussian_7", "w3_median_5", "w4_deglitch", "w5_profile_roughness_band",
    "w6_areal_roughness_band", "w7_filtered_areal_roughness", "w8_filtered_curve_roughness", "w10_savitzky_golay", "w11_noise",
    "w12_peak_table", "f2_flatten_surface", "f3_flatten_line", "f4_flatten_curve", "f5_als_baseline", "x1_line_psd", "x2_fourier_lowpass",
    "g1_grains", "g1_grains_across_tiles", "g2_descendants", "s1_s5_tiff_round_trip",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("heightfield-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    suite = load()
    suite["w1_mean_5"].run(spark, folder).write.format("noop").mode("overwrite").save()  # start the workers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        suite[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
