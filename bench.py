"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linkloom.catalog import QUERIES  # noqa: E402
from linkloom.session import build_session  # noqa: E402

HEADLINE = [
    "expand_prc", "expand_crpg", "expand_global", "reached_network", "sif_edges", "resolve_sparse", "score_pairs_compound",
    "components", "components_dense", "expanded_network", "dead_end_diff", "same_reaction", "organism_metabolites",
    "equation_parse", "normalize_names", "ec_extract", "name_search", "page_text", "kegg_compound_pages", "entity_lines",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up is not measured
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
