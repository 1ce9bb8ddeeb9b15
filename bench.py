"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is written to the noop
sink, so all its rows and columns are computed. The loop tables are an input of the cycle queries:
``g16_cycle_detection`` times their detection from the gifts, the other queries read the result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "g16_cycle_detection",
    "q02_directors_for_org",
    "q03_funding_edges",
    "q04_precomputed_cycles",
    "q05_cycle_edges",
    "q08_sole_source_flags",
    "q09_fed_concentration",
    "q14_shared_director_candidates",
    "q15_high_overhead",
    "q16_address_clusters",
    "q17_nonqualified_donees",
    "q19_shared_director_funding_pairs",
    "q20_director_funding_pairs_fast",
    "q23_crossover",
    "g02_edges",
    "g08_related_party_rings",
    "g10_prewarmed_rings",
    "sc1_score_all",
    "sc3_top_rings",
    "er1_extract_records",
    "er4_clusters",
    "er5_resolve_fed_grants",
    "st6_batch_ledger",
    "st7_findings_fed_grants",
]


def main() -> None:
    from fundtrace.plans import catalog
    from fundtrace.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    queries = catalog.queries()
    chosen = sys.argv[1:] or HEADLINE
    if chosen == ["all"]:
        chosen = list(queries)
    # Start the executor threads and compile the scan once.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in chosen:
        begun = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
