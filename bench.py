"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from normlake.plans import load_all
from normlake.plans.registry import REGISTRY
from normlake.session import local_session

HEADLINE = (
    "duty_coverage", "win04_rank_fusion", "agg01_counted_coverage", "agg02_element_coverage", "jon09_route_entities", "agg05_rollup_products",
    "jon34_export_rows", "jon31_apply_approvals", "src10_append_versions", "jon27_earlier_with_other_bytes", "jon19_provision_changes",
    "jon35_row_fates", "agg10_classification", "agg15_runtime", "agg15_model_switches", "agg23_gate_checks", "agg24_multiset_fingerprint",
    "win09_chain_breaks", "jon16_candidates", "fun05_gram_similarity", "top05_reranked_head", "top02_passages_to_judge", "jon20_pair_predictions",
    "top01_question_items", "fun09_quantities", "fun29_extract_duties", "win07_clauses", "fun24_entity_gate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    spent = {}
    for name in HEADLINE:
        started = time.time()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
