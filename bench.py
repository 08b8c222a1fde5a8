"""Times the headline queries: one JSON line."""

import json
import os
import sys
import time

from sievework import registry
from sievework.session import local_session, prepare

HEADLINE = ["d11_ngram_decontamination", "a05_full_metrics", "a09_threshold_sweep", "a29_spearman", "f19_lexicon_ladder", "x24_redact", "j03_anti_composite", "j09_tier_match", "d12_group_split", "t08_stratified_sample", "st_sessions", "m03_batch_scores", "m04_sliding_scores", "p04_suite", "d21_augmentation_blocks", "d25_pool", "a27_bootstrap_metrics", "a05_model_metrics", "w14_group_batches", "m06_contrastive_loss", "s03_lines_in_order"]
CORPUS = ["op1_pii", "op2_quality", "op3_near_dedup", "op4_line_dedup", "op5_sharding", "op6_toxicity", "op7_substring_dedup", "op8_mixing", "op9_decontamination", "op10_url_filters", "op11_importance_resampling", "op12_exact_dedup", "op13_periodic_runs", "pipeline"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = prepare(local_session(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries = {k: v for k, v in registry.queries().items() if k in HEADLINE}
    try:
        from sievework.llm.queries import queries as corpus

        queries |= {k: v for k, v in corpus().items() if k in CORPUS}
    except ModuleNotFoundError as missing:  # the corpus operators are an optional part
        if missing.name not in ("sievework.llm", "sievework.llm.queries"):
            raise
    spark.range(1000).count()
    took = {}
    for name, q in queries.items():
        start = time.time()
        q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
