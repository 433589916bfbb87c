"""Time the headline queries on the tables in $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import logging
import os
import sys
import time

logging.disable(logging.CRITICAL)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from notespark.plans.catalog import QUERIES  # noqa: E402
from notespark.session import local_session  # noqa: E402

HEADLINE = (
    "vault_breakdown",
    "vault_summary",
    "name_chunks",
    "vault_themes",
    "header_pack",
    "fixed_sections",
    "check_full_replies",
    "check_full_lint",
    "auto_verdicts",
    "text_hashes",
    "check_requests",
    "parsed_corrections",
    "apply_corrections",
    "corrected_notes",
    "cache_lookup",
    "cache_replay",
    "pending_requests",
    "protected_mask",
    "lexicon",
    "spell_candidates",
    "lint_findings",
    "safe_fixes",
    "smart_links_anchor",
    "theme_partners",
    "embedding_links",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        QUERIES["lint_findings"](spark, warm).count()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
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
