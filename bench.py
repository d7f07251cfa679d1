"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the table folder, BENCH_CPUS the number of local cores. Searches run on a store and an index built
beforehand, as they do in service; building them is timed as ``index_build``.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from yomisaku.plans import catalog  # noqa: E402
from yomisaku.session import local_session  # noqa: E402

HEADLINE = ["article_rows", "html_text", "rest_normalize", "index_text", "index_text_ja", "upsert_posts", "purge_stale",
            "advance_marks", "facets_all", "search_posts", "search_relevance", "search_blank", "match_phrase",
            "search_many", "result_cards", "export_urls", "stream_upsert"]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # Start the JVM's and the Python workers' machinery before the clock.
    spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count().collect()
    catalog.html_text(spark, folder).limit(1).collect()

    def timed(run):
        start = time.time()
        run()
        return round(time.time() - start, 3)
    queries = {"index_build": timed(lambda: catalog.corpus(spark, folder))}
    for name in HEADLINE:
        queries[name] = timed(lambda: catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(queries.values()), 3), "unit": "sec",
                      "queries": queries, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
