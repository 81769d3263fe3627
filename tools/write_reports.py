"""Write the global and weekly report documents (W6) for a data folder.

    python tools/write_reports.py /root/testdata/sf0.01 <out_dir> [as_of]

``out_dir`` should be a shared folder on a cluster; each document is one
UTF-8 text file written by the executors (``global/``, ``weekly/``).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from revq.operators.stats import products_dim
    from revq.plans.base import report_reviews
    from revq.plans.reports import global_report_lines, weekly_report_lines, write_report
    from revq.session import get_spark
    from revq.sources.fixtures import reviews_in

    sf, out = sys.argv[1], sys.argv[2].rstrip("/")
    as_of = sys.argv[3] if len(sys.argv) > 3 else "2024-02-27"
    spark = get_spark(app="revq-reports")
    r = report_reviews(spark, sf, with_text=True)
    p = products_dim(reviews_in(spark, sf))
    first = p.agg({"product_id": "min"}).first()[0]  # observed: quotes from one product
    write_report(global_report_lines(r, p, first), f"{out}/global")
    write_report(weekly_report_lines(r, p, as_of, quote_product=first), f"{out}/weekly")
    spark.stop()


if __name__ == "__main__":
    main()
