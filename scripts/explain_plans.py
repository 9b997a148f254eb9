"""Print the physical plans of key queries as they look at scale.

Broadcast joins are disabled (``autoBroadcastJoinThreshold=-1``) so the plan
shows the shuffle strategy Spark would pick for large inputs.  The first part
prints a one-line-per-operator outline (exchanges, joins, windows, scans);
``--formatted`` prints the full ``explain("formatted")`` text.

Usage: python scripts/explain_plans.py [sf_dir] [--formatted] [query ...]
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from slotwise.plans.registry import QUERIES, load_all  # noqa: E402
from slotwise.session import get_session  # noqa: E402

DEFAULT = ["hourly_demand", "feature_table", "random_split", "forecast_table", "quality_audit"]
KEEP = re.compile(r"(Exchange|Join|Window|Scan|Generate|HashAggregate|Sort |Subquery|TakeOrdered)")


def main(argv):
    args = [a for a in argv[1:] if not a.startswith("--")]
    formatted = "--formatted" in argv
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or DEFAULT
    load_all()
    spark = get_session(
        "local[8]",
        shuffle_partitions=8,
        conf={"spark.ui.showConsoleProgress": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted" if formatted else "simple")
        print(f"### {name}\n")
        if formatted:
            print("```\n" + buf.getvalue().strip() + "\n```\n")
            continue
        lines = []
        for ln in buf.getvalue().splitlines():
            if KEEP.search(ln):
                ln = re.sub(r"#\d+L?", "", ln)
                ln = re.sub(r", \[plan_id=\d+\]", "", ln)
                ln = re.sub(r"(ReadSchema: struct<[^>]*>).*", r"\1", ln)
                ln = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\], ", "", ln)
                lines.append(ln.rstrip()[:220])
        print("```\n" + "\n".join(lines) + "\n```\n")


if __name__ == "__main__":
    main(sys.argv)
