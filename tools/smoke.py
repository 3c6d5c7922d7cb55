"""Run catalog queries at a scale factor and report rows / errors (developer tool)."""

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")

from gauntlet.plans.catalog import QUERIES  # noqa: E402
from gauntlet.session import get_spark  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = get_spark(shuffle_partitions=8)
    bad = []
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            n = df.count()
            print(f"OK   {name:30s} rows={n:7d} {time.time() - t:6.2f}s {df.columns}", flush=True)
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: {str(exc)[:600]}", flush=True)
            traceback.print_exc(limit=3)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
