"""Run registered queries at one scale and print what differs: ``python tests/check.py [prefix ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from wirelake.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = connect(sf)
    oracle = entry.oracle_sql()
    bad = done = 0
    for key, run in sorted(entry.queries().items()):
        if sys.argv[1:] and not any(key.startswith(p) for p in sys.argv[1:]):
            continue
        start = time.time()
        done += 1
        try:
            df = run(spark, sf)
            if key in oracle:
                spent = None
                problems = differences(df, con, oracle[key])
            else:
                problems = []
                n = df.count()
                print(f"      {key}: rows only, {n}")
        except Exception as error:  # report and go on
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
            if os.environ.get("CHECK_TRACE"):
                traceback.print_exc()
        took = time.time() - start
        if problems:
            bad += 1
            print(f"FAIL  {key} ({took:.1f}s)")
            for p in problems:
                print("      ", p[:900])
        elif took > 4:
            print(f"slow  {key} ({took:.1f}s)")
    print(f"{done - bad} of {done} agree")
