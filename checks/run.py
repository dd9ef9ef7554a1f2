"""Compare queries with DuckDB: ``python -m checks.run SF_DIR [name ...]``."""

import sys
import time
import traceback

from checks import ORACLE, QUERIES
from checks.base import compare
from matchloom.session import session


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:]
    spark = session("checks", spark__master="local[8]", spark__sql__shuffle__partitions="8",
                    spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in [n for n in QUERIES if not names or any(n.startswith(x) for x in names)]:
        t = time.time()
        try:
            why = compare(spark, sf, name)
        except Exception:
            why = traceback.format_exc(limit=-3)[-500:]
        bad += why is not None
        mark = "ok  " if why is None else "FAIL"
        print(f"{mark} {name} {time.time() - t:.1f}s {'' if name in ORACLE else '(no sql)'} {why or ''}",
              flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
