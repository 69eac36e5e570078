"""python tests/check.py SF_DIR [name-part ...]: compare queries with their reference SQL."""

import sys
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from palimpsest.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main(sf_dir: str, parts: list[str]) -> int:
    from palimpsest.plans.catalog import ORACLES, QUERIES

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            if name in ORACLES:
                diff = compare(spark, con, name, fn, ORACLES[name], sf_dir)
            else:
                n = len(fn(spark, sf_dir).collect())
                diff = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
            if len(parts) == 1:
                traceback.print_exc()
        bad += diff is not None
        print(("ok   " if diff is None else "FAIL ") + name + ("" if diff is None else f": {diff}"), flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
