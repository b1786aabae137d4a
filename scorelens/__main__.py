"""python -m scorelens check [names...]  -- compare queries with DuckDB oracles."""

import json
import sys
import time


def main(argv):
    from scorelens.oracle_check import compare, duck
    from scorelens.registry import ORACLES, QUERIES
    from scorelens.session import local_session

    sf = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")] or list(QUERIES)
    for a in argv:
        if a.startswith("--sf="):
            sf = a[5:]
    spark = local_session(8)
    con = duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            r = compare(spark, sf, n, QUERIES[n], ORACLES.get(n), con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:800]}
        r["sec"] = round(time.time() - t, 2)
        ok = r.get("hash_ok", r.get("oracle", 1) is None) and "error" not in r
        bad += 0 if ok else 1
        print(json.dumps(r, default=str), flush=True)
    print(f"FAILED {bad} of {len(names)}")


if __name__ == "__main__":
    main(sys.argv[1:] if sys.argv[1:2] != ["check"] else sys.argv[2:])
