"""python tests/run_oracle.py [sf_dir] [key ...] -- compare catalog vs DuckDB."""
import sys
import time

sys.path.insert(0, ".")
from qanat.session import build_session  # noqa: E402
from qanat.plans.catalog import ORACLES, QUERIES  # noqa: E402
from tests.oracle_harness import compare, duck  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
keys = sys.argv[2:] or list(QUERIES)
spark = build_session()
con = duck(sf)
bad = 0
for k in keys:
    t = time.time()
    try:
        if k in ORACLES:
            probs, n = compare(spark, k, QUERIES[k], ORACLES[k], sf, con)
        else:
            n = QUERIES[k](spark, sf).count()
            probs = ["(no oracle)"]
    except Exception as e:  # noqa: BLE001
        probs, n = [f"ERROR {type(e).__name__}: {str(e)[:400]}"], -1
    ok = not probs or probs == ["(no oracle)"]
    bad += 0 if ok else 1
    print(f"{'OK ' if ok else 'BAD'} {k:28s} rows={n:<7d} {time.time()-t:6.1f}s {'; '.join(probs)}", flush=True)
print(f"{len(keys)-bad}/{len(keys)} ok")
