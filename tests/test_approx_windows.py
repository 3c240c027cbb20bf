"""The second filter against a serial copy of the surveyed rule."""

import random

from glyphstream.operators import approx


def test_candidate_windows(spark):
    rng = random.Random(5)
    rows = [(k, f"p{rng.randrange(3)}", rng.randrange(80), rng.randrange(3)) for k in range(6) for _ in range(40)]
    want = {}
    for k in range(6):
        hits = sorted({(pos, dist) for key, _, pos, dist in rows if key == k})
        totals = [sum(d for q, d in hits if 0 <= q - pos < 8 * 1.25) for pos, _ in hits]
        want[k] = (len(hits), sum(t > int(3 * 3 - 8 * 0.25) for t in totals))
    df = spark.createDataFrame(rows, "k int, pattern string, pos bigint, dist int")
    got = {r["k"]: (r["n1"], r["n2"]) for r in approx.candidate_windows(df, "k", 3, 8, 0.25, 2).collect()}
    assert got == want and any(0 < b < a for a, b in want.values())
