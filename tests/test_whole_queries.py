"""Span and graph queries over whole tables against brute force."""

from sparkvet.plans import driver_queries

SF = "/root/testdata/sf0.01"


def test_innermost_region(spark):
    spans = [(r["p_partkey"], r["p_size"] * 97 % 4000) for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    spans = [(k, k % 10, a, a + 50 + k % 900) for k, a in spans]
    lines = {(r["l_orderkey"], r["l_linenumber"], int(r["l_quantity"]) * 100 + r["l_linenumber"], r["l_suppkey"] % 10) for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect()}
    best = {(p, f): min(((b - a, k) for k, g, a, b in spans if f == g and a <= p < b), default=None) for p, f in {x[2:] for x in lines}}
    want = sorted((*x, best[x[2:]][1]) for x in lines if best[x[2:]])
    assert max(x[4] for x in want) >= 200
    assert sorted(tuple(r) for r in driver_queries.QUERIES["innermost_region"](spark, SF).collect()) == want


def test_whole_graph(spark):
    sf = "/root/testdata/sf0.001"
    calls = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        calls.setdefault(r["l_suppkey"], set()).add(r["l_suppkey"] * 7 + r["l_partkey"])

    def reached(starts, most):
        depth, queue = dict.fromkeys(starts, 0), list(starts)
        for n in queue:
            for m in calls.get(n, ()) if depth[n] < most else ():
                if m not in depth:
                    depth[m] = depth[n] + 1
                    queue.append(m)
        return depth

    want = sorted((c, n, d) for c in calls for n, d in reached([c], 5).items())
    assert max(c for c, _, _ in want) >= 9 and max(d for _, _, d in want) > 1
    assert sorted(tuple(r) for r in driver_queries.QUERIES["bfs_depth5"](spark, sf).collect()) == want
    owing = [r["s_suppkey"] for r in spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal < 0").collect()]
    got = sorted(r["node"] for r in driver_queries.QUERIES["closure"](spark, sf).collect())
    assert got == sorted(reached(owing, 1 << 30))
