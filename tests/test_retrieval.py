import random
from decimal import ROUND_HALF_UP, Decimal

from palimpsest.operators import retrieval


def brute(vectors, queries, most):
    out = []
    for name, q in queries:
        scored = []
        for vec_id, v in vectors:
            total = None
            if v is not None and len(v) == len(q) and None not in v:
                total = 0.0
                for x, y in zip(v, q, strict=True):
                    total += x * y
                total = total if total != total else float(Decimal(repr(total)).quantize(Decimal("1e-9"), ROUND_HALF_UP))
            nan = total is not None and total != total
            scored.append((total is None, not nan, 0 if nan or total is None else -total, vec_id, repr(total)))
        out += [(name, k + 1, x[3], x[4]) for k, x in enumerate(sorted(scored)[:most])]
    return sorted(out)


def test_vector_search_multiplies_blocks(spark, monkeypatch):
    """Ties, odd arrays and several blocks and steps; no pair of a query and a vector is a row of a join."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng = random.Random(5)
    vectors = [(k, [rng.choice([-1.0, 0.25, 0.1, 0.5]) for _ in range(6)]) for k in range(400)]
    vectors += [(400 + k, list(vectors[3][1])) for k in range(60)]
    odd = [(900, None), (901, []), (902, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (903, [0.1] * 5), (904, [float("nan")] * 6)]
    for rows, most in ((vectors, 10), (vectors[:4] + odd, 8), ([], 3)):
        queries = [(k, v) for k, v in vectors[:20]] + [(1000, [0.5] * 5)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        asked = spark.createDataFrame(queries, "query_id long, qvec array<double>")
        found = retrieval.vector_search(frame, asked, most)
        assert sorted((r.query_id, r.rank, r.vec_id, repr(r.score)) for r in found.collect()) == brute(rows, queries, most)
        assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert retrieval.vector_search(frame, asked.where("query_id < 0"), 3).count() == 0
