import numpy as np

from ledgerline.llm import embeddings

DDL = "vec_id long, label int, embedding array<float>, id string, n string"


def brute(rows, threshold=0.93):
    def sound(r):
        v = r[2]
        return (
            r[0] is not None
            and r[1] is not None
            and v is not None
            and None not in v
            and np.isfinite(np.float32(v)).all()
            and any(np.float32(v) != 0)
        )

    good = [r for r in rows if sound(r)]
    up = {i: i for i in range(len(good))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(good)
    vectors = [np.float32(r[2]).astype(float) for r in good]
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if good[i][1] == good[j][1] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    out = [(r[0], 0, r[0], r[0] is not None) for r in rows if not sound(r)]
    for i, r in enumerate(good):
        low = min(x[0] for j, x in enumerate(good) if find(j) == find(i))
        out.append((r[0], links[i], low, r[0] == low))
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DDL)
    found = embeddings.near_vectors(df, **options)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, [1.0, 0.0, 0.0]),
        (2, 0, [2.0, 0.0, 0.0]),
        (3, 1, [1.0, 0.0, 0.0]),
        (4, None, [1.0, 0.0, 0.0]),
        (5, 0, None),
        (6, 0, [0.0, 0.0, 0.0]),
        (7, 0, [1.0, None, 0.0]),
        (8, 0, [nan, 1.0, 0.0]),
        (9, 0, [inf, 1.0, 0.0]),
        (10, 0, []),
        (11, 0, [1.0, 0.1]),
        (12, 0, [1.0, 0.1]),
        (None, 0, [1.0, 0.0, 0.0]),
        (13, 0, [1e-30, 0.0, 1e-32]),
        (14, 0, [-1.0, 0.0, 0.0]),
    ]
    check(spark, rows)
    check(spark, rows, block_rows=1)
    check(spark, [])
    check(spark, [(1, None, None)])


def test_random_vectors_copies_and_chains(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in range(3):
        for _ in range(60):
            base = rng.normal(size=40)
            for _ in range(rng.integers(1, 6)):
                rows.append((i, label, (base + rng.normal(size=40) * rng.uniform(0, 0.5)).tolist()))
                i += 1
        angle = np.linspace(0, 3, 60)  # a chain
        for a in angle:
            rows.append((i, label, [float(np.cos(a)), float(np.sin(a)), *[0.0] * 38]))
            i += 1
    rows += [(i + k, 1, rows[5][2]) for k in range(50)]  # copies
    for block_rows in (7, 64, 4096):
        check(spark, rows, block_rows=block_rows)


def test_threshold_itself(spark):
    """Vectors at exactly the threshold, and next to it."""
    x = [1.0, 0.0]
    rows = [(k, 0, [0.93 + d, float(np.sqrt(1 - 0.93**2))]) for k, d in enumerate((-1e-6, 0, 1e-6, 1e-4))]
    check(spark, [(99, 0, x), *rows])


def test_a_vec_id_with_several_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [0.99, 0.01]), (3, 0, [-1.0, 0.0]), (3, 1, [0.0, 1.0]), (3, 1, [0.0, 1.0])]
    check(spark, rows)
