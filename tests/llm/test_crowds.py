import numpy as np

from test_neighbours import brute, lists, rows_of


def test_crowds_of_near_copies_keep_recall(spark):
    rng = np.random.default_rng(5)
    crowd = rng.normal(size=16) + 1e-3 * rng.normal(size=(1_500, 16))
    x = np.concatenate([crowd, rng.normal(size=(300, 16))])
    rows = rows_of(x)
    got, want = lists(spark, rows), brute(x, [r[0] for r in rows])
    hits = sum(len(set(v) & set(want[key[1]])) for key, v in got.items())
    assert len(got) == len(rows) and hits >= 0.98 * 5 * len(rows), hits / 5 / len(rows)
