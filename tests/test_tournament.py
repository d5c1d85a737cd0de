"""Pairing and ratings against plain versions."""

import hashlib
import math
import random

from rankspark.operators import tournament as T


def games(seed, targets=4, players=9):
    rnd = random.Random(seed)
    out = []
    for t in range(targets):
        names = [f"p{i}" for i in range(players)]
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if rnd.random() < 0.45:
                    out.append((t, a, b, rnd.choice([a, b, b, "tie"])))
    return out


def plain_pairs(standings, met, seed):
    """Round by round: whoever has fewest points first, hashes break ties; the first later free one not met yet."""
    out = []
    for t in sorted({t for t, _, _ in standings}):
        queue = sorted(((p, hashlib.md5(f"{seed}|{t}|{n}".encode()).hexdigest(), n) for u, n, p in standings if u == t))
        names = [n for _, _, n in queue]
        while names:
            first = names.pop(0)
            for other in names:
                if (t, *sorted((first, other))) not in met:
                    out.append((t, *sorted((first, other))))
                    names.remove(other)
                    break
    return sorted(out)


def test_swiss_pairs_equal_a_plain_loop(spark):
    rnd = random.Random(11)
    played = games(5)
    standings = [(t, f"p{i}", rnd.randint(0, 4)) for t in range(4) for i in range(9)] + [(9, "alone", 0)]
    frame = spark.createDataFrame(standings, "target long, player string, points long")
    met = spark.createDataFrame([(t, a, b) for t, a, b, _ in played], "target long, a string, b string")
    got = sorted(tuple(r) for r in T.swiss_pairs(frame, met, "42").collect())
    assert got == plain_pairs(standings, {(t, a, b) for t, a, b, _ in played}, "42")


def plain_ratings(rows, c=1.0, steps=4000, rate=0.05):
    """Gradient descent on every judgement by itself: ridge 1/2 |w|^2 plus c times the log loss."""
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    w = dict.fromkeys(names, 0.0)
    for _ in range(steps):
        grad = dict(w)
        for a, b, winner in rows:
            share = 0.5 if winner == "tie" else float(winner == a)
            g = c * (1 / (1 + math.exp(w[b] - w[a])) - share)
            grad[a] += g
            grad[b] -= g
        for n in names:
            w[n] -= rate * grad[n]
    return w


def test_ratings_equal_gradient_descent(spark):
    played = games(8) + games(9)[:6]  # some pairs are judged twice
    frame = spark.createDataFrame(played, "target long, a string, b string, winner string")
    got = {(r.target, r.player): r.rating for r in T.bradley_terry(frame).collect()}
    for t in range(4):
        want = plain_ratings([g[1:] for g in played if g[0] == t])
        assert {n for u, n in got if u == t} == set(want)
        assert all(abs(got[t, n] - v) < 1e-6 for n, v in want.items())


def test_sparse_ratings_equal_dense_ones_and_take_many_players():
    import numpy as np

    from rankspark.operators.tournament import fit_bradley_terry

    draw = np.random.default_rng(3)

    def dense(a, b, wa, wb, n, c, bias):
        x = np.zeros((len(a), n + bias.shape[1]))
        x[np.arange(len(a)), a] += 1
        x[np.arange(len(a)), b] -= 1
        x[:, n:] = bias
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve(np.eye(len(w)) + c * x.T @ (x * ((wa + wb) * p * (1 - p))[:, None]), w - c * x.T @ (wa - (wa + wb) * p))
        return w

    for n, m, c in ((2, 1, 1.0), (12, 40, 1.0), (30, 200, 5.0), (600, 3000, 1.0)):
        a = draw.integers(0, n, m)
        b = (a + draw.integers(1, n, m)) % n
        wa, wb, bias = draw.integers(0, 4, m).astype(float), draw.random(m), draw.normal(size=(m, 2))
        assert np.abs(fit_bradley_terry(a, b, wa, wb, n, c, bias) - dense(a, b, wa, wb, n, c, bias)).max() < 1e-7
    n = 10_000
    a = np.arange(n).repeat(8)
    b = (a + draw.integers(1, n, len(a))) % n
    ratings = fit_bradley_terry(a, b, (a < b).astype(float), (a > b).astype(float), n)
    assert ratings[: n // 4].mean() > 0.5 > -0.5 > ratings[-n // 4 :].mean()
