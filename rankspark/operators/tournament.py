"""Matches, points, Swiss pairing and Bradley-Terry ratings.

Pairing and fitting are sequential within a target, so a target is one row of arrays, and a task is called on batches of such
rows; a target has a bounded list of candidates. Matches are summed to (target, a, b) before they are grouped.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(matches: DataFrame, order: Column) -> DataFrame:
    """matches (target, model_a, model_b, winner '1'|'2'|name, winner_id) with the pair in order and the winner's id; of
    repeated judgements of a pair the last by `order` stays."""
    winner = F.coalesce(F.nullif("winner_id", F.lit("")), F.when(F.col("winner") == "1", F.col("model_a")).when(F.col("winner") == "2", F.col("model_b")).otherwise(F.col("winner")))
    rows = matches.select("target", F.least("model_a", "model_b").alias("a"), F.greatest("model_a", "model_b").alias("b"), winner.alias("winner"), order.alias("_at"))
    return rows.groupBy("target", "a", "b").agg(F.max_by("winner", "_at").alias("winner"))


def points(matches: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """(target, player, points): one for each match won; players without one have 0. Without players, those of the matches are
    taken, which are read once and not joined."""
    if players is None:
        sides = [F.struct(F.col(c).alias("player"), F.lit(0).alias("won"), F.lit(True).alias("plays")) for c in ("a", "b")]
        rows = matches.select("target", F.inline(F.array(*sides, F.struct(F.col("winner").alias("player"), F.when(F.col("winner").isNotNull(), 1).otherwise(0).alias("won"), F.lit(False).alias("plays")))))
        sums = rows.groupBy("target", "player").agg(F.sum("won").alias("points"), F.max("plays").alias("plays"))
        return sums.where("plays").select("target", "player", "points")
    won = matches.groupBy("target", F.col("winner").alias("player")).agg(F.count("*").alias("points"))
    return players.join(won, ["target", "player"], "left").select("target", "player", F.coalesce("points", F.lit(0)).alias("points"))


def unplayed(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """The pairs (target, a, b) that have no judgement yet, repeats and all. Pairs and matches are counted together instead of
    joined, since a join would deal sides that are dealt by target once more by pair."""
    key = ["target", "a", "b"]
    known = matches.select(*key, F.lit(0).alias("asked")).dropna(subset=key)
    sums = pairs.select(*key, F.lit(1).alias("asked")).unionByName(known).groupBy(*key).agg(F.sum("asked").cast("int").alias("times"), F.min("asked").alias("asked"))
    return sums.where("asked = 1").select(*key, F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_")).drop("_")


def _paired(names: list, left: list, right: list) -> list[tuple]:
    """Each of the names in order with the first later one that is free and not met yet."""
    met, free, out = set(zip(left, right, strict=True)), deque(dict.fromkeys(names)), []
    while free:
        p, passed = free.popleft(), []
        while free:
            q = free.popleft()
            couple = (min(p, q), max(p, q))
            if couple not in met:
                out.append(couple)
                break
            passed.append(q)
        free.extendleft(reversed(passed))
    return out


def swiss_pairs(standings: DataFrame, played: DataFrame, seed: str, player_type: str = "string") -> DataFrame:
    """standings (target, player, points) and played (target, a, b): the next round's pairs (target, a, b). Players in order of
    points, ties by hash; each takes the first later one that is free and not met yet. A target is one row of arrays."""
    place = F.struct("points", F.md5(F.concat_ws("|", F.lit(seed), F.col("target").cast("string"), F.col("player").cast("string"))).alias("h"), "player")
    rows = standings.select("target", place.alias("s"), F.lit(None).cast(f"struct<a:{player_type},b:{player_type}>").alias("m"))
    rows = rows.unionByName(played.select("target", F.struct(F.col("a").cast(player_type).alias("a"), F.col("b").cast(player_type).alias("b")).alias("m")), allowMissingColumns=True)
    lists = rows.groupBy("target").agg(F.array_sort(F.collect_list("s"))["player"].alias("names"), F.collect_list("m").alias("met"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, left, right = (batch.column(i) for i in (1, 2, 3))
            held = [pc.list_flatten(c).to_pylist() for c in (names, left, right)]
            ends = [[0, *pc.cumulative_sum(pc.list_value_length(c)).to_pylist()] for c in (names, left, right)]
            owner, pairs = [], []
            for i in range(batch.num_rows):
                found = _paired(*[h[e[i] : e[i + 1]] for h, e in zip(held, ends, strict=True)])
                owner += [i] * len(found)
                pairs += found
            sides = [pa.array([c[k] for c in pairs], names.type.value_type) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *sides], names=["target", "a", "b"])

    kind = dict(standings.dtypes)["target"]
    return lists.select("target", "names", F.col("met.a").alias("a"), F.col("met.b").alias("b")).mapInArrow(run, f"target {kind}, a {player_type}, b {player_type}")


#: Players whose square matrix (2 MB) is solved at once.
FEW_PLAYERS = 512


def fit_bradley_terry(a: np.ndarray, b: np.ndarray, wins_a: np.ndarray, wins_b: np.ndarray, n: int, c: float = 1.0, bias: np.ndarray | None = None) -> np.ndarray:
    """Ratings (and bias weights) of a logistic model without intercept on +1/-1 rows, with ridge 1/c, by Newton steps. No matrix
    of matches and players is built: a row has two entries. Steps of up to FEW_PLAYERS are solved by their square matrix, others by
    conjugate gradients."""
    more = bias if bias is not None else np.zeros((len(a), 0))

    def forward(w: np.ndarray) -> np.ndarray:
        return w[a] - w[b] + more @ w[n:]

    def backward(r: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(a, r, n) - np.bincount(b, r, n), more.T @ r))

    def solve(curve: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The step of (1 + c X' curve X) step = goal; the diagonal scales gradients."""
        if len(goal) <= FEW_PLAYERS:
            x = np.eye(len(goal))
            for p, q, sign in ((a, a, c), (b, b, c), (a, b, -c), (b, a, -c)):
                np.add.at(x, (p, q), sign * curve)
            if more.shape[1]:
                side = c * curve[:, None] * more
                cross = np.zeros((n, more.shape[1]))
                np.add.at(cross, a, side)
                np.add.at(cross, b, -side)
                x[:n, n:], x[n:, :n] = cross, cross.T
                x[n:, n:] += more.T @ side
            return np.linalg.solve(x, goal)
        scale = 1 + c * np.concatenate((np.bincount(a, curve, n) + np.bincount(b, curve, n), (more * more).T @ curve))
        step, rest = np.zeros_like(goal), goal.copy()
        z = rest / scale
        way, size = z.copy(), rest @ z
        enough = 1e-10 * np.abs(goal).max(initial=0)
        for _ in range(len(goal)):
            if np.abs(rest).max(initial=0) <= enough:
                break
            ahead = way + c * backward(curve * forward(way))
            pace = size / (way @ ahead)
            step += pace * way
            rest -= pace * ahead
            z = rest / scale
            size, before = rest @ z, size
            way = z + size / before * way
        return step

    w, total = np.zeros(n + more.shape[1]), wins_a + wins_b
    for _ in range(100):
        p = 1 / (1 + np.exp(-forward(w)))
        step = solve(total * p * (1 - p), w - c * backward(wins_a - total * p))
        w -= step
        if np.abs(step).max(initial=0) < 1e-10:
            break
    return w


#: Numbers in the square matrices that are solved at once (8 MB).
SOLVED_CELLS = 1 << 20


def _fit_alike(owner: np.ndarray, a: np.ndarray, b: np.ndarray, wins_a: np.ndarray, wins_b: np.ndarray, count: int, width: int, c: float) -> np.ndarray:
    """fit_bradley_terry() of `count` targets of at most `width` players at once, without bias; a and b are places within a
    target. Places without a player rate 0."""
    at_a, at_b, size = owner * width + a, owner * width + b, count * width
    cells = np.concatenate([p * width + q for p, q in ((at_a, a), (at_b, b), (at_a, b), (at_b, a))])
    w, total, diagonal = np.zeros(size), wins_a + wins_b, np.arange(width)
    for _ in range(100):
        p = 1 / (1 + np.exp(w[at_b] - w[at_a]))
        rest, curve = wins_a - total * p, c * total * p * (1 - p)
        x = np.bincount(cells, np.concatenate((curve, curve, -curve, -curve)), size * width).reshape(count, width, width)
        x[:, diagonal, diagonal] += 1
        goal = w - c * (np.bincount(at_a, rest, size) - np.bincount(at_b, rest, size))
        step = np.linalg.solve(x, goal.reshape(count, width, 1)).ravel()
        w -= step
        if np.abs(step).max(initial=0) < 1e-10:
            break
    return w.reshape(count, width)


def fit_targets(owner: np.ndarray, a: np.ndarray, b: np.ndarray, wins_a: np.ndarray, wins_b: np.ndarray, sizes: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Ratings of all targets' players, target after target. owner: the target of a match, in order; a and b: places among its
    sizes[owner] players. Targets of about one size are solved together."""
    starts, ends = np.searchsorted(owner, np.arange(len(sizes))), np.searchsorted(owner, np.arange(len(sizes)), "right")
    before, order, out, at = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable"), np.zeros(int(sizes.sum())), 0
    while at < len(order):
        width = int(sizes[order[at]])
        some = order[at : at + max(1, SOLVED_CELLS // max(width * width, 1))]
        at += len(some)
        rows = np.concatenate([np.arange(starts[t], ends[t]) for t in some])
        nth = np.repeat(np.arange(len(some)), ends[some] - starts[some])
        if width > FEW_PLAYERS:
            ratings = [fit_bradley_terry(*[x[starts[t] : ends[t]] for x in (a, b, wins_a, wins_b)], int(sizes[t]), c) for t in some]
        else:
            ratings = _fit_alike(nth, a[rows], b[rows], wins_a[rows], wins_b[rows], len(some), width, c)
        for t, w in zip(some, ratings, strict=True):
            out[before[t] : before[t] + sizes[t]] = w[: sizes[t]]
    return out


def bradley_terry(matches: DataFrame, c: float = 1.0, tie: str = "tie") -> DataFrame:
    """matches (target, a, b, winner) to (target, player, rating); a tie is half a win for each side. A target is one row of
    arrays; a task fits a batch of targets at once."""
    half = F.when(F.col("winner") == tie, 0.5)
    sums = matches.groupBy("target", "a", "b").agg(F.sum(F.coalesce(half, F.when(F.col("winner") == F.col("a"), 1.0).otherwise(0.0))).alias("wa"), F.sum(F.coalesce(half, F.when(F.col("winner") == F.col("b"), 1.0).otherwise(0.0))).alias("wb"))
    each = F.struct(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "wa", "wb")
    lists = sums.groupBy("target").agg(F.array_sort(F.collect_list(each)).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy())
            left, right, wins_a, wins_b = (pc.list_flatten(batch.column(i)) for i in range(1, 5))
            coded = pa.concat_arrays([left, right]).dictionary_encode()
            inorder = np.asarray(pc.sort_indices(coded.dictionary))
            rank = np.empty(len(inorder), np.int64)
            rank[inorder] = np.arange(len(inorder))
            players, place = np.unique(np.concatenate((owner, owner)) * max(len(rank), 1) + rank[np.asarray(coded.indices)], return_inverse=True)
            whose = players // max(len(rank), 1)
            sizes = np.bincount(whose, minlength=batch.num_rows)
            place = place - (np.cumsum(sizes) - sizes)[np.concatenate((owner, owner))]
            ratings = fit_targets(owner, place[: len(owner)], place[len(owner) :], wins_a.to_numpy(), wins_b.to_numpy(), sizes, c)
            names = coded.dictionary.take(pa.array(inorder[players % max(len(rank), 1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose)), names, pa.array(ratings)], names=["target", "player", "rating"])

    kind = dict(matches.dtypes)["target"]
    return lists.select("target", *[F.col(f"m.{x}").alias(x) for x in ("a", "b", "wa", "wb")]).mapInArrow(run, f"target {kind}, player string, rating double")


def min_max(rows: DataFrame, group: str, value: str, scale: float = 1.0, out: str = "relevance") -> DataFrame:
    """value scaled to [0, scale] within the group; 0 where all are equal."""
    w = Window.partitionBy(group)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn(out, F.when(hi == lo, 0.0).otherwise((F.col(value) - lo) / (hi - lo) * scale))
