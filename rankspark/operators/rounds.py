"""Work in rounds: a Swiss tournament with a judge, and work lists that are tried until none is left.

Each round's rows are written to a folder that driver and executors share and read again, so a run that was cut off goes on
after its last whole round and plans stay short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import boxed_choice
from .tournament import points, swiss_pairs


def _whole(rows: DataFrame, path: str) -> bool:
    """Whether a round was written to its end."""
    place = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _round(rows: Callable[[], DataFrame], like: DataFrame, path: str) -> DataFrame:
    if not _whole(like, path):
        rows().write.mode("overwrite").parquet(path)
    return like.sparkSession.read.parquet(path)


def _verdicts(pairs: DataFrame, judge: Callable[[DataFrame, int], DataFrame], attempt: int) -> DataFrame:
    """(target, a, b, winner) of the pairs whose answer has a boxed 1 or 2."""
    choice = boxed_choice(F.col("answer"))
    judged = judge(pairs, attempt).select("target", "a", "b", F.when(choice == 1, F.col("a")).when(choice == 2, F.col("b")).alias("winner"))
    return judged.where(F.col("winner").isNotNull())


def swiss_tournament(players: DataFrame, judge: Callable[[DataFrame, int], DataFrame], rounds: int, seed: str, folder: str) -> DataFrame:
    """players (target, player) to matches (target, a, b, winner, round). judge(pairs (target, a, b), attempt) gives them an
    answer, text with a boxed 1 for a or 2 for b; pairs without a verdict are asked once more, and those that still have none
    count as not met. Nobody meets the same player twice; a target without free pairs has no more matches."""
    kind = dict(players.dtypes)["player"]
    given = players
    players = _round(lambda: given, given, f"{folder}/players")  # read by every round
    matches = players.select("target", F.col("player").alias("a"), F.col("player").alias("b"), F.col("player").alias("winner"), F.lit(0).alias("round")).where(F.lit(False))
    for number in range(1, rounds + 1):
        place, before = f"{folder}/round={number}", matches

        def pairs(number=number, before=before) -> DataFrame:
            return swiss_pairs(points(before, players), before.select("target", "a", "b"), f"{seed}|{number}", kind)

        asked = _round(pairs, players, f"{place}/pairs")
        first = _round(lambda asked=asked: _verdicts(asked, judge, 1), players, f"{place}/first")
        again = _round(lambda asked=asked, first=first: _verdicts(asked.join(first, ["target", "a", "b"], "left_anti"), judge, 2), players, f"{place}/second")
        matches = matches.unionByName(first.unionByName(again).withColumn("round", F.lit(number)))
    return matches


def tried(items: DataFrame, key: str, work: Callable[[DataFrame, int], DataFrame], tries: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows that work(items, attempt) gave, with attempt, and the items that still have none: what an attempt leaves out is
    tried again until none is left or `tries` are made. Items without a key cannot be told apart and are never done."""
    spark = items.sparkSession
    left, done = items, None
    for attempt in range(1, tries + 1):
        given = _round(lambda left=left, attempt=attempt: work(left, attempt), items, f"{folder}/attempt={attempt}").withColumn("attempt", F.lit(attempt))
        done = given if done is None else done.unionByName(given)
        left = items.join(done.select(key), key, "left_anti")
        if not left.limit(1).count():
            break
    return done if done is not None else spark.createDataFrame([], items.schema).withColumn("attempt", F.lit(0)), left
