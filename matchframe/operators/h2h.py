"""Head-to-head records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import or_hard


def h2h(matches: DataFrame, players: DataFrame, recent: int = 5) -> DataFrame:
    """tour, a, b (smaller bio_id first), wins, wins by surface, the last meetings as '1,2,…' from old to new, last_date.

    Both competitors are tracked and the winner is known. The last meetings are ranked before they are gathered,
    so no pair's list grows.
    """
    bio = lambda me, name: players.select("tour", F.col("mid").alias(me), F.col("bio_id").alias(name))
    met = matches.where("winner_id is not null").join(bio("p1_id", "b1"), ["tour", "p1_id"]).join(bio("p2_id", "b2"), ["tour", "p2_id"])
    first = F.col("b1") < F.col("b2")
    code = F.when(first == (F.col("winner_id") == F.col("p1_id")), 1).otherwise(2)
    pairs = met.select("tour", F.least("b1", "b2").alias("a"), F.greatest("b1", "b2").alias("b"), code.alias("code"), or_hard(F.col("surface")).alias("surface"), "date", "id")
    last = Window.partitionBy("tour", "a", "b").orderBy(F.desc("date"), F.desc("id"))
    ranked = pairs.withColumn("rn", F.row_number().over(last))
    wins = lambda side, surface=None: F.count_if((F.col("code") == side) & (F.lit(True) if surface is None else F.col("surface") == surface))
    kept = F.array_sort(F.collect_list(F.when(F.col("rn") <= recent, F.struct("date", "id", F.col("code").cast("string").alias("code")))))
    return ranked.groupBy("tour", "a", "b").agg(
        wins(1).alias("a_wins"), wins(2).alias("b_wins"), *(wins(s, f).alias(f"{f.lower()}_{n}") for f in "HCG" for s, n in ((1, "a"), (2, "b"))),
        F.array_join(F.transform(kept, lambda x: x["code"]), ",").alias("recent"), F.max("date").alias("last_date"),
    )


def h2h_view(records: DataFrame) -> DataFrame:
    """Both perspectives of each record: me, them, my_wins, their_wins, recent with 1 for me."""
    one = F.struct(F.col("a").alias("me"), F.col("b").alias("them"), F.col("a_wins").alias("my_wins"), F.col("b_wins").alias("their_wins"), F.col("recent").alias("recent"))
    two = F.struct(F.col("b").alias("me"), F.col("a").alias("them"), F.col("b_wins").alias("my_wins"), F.col("a_wins").alias("their_wins"), F.translate("recent", "12", "21").alias("recent"))
    return records.select("tour", F.inline(F.array(one, two)))
