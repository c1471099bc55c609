"""Column functions: rounding, truthiness, aliases, scores, names and form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import COURTS, TOUR_TIERS

#: Names of each counter in the feeds, the first present one wins.
STAT_ALIASES = {
    "svpt": ("firstServeOf", "totalServePointsAttempted", "serveOf", "serveOfGm", "svpt"),
    "opp_svpt": ("firstServeOf", "totalServePointsAttempted", "svpt"),
    "first_in": ("firstServe", "firstServeIn", "1stIn"),
    "first_won": ("winningOnFirstServe", "firstServeWon", "1stWon"),
    "second_won": ("winningOnSecondServe", "secondServeWon", "2ndWon"),
    "aces": ("aces", "ace"),
    "double_faults": ("doubleFaults", "doubleFault", "df"),
    "bp_faced": ("breakPointFaced", "breakPointsFaced", "bpFaced"),
    "bp_saved": ("breakPointSaved", "breakPointsSaved", "bpSaved"),
    "bp_converted": ("breakPointsConverted", "breakPointConverted", "bpConv"),
    "bp_attempts": ("breakPointsConvertedOf", "breakPointsAttempted", "breakPointAttempted", "bpAttempt"),
}


def ratio_sql(num: str, den: str, places: int, percent: bool = True, div: str = "div") -> str:
    """SQL of num / den (in percent) rounded half-even in integers; null for no denominator. div: the engine's integer division."""
    scale = 10**places * (100 if percent else 1)
    q, r = f"({scale} * abs({num}) {div} {den})", f"({scale} * abs({num}) % {den})"
    whole = f"({q} + CASE WHEN 2 * {r} > {den} THEN 1 WHEN 2 * {r} = {den} THEN {q} % 2 ELSE 0 END)"
    return f"CASE WHEN {den} <> 0 THEN CAST(CASE WHEN {num} < 0 THEN -1 ELSE 1 END * {whole} AS DOUBLE) / {10**places} END"


def ratio(num: str, den: str, places: int, percent: bool = True) -> Column:
    return F.expr(ratio_sql(num, den, places, percent))


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def first_truthy(*cols: Column) -> Column:
    """First that is not null, '' or '0'."""
    return F.coalesce(*(F.nullif(F.nullif(c.cast("string"), F.lit("")), F.lit("0")) for c in cols))


def stat_int(stats: Column, *aliases: str) -> Column:
    """First alias present and not '' or NA, a present 0 included; whole part of a number, else 0."""
    found = F.coalesce(*(F.when(~stats[k].isin("", "NA"), stats[k]) for k in aliases))
    return F.coalesce(found.try_cast("int"), found.try_cast("double").cast("int"), F.lit(0))


def won(winner: Column, me: Column, unknown: bool | None) -> Column:
    return F.when(winner.isNotNull(), winner == me).otherwise(F.lit(unknown).cast("boolean"))


def surface_of(court: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in COURTS.items() for x in pair))[court]


def or_hard(surface: Column) -> Column:
    return F.coalesce(surface, F.lit("H"))


def rescaled_points(tour: Column, points: Column) -> Column:
    """The wta feed gives points times 100; half-even."""
    return F.when(tour == "wta", F.bround(points / 100)).otherwise(points).cast("int")


def completed(score: Column) -> Column:
    return F.coalesce((score != "") & ~F.upper(score).rlike("RET|W/O|DEF"), F.lit(False))


def tour_level(kind: Column) -> Column:
    return F.coalesce(kind.isin(*TOUR_TIERS), F.lit(False))


def main_draw(round_: Column) -> Column:
    return ~F.coalesce(round_, F.lit("")).startswith("Q")


def draw_bucket(size: Column) -> Column:
    return F.when(size >= 128, 128).when(size >= 96, 96).when(size >= 64, 64).otherwise(32)


def points_type(kind: Column, draw: Column) -> Column:
    return F.when((kind == "M1000") & (draw == 128), "M1000_128").when(kind == "M1000", "M1000_96").otherwise(kind)


def year_of(day: Column) -> Column:
    return F.year(day.try_cast("date"))


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def slug(name: Column, year: Column) -> Column:
    last = F.element_at(F.split(name, " - "), -1)
    short = F.substring(F.regexp_replace(F.lower(last), "[^a-z0-9]", ""), 1, 18)
    return F.concat(F.coalesce(F.nullif(short, F.lit("")), F.lit("event")), F.lpad((year % 100).cast("string"), 2, "0"))


@F.pandas_udf(StringType())
def _folded(name: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    fold = lambda text: "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return name.map(fold, na_action="ignore")


def folded(name: Column) -> Column:
    """The name without accents and other marks, of any script, composed or not. Names in ASCII go round the batches to Python as nulls."""
    return F.coalesce(_folded(F.when(name.rlike(r"[^\x00-\x7F]"), name)), name)


def name_key(name: Column, hyphens: bool = False) -> Column:
    """Lower case without accents, single spaces; hyphens and apostrophes count as spaces for linking. Letters that are no letter with a mark stay, such as the Danish o."""
    return F.trim(F.regexp_replace(F.lower(folded(name)), r"[\s\-']+" if hyphens else r"\s+", " "))


def word_set(key: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.split(key, " "))), " ")


def form_pct(form: Column, n: int = 10) -> Column:
    last = F.right(form, F.lit(n))
    return js_round(100 * F.length(F.regexp_replace(last, "[^W]", "")) / F.nullif(F.length(last), F.lit(0)))


def form_recent(form: Column, n: int = 10) -> Column:
    return F.transform(F.filter(F.split(F.right(form, F.lit(n)), ""), lambda c: c != ""), lambda c: (c == "W").cast("int"))


def sets_of(score: Column) -> Column:
    """Sets (a, b, tb) with at least six games on a side; tb is null without a tiebreak."""
    part = lambda k: F.regexp_extract_all(F.coalesce(score, F.lit("")), F.lit(r"(\d+)-(\d+)(?:\((\d+)\))?"), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("tb"))
    sets = F.transform(zipped, lambda s: F.struct(s["a"].cast("int").alias("a"), s["b"].cast("int").alias("b"), F.nullif(s["tb"], F.lit("")).alias("tb")))
    return F.filter(sets, lambda s: F.greatest(s["a"], s["b"]) >= 6)


def tiebreaks_won(sets: Column, we_won: Column) -> Column:
    return F.size(F.filter(sets, lambda s: s["tb"].isNotNull() & ((we_won & (s["a"] > s["b"])) | (~we_won & (s["a"] < s["b"])))))


def tiebreaks_played(sets: Column) -> Column:
    return F.size(F.filter(sets, lambda s: s["tb"].isNotNull()))


def went_the_distance(sets: Column, best_of: Column) -> Column:
    return F.size(sets) >= F.coalesce(F.nullif(best_of, F.lit(0)), F.when(F.size(sets) >= 4, 5).otherwise(3))
