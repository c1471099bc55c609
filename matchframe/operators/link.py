"""Linking competitors across registries by names and countries, through blocked equi-joins.

The stages run in order and the first that decides a row ends it, rejections included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import name_key, word_set
from ..schema import COUNTRY_ALIASES


def country_match(a: Column, b: Column) -> Column:
    """Equal codes, or b among the codes that a also stands for; an empty code matches nothing."""
    a, b = F.upper(F.coalesce(a, F.lit(""))), F.upper(F.coalesce(b, F.lit("")))
    alias = F.lit(False)
    for code, others in COUNTRY_ALIASES.items():
        alias = alias | ((a == code) & b.isin(*others))
    return (a != "") & (b != "") & ((a == b) | alias)


def compatible(code: Column) -> Column:
    """The codes that country_match(code, …) takes: its own and those it also stands for; none for an empty code."""
    up = F.upper(F.coalesce(code, F.lit("")))
    also = F.array().cast("array<string>")
    for name, others in COUNTRY_ALIASES.items():
        also = F.when(up == name, F.array(*map(F.lit, others))).otherwise(also)
    return F.when(up == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(up), also)))


def link(left: DataFrame, right: DataFrame) -> DataFrame:
    """bid, pid (null where rejected), kind. left: bid, name, ab, country; right: pid, ordinal, name, country."""
    key = name_key(F.col("name"), hyphens=True)
    first, last = lambda k: F.element_at(F.split(k, " "), 1), lambda k: F.element_at(F.split(k, " "), -1)
    label = F.element_at(F.split(name_key(F.coalesce("ab", F.lit("")), hyphens=True), r"\."), -1)
    bios = left.select("bid", key.alias("bkey"), F.col("country").alias("bcountry"), label.alias("blabel"))
    bios = bios.withColumn("bfirst", first(F.col("bkey"))).withColumn("blast", last(F.col("bkey"))).withColumn("bset", word_set(F.col("bkey")))
    regs = right.select("pid", "ordinal", key.alias("rkey"), F.col("country").alias("rcountry"), F.upper(F.coalesce("country", F.lit(""))).alias("rcode"))
    regs = regs.withColumn("rfirst", first(F.col("rkey"))).withColumn("rlast", last(F.col("rkey"))).withColumn("rset", word_set(F.col("rkey")))
    # namesakes of a country count as one: what the rules ask of them is how many there are and which is first, so no pair of namesakes is built
    own = bios.withColumn("code", F.explode_outer(compatible(F.col("bcountry"))))

    def earliest(asking: DataFrame, mine: str, theirs: str, kind: str, place: int) -> DataFrame:
        first_there = regs.where("rcode <> ''").groupBy(theirs, "rcode").agg(F.min(F.struct("ordinal", "pid")).alias("p"))
        met = asking.join(first_there, (F.col(mine) == F.col(theirs)) & (F.col("code") == F.col("rcode")))
        return met.groupBy("bid").agg(F.min("p")["pid"].alias("pid")).select("bid", "pid", F.lit(kind).alias("kind"), F.lit(place).alias("place"))

    exact = earliest(own, "bkey", "rkey", "exact_full", 1)
    order = earliest(own.where(F.size(F.split("bset", " ")) >= 2), "bset", "rset", "word_order", 2)

    # a surname is asked for, and the label's where that is another one
    surnames = F.array_distinct(F.when(F.col("blabel") != "", F.array("blast", "blabel")).otherwise(F.array("blast")))
    asked = bios.select("bid", "bfirst", "bcountry", F.explode(surnames).alias("last"))
    named_so = regs.groupBy("rlast").agg(F.count_distinct("pid").alias("n"), F.min(F.struct("pid", "rfirst", "rcountry")).alias("one"))
    counts = asked.join(named_so, F.col("last") == F.col("rlast")).groupBy("bid", "bfirst", "bcountry").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    there = regs.where("rcode <> ''").groupBy("rlast", "rcode").agg(F.count_distinct("pid").alias("k"), F.min("pid").alias("first_pid"))
    codes = asked.withColumn("code", F.explode(compatible(F.col("bcountry")))).join(there, (F.col("last") == F.col("rlast")) & (F.col("code") == F.col("rcode")))
    counts = counts.join(codes.groupBy("bid").agg(F.sum("k").alias("n_same"), F.min("first_pid").alias("same_pid")), "bid", "left")
    prefix = (F.length("bfirst") >= 2) & (F.length("one.rfirst") >= 2) & (F.substring("bfirst", 1, 2) == F.substring("one.rfirst", 1, 2))
    single, named, tied = F.col("n") == 1, (F.col("bfirst") == F.col("one.rfirst")) | prefix, country_match(F.col("bcountry"), F.col("one.rcountry"))
    alike = F.coalesce(F.col("n_same"), F.lit(0)) == 1
    kind = (
        F.when(single & named & tied, "exact_last+country").when(single & named, "last+first").when(single & tied, "rejected_diff_first").when(single, "rejected_diff_first+country")
        .when(alike, "exact_last+country").otherwise("ambiguous")
    )
    chosen = F.when(single & named, F.col("one.pid")).when(~single & alike, F.col("same_pid"))
    surname = counts.select("bid", chosen.alias("pid"), kind.alias("kind"), F.lit(3).alias("place"))

    # a name is in another only if its rarest word is: one join on that word of the different names there are, then the whole sets are compared
    words = lambda k: F.array_distinct(F.split(k, " "))
    names = regs.groupBy("rset").agg(F.count_distinct("pid").alias("k"), F.min("pid").alias("any_pid"))
    spread = names.select("rset", words("rset").alias("rwords"), "k", "any_pid").withColumn("word", F.explode("rwords"))
    held = spread.groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    asked = bios.select("bid", "bcountry", words("bset").alias("bwords")).withColumn("word", F.explode("bwords")).join(held, "word", "left")
    rarest = asked.groupBy("bid", "bcountry", "bwords").agg(F.min_by("word", F.struct(F.coalesce("held", F.lit(0)), "word")).alias("word"))
    met = rarest.join(spread, "word").where(F.size(F.array_except("bwords", "rwords")) == 0).select("bid", "bcountry", "rset", "k", "any_pid")
    by_code = regs.where("rcode <> ''").groupBy("rset", "rcode").agg(F.count_distinct("pid").alias("same_k"), F.min("pid").alias("code_pid"))
    codes = met.select("bid", "rset", F.explode(compatible(F.col("bcountry"))).alias("rcode")).join(by_code, ["rset", "rcode"])
    whole = met.groupBy("bid").agg(F.sum("k").alias("n"), F.min("any_pid").alias("only"))
    found = whole.join(codes.groupBy("bid").agg(F.sum("same_k").alias("n_same"), F.min("code_pid").alias("same_pid")), "bid", "left").fillna(0, ["n_same"])
    one, alone, many = F.col("n_same") == 1, (F.col("n") == 1) & (F.col("n_same") == 0), F.col("n_same") > 1
    subset = found.where(one | alone | many).select("bid", F.when(one, F.col("same_pid")).when(alone, F.col("only")).alias("pid"), F.when(one, "subset_match+country").when(alone, "subset_match_country_diff").otherwise("ambiguous_subset").alias("kind"), F.lit(4).alias("place"))

    decided = exact.unionByName(order).unionByName(surname).unionByName(subset).groupBy("bid").agg(F.min_by(F.struct("pid", "kind"), "place").alias("d"))
    return left.select("bid").join(decided, "bid", "left").select("bid", "d.pid", F.coalesce("d.kind", F.lit("unmatched")).alias("kind"))


def link_summary(links: DataFrame) -> DataFrame:
    return links.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("pid").alias("linked"))


def apply_links(players: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """players (bid, …) with id_col filled where it is null; set ids stay."""
    found = links.where("pid is not null").select("bid", F.col("pid").alias("_pid"))
    return players.join(found, "bid", "left").withColumn(id_col, F.coalesce(id_col, "_pid")).drop("_pid")


def name_index(players: DataFrame) -> DataFrame:
    """key, mid: full name, short label, last name and 'F. Last' of each player; on a clash the later row (ordinal) owns the key."""
    key = name_key(F.col("name"))
    last = F.element_at(F.split(key, " "), -1)
    initial = F.concat(F.substring(key, 1, 1), F.lit(". "), last)
    rows = players.select("mid", "ordinal", F.explode(F.array_distinct(F.array_compact(F.array(key, name_key(F.col("ab")), last, initial)))).alias("key")).where("key <> ''")
    return rows.groupBy("key").agg(F.max_by("mid", "ordinal").alias("mid"))


def resolve_by_name(rows: DataFrame, players: DataFrame) -> DataFrame:
    """rows (player_id, player_name, …) with mid: the id if it is known, else the owner of the full name, else of its last word."""
    index = name_index(players)
    full, part = index.select(F.col("key").alias("k1"), F.col("mid").alias("m1")), index.select(F.col("key").alias("k2"), F.col("mid").alias("m2"))
    keyed = rows.withColumn("_key", name_key(F.col("player_name"))).withColumn("_last", F.element_at(F.split("_key", " "), -1))
    known = players.select(F.col("mid").alias("m0")).distinct()
    joined = keyed.join(known, F.col("player_id") == F.col("m0"), "left").join(full, F.col("_key") == F.col("k1"), "left").join(part, F.col("_last") == F.col("k2"), "left")
    return joined.select(*rows.columns, F.coalesce("m0", "m1", "m2").alias("mid"))
