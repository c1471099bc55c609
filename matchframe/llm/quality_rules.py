"""Rule bitmask ledger, by DataFrame functions only.

Every rule is evaluated once for each document: the ledger holds its measurements and one bit for each failed
rule. A policy is a versioned mask of the rules that reject; applying it is a bitwise AND, so policies change
without another pass over the texts. Ablations (what each rule alone rejects, what would come back without it)
are counts over the ledger's bits, summed before any shuffle.

Null text counts as empty: no words, so the length rule fails. Repeated rows stay rows. An empty table gives an
empty ledger. Texts of any length are measured whole, within their own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: Fixed values of the rules, in the order of their bits.
RULES = ("few_words", "repeated_words", "long_mean_word", "symbol_ratio", "duplicate_lines", "no_letters")
#: Policy version -> names of the rules that reject.
POLICIES = {1: ("few_words", "repeated_words"), 2: RULES}


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more: equal windows meet in a sorted array, then runs of starts are measured."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(n >= 4, windows).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), words_of(text).alias("w"))
    base = base.withColumn("s", F.sort_array(_repeated_words(F.col("w"))))
    s = F.col("s")
    same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
    starts = F.transform(F.filter(F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda x: x.isNotNull()), lambda x: x)
    base = base.withColumn("d", F.sort_array(starts))
    d = F.col("d")
    covered = F.aggregate(
        d,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).cast("long").alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.when(F.instr("t", "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.col("t").rlike(r"\p{L}").alias("has_letter"),
        F.when(F.instr("t", "\n") > 0, F.size(lines)).otherwise(F.least(F.size("w"), F.lit(1))).cast("long").alias("n_lines"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and failures, a mask with one bit per failed rule."""
    n = F.col("n_words")
    failed = {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "long_mean_word": F.col("word_chars") > 25 * n,
        "symbol_ratio": 5 * F.col("n_symbols") > n,
        "duplicate_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "no_letters": ~F.col("has_letter"),
    }
    bits = sum((F.when(failed[r], F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)), F.lit(0))
    return measured(docs, id_col, text_col).withColumn("failures", bits.cast("long"))


def apply_policy(entries: DataFrame, version: int) -> DataFrame:
    """entries with kept and policy_version."""
    mask = mask_of(POLICIES[version])
    return entries.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask)) == 0).withColumn("policy_version", F.lit(version))


def ablations(entries: DataFrame, version: int) -> DataFrame:
    """A row for each rule of the policy: documents it fails, documents only it fails; and overlaps as OR and AND of the masks it meets."""
    mask = mask_of(POLICIES[version])
    seen = F.col("failures").bitwiseAND(F.lit(mask))
    combos = entries.select(seen.alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).alias("bit")) for r in POLICIES[version]]))
    each = combos.select("f", "n", rules.alias("r")).where(F.col("f").bitwiseAND(F.col("r.bit")) != 0)
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("failed"),
        F.sum(F.when(F.col("f") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.bit_or("f").alias("meets_any"),
        F.bit_and("f").alias("meets_all"),
    )
