"""Benchmark decontamination by template canonicalisation, by DataFrame functions only.

Numbers, names (capitalised words) and units after numbers become typed placeholders; windows of five template
tokens are hashed and joined with those of the benchmark. A document that covers at least 0.8 of an item's
different windows is a candidate. For candidates the values behind the placeholders are compared: along each
alignment an item's value must stand for one value of the document throughout (0.8 of the slots at least), so
that the same question with other numbers or names is caught, and chance matches of templates are not.

Beside the templates each item is looked for token by token in lower case, so that copies in capitals and items
without template windows (short ones, arithmetic) are found: as a whole up to five tokens, beyond that by windows
of five. An item of a single token is found only where it is the whole text, as it would stand in any.

The same pass also looks for lower-case templates, where only numbers and their units are placeholders and a sign
before a number is a token: `compute <num> times <num>` as a whole below five tokens, beyond that by windows of five.
They catch the same question with other numbers in any case, short or full of numbers. Windows with fewer than two
literal tokens count only for items that have no other. An item needs a word and two literal tokens in all: numbers
and signs alone (`12 + 45 = 57`) are found only as they are, as any sum would match them. In lower case a name cannot
be told from a word, so another name there is found only where enough windows are free of it.

The benchmark's windows are broadcast only up to a number of rows; beyond that the join is shuffled. Windows
of cased templates with fewer than two literal tokens are left out, as the lower-case ones stand for them. Null texts count as empty. Repeated rows and ids give one
result per id and item. Documents and items without an id cannot be named and give no result, so they stay. Empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WIDTH, SHARE = 5, 0.8
#: Rows of one or two numbers, and rows with a window's tokens, that may be broadcast.
BROADCAST_ROWS, BROADCAST_WINDOWS = 1_000_000, 50_000
#: Placeholders, and words read as units after a number.
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees meter meters metre metres kilometer kilometers watt watts volt volts"
).split()
TOKEN = r"\p{L}[\p{L}\p{M}]*|[0-9]+(?:[.,][0-9]+)*"
#: Signs that are tokens where a number follows.
SIGNS = ("-", "+", "*", "/", "=", "^", "×", "÷")
SIGN = r"[-+*/=^×÷](?=\s*[0-9])"
#: Capitalised words in a row are one name, so that a name of two words may stand for one of one word.
NAMES = r"\p{Lu}[\p{L}\p{M}]*(?: \p{Lu}[\p{L}\p{M}]*)+"


def tokens_of(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def canonical(tokens: Column) -> Column:
    """Placeholders for numbers, names and units; lower case for the rest. Same size as tokens."""
    digit = lambda t: F.substring(t, 1, 1).between("0", "9")
    return F.transform(
        tokens,
        lambda t, i: F.when(digit(t), NUMBER).when(t == F.lower(t), F.when((F.length(t) < 12) & t.isin(UNITS) & F.coalesce(digit(F.get(tokens, i - 1)), F.lit(False)), UNIT).otherwise(t)).when((F.instr(t, " ") > 0) | (F.length(t) > 1) & (F.initcap(t) == t), NAME).otherwise(F.lower(t)),
    )


def _hash(template: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(template, i + k) for k in range(WIDTH)])


def _starts(template: Column) -> Column:
    return F.when(F.size(template) >= WIDTH, F.sequence(F.lit(0), F.size(template) - WIDTH)).otherwise(F.array().cast("array<int>"))


def templated(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    out = rows.select(F.col(key).cast("long").alias(key), tokens_of(F.col(text_col), f"{NAMES}|{TOKEN}").alias("raw"))
    return out.withColumn("template", canonical(F.col("raw")))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, at, h, values, template: each window of each item with two literal tokens or more."""
    rows = materialise(templated(benchmark, "item_id", "text"), "benchmark-templates")
    each = rows.select("item_id", F.explode_outer(F.transform(_starts(F.col("template")), lambda i: F.struct(i.alias("at"), _hash(F.col("template"), i).alias("h"), F.slice("raw", i + 1, F.lit(WIDTH)).alias("values"), F.slice("template", i + 1, F.lit(WIDTH)).alias("types")))).alias("w"))
    literal = F.size(F.filter("w.types", lambda t: ~t.isin(NUMBER, NAME, UNIT))) >= 2
    return each.where("w is not null").where(literal).select("item_id", "w.*")


def _run(tokens: Column, i: Column, w: int) -> Column:
    return F.xxhash64(F.lit(w), *[F.get(tokens, i + k) for k in range(w)])


def _runs(tokens: Column, widths: list[int]) -> Column:
    """Hashes of the runs of `widths` tokens; a run of one must be the whole text."""

    def runs(w: int) -> Column:
        able = F.size(tokens) >= w if w > 1 else F.size(tokens) == 1
        return F.when(able, F.transform(F.sequence(F.lit(0), F.size(tokens) - w), lambda i: _run(tokens, i, w))).otherwise(F.array().cast("array<bigint>"))

    return F.concat(F.array().cast("array<bigint>"), *[runs(w) for w in widths])


def _windows(w: int, at: str, values: str) -> Column:
    """The windows of w tokens of raw and template: place, hash, values and types; null where there are fewer."""

    def window(i: Column) -> Column:
        return F.struct(i.alias(at), _run(F.col("template"), i, w).alias("h"), F.slice("raw", i + 1, F.lit(w)).alias(values), F.slice("template", i + 1, F.lit(w)).alias("types"))

    return F.when(F.size("template") >= w, F.transform(F.sequence(F.lit(0), F.size("template") - w), window))


def folded(rows: DataFrame, key: str) -> DataFrame:
    """key, raw, low, template: lower-case tokens with the signs before numbers and without, and their placeholders."""
    out = rows.select(F.col(key).cast("long").alias(key), tokens_of(F.lower("text"), f"{SIGN}|{TOKEN}").alias("raw"))
    return out.select(key, "raw", F.filter("raw", lambda t: ~t.isin(*SIGNS)).alias("low"), canonical(F.col("raw")).alias("template"))


def _literals(template: Column) -> Column:
    return F.size(F.filter(template, lambda t: ~t.isin(NUMBER, NAME, UNIT)))


def folded_windows(items: DataFrame) -> DataFrame:
    """item_id, at, h, values, types: windows of lower-case templates with numbers, the whole template below WIDTH tokens."""
    able = F.array_contains("template", NUMBER) & (_literals(F.col("template")) >= 2) & F.exists("raw", lambda t: t.rlike(r"^\p{L}"))

    cut = F.coalesce(*[_windows(w, "at", "values") for w in range(WIDTH, 1, -1)])  # below WIDTH tokens one window, of all
    cut = items.where(able).select("item_id", cut.alias("all")).withColumn("good", F.filter("all", lambda w: _literals(w.types) >= 2))
    return cut.select("item_id", F.explode_outer(F.when(F.size("good") > 0, F.col("good")).otherwise(F.col("all"))).alias("w")).where("w is not null").select("item_id", "w.*")


def token_matches(texts: DataFrame, benchmark: DataFrame, found: DataFrame) -> DataFrame:
    """Items not in found that lower-case texts hold token by token, or with other numbers; columns of template_matches."""
    items = materialise(folded(benchmark, "item_id").where(F.size("low") > 0).distinct(), "literal-items")
    bench = materialise(folded_windows(items).distinct(), "folded-windows")
    width = F.least(F.size("low"), F.lit(WIDTH))
    widths = sorted(r.w for r in items.select(width.alias("w")).distinct().collect()) or [WIDTH]  # WIDTH values at most
    shapes = sorted(r.w for r in bench.select(F.size("types").alias("w")).distinct().collect())
    each = F.coalesce(*[F.when(width == w, _runs(F.col("low"), [w])) for w in widths])
    plain = items.select("item_id", F.lit(False).alias("shaped"), F.explode_outer(each).alias("h"))
    held = materialise(plain.unionByName(bench.select("item_id", F.lit(True).alias("shaped"), "h")).distinct(), "literal-windows")
    sizes = held.groupBy("item_id", "shaped").agg(F.count(F.lit(1)).alias("item_windows"))
    hashes = held.select("h").distinct()
    if held.count() <= BROADCAST_ROWS:  # of checked size
        hashes, held = F.broadcast(hashes), F.broadcast(held)
    # a text without numbers is its own template, so only runs of other widths are new there
    shaped = F.when(F.array_contains("template", NUMBER), _runs(F.col("template"), shapes)).otherwise(_runs(F.col("low"), [w for w in shapes if w not in widths]))
    hs = F.concat(_runs(F.col("low"), widths), shaped) if shapes else _runs(F.col("low"), widths)
    met = folded(texts, "doc_id").select("doc_id", hs.alias("hs")).select("doc_id", F.explode_outer("hs").alias("h")).join(hashes, "h", "left_semi").distinct()
    cover = met.join(held, "h").groupBy("doc_id", "item_id", "shaped").agg(F.count(F.lit(1)).alias("windows")).join(sizes, ["item_id", "shaped"])
    cover = materialise(cover.where(F.col("windows") >= SHARE * F.col("item_windows")).join(found.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti"), "covered")
    plain = cover.where(~F.col("shaped")).select("doc_id", "item_id", "windows", "item_windows", F.lit(0).cast("long").alias("slots"), F.lit(1.0).alias("agreement"), (F.col("windows") == F.col("item_windows")).alias("verbatim"))
    likely = cover.where("shaped").join(plain.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti").select("doc_id", "item_id", "windows", "item_windows")
    none = F.array().cast("array<struct<d_at:int,h:bigint,d_values:array<string>,types:array<string>>>")
    cut = F.concat(none, *[F.coalesce(_windows(w, "d_at", "d_values"), none) for w in shapes])
    cut = F.transform(cut, lambda w: F.struct(w.d_at.alias("d_at"), w.h.alias("h"), w.d_values.alias("d_values")))
    return plain.unionByName(agreeing(texts, likely, bench, lambda rows: folded(rows, "doc_id"), cut)) if shapes else plain


def template_matches(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, windows, item_windows, slots, agreement, verbatim: items whose template windows are covered by slots that agree."""
    bench = materialise(benchmark_windows(benchmark).distinct(), "benchmark-windows")
    sizes = bench.groupBy("item_id").agg(F.count_distinct("h").alias("item_windows"))
    held = materialise(bench.select("h", "item_id").distinct(), "benchmark-hashes")
    hashes, n_windows = held.select("h").distinct(), bench.count()
    if n_windows <= BROADCAST_ROWS:  # of checked size: two numbers a row
        hashes, held = F.broadcast(hashes), F.broadcast(held)
    template = F.col("template")
    rows = templated(texts, "doc_id", "text").select("doc_id", F.transform(_starts(template), lambda i: _hash(template, i)).alias("hs"))
    # the outer form, as a filter inferred from the plain one would go below the templates and work them out for each window
    met = rows.select("doc_id", F.explode_outer("hs").alias("h")).join(hashes, "h", "left_semi").distinct()
    cover = met.join(held, "h").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("windows")).join(sizes, "item_id")
    likely = materialise(cover.where(F.col("windows") >= SHARE * F.col("item_windows")), "candidates")
    cut = F.transform(_starts(template), lambda i: F.struct(i.alias("d_at"), _hash(template, i).alias("h"), F.slice("raw", i + 1, F.lit(WIDTH)).alias("d_values")))
    return agreeing(texts, likely, bench, lambda rows: templated(rows, "doc_id", "text"), cut)


def agreeing(texts: DataFrame, likely: DataFrame, bench: DataFrame, templates: Callable[[DataFrame], DataFrame], cut: Column) -> DataFrame:
    """likely with slots, agreement and verbatim, where slots agree: a second look, at the candidates' texts only."""
    ids = likely.select("doc_id").distinct()
    if ids.count() <= BROADCAST_ROWS:  # of checked size
        ids = F.broadcast(ids)
    rows = materialise(templates(texts.join(ids, "doc_id", "left_semi")).select("doc_id", "raw", "template"), "candidate-templates").select("doc_id", cut.alias("ws"))
    windows = F.broadcast(bench) if bench.count() <= BROADCAST_WINDOWS else bench  # of checked size: some 500 bytes a row
    pairs = rows.select("doc_id", F.explode_outer("ws").alias("w")).select("doc_id", "w.*").join(windows, "h").join(likely.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")
    slot = F.explode(F.arrays_zip("types", "values", "d_values"))
    slots = pairs.select("doc_id", "item_id", (F.col("d_at") - F.col("at")).alias("shift"), slot.alias("s")).where(F.col("s.types").isin(NUMBER, NAME, UNIT))
    seen = slots.groupBy("doc_id", "item_id", "shift", F.col("s.values").alias("mine"), F.col("s.d_values").alias("theirs")).agg(F.count(F.lit(1)).alias("n"))
    kept = seen.groupBy("doc_id", "item_id", "shift", "mine").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.when(F.col("mine") == F.col("theirs"), F.col("n")).otherwise(0)).alias("equal"))
    agreed = kept.groupBy("doc_id", "item_id").agg(F.sum("n").alias("slots"), (F.sum("most") / F.sum("n")).alias("agreement"), (F.sum("equal") == F.sum("n")).alias("verbatim"))
    out = likely.join(agreed, ["doc_id", "item_id"], "left").where(F.coalesce(F.col("agreement"), F.lit(1.0)) >= SHARE)
    return out.select("doc_id", "item_id", "windows", "item_windows", F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("agreement", F.lit(1.0)).alias("agreement"), F.coalesce("verbatim", F.lit(True)).alias("verbatim"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, windows, item_windows, coverage, slots, agreement, verbatim: the matches that hold, by templates or, where those do not, by the tokens themselves."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col("text"))
    found = materialise(template_matches(texts, items), "template-matches")
    rows = found.unionByName(token_matches(texts, items, found))
    return rows.select("doc_id", "item_id", "windows", "item_windows", (F.col("windows") / F.col("item_windows")).alias("coverage"), "slots", "agreement", "verbatim")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; same columns."""
    bad = materialise(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    if bad.count() <= BROADCAST_ROWS:  # of checked size
        bad = F.broadcast(bad)
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
