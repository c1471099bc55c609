"""Information-theoretic sanitisation, by DataFrame functions only.

Protected entities are personal data found by fixed patterns (email, ip, card, phone), as values and, as most values
stand in one text only, as their owners (mail domain, network, card issuer, phone area). A term near an entity
(within `reach` characters) discloses it by their pointwise mutual information over the corpus,
log2(D n(t,c) / (n(t) n(c))), against the entity's own information log2(D / n(c)); all counts are of rows, over the
whole corpus. A term whose share reaches `threshold` is a span of kind `term` wherever it stands in those texts, if it
either meets the entity in at least `least_texts` different texts (so that mere copies prove nothing) or is a name: it
stands beside the entity with a capital that no sentence or line start explains, and at most a tenth of the corpus's
rows with it write it small. For names one text is enough; other rare words of one text prove nothing. Sanitised texts
have entities generalised to their kind and disclosing terms removed.

Null text counts as empty. Repeated rows are found each; rows with a null id are told apart by their texts.
Overlapping spans are all listed, and are removed as one stretch. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Patterns in the order of kinds. Possessive forms and look-arounds say the same as the plain ones, in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TERM = r"\p{L}[\p{L}\p{M}]{2,}"
#: A capital with small letters after it, and what comes before a word that opens a sentence, a line or a quotation.
TITLED, OPENING = r"^\p{Lu}.*\p{Ll}", r"(?:[.!?:;\u2026][\p{P}\s]*|[\r\n]\s*|[\"\u201C\u201E\u00AB]\s*)$"
_IP = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
_SPAN = "array<struct<start:int,end:int,value:string>>"
_PLACES = "array<struct<start:int,end:int>>"
_TAGGED = "array<struct<start:int,end:int,tag:string>>"
BROADCAST_ROWS = 100_000
BLOCK = 256


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: what stands inside a lambda is otherwise worked out again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(array: Column) -> Column:
    """The array cut into arrays of BLOCK elements, so that lists built element by element stay short."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")), lambda k: F.slice(array, k * BLOCK + 1, F.lit(BLOCK)))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points: the gaps between them tell where they are.

    Places are counted within blocks first and moved by the lengths of the blocks before, so work stays linear in the matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), hits.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out")))

    walk = lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), step)
    moved = lambda block, by: F.transform(block["out"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["value"].alias("value")))

    def joined(walked: Column) -> Column:
        before = F.aggregate(
            walked,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, w: F.struct((acc["at"] + w["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        return F.flatten(F.zip_with(walked, before, moved))

    return _once(pairs, lambda p: _once(F.transform(_blocks(p), walk), joined))


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[ -]", ""))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise((F.substring(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(digits, i, F.lit(1)).cast("int") / 5).cast("int")),
    )
    return total % 10 == 0


def entities(text: Column) -> dict[str, Column]:
    """kind -> array of its valid matches (start, end, value)."""
    none = F.array().cast(_SPAN)
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    guards = {"email": F.instr(text, "@") > 0, "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), "phone": F.instr(text, "+") > 0}
    valid = {"email": lambda x: F.lit(True), "ip": lambda x: x["value"].rlike(_IP), "card": lambda x: _luhn(x["value"]), "phone": lambda x: digits(x["value"]).between(8, 15)}
    return {k: F.when(guards[k], F.filter(located(text, p), valid[k])).otherwise(none) for k, p in PATTERNS.items()}


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), text and an array of spans for each kind."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("th", F.xxhash64("text"))
    for kind, spans in entities(F.col("text")).items():
        base = base.withColumn(kind, spans)
    return base


def _owner(kind: str, value: Column) -> Column:
    """What a value belongs to, so that values seen once are counted with their like: the mail's domain, the network, the issuer, the area."""
    if kind == "email":
        return F.lower(F.substring_index(value, "@", -1))
    if kind == "ip":
        return F.substring_index(value, ".", 3)
    return F.substring(F.regexp_replace(value, "[^0-9]", ""), 1, 6 if kind == "card" else 4)


def candidates(hits: DataFrame, reach: int = 60) -> DataFrame:
    """row, doc_id, th, entity, term, name: each term near each entity (a value or its owner), and whether it is written as a name there. Only texts with an entity give rows.

    A text is cut into characters once and the windows beside all its entities are taken from these; only windows leave the row.
    """

    def tagged(kind: str) -> Column:
        names = lambda v: F.array(F.concat(F.lit(f"{kind}:"), v), F.concat(F.lit(f"{kind} of "), _owner(kind, v)))
        return F.transform(F.col(kind), lambda s: F.struct(names(s["value"]).alias("names"), s["start"].alias("s"), s["end"].alias("e")))

    def windows(chars: Column) -> Column:
        part = lambda start, n: F.array_join(F.slice(chars, start + 1, n), "")

        def beside(x: Column) -> Column:
            low = F.greatest(F.lit(0), x["s"] - reach)
            left = F.struct(part(low, x["s"] - low).alias("part"), (low > 0).alias("cut_left"), F.lit(False).alias("cut_right"), (low == 0).alias("first"))
            right = F.struct(part(x["e"], F.lit(reach)).alias("part"), F.lit(False).alias("cut_left"), (F.size(chars) > x["e"] + reach).alias("cut_right"), F.lit(False).alias("first"))
            return F.struct(x["names"].alias("names"), F.array(left, right).alias("sides"))

        return F.transform(every, beside)

    every = F.concat(*[tagged(k) for k in KINDS])
    # the outer form, as a filter inferred from the plain one would work everything out twice
    cut = F.when(F.size(every) > 0, _once(F.split("text", ""), windows))
    each = hits.select(F.monotonically_increasing_id().alias("row"), "doc_id", "th", F.explode_outer(cut).alias("x")).where("x is not null")
    each = each.select("row", "doc_id", "th", "x.names", F.explode_outer("x.sides").alias("w")).select("row", "doc_id", "th", "names", "w.*")
    terms = each.select("row", "doc_id", "th", "names", "cut_left", "cut_right", "first", "part", F.length("part").alias("n"), F.explode_outer(located(F.col("part"), TERM)).alias("t")).where("t is not null")
    whole = ~((F.col("cut_left") & (F.col("t.start") == 0)) | (F.col("cut_right") & (F.col("t.end") == F.col("n"))))
    before = F.substring("part", F.lit(1), F.col("t.start"))
    opens = before.rlike(OPENING) | (F.col("first") & before.rlike(r"^[\p{P}\s]*$"))
    written = F.col("t.value").rlike(TITLED) & ~opens
    met = terms.where(whole).select("row", "doc_id", "th", F.lower("t.value").alias("term"), written.alias("name"), F.explode_outer("names").alias("entity"))
    return met.groupBy("row", "doc_id", "th", "entity", "term").agg(F.max("name").alias("name"))


def disclosures(docs: DataFrame, near: DataFrame, threshold: float = 0.8, least_texts: int = 2, text_col: str = "text") -> DataFrame:
    """term, entity, share: the terms that disclose an entity. All counts are of rows of docs, and cover every row."""
    joint = near.groupBy("term", "entity").agg(F.count_distinct("th").alias("texts"), F.count(F.lit(1)).alias("both"), F.max("name").alias("name"))
    joint = materialise(joint.where((F.col("texts") >= least_texts) | F.col("name")), "joint")
    owners = near.select("entity", "row").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    written, small = (F.split(t, r"[^\p{L}\p{M}]+") for t in (text, F.lower(text)))
    tagged = lambda words, is_small: F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(is_small).alias("small")))
    # each word of a row once: those it writes small at least once, then those it never does
    words = docs.select(F.explode_outer(F.concat(tagged(F.array_intersect(small, written), 1), tagged(F.array_except(small, written), 0))).alias("w")).select("w.*")
    # an inner join, as Spark would move a semi-join below the count, where it gives a row per occurrence
    counted = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"), F.sum("small").alias("n_small"))
    total = docs.count()
    out = joint.join(counted, "term").join(owners, "entity")
    joined = F.log2(total * F.col("both") / (F.greatest("n_term", "both") * F.col("n_entity")))
    own = F.log2(total / F.col("n_entity"))
    share = F.when(own > 0, joined / own).otherwise(F.lit(0.0))
    proved = (F.col("texts") >= least_texts) | (10 * F.col("n_small") <= F.col("n_term"))
    return out.where(proved).select("term", "entity", share.alias("share")).where(F.col("share") >= threshold)


def term_spans(docs: DataFrame, hits: DataFrame, threshold: float, least_texts: int, reach: int, text_col: str = "text") -> DataFrame:
    """did, dth, terms: for each document, every place of its disclosing terms in the whole text as (start, end)."""
    near = materialise(candidates(hits, reach), "near-terms")
    told = near.join(disclosures(docs, near, threshold, least_texts, text_col), ["term", "entity"], "left_semi")
    told = materialise(told.groupBy("doc_id", "th").agg(F.collect_set("term").alias("told")).withColumnsRenamed({"doc_id": "did", "th": "dth"}), "told-terms")
    if told.count() <= BROADCAST_ROWS:  # of checked size
        told = F.broadcast(told)
    held = hits.select("doc_id", "th", "text").join(told, F.col("doc_id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("dth"))).dropDuplicates(["did", "dth"])
    places = F.filter(located(F.col("text"), TERM), lambda t: F.array_contains("told", F.lower(t["value"])))
    return held.select("did", "dth", F.transform(places, lambda t: F.struct(t["start"], t["end"])).alias("terms"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, least_texts: int = 2, reach: int = 60) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    hits = found(docs, id_col, text_col)
    told = materialise(term_spans(docs, hits, threshold, least_texts, reach, text_col), "term-spans")
    written = lambda kind, spans: F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    base = F.concat(*[written(k, F.col(k)) for k in KINDS])
    rows = hits.select("doc_id", "th", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"))
    # extra spans: one row per document that has some, no text on either side
    rows = rows.join(told, F.col("doc_id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("dth")), "left")
    terms = F.coalesce(F.col("terms"), F.array().cast(_PLACES))
    return rows.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("base", written("term", terms)), ",").alias("spans"), F.size(terms).cast("long").alias("n_term"),
    )


def merged(spans: Column) -> Column:
    """Sorted spans (start, end, tag) with overlapping ones as one stretch under the first one's tag; in blocks, so that work stays linear."""
    none = F.array().cast(_TAGGED)

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["tag"].alias("tag"))
        return F.when(s["start"] < last["end"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    def meet(done: Column, block: Column) -> Column:
        # a long stretch of earlier blocks may cover the first ones of this block
        reach = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1))
        first = F.aggregate(F.filter(block, lambda s: s["start"] < reach), F.try_element_at(done, F.lit(-1)), lambda last, s: F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["tag"].alias("tag")))
        covered = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(first))
        rest = F.filter(block, lambda s: s["start"] >= reach)
        return F.when(F.size(done) == 0, block).when(F.size(rest) == F.size(block), F.concat(done, block)).otherwise(F.concat(covered, rest))

    return F.aggregate(F.transform(_blocks(spans), lambda b: F.aggregate(b, none, add)), none, meet)


def rewritten(text: Column, spans: Column) -> Column:
    """text with each stretch replaced by its tag. The text is cut into characters once, as a substring by place walks from the start each time."""

    def write(chars: Column, stretches: Column) -> Column:
        before = lambda i: F.coalesce(F.get(stretches, i - 1)["end"], F.lit(0))
        text_from = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
        pieces = F.transform(stretches, lambda s, i: F.concat(text_from(before(i), s["start"]), s["tag"]))
        return F.concat(F.array_join(pieces, ""), text_from(before(F.size(stretches)), F.size(chars)))

    return _once(merged(spans), lambda m: _once(F.split(text, ""), lambda chars: write(chars, m)))


def sanitise(docs: DataFrame, threshold: float = 0.8, least_texts: int = 2, reach: int = 60) -> DataFrame:
    """docs with text rewritten where something was found: [EMAIL], [IP], [CARD], [PHONE] for entities, [TERM] for disclosing terms. Other columns may have any name."""
    told = materialise(term_spans(docs, found(docs), threshold, least_texts, reach), "term-spans")
    if told.count() <= BROADCAST_ROWS:  # of checked size
        told = F.broadcast(told)
    text = docs["text"]
    row = docs["doc_id"].cast("long").eqNullSafe(told["did"]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == told["dth"])
    tagged = lambda kind, spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag")))
    named = [tagged(k, spans) for k, spans in entities(F.coalesce(text, F.lit(""))).items()]
    named.append(tagged("term", F.coalesce(told["terms"], F.array().cast(_PLACES))))
    clean = _once(F.array_sort(F.concat(*named)), lambda spans: F.when(F.size(spans) > 0, rewritten(text, spans)).otherwise(text))
    return docs.join(told, row, "left").select(*[clean.alias(c) if c == "text" else docs[c] for c in docs.columns])
