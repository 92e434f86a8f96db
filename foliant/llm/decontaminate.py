"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

White space and words without letters or digits are dropped.  Two forms of the
remaining words are compared, word for word:

    template  numbers, units after numbers and names (capitalised words inside a
              sentence) are typed placeholders, the rest loses case and punctuation
    verbatim  every word, without case and punctuation

Windows of `window` words of either form are hashed and hash-joined with those
of the benchmark; a template window needs `literal` plain words, a verbatim one
none.  An item shorter than a window is one window of its own length.  Matches
of a document and an item at the same shift form one aligned passage.  Its slots
are checked: a value of the item stands for one value of the document, the one
that it stands for most often; places that say otherwise do not count, and what
counts has to cover enough of the item.  So verbatim copies, edited copies and
re-parameterised questions match, and accidental templates don't.

Cases: null texts have no words.  Items with fewer than `shortest` words are
phrases of any text and never found.  Rows that share an id (or have none) are
judged each by their own text and reported under that id; repeated rows and
repeated items count once.  Of passages of equal length the one with the
smallest shift is reported.  Empty tables give an empty result.  Other columns
are ignored, whatever they are called.  A text of any length is one row, and so
are its windows' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import join_ids, materialise

NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
UNITS = (
    "mm|cm|m|km|inch|inches|ft|feet|yards?|miles?|mg|g|kg|grams?|kilograms?|lbs?|pounds?|oz|ounces?|tons?|ml|l|liters?|litres?|gallons?|s|sec|"
    "seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|percent|dollars?|cents?|euros?|usd|eur|gbp|mph|kmh|volts?|watts?|kw|hz|degrees?"
)


def clean(text: Column) -> Column:
    """Words with a letter or digit, one space apart."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01-\x08\x0E-\x1F]", "")
    text = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    return F.trim(F.regexp_replace(text, r"(^| )[^\p{L}\p{N} ]+(?= |$)", ""))


def canonical(cleaned: Column) -> Column:
    """The cleaned text with placeholders, word for word."""
    out = F.regexp_replace(cleaned, r"(?<=[\p{L}\p{N},;] )\p{Lu}[\p{L}\p{M}'’-]*", NAME)
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}])\p{Nd}+(?:[.,:/-]\p{Nd}+)*+", NUMBER)
    out = F.regexp_replace(out, rf"(?i){NUMBER}( ?)(?:{UNITS})(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1{UNIT}")
    return F.regexp_replace(F.lower(out), rf"[^\p{{L}}\p{{N}}{NUMBER}{NAME}{UNIT} ]+", "")


def forms(text: Column) -> Column:
    """struct of equally long lists: `words` without case and punctuation, and their template form `canon`."""

    def split(c: Column) -> Column:
        folded = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} ]+", "")
        return F.struct(F.split(folded, " ").alias("words"), F.split(canonical(c), " ").alias("canon"))

    # As a lambda's argument the cleaned text is made once, however often it is named.
    return F.transform(F.array(clean(text)), split)[0]


def hashed(f: Column) -> Column:
    """The forms with a hash for each word, so that a window hashes numbers."""
    return F.struct(*(F.transform(f[x], lambda w: F.xxhash64(w)).alias(x) for x in ("words", "canon")))


def window_hash(hashes: Column, at: Column, n: int) -> Column:
    """Hash of the n words from place `at` (0-based) on, without a copy of them."""
    return F.xxhash64(*(F.get(hashes, at + j) for j in range(n)))


def windows(df: DataFrame, key: str, text: str, lengths: list[int]) -> DataFrame:
    """(key, pos, h) of every window of both forms; windows without placeholders are the same in both."""

    def hashes(f: Column, n: int) -> Column:
        at = lambda i: F.struct(i.alias("pos"), window_hash(f["canon"], i, n).alias("a"), window_hash(f["words"], i, n).alias("b"))
        none = F.array().cast("array<struct<pos:int,a:bigint,b:bigint>>")
        return F.when(F.size(f["words"]) >= n, F.transform(F.sequence(F.lit(0), F.size(f["words"]) - n), at)).otherwise(none)

    # Lambdas over the forms, and no filter on them: either would have them made twice.
    found = F.transform(F.transform(F.array(forms(F.col(text))), hashed), lambda f: F.concat(*(hashes(f, n) for n in lengths)))[0]
    both = F.when(F.col("w.a") == F.col("w.b"), F.array("w.a")).otherwise(F.array("w.a", "w.b"))
    return df.select(key, F.explode(found).alias("w")).select(key, F.col("w.pos").alias("pos"), F.explode(both).alias("h"))


def _is_slot(token: Column) -> Column:
    return token.rlike(f"[{NUMBER}{NAME}{UNIT}]")


def item_windows(items: DataFrame, window: int, literal: int) -> DataFrame:
    """(item_id, item_hash, ipos, len, h) of the windows that items are looked up by."""
    told = items.select("item_id", F.hash("item_text").alias("item_hash"), forms(F.col("item_text")).alias("f")).withColumn("len", F.least(F.size("f.words"), F.lit(window)))
    told = told.withColumn("h", hashed(F.col("f")))
    of = lambda form, i: F.coalesce(*(F.when(F.col("len") == n, window_hash(F.col("h")[form], i, n)) for n in range(1, window + 1)))
    plain = lambda i: F.size(F.filter(F.slice("f.canon", i + 1, F.col("len")), lambda t: ~_is_slot(t)))
    at = F.transform(F.sequence(F.lit(0), F.size("f.words") - F.col("len")), lambda i: F.struct(of("words", i).alias("w"), F.when(plain(i) >= F.least(F.lit(literal), F.ceil(F.col("len") / 2)), of("canon", i)).alias("c")))
    told = told.select("item_id", "item_hash", "len", F.posexplode(at).alias("ipos", "g"))
    return told.select("item_id", "item_hash", "ipos", "len", F.explode(F.array_compact(F.array_distinct(F.array("g.w", "g.c")))).alias("h")).distinct()


def consistent(slots: Column) -> Column:
    """The slots (iw, dw) whose item value stands for its most frequent document value; itself and then the smallest at a tie."""
    counted = F.transform(slots, lambda s: F.struct(s["iw"].alias("iw"), F.struct(F.size(F.filter(slots, lambda t: (t["iw"] == s["iw"]) & (t["dw"] == s["dw"]))).alias("n"), (s["iw"] == s["dw"]).alias("same"), s["dw"].alias("dw")).alias("r")))
    return F.transform(F.array(counted), lambda all_: F.filter(all_, lambda s: ~F.exists(all_, lambda t: (t["iw"] == s["iw"]) & (t["r"] > s["r"]))))[0]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 8,
    literal: int = 4,
    min_words: int = 12,
    shortest: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    most: int = 500_000,
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_slots, verbatim) of every aligned passage.

    A passage counts when it covers min_words words of the item, or half of a
    shorter one and a window.  start_word counts the document's words with a letter or digit.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text")).distinct()
    items = materialise(items.where(F.size(F.split(clean(F.col("item_text")), " ")) >= shortest), "items")
    grams = materialise(item_windows(items, window, literal), "grams")
    lengths = [r["len"] for r in grams.select("len").distinct().orderBy("len").collect()]  # at most `window`
    # The benchmark is broadcast only up to `most` windows and 64 characters for each; beyond that both sides are shuffled by hash.
    size = grams.count(), items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    small = size[0] <= most and size[1] <= 64 * most
    ours = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text"))
    hits = windows(ours, "doc_id", "doc_text", lengths or [window]).join(F.broadcast(grams) if small else grams, "h")
    shifts = hits.groupBy("doc_id", "item_id", "item_hash", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.min("ipos").alias("lo"), F.max(F.col("ipos") + F.col("len")).alias("hi"))
    shifts = materialise(shifts, "shifts")

    # Only documents with a match are read again, for the values of their slots.
    found = materialise(shifts.select("doc_id").distinct(), "found")
    few = found.count() <= most
    again = ours.join(F.broadcast(found) if few else found, ours["doc_id"].eqNullSafe(found["doc_id"]), "left_semi")
    again = materialise(again.select(F.col("doc_id").alias("d"), forms(F.col("doc_text")).alias("df")).distinct(), "again")
    asked = items.select(F.col("item_id").alias("i"), F.hash("item_text").alias("ih"), forms(F.col("item_text")).alias("if"))
    both = shifts.join(again, shifts["doc_id"].eqNullSafe(F.col("d"))).join(F.broadcast(asked) if small else asked, shifts["item_id"].eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("ih")))
    span = F.sequence(F.col("lo") + 1, F.col("hi"))
    theirs = lambda k: k - 1 + F.col("shift")
    pair = F.transform(span, lambda k: F.struct(F.get("if.words", k - 1).alias("iw"), F.get("df.words", theirs(k)).alias("dw"), F.get("if.canon", k - 1).alias("ic"), F.get("df.canon", theirs(k)).alias("dc")))
    both = both.withColumn("pairs", F.filter(pair, lambda p: (p["iw"] == p["dw"]) | (p["ic"] == p["dc"])))
    both = both.withColumn("slots", consistent(F.filter("pairs", lambda p: _is_slot(p["ic"]))))
    counted = F.size(F.filter("pairs", lambda p: ~_is_slot(p["ic"]))) + F.size("slots")
    total = F.size("if.words")
    enough = F.least(F.lit(min_words), F.greatest(F.least(F.lit(window), total), F.ceil(total / 2)))
    passages = both.withColumn("counted", counted).where(F.col("counted") >= enough)
    best = F.struct(F.col("counted").alias("n"), (-F.col("shift")).alias("m"), F.col("lo"), F.size(F.array_distinct("slots")).alias("s"), F.forall("pairs", lambda p: p["iw"] == p["dw"]).alias("v"))
    out = passages.groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
    return out.select("doc_id", "item_id", (F.col("b.lo") - F.col("b.m")).cast("long").alias("start_word"), F.col("b.n").cast("long").alias("n_words"), F.col("b.s").cast("long").alias("n_slots"), F.col("b.v").alias("verbatim"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold a passage of the benchmark."""
    bad = materialise(contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(id_col)).distinct(), "bad")
    return join_ids(docs, bad, id_col, "left_anti")
