"""Event classification: ordered rules as data, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The boat classes that a rule looks for.
BOAT = r"1x|2x|2-|2\+|4x|4-|4\+|8\+"
# Rule, what the text must have beside a boat, the age bracket it gives.
RULES = (
    ("masters_exact_letter", (r"\bmasters?\b", r"\(\s*([a-k])\s*\)"), None),
    ("masters_open_ended", (r"\bmasters?\b", r"\(\s*[a-k]\s*\+\s*\)"), "masters_unspecified"),
    ("masters_letter_range", (r"\bmasters?\b", r"\(\s*[a-k]\s*[-–]\s*[a-m]\s*\+?\s*\)"), "masters_unspecified"),
    ("masters_unspecified", (r"\bmasters?\b",), "masters_unspecified"),
    ("u13", (r"\b(?:u[ -]?13|under[ -]?13|j13|junior\s+13)\b",), "u13"),
    ("u15", (r"\b(?:u[ -]?15|under[ -]?15|j15|junior\s+15)\b",), "u15"),
    ("u16", (r"\b(?:u[ -]?16|under[ -]?16|j16|junior\s+16)\b",), "u16"),
    ("u17", (r"\b(?:u[ -]?17|under[ -]?17|j17|junior\s+17)\b",), "u17"),
    ("u19", (r"\b(?:u[ -]?19|under[ -]?19|j19|junior\s+19)\b",), "u19_youth"),
    ("junior_youth", (r"\b(?:juniors?|jr\.?)\b",), "u19_youth"),
    ("youth", (r"\b(?:y|youth)\b",), "u19_youth"),
    ("collegiate_literal", (r"\bcollegiate\b",), "collegiate"),
    ("collegiate_modifiers", (r"\b(?:ltwt|lightweight|varsity|jv|2v)\b",), "collegiate"),
    ("open", (r"\bopen\b",), "open"),
)
# Words for a gender.
GENDERS = {"men": ("m", "man", "men", "mens", "b", "boy", "boys"), "women": ("w", "woman", "women", "womens", "g", "girl", "girls"), "mixed": ("mixed",)}
# Fixed patterns: full words, and letters that stand right before an age or a boat.
FULL = r"(?i)\b(men(?:['’]?s)?|man|women(?:['’]?s)?|woman|boys?|girls?|mixed)\b"
COMPACT = r"(?i)([mwbg])\s*(?=(?:u[ -]?1[35679]|j(?:unior)?[ -]?1[5679]|junior\s+1[5679]|y\b|youth|1x|2x|2[-+]|4x|4[-+]|8\+))"


def gender_alias(c: Column) -> Column:
    word = F.regexp_replace(F.lower(c), "['’]", "")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for gender, words in GENDERS.items():
        out = out.when(word.isin(*words), gender)
    return out


def structural_gender(gender_raw: Column, *fields: Column) -> Column:
    """The provider's own field, else the one gender its words agree on, else the one its letters do."""
    text = F.concat_ws("\n", *fields)

    def agreed(pattern: str) -> Column:
        return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), gender_alias)))

    words, letters = agreed(FULL), agreed(COMPACT)
    return F.coalesce(gender_alias(gender_raw), F.when(F.size(words) == 1, words[0]).when((F.size(words) == 0) & (F.size(letters) == 1), letters[0]))


def classify(events: DataFrame, event_code: Column, name: Column, boat_raw: Column, age_raw: Column, gender_raw: Column) -> DataFrame:
    """Adds mapping_key, boat_class, age_bracket and gender; all null where no rule or no gender fits.

    A boat token that occurs more than once counts with its last occurrence.
    """
    fields = (event_code, name, boat_raw, age_raw, gender_raw)
    text = F.concat_ws("\n", *(F.coalesce(f, F.lit("")) for f in fields))
    df = events.withColumn("_text", text).withColumn("_gender", structural_gender(gender_raw, event_code, name, boat_raw, age_raw))
    df = df.withColumn("_boat", F.lower(F.regexp_extract("_text", rf"(?is).*({BOAT})", 1)))
    ready = F.col("_gender").isNotNull() & (F.col("_boat") != "")
    key = bracket = F.when(~ready, F.lit(None).cast("string"))
    for name_, patterns, age in RULES:
        hit = F.lit(True)
        for p in patterns:
            hit = hit & F.col("_text").rlike("(?is)" + p)
        key = key.when(hit, name_)
        letter = F.lower(F.regexp_extract("_text", "(?is).*" + patterns[-1], 1)) if age is None else None
        bracket = bracket.when(hit, F.concat(F.lit("masters_"), letter) if age is None else F.lit(age))
    df = df.withColumn("mapping_key", key).withColumn("age_bracket", bracket)
    mapped = F.col("mapping_key").isNotNull()
    return df.withColumn("boat_class", F.when(mapped, F.col("_boat"))).withColumn("gender", F.when(mapped, F.col("_gender"))).drop("_text", "_gender", "_boat")


def unmapped(events: DataFrame, pattern: list[str], name: str, mapped: str) -> DataFrame:
    """Unmapped events by pattern: how many, up to five names, and the coverage of all."""
    total = events.agg(F.round(100.0 * F.count_if(mapped) / F.count("*"), 2).alias("coverage"))
    names = F.array_join(F.slice(F.array_sort(F.collect_set(name)), 1, 5), "|")
    return events.filter(~F.col(mapped)).groupBy(*pattern).agg(F.count("*").alias("n"), names.alias("examples")).join(F.broadcast(total))
