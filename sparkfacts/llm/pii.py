"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Only DataFrame and SQL functions are used. Positions come from the lengths of the
pieces between matches (``split``) and of the matches (``regexp_extract_all``), summed
block by block so that a text with very many matches stays near linear.

Defined cases: a null text counts as empty; an empty text has no spans and the hash of
the empty string; documents that repeat are judged row by row; other columns of the
input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK = 256
CONTEXT_CHARS = 40

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """One kind of span.

    ``need`` is a cheap test that a text can hold a match at all; ``check`` is SQL over
    ``x.m`` (the match); ``base`` is the score before context; ``words`` are context
    words that add CONTEXT_BONUS when they stand within CONTEXT_CHARS before or after.
    ``fixed`` kinds keep every confirmed span, others need MIN_SCORE.
    """

    name: str
    pattern: str
    need: str
    check: str
    base: float
    words: str
    fixed: bool


CONTEXT_BONUS = 0.3
MIN_SCORE = 0.7

# Possessive forms match what the greedy ones match, without recursion on long runs.
# (?:(?<![class])|\G) keeps one start for each run; \G lets a match begin where the last ended.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true", 0.8, "mail|contact|write|e-mail", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "text rlike '[0-9][.][0-9]'", f"x.m rlike '^0*{_OCTET}(?:[.]0*{_OCTET}){{3}}$'", 0.6, "ip|host|server|address|addr", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "text rlike '[0-9]'", "length(translate(x.m, ' -', '')) between 13 and 19 and luhn_check(translate(x.m, ' -', ''))", 0.9, "card|visa|credit|debit|pay", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", "length(translate(x.m, ' ().+-', '')) between 9 and 15", 0.6, "phone|tel|call|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "text rlike '[A-Z]{2}[0-9]{2}'",
         "length(translate(x.m, ' ', '')) between 15 and 34 and aggregate(split(concat(substring(translate(x.m, ' ', ''), 5), substring(x.m, 1, 4)), ''), 0L,"
         " (s, c) -> if(c = '', s, (s * if(c between 'A' and 'Z', 100, 10) + instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1) % 97)) = 1", 0.9, "iban|bank|account", False),
    # a run of letters and digits is a secret only where a word near it says so
    Kind("secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,200}+={0,2}(?![A-Za-z0-9_+/=-])", "text rlike '(?i)token|key|secret|passw|auth|bearer|credential'",
         "x.m rlike '[0-9]' and x.m rlike '[A-Za-z]' and size(array_distinct(split(lower(x.m), ''))) >= 8", 0.5, "(?:[a-z]+[_-])*(?:token|key|secret|password|passwd|auth|authorization|bearer|credentials?)", False),
    # known prefixes; gh?_ ends in the CRC-32 of what stands before, base 62
    Kind("api_key", r"(?<![A-Za-z0-9_])(?:A(?:KIA|SIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,99}|xox[abprs]-[A-Za-z0-9-]{20,99})(?![A-Za-z0-9_])", "text rlike 'A[KS]IA|gh[pousr]_|sk_live_|xox'",
         "not x.m rlike '^gh' or crc32(cast(substring(x.m, 5, 30) as binary)) = aggregate(split(substring(x.m, 35, 6), ''), 0L,"
         " (s, c) -> if(c = '', s, s * 62 + instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', c) - 1))", 0.9, "key|token|secret|aws|github|stripe|slack", False),
    # digits weighted 3, 7, 1 add to a multiple of 10
    Kind("routing", r"(?<![0-9.,-])[0-9]{9}(?![0-9-])", "text rlike '[0-9]{9}'",
         "aggregate(sequence(1, 9), 0, (s, i) -> s + cast(substring(x.m, i, 1) as int) * element_at(array(1, 3, 7), i % 3 + 1)) % 10 = 0 and x.m <> '000000000'", 0.5, "routing|aba|transit", False),
    # a letter for the number modulo 23
    Kind("dni", r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Z](?![A-Za-z0-9])", "text rlike '[0-9]{8}-?[A-Z]'", "right(x.m, 1) = substring('TRWAGMYFPDXBNJZSQVHLCKE', cast(substring(x.m, 1, 8) as int) % 23 + 1, 1)", 0.7, "dni|nif|documento|identidad", False),
    # sex, year, month, place and order; the key is 97 less the number modulo 97
    Kind("nir", r"(?<![0-9])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])", "text rlike '[0-9] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3}'",
         "cast(right(x.m, 2) as int) = 97 - cast(substring(translate(x.m, ' ', ''), 1, 13) as bigint) % 97", 0.7, "nir|insee", False),
    # ISO 7064, modulo 11 and 10
    Kind("tax_id", r"(?<![0-9])[1-9][0-9]{10}(?![0-9])", "text rlike '[0-9]{11}'",
         "aggregate(sequence(1, 10), 10, (p, i) -> (if((cast(substring(x.m, i, 1) as int) + p) % 10 = 0, 10, (cast(substring(x.m, i, 1) as int) + p) % 10) * 2) % 11, p -> (11 - p) % 10) = cast(right(x.m, 1) as int)",
         0.5, "steuer|steuer-id|steueridentifikationsnummer|idnr|tin|tax", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "text rlike '[0-9]-[0-9]'", "not x.m rlike '^(?:000|666|9)|-00-|-0000$'", 0.5, "ssn|social|security", False),
)
BASE = ("email", "ip", "card", "phone")

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _find(df: DataFrame, kind: Kind) -> DataFrame:
    """Adds ``s_<kind>``: the kind's confirmed spans in order.

    Arrays that go along with another one are zipped with it, never indexed inside a
    lambda: there the optimizer could put their whole expression in for each element.
    """
    k, p = kind.name, _literal(kind.pattern)
    near = f"substring(text, greatest(cast(s.p + x.g - {CONTEXT_CHARS} as int), 0) + 1, cast(least(s.p + x.g, {CONTEXT_CHARS}) + x.n + {CONTEXT_CHARS} as int))"
    score = f"if({near} rlike '(?i)(?<![a-z])(?:{kind.words})(?![a-z])', least(1D, {kind.base}D + {CONTEXT_BONUS}D), {kind.base}D)"
    fits = kind.check if kind.fixed else f"({kind.check}) and {score} >= {MIN_SCORE}D"
    new = f"array(named_struct('kind', '{k}', 'start', s.p + x.g, 'end', s.p + x.g + x.n, 'score', {score}))"
    df = df.withColumn("_m", F.expr(f"if({kind.need}, regexp_extract_all(text, {p}, 0), cast(array() as array<string>))"))
    df = df.withColumn("_g", F.expr(f"if(size(_m) > 0, transform(split(text, {p}, -1), t -> length(t)), cast(array() as array<int>))"))
    df = df.withColumn("_i", F.expr("zip_with(_m, slice(_g, 1, size(_m)), (m, g) -> named_struct('g', cast(g as bigint), 'm', m, 'n', cast(length(m) as bigint)))"))
    df = df.withColumn("_b", F.expr(f"if(size(_i) = 0, cast(array() as array<array<struct<g:bigint,m:string,n:bigint>>>), transform(sequence(0, (size(_i) - 1) div {BLOCK}), b -> slice(_i, cast(b as int) * {BLOCK} + 1, {BLOCK})))"))
    df = df.withColumn("_o", F.expr("aggregate(_b, array(0L), (a, b) -> concat(a, array(element_at(a, -1) + aggregate(b, 0L, (t, x) -> t + x.g + x.n))))"))
    found = (
        f"flatten(zip_with(_b, slice(_o, 1, size(_b)), (b, o) -> aggregate(b, named_struct('p', o, 'o', cast(array() as {_SPAN})),"
        f" (s, x) -> named_struct('p', s.p + x.g + x.n, 'o', if({fits}, concat(s.o, cast({new} as {_SPAN})), s.o)), s -> s.o)))"
    )
    return df.withColumn(f"s_{k}", F.expr(found)).drop("_m", "_g", "_i", "_b", "_o")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text, and spans by kind.

    ``spans`` is an array of (kind, start, end, score) over all kinds in KINDS order,
    then by start; positions are code points, end exclusive. ``s_<kind>`` has one kind.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        df = _find(df, kind)
    return df.withColumn("spans", F.concat(*(F.col(f"s_{k.name}") for k in KINDS)))


def redact(docs: DataFrame) -> DataFrame:
    """Texts with every span replaced by its kind in brackets; overlapping spans merge under the first kind."""
    found = find_pii(docs).withColumn("spans", F.expr("array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"))
    merged = (
        "aggregate(spans, named_struct('p', 0L, 'o', ''), (a, s) -> if(s.start < a.p, a, named_struct('p', s.end, 'o',"
        " concat(a.o, substring(text, cast(a.p as int) + 1, cast(s.start - a.p as int)), '[', s.kind, ']'))), a -> concat(a.o, substring(text, cast(a.p as int) + 1)))"
    )
    return found.select("doc_id", F.expr(merged).alias("text"))


def _joined(column: str) -> str:
    return f"array_join(transform({column}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.expr(_joined(f"concat({', '.join(f's_{k}' for k in BASE)})")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_joined("spans")).alias("spans"),
    )
