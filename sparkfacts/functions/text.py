"""String keys, predicates and parsers as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Tokens that take an entry out of a field, and prefixes that do.
EXCLUDED_TOKENS = ("DNS", "DIDNOTSTART", "DNF", "DIDNOTFINISH", "DSQ", "DQ", "DISQUALIFIED", "WITHDRAWN", "WITHDRAW", "WD", "SCRATCH", "SCRATCHED", "EXCLUDED")
EXCLUDED_PREFIXES = ("DNS", "DIDNOTSTART", "DNF", "DIDNOTFINISH", "DSQ", "DISQUAL", "WITHDRAW", "WITHDREW", "SCRATCH", "SCRATCHED", "EXCLUS")
# Statuses of a finished entry.
FINISHED_TOKENS = ("complete", "completed", "finish", "finished", "official", "ok", "valid")
# Crew roles in order of precedence.
ROLES = ("cox", "coach", "stroke", "bow")
# Words for "no time".
NO_TIME = ("-", "--", "DNS", "DNF", "DSQ", "SCRATCH", "N/A", "OFFICIAL", "OK")
# Fixed pattern: names worth a look when an unknown organisation turns up.
DISCOVERY = r"(?i)(?<![A-Z0-9])(?:ROWING|CREW|BOAT[ -]?CLUB|SCULL|REGATTA|OARS)"


def alias_normalize(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\p{Punct}", ""))


def search_normalize(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def club_key(c: Column, spaces: bool = False) -> Column:
    """Letters and digits only; with ``spaces`` runs of others become one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")) if spaces else search_normalize(c)


def token_sort(c: Column) -> Column:
    """Distinct words in order, as one string."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))), " ")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def ein(c: Column, pad: bool = False) -> Column:
    """Nine digits, or null; with ``pad`` fewer digits are filled with zeros and more are kept."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    if pad:
        return F.when(F.length(digits) == 0, None).when(F.length(digits) < 9, F.lpad(digits, 9, "0")).otherwise(digits)
    return F.when(F.length(digits) == 9, digits)


# What a provider's name ends in beside the club's own: a crew's letter or number, a legal form.
CREW_ENDING = r"\s+(?:[A-Za-z]|[0-9]+[A-Za-z]?)$"
LEGAL_ENDING = r"(?i),?\s+(?:L\.?L\.?C\.?|LLC|INC\.?|INCORPORATED)$"


def match_name(c: Column) -> Column:
    """A provider's name without crew letter and legal form."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), CREW_ENDING, ""), LEGAL_ENDING, ""))


@pandas_udf(T.StringType())
def person_key(names: pd.Series) -> pd.Series:
    """Compatible, case-folded, distinct name words in order (no built-in does NFKC)."""

    def key(name):
        folded = unicodedata.normalize("NFKC", name or "").casefold()
        return " ".join(sorted(set(re.sub(r"[^\w\s]", "", folded).split())))

    return names.map(key, na_action=None)


#: Text on which Spark's own functions fold names as ``person_key`` does.
PLAIN = r"^[\t\n\x0B\f\r\x20-\x7E]*$"


def split_words(c: Column) -> Column:
    """Words of a text, compatible and case-folded, some repeated or empty; plain ASCII never leaves the JVM."""
    plain = c.rlike(PLAIN)
    folded = F.regexp_replace(F.lower(c), r"[^a-z0-9_\s]", "")
    other = person_key(F.when(~plain, c))
    return F.split(F.when(plain, folded).otherwise(other), r"\s+")


def name_words(c: Column) -> Column:
    """Distinct words of a name, compatible, case-folded and sorted."""
    return F.array_sort(F.array_distinct(F.filter(split_words(c), lambda w: w != "")))


def is_discovery_name(c: Column) -> Column:
    return F.coalesce(c.rlike(DISCOVERY), F.lit(False))


def excluded_status(c: Column) -> Column:
    token = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", "")
    return token.isin(*EXCLUDED_TOKENS) | token.rlike("^(?:" + "|".join(EXCLUDED_PREFIXES) + ")")


def finished_status(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "").isin(*FINISHED_TOKENS)


def crew_role(c: Column) -> Column:
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+", "")
    out = F
    for role in ROLES:
        out = out.when(F.contains(text, F.lit(role)), role)
    return out.otherwise("rower")


def json_flag(c: Column, path: str) -> Column:
    """True where a JSON value is true or the word true."""
    return F.coalesce(F.lower(F.trim(F.get_json_object(c, path))) == "true", F.lit(False))


# How age groups of ten to thirteen are written, whatever the letter case.
UNDER13 = (
    r"(?<![A-Za-z0-9])(?:[WMBG])?U[\s-]?(?:10|11|12|13)[A-Za-z]?(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])UNDER[\s-]*(?:10|11|12|13)(?!\d)",
    r"(?<!\d)(?:10|11|12|13)[\s-]*U(?![A-Za-z0-9])",
)


def is_under13(*fields: Column) -> Column:
    """True where a field names an age group of UNDER13."""
    hits = [F.coalesce(f.rlike("(?i)" + p), F.lit(False)) for f in fields for p in UNDER13]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def provider_of_host(host: Column) -> Column:
    """Source type of a results host, or null."""
    h = F.regexp_replace(F.lower(host), r"^www\.", "")
    return (
        F.when((h == "regatta.time-team.nl") | h.endswith(".time-team.com"), "time_team")
        .when(h.isin("legacy.herenow.com", "herenow.com", "bigresults.herenow.com"), "herenow")
        .when(h == "crewtimer.com", "crewtimer")
        .when(h == "results.regattatiming.com", "regattatiming")
    )


def provider_key(url: Column, provider: Column) -> Column:
    """A provider's own key of an event page, or null."""
    path, part = F.parse_url(url, F.lit("PATH")), F.parse_url(url, F.lit("REF"))
    found = (
        F.when(provider == "herenow", F.regexp_extract(part, r"(?:^|/)races/(\d+)(?:/|$)", 1))
        .when(provider == "time_team", F.regexp_extract(path, r"^/([^/]+/(?:19|20)\d{2})(?:/|$)", 1))
        .when(provider == "crewtimer", F.lower(F.regexp_extract(path, r"(?i)/regatta/(r\d+)(?:/|$)", 1)))
        .when(provider == "regattatiming", F.coalesce(F.parse_url(url, F.lit("QUERY"), F.lit("raceId")), F.parse_url(url, F.lit("QUERY"), F.lit("raceid"))))
    )
    return F.when(found != "", found)


def _clock(text: Column) -> Column:
    """Milliseconds of S, M:S or H:M:S (any number of parts), null where a part isn't a number."""
    parts = F.reverse(F.split(text, ":"))
    return F.aggregate(F.transform(parts, lambda x, i: x.try_cast("double") * F.pow(F.lit(60.0), i)), F.lit(0.0), lambda a, x: a + x, lambda a: F.bround(a * 1000, 0).cast("long"))


def result_time(c: Column) -> Column:
    """Signed milliseconds of a result, null for status words and bad shapes."""
    text = F.trim(c)
    body = F.regexp_replace(text, r"^[+-]", "")
    ok = body.rlike(r"^(?:\d+:){0,2}\d+(?:\.\d+)?$") & ~F.upper(text).isin(*NO_TIME)
    return F.when(ok, F.when(text.startswith("-"), -1).otherwise(1) * _clock(body))


def split_time(c: Column) -> Column:
    """As ``result_time`` with any number of parts; not above zero is null."""
    text = F.trim(c)
    body = F.regexp_replace(text, r"^[+-]+", "")
    ms = F.when(body.rlike(r"^(?:\d+:)*\d*\.?\d+$"), _clock(body))
    return F.when(ms > 0, F.when(text.startswith("-"), -ms).otherwise(ms))


# Fixed value: a time of minutes, seconds and thousandths.
STRICT_TIME = r"^(?:(\d+):)?(\d{1,2})(?:\.(\d{1,3}))?$"


def strict_time(c: Column) -> Column:
    """struct(ms, bad): [M:]SS[.fff] to milliseconds, or bad where the text is something else."""
    text = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "−", "-")
    minutes, seconds, part = (F.regexp_extract(text, STRICT_TIME, i) for i in (1, 2, 3))
    shaped = text.rlike(STRICT_TIME) & ~((minutes != "") & (seconds.try_cast("int") >= 60))
    ms = (F.coalesce(minutes.try_cast("long"), F.lit(0)) * 60 + seconds.try_cast("long")) * 1000 + F.rpad(F.concat(part, F.lit("000")), 3, "0").try_cast("long")
    return F.struct(F.when(shaped, ms).alias("ms"), (~shaped).alias("bad"))


def us_date(c: Column) -> Column:
    return F.try_to_date(c, "MM-dd-yyyy")


def period_label(begin: Column, end: Column) -> Column:
    """FY2024 (Jul 2024-Jun 2025); a missing begin is a year before the end."""
    start = F.coalesce(begin, F.date_add(F.add_months(end, -12), 1))
    return F.concat(F.lit("FY"), F.year(start), F.lit(" ("), F.date_format(start, "MMM yyyy"), F.lit("–"), F.date_format(end, "MMM yyyy"), F.lit(")"))


def race_time(ms: Column) -> Column:
    """m:ss.hh"""
    h = F.round(ms / 10).cast("long")
    return F.format_string("%d:%02d.%02d", F.floor(h / 6000), F.floor(h / 100) % 60, h % 100)


def ordinal(n: Column) -> Column:
    tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def compact_usd(v: Column) -> Column:
    a = F.abs(v)
    sign = F.when(v < 0, "-").otherwise("")
    return F.concat(sign, F.when(a >= 1e6, F.format_string("$%.1fM", a / 1e6)).when(a >= 1e3, F.format_string("$%.0fK", a / 1e3)).otherwise(F.format_string("$%.0f", a)))


def fnv1a(c: Column) -> Column:
    """FNV-1a of a text's code points, 32 bits."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(4294967295))


def id_ranges(c: Column) -> Column:
    """'1-3,7' as sorted distinct numbers; an empty array where the text is something else."""
    part = F.filter(F.split(F.regexp_replace(c, r"\s", ""), ","), lambda x: x.rlike(r"^\d+(-\d+)?$"))
    ranges = F.transform(part, lambda x: F.sequence(F.split(x, "-")[0].cast("int"), F.element_at(F.split(x, "-"), -1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(ranges)))
