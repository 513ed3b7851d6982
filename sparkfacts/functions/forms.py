"""Forms of names, dates, labels and links, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nested import CONTACTS
from .text import provider_of_host, search_normalize

# Forms that are read, and what they are called.
FORM_NAMES = {"IRS990": "990", "IRS990EZ": "990EZ"}
# A result's known status numbers.
KNOWN_STATUSES = tuple(range(13))


def canonical_form(c: Column) -> Column:
    """The form's short name; null for one that isn't read."""
    out = F
    for element, name in FORM_NAMES.items():
        out = out.when(c == element, name)
    return out.otherwise(None)


def tax_year(begin: Column, end: Column) -> Column:
    return F.year(F.coalesce(begin, end))


def period_key(end: Column) -> Column:
    """YYYYMM of a date written as YYYY-MM-DD."""
    return F.concat(F.substring(end, 1, 4), F.substring(end, 6, 2))


def weekly_hours(c: Column) -> Column:
    """Hours as a number from 0 to below 1000; null where the text is something else."""
    number = F.when(F.trim(c).rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), F.trim(c).try_cast("decimal(20,6)"))
    return F.when((number >= 0) & (number < 1000), number)


def split_entry(c: Column) -> Column:
    """struct(club, stroke): 'Club (Surname, I)' in two, else the whole as club."""
    pattern = r"^(.*?)\s*\(([^(),]+,\s*[^()]+)\)\s*$"
    stroke = F.regexp_extract(c, pattern, 2)
    return F.struct(F.when(stroke != "", F.trim(F.regexp_extract(c, pattern, 1))).otherwise(c).alias("club"), F.when(stroke != "", F.trim(stroke)).alias("stroke"))


def is_club_like(candidate: Column, club: Column) -> Column:
    """True where a name is the club's, or that with at most two more characters."""
    a, b = search_normalize(candidate), search_normalize(club)
    return F.coalesce((a != "") & (b != "") & a.startswith(b) & (F.length(a) - F.length(b) <= 2), F.lit(False))


def person_of_display(display: Column, single: Column, club: Column) -> Column:
    """A person's name from 'person (club)' of singles or 'club (stroke)' of crews; null where it is club-like."""
    pattern = r"^\s*(.*?)\s*\((.*?)\)\s*$"
    name = F.trim(F.when(single, F.regexp_extract(display, pattern, 1)).otherwise(F.regexp_extract(display, pattern, 2)))
    return F.when((name != "") & ~is_club_like(name, club), name)


def date_range(c: Column) -> Column:
    """struct(first, last) of 'May 30 - Jun 1, 2025' or 'May 30, 2025', months long or short; the year is the last day's."""
    pattern = r"^\s*([A-Za-z]{3,9})\s+(\d{1,2})\s*(?:-\s*([A-Za-z]{3,9})\s+(\d{1,2})\s*)?,\s*(\d{4})\s*$"
    m1, d1, m2, d2, year = (F.regexp_extract(c, pattern, i) for i in range(1, 6))

    def day(month: Column, of: Column, y: Column) -> Column:
        return F.try_to_date(F.concat_ws(" ", F.initcap(F.substring(month, 1, 3)), of, y), "MMM d yyyy")

    last = F.when(m2 != "", day(m2, d2, year)).otherwise(day(m1, d1, year))
    same = day(m1, d1, year)
    # a range that would start after its end starts in the year before
    first = F.when(F.month(same) > F.month(last), day(m1, d1, (year.try_cast("int") - 1).cast("string"))).otherwise(same)
    return F.struct(first.alias("first"), last.alias("last"))


def local_instant(local: Column, zone: Column, known: Column) -> Column:
    """Instant of a wall time in a zone; a zone that isn't ``known`` counts as UTC."""
    return F.to_utc_timestamp(local, F.when(known, zone).otherwise("UTC"))


def day_scope(date: Column, offset_hours: Column) -> Column:
    """struct(start, end): the UTC instants between which a local day at an offset lies."""
    start = F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) - offset_hours * 3600)
    return F.struct(start.alias("start"), (start + F.expr("interval 1 day")).alias("end"))


def iso_utc(c: Column) -> Column:
    """Timestamps written with Z, an offset or none (UTC), as UTC with Z."""
    stamp = F.try_to_timestamp(c)
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(stamp, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


# Fixed value: a year that is a part of a key's path.
KEY_YEAR = r"(?:^|/)((?:19|20)\d{2})(?=/|$)"


def season(start: Column, key: Column, of_key: Column | None = None) -> Column:
    """Year of the start date, else the last year in the key's path where ``of_key`` lets keys tell it (everywhere if not given), else null."""
    year = F.try_element_at(F.regexp_extract_all(key, F.lit(KEY_YEAR), F.lit(1)), F.lit(-1)).cast("int")
    return F.coalesce(F.year(start), year if of_key is None else F.when(of_key, year))


def season_problem(start: Column, key: Column, source: Column) -> Column:
    """Why a result has no season, null if it has one: such a row stops a publication."""
    return F.when(season(start, key, source == "time_team").isNull(), F.lit("neither a start date nor a year in the key"))


def number_text(c: Column) -> Column:
    """Whole numbers without a point, others as they are."""
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(c.cast("decimal(38,6)").cast("string"), "0+$", ""))


def share_text(c: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.round(c * 100, 1)), F.lit("%"))


def humanise(slug: Column) -> Column:
    return F.initcap(F.regexp_replace(slug, "[-_]+", " "))


def year_end_label(end: Column) -> Column:
    return F.concat(F.lit("FYE "), F.date_format(end, "MMM yyyy"))


def first_key(doc: Column, *paths: str) -> Column:
    """The first of a JSON document's paths that holds anything."""
    return F.coalesce(*(F.get_json_object(doc, p) for p in paths))


def looks_like_location(c: Column) -> Column:
    """'..., ST', '..., Some Place', a trailing pair of capitals, or a country's name."""
    return F.coalesce(c.rlike(r",\s*[A-Za-z .'-]+$") | c.rlike(r"\b[A-Z]{2}$") | c.rlike(r"(?i)\b(?:USA|Canada|UK)\b"), F.lit(False))


def is_category_heading(c: Column, markers: tuple[str, ...]) -> Column:
    return F.coalesce((F.length(c) <= 80) & F.upper(c).rlike("|".join(markers)), F.lit(False))


def listing_parts(c: Column) -> Column:
    """struct(name, location) of a listing: its labels go, the last part is the location if it looks like one."""
    bare = F.regexp_replace(c, r"(?i)\b(?:live\s+)?results?\b|\blive\s+video(?:\s+feed)?\b", "")
    parts = F.filter(F.transform(F.split(bare, r"\||\s[–—-]\s"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    tail = F.try_element_at(parts, F.lit(-1))
    split = (F.size(parts) >= 2) & looks_like_location(tail)
    rest = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " — ")
    return F.struct(F.when(split, rest).otherwise(F.array_join(parts, " — ")).alias("name"), F.when(split, tail).alias("location"))


def is_result_link(href: Column, label: Column, own: tuple[str, ...], own_page: str, listing: Column) -> Column:
    """Links worth following: web addresses without video; on the directory's own hosts only its results page."""
    host = F.lower(F.try_parse_url(href, F.lit("HOST")))
    path = F.lower(F.coalesce(F.try_parse_url(href, F.lit("PATH")), F.lit("")))
    low = F.lower(F.coalesce(label, F.lit("")))
    web = F.lower(F.try_parse_url(href, F.lit("PROTOCOL"))).isin("http", "https")
    elsewhere = provider_of_host(host).isNotNull() | F.contains(low, F.lit("result")) | listing
    return F.coalesce(web & ~F.contains(low, F.lit("video")) & F.when(host.isin(*own), F.contains(path, F.lit(own_page))).otherwise(elsewhere), F.lit(False))


def public_url(url: Column, key: Column, template: str, single: Column) -> Column:
    """A sane web address, else the template's by key; null where a value rests on several filings."""
    clean = F.trim(url)
    sane = ~clean.rlike(r"\s") & F.try_parse_url(clean, F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(clean, F.lit("HOST")).isNotNull()
    by_key = F.when((F.trim(key) != "") & ~F.trim(key).rlike(r"\s"), F.format_string(template, F.trim(key)))
    return F.when(single, F.when(F.coalesce(sane, F.lit(False)), clean).otherwise(by_key))


def seed_status(notes: Column) -> Column:
    return F.when(F.coalesce(notes, F.lit("")).rlike("(?i)exclude|dormant"), "candidate").otherwise("included")


def has_order(position: Column, time_ms: Column) -> Column:
    """True where a row can be put in order by place or by time."""
    return (F.coalesce(position, F.lit(0)) > 0) | (F.coalesce(time_ms, F.lit(0)) > 0)


def any_present(*columns: Column) -> Column:
    return F.coalesce(*(F.when(c.isNotNull(), True) for c in columns), F.lit(False))


def without_contacts(fields: Column, pattern: str = CONTACTS) -> Column:
    """A map without the keys that name contacts; ``nested.scrub`` does so at any depth."""
    return F.map_filter(fields, lambda k, v: ~k.rlike(pattern))


def crew_suffix(label: Column, *bases: Column) -> Column:
    """What follows a club's name in an entry's label, else what follows the last ' - '; never a person's display name."""
    found = []
    for base in bases:
        rest = F.regexp_replace(F.substring(label, F.length(base) + 1, F.length(label)), r"^[ –—()-]+|[ –—()-]+$", "")
        found.append(F.when((base != "") & label.startswith(base) & (rest != ""), rest))
    tail = F.element_at(F.split(label, " - "), -1)
    return F.coalesce(*found, F.when(F.contains(label, F.lit(" - ")) & (tail != ""), tail))


def event_display(event: Column, round_: Column) -> Column:
    """The event's name with its round, unless it says the round already."""
    said = F.coalesce((round_ == "") | F.contains(F.lower(event), F.lower(round_)), F.lit(True))
    return F.when(said, event).otherwise(F.concat(event, F.lit(" — "), round_))


def numbered_splits(*times: Column) -> Column:
    """array of (number, time_ms) of the split times that are there."""
    return F.filter(F.array(*(F.struct(F.lit(i + 1).alias("number"), t.alias("time_ms")) for i, t in enumerate(times))), lambda s: s.time_ms.isNotNull())
