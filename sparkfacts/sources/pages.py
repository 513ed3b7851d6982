"""HTML and JSON documents: links, tables, carried headings, object graphs."""

from __future__ import annotations

import hashlib
import json
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema


def anchors(html: Column) -> Column:
    """Targets of all links."""
    return F.regexp_extract_all(html, F.lit('(?i)<a\\b[^>]*?href="([^"]+)"'), F.lit(1))


def event_links(html: Column) -> Column:
    """'slug/year' of links to event pages, each once, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit('href="/([a-z0-9-]+/20[0-9]{2})"'), F.lit(1)), lambda x: x))


# Statuses and phrases of a page that stands for "blocked", and phrases of one without results.
BLOCKED_STATUS = (403, 429, 503)
BLOCKED_PHRASES = ("just a moment", "enable javascript and cookies", "/cdn-cgi/", "cf-chl-", "cf-mitigated", "challenge-platform")
EMPTY_PHRASES = ("page not found", "no results found")


def page_state(html: Column, status: Column | None = None, challenged: Column | None = None) -> Column:
    """blocked, missing, placeholder or content; ``challenged`` is true where a header says so."""
    low = F.lower(F.coalesce(html, F.lit("")))
    words = F.trim(F.regexp_replace(F.regexp_replace(low, "<[^>]*>", " "), r"\s+", " "))
    held = low.rlike("|".join(BLOCKED_PHRASES))
    if status is not None:
        held = held | F.coalesce(status.isin(*BLOCKED_STATUS), F.lit(False))
    if challenged is not None:
        held = held | F.coalesce(challenged, F.lit(False))
    return F.when(held, "blocked").when(words == "", "missing").when(words.rlike("|".join(EMPTY_PHRASES)), "placeholder").otherwise("content")


class _Tables(HTMLParser):
    """Rows of all tables as lists of cell texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.row, self.cell = [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


@pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_cells(html: pd.Series) -> pd.Series:
    def rows(text):
        p = _Tables()
        p.feed(text or "")
        return p.rows

    return html.map(rows)


# Columns of a results table.
RESULT_COLUMNS = ("place", "lane", "entry", "penalty", "time", "margin")


def result_rows(pages: DataFrame, key: str, html: str) -> tuple[DataFrame, DataFrame]:
    """Rows of results tables with their entry key, and the pages of another shape (for quarantine)."""
    rows = pages.select(key, F.posexplode(table_cells(html)).alias("pos", "cells")).filter(F.size("cells") > 0)
    head = F.transform("cells", F.lower) == F.array(*map(F.lit, RESULT_COLUMNS))
    good = rows.filter((F.size("cells") == len(RESULT_COLUMNS)) & ~head)
    named = good.select(key, "pos", *(F.col("cells")[i].alias(c) for i, c in enumerate(RESULT_COLUMNS)))
    entry = F.coalesce(F.nullif("place", F.lit("")), F.nullif("lane", F.lit("")), F.concat(F.lit("row-"), F.col("pos").cast("string")))
    bad = rows.filter(F.size("cells") != len(RESULT_COLUMNS)).select(key, F.concat(F.lit("row of "), F.size("cells").cast("string"), F.lit(" cells")).alias("reason"))
    return named.withColumn("entry_key", entry), bad


class _Directory(HTMLParser):
    """Links of a directory page, in order, each with the date row and category heading that stand before it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.n, self.date, self.category, self.kind, self.href, self.text = {}, 0, None, None, None, None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        kind = "date" if tag == "tr" and (a.get("bgcolor") or "").lower().lstrip("#") == "ffcc00" else "category" if tag == "span" and "newscat2" in (a.get("class") or "") else "link" if tag == "a" and a.get("href") else None
        if kind:
            self.kind, self.href, self.text = (tag, kind), a.get("href"), []

    def handle_data(self, data):
        if self.kind:
            self.text.append(data)

    def handle_endtag(self, tag):
        if self.kind and tag == self.kind[0]:
            label = " ".join("".join(self.text).split())
            if self.kind[1] == "link":
                self.out.setdefault((self.date, self.href), (self.n, label, self.href, self.date, self.category))
            else:
                setattr(self, self.kind[1], label)
            self.kind, self.n = None, self.n + 1


#: Pages whose links a task holds at a time.
PAGES = 256


def directory_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Links (key, pos, label, href, date, category) of pages with the date and category that stand before them; of a page's links of equal (date, href) the first.

    Each row is a page; what stands before a link stands in the same row, so no row is sent anywhere.
    """
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField("pos", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("label", "href", "date", "category"))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                ids, texts = batch.slice(start, PAGES).columns
                at, links = [], []
                for i, text in enumerate(texts):
                    p = _Directory()
                    p.feed(text.as_py() or "")
                    links += p.out.values()
                    at += [i] * len(p.out)
                columns = zip(*links) if links else [()] * 5
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, "int32")).cast(arrow.types[0]), *(pa.array(c, t) for c, t in zip(columns, arrow.types[1:]))], schema=arrow)

    return pages.select(key, html).mapInArrow(run, schema)


def archive_years(html: Column) -> Column:
    """Map of year to url from the options of a page's archive list."""
    urls = F.regexp_extract_all(html, F.lit('(?i)<option[^>]*value="([^"]+)"'), F.lit(1))
    entries = F.transform(urls, lambda u: F.struct(F.regexp_extract(u, "(?:19|20)[0-9]{2}", 0).alias("year"), u.alias("url")))
    entries = F.filter(entries, lambda e: e.year != "")
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x.year), e.year) == i + 1))


def _resolved(node, index, path=()):
    if isinstance(node, list):
        return [_resolved(x, index, path) for x in node]
    if not isinstance(node, dict):
        return node
    ref = node.get("$ref")
    if ref is not None:
        if ref in path or ref not in index:
            return None
        own = {k: v for k, v in node.items() if k != "$ref"}
        return _resolved({**{k: v for k, v in index[ref].items() if k != "$id"}, **own}, index, (*path, ref))
    return {k: _resolved(v, index, path) for k, v in node.items() if k != "$id"}


def _ids(node, out):
    for x in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        _ids(x, out)
    if isinstance(node, dict) and "$id" in node:
        out[node["$id"]] = node
    return out


@pandas_udf(T.StringType())
def resolve_graph(docs: pd.Series) -> pd.Series:
    """JSON with every {"$ref"} replaced by the object of that "$id"; cycles end in null."""

    def one(text):
        try:
            doc = json.loads(text)
        except (TypeError, ValueError):
            return None
        return json.dumps(_resolved(doc, _ids(doc, {})), sort_keys=True)

    return docs.map(one)


def checksum_of(volatile: tuple[str, ...] = ()):
    """A UDF: sha-256 of a JSON document with keys in order, without volatile keys at any depth."""

    def strip(node):
        if isinstance(node, dict):
            return {k: strip(v) for k, v in node.items() if k not in volatile}
        return [strip(x) for x in node] if isinstance(node, list) else node

    @pandas_udf(T.StringType())
    def canonical(docs: pd.Series) -> pd.Series:
        return docs.map(lambda t: None if t is None else hashlib.sha256(json.dumps(strip(json.loads(t)), sort_keys=True, separators=(",", ":")).encode()).hexdigest())

    return canonical


def strict_json(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed documents, and rows that aren't such documents (for quarantine)."""
    parsed = df.withColumn("doc", F.from_json(column, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("doc").isNull() | F.col("doc._corrupt").isNotNull()
    return parsed.filter(~bad).withColumn("doc", F.col("doc").dropFields("_corrupt")), parsed.filter(bad).drop("doc")


def keyed_rows(column: Column, element: str) -> Column:
    """Rows of a JSON value that is either a list or an object by id."""
    as_list = F.from_json(column, f"array<{element}>")
    as_map = F.map_values(F.from_json(column, f"map<string,{element}>"))
    return F.when(F.trim(column).startswith("["), as_list).otherwise(as_map)


def envelope_rows(column: Column, element: str, field: str = "value") -> Column:
    """Rows of a landed JSON page that is either a list or an object with the list in a field."""
    as_list = F.from_json(column, f"array<{element}>")
    inside = F.from_json(F.get_json_object(column, f"$.{field}"), f"array<{element}>")
    return F.coalesce(F.when(F.trim(column).startswith("["), as_list).otherwise(inside), F.array().cast(f"array<{element}>"))


def landed_payloads(rows: DataFrame, key: str, status: str, body: str) -> tuple[DataFrame, DataFrame]:
    """Payloads worth staging with their checksum, and (key, reason) of the others: not found, failed or no JSON."""
    reason = F.when(F.col(status) == 404, "not_found").when(F.col(status) >= 400, "failed").when(~F.coalesce(F.substring(F.trim(body), 1, 1).isin("{", "["), F.lit(False)), "not_json")
    marked = rows.withColumn("_reason", reason)
    good = marked.filter("_reason is null").drop("_reason").withColumn("checksum", F.sha2(F.col(body).cast("binary"), 256))
    return good, marked.filter("_reason is not null").select(key, F.col("_reason").alias("reason"))


def store_states(landed: DataFrame, stored: DataFrame, key: str, checksum: str) -> DataFrame:
    """(key, state): new, same or conflict of landed content against a store that is written once."""
    have = stored.select(key, F.col(checksum).alias("_have"))
    state = F.when(F.col("_have").isNull(), "new").when(F.col("_have") == F.col(checksum), "same").otherwise("conflict")
    return landed.join(have, key, "left").select(key, state.alias("state"))


def paged_catalog(spark, path: str, element: str, size: int = 5000, field: str = "value") -> DataFrame:
    """Rows of landed catalog pages, up to the first page of fewer than ``size`` rows.

    Each page is a file or folder ``page=<number>`` with a list or an envelope. A page
    that is no JSON counts as empty and so ends the catalog, as does a gap in the numbers;
    what lies behind the end isn't read into rows. Only one row a page is looked at to
    find the end.
    """
    landed = spark.read.text(path, wholetext=True).withColumn("page", F.regexp_extract(F.input_file_name(), r"page=(\d+)", 1).cast("long"))
    pages = landed.select("page", envelope_rows(F.col("value"), element, field).alias("rows"))
    sizes = pages.select("page", F.size("rows").alias("n"))
    short = sizes.filter(F.col("n") < size).select("page")
    last = sizes.select("page").join(sizes.select((F.col("page") - 1).alias("page")), "page", "left_anti")
    bound = short.unionByName(last).agg(F.min("page").alias("_end"))  # one row
    return pages.join(F.broadcast(bound), F.col("page") <= F.col("_end")).select("page", F.inline("rows"))
