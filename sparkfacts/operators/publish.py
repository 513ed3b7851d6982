"""Publication: invariants, redaction, snapshots with an atomic pointer, rollback and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import finished_status, name_words
from .curation import contained_names


def invariant_counts(violations: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): violations of each rule; each rule is counted where its rows are."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in violations.items()]
    return reduce(DataFrame.unionByName, parts)


def require(counts: DataFrame) -> None:
    """Raises if any rule is broken; one row a rule comes to the driver."""
    broken = [f"{r.rule}: {r.n}" for r in counts.filter("n > 0").collect()]
    if broken:
        raise ValueError("publish stopped: " + ", ".join(broken))


def snapshot_violations(rows: DataFrame, scope: DataFrame, series: list[str]) -> dict[str, DataFrame]:
    """Violations by rule of rows (org, slug, season and the columns of a series key) that may be published for ``scope`` only."""
    return {
        "slug_blank": rows.filter(F.trim("slug") == ""),
        "slug_shared": rows.filter(F.trim("slug") != "").groupBy("slug").agg(F.countDistinct("org").alias("n_orgs")).filter("n_orgs > 1"),
        "series_repeated": rows.groupBy(*series).agg(F.count("*").alias("n_rows")).filter("n_rows > 1"),
        "no_season": rows.filter("season is null"),
        "out_of_scope": rows.join(scope.select("org"), "org", "left_anti"),
    }


def redacted(entries: DataFrame, people: DataFrame, suppressed: DataFrame, key: str, by: str = "name") -> DataFrame:
    """Entries with ``names`` in seat order: minors have neither names nor a label, people suppressed ``by`` name or another column go before they are gathered."""
    open_ = people.join(suppressed, by, "left_anti").join(entries.filter("not minor").select(key), key, "left_semi")
    named = open_.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seat", "name"))), lambda p: p["name"]).alias("names"))
    return hide_labels(entries, F.col("minor"), "crew_label").join(named, key, "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def suppressed(rows: DataFrame, rules: DataFrame, name: str, scope: list[str]) -> DataFrame:
    """Rows that a suppression rule names; a null in a rule's scope column matches all."""
    r = rules.select(F.col(name).alias("_name"), *(F.col(c).alias(f"_{c}") for c in scope))
    same = reduce(lambda a, b: a & b, (F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)) for c in scope))
    return rows.join(r, (F.col(name) == F.col("_name")) & same, "left_semi")


def unsuppressed(people: DataFrame, rules: DataFrame) -> DataFrame:
    """People (name, source, club and others) that no suppression names.

    A rule (name, source, club) holds for its source and club, a null in either for all.
    Names are equal by their words. Each kind of rule is an equi anti-join of its own.
    """
    keyed = people.withColumn("_words", name_words(F.col("name")))
    told = rules.select(name_words(F.col("name")).alias("_words"), "source", "club").filter(F.size("_words") > 0)
    for scope in (["source", "club"], ["source"], ["club"], []):
        blank = [c for c in ("source", "club") if c not in scope]
        own = told.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in scope] + [F.col(c).isNull() for c in blank]))
        keyed = keyed.join(own.select("_words", *scope).distinct(), ["_words", *scope], "left_anti")
    return keyed.select(*people.columns)


def crews(entries: DataFrame, people: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Entries with ``crew`` (seat, name) in seat order after scoped suppressions; minors have neither crew nor label.

    ``people`` has the key, seat and name, ``entries`` the key, source, club, minor and crew_label.
    """
    scoped = people.join(entries.filter("not minor").select(key, "source", "club"), key)
    named = unsuppressed(scoped, rules).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seat", "name"))).alias("crew"))
    return hide_labels(entries, F.col("minor"), "crew_label").join(named, key, "left")


def leaks(names: DataFrame, rows: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(key, place, person_id): published people whose names stand in labels of published rows, the last check before activation."""
    strings = rows.select(F.col(key), F.explode(F.array(*(F.struct(F.lit(c).alias("place"), F.col(c).alias("value")) for c in labels))).alias("s")).select(key, "s.*").filter("value is not null")
    found = contained_names(names, strings.select(F.struct(key, "place").alias("value_id"), "value"))
    return found.select(F.col(f"value_id.{key}").alias(key), "value_id.place", "person_id")


def hide_labels(rows: DataFrame, minor: Column, *labels: str) -> DataFrame:
    """Labels of minors' events are null."""
    return rows.withColumns({c: F.when(~minor, F.col(c)) for c in labels})


def result_sanity(rows: DataFrame) -> DataFrame:
    """Adds reasons and quality_state: a finish under a minute or over six hours, a place without a finish."""
    seconds = F.col("time_ms") / 1000
    reasons = F.array_compact(F.array(
        F.when((seconds < 60) | (seconds > 6 * 3600), "finish time out of range"),
        F.when(F.col("position").isNotNull() & ~finished_status(F.col("status")), "place without a finish")))
    return rows.withColumn("reasons", reasons).withColumn("quality_state", F.when(F.size("reasons") > 0, "under_review").otherwise("verified"))


KEPT = 10  # pointer files that stay


class Snapshots:
    """Published tables under one root: each snapshot a partition, numbered pointer files naming the active one.

    Pointers are only added, each by a rename to a name that isn't there yet, and the
    highest number counts: readers see the old snapshot or the new one, on any store.
    Paths go through Hadoop's file system, so any store that Spark writes will do.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, snapshot: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/snapshot_id={snapshot}")

    def read(self, name: str, snapshot: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/snapshot_id={snapshot or self.active()}")

    def _pointers(self) -> list[str]:
        at = self._path(f"{self.root}/_active")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in names if n.isdigit())

    def active(self) -> str | None:
        have = self._pointers()
        return self.spark.read.text(f"{self.root}/_active/{have[-1]}").first()[0] if have else None

    def activate(self, snapshot: str) -> None:
        """A new pointer file appears by one rename under the next number; the last KEPT ones stay."""
        have = self._pointers()
        number = int(have[-1]) + 1 if have else 1
        new = self._path(f"{self.root}/_active/_new-{number}")
        out = self._fs.create(new, True)
        out.write(bytearray(snapshot.encode()))
        out.close()
        if not self._fs.rename(new, self._path(f"{self.root}/_active/{number:012d}")):
            raise OSError("the pointer could not be moved on")
        for name in have[: 1 - KEPT]:
            self._fs.delete(self._path(f"{self.root}/_active/{name}"), False)

    def rollback(self, states: DataFrame, directory: str) -> str:
        """Activates the newest superseded snapshot that still has directory rows."""
        have = [s.getPath().getName().split("=", 1)[1] for s in self._fs.listStatus(self._path(f"{self.root}/{directory}"))]
        last = states.filter((F.col("status") == "superseded") & F.col("snapshot_id").isin(*have)).agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("id")).first()
        if last.id is None:
            raise ValueError("no snapshot to go back to")
        self.activate(last.id)
        return last.id

    def collect_garbage(self, ranked: DataFrame, names: list[str]) -> list[str]:
        """Deletes snapshots beyond retention, never the active one."""
        gone = [r.snapshot_id for r in ranked.filter("not kept").select("snapshot_id").collect() if r.snapshot_id != self.active()]
        for s in gone:
            for name in names:
                self._fs.delete(self._path(f"{self.root}/{name}/snapshot_id={s}"), True)
        return gone
