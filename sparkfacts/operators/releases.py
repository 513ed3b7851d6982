"""Releases: many tables that become visible together, under one numbered manifest."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer released first; the draft is based on what isn't current any more."""


class Releases:
    """Tables under one root, and manifests that name their paths, rows and checksums.

    A draft's tables are written to a folder of their own, which nobody reads yet, and
    counted while they are written. It is validated from what was written: counts,
    checksums and the caller's rules. The manifest of the next number is then put in place
    by a rename that fails where a file of that number is: of two drafts on one base, one
    becomes the release and the other gets a Conflict. Until then readers see the release
    before. The rename has to be atomic, as it is on HDFS; a store without such a rename
    needs one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # -- reading

    def numbers(self) -> list[int]:
        at = self._path(f"{self.root}/_manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> dict | None:
        have = self.numbers()
        if not have:
            return None
        path = f"{self.root}/_manifests/{have[-1] if number is None else number:012d}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def read(self, name: str, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.manifest(number)["tables"][name]["path"])

    # -- writing

    @staticmethod
    def _measures():
        row = F.xxhash64(F.to_json(F.struct(F.col("*")))).cast("decimal(38,0)")
        return F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("checksum")

    def draft(self, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]) -> dict:
        """Writes the tables; rows and checksums are observed in the same pass.

        A table may be a function of those before it, which it gets as they were written:
        what they hold isn't worked out again.
        """
        have = self.numbers()
        made = {"base": have[-1] if have else 0, "folder": f"{self.root}/data/{uuid.uuid4().hex}", "tables": {}}
        for name, df in tables.items():
            seen, path = Observation(), f"{made['folder']}/{name}"
            if callable(df):
                df = df({n: self.spark.read.parquet(t["path"]) for n, t in made["tables"].items()})
            df.observe(seen, *self._measures()).write.parquet(path)
            made["tables"][name] = {"path": path} | seen.get
        return made

    def validate(self, draft: dict, rules: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> None:
        """Raises where a written table isn't what was observed, or where a rule has rows."""
        written = {name: self.spark.read.parquet(t["path"]) for name, t in draft["tables"].items()}
        for name, t in draft["tables"].items():
            found = written[name].agg(*self._measures()).first().asDict()
            if found != {k: t[k] for k in ("rows", "checksum")}:
                raise ValueError(f"{name} was not written whole")
        broken = {rule: n for rule, df in (rules(written) if rules else {}).items() if (n := df.count())}
        if broken:
            raise ValueError(f"not released: {broken}")

    def commit(self, draft: dict) -> int:
        """Puts the manifest of the next number in place, if it is still the next."""
        number = draft["base"] + 1
        new, final = (self._path(f"{self.root}/_manifests/{n}") for n in (f"_{uuid.uuid4().hex}", f"{number:012d}.json"))
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps({"number": number, **draft, "at": time.time()}).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs.makeQualified(new), self._fs.makeQualified(final), none)
        except Exception as e:
            self._fs.delete(new, False)
            if self._fs.exists(final):
                raise Conflict(f"release {number} is there already") from e
            raise
        return number

    def release(self, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], rules: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> int:
        draft = self.draft(tables)
        self.validate(draft, rules)
        return self.commit(draft)

    def sweep(self, keep: int = 3, older_than: float = 86_400.0) -> list[str]:
        """Deletes manifests beyond the last ``keep`` and folders that no manifest names, if they are so many seconds old: another writer's draft may be among them."""
        for n in self.numbers()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{n:012d}.json"), False)
        named = {self.manifest(n)["folder"].rsplit("/", 1)[1] for n in self.numbers()}
        at = self._path(f"{self.root}/data")
        old = [f for f in (self._fs.listStatus(at) if self._fs.exists(at) else []) if f.getPath().getName() not in named and time.time() - f.getModificationTime() / 1000 >= older_than]
        for f in old:
            self._fs.delete(f.getPath(), True)
        return [f.getPath().getName() for f in old]
