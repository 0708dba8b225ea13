"""The vault: which placeholder stands for which value, per engagement. A folder of Parquet batches and numbered manifests.

    <root>/engagement=<name>/entries/batch=<n>        real, token, entity_type, first_seen, seq, generation, removed
    <root>/engagement=<name>/manifests/<number>.json  the batches that count; the highest number holds
    <root>/engagement=<name>/salt                     what placeholders are derived with

A batch counts once a manifest names it, and rewritten text is only handed out after that, so a placeholder that was seen
outside always restores. A manifest is written aside and takes its number in one step that fails if the number is taken:
a crash leaves the manifest before it in force, and of two writers one finds out, reads what the other did, and mints anew.
The step is a hard link on local file systems and a rename elsewhere, so the store's rename must be atomic and must refuse
an existing target, as that of HDFS does.

A value has one placeholder whatever entity asks for it. Removing a value writes a tombstone: its placeholder no longer
restores, stays protected from being detected, and the value gets a new one when it is seen again. Entries without a value
are placeholders of networks and small spaces that stood in texts by chance: they are taken and never restore.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import secrets
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.entities import COUNTED, ENTITIES, LABEL_ONLY, SHAPES, SMALL, placeholder_column
from .rules import check_engagement

ENTRY = "real string, token string, entity_type string, first_seen timestamp, seq long, generation int, removed boolean"
TRIES = 10
KEPT = 20  # manifests


class VaultFull(Exception):
    """A space of placeholders has none left: nothing is handed out."""


class VaultBusy(Exception):
    """Other writers came first, again and again."""


class Vault:
    """One engagement's vault. Batches are read and written through Spark, manifests through its file systems.

    ``salt``: by default a random one is made for a new engagement and kept beside its manifests.
    """

    def __init__(self, spark: SparkSession, root: str, engagement: str = "default", salt: str | None = None, extended: bool = False):
        self.spark, self.extended = spark, extended
        self.base = posixpath.join(root, f"engagement={check_engagement(engagement)}")
        self._salt = salt

    @property
    def salt(self) -> str:
        if self._salt is None:
            if not self._exists("salt"):
                self._take("salt", secrets.token_hex(32))
            self._salt = self._read("salt")
        return self._salt

    # -- files ----------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(posixpath.join(self.base, name))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def _read(self, name: str) -> str:
        path, fs = self._path(name)
        source = fs.open(path)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def _take(self, name: str, content: str) -> bool:
        """Makes the file ``name`` with all of its content, or nothing if there is one; whether it was made."""
        own, fs = self._path(f"{posixpath.dirname(name)}/.new-{uuid.uuid4().hex}".lstrip("/"))
        out = fs.create(own, False)
        out.write(bytearray(content.encode()))
        out.hsync() if hasattr(out, "hsync") else out.flush()
        out.close()
        path, _ = self._path(name)
        try:
            if fs.getScheme() == "file":
                os.link(own.toUri().getPath(), path.toUri().getPath())
                return True
            return not fs.exists(path) and fs.rename(own, path)
        except FileExistsError:
            return False
        finally:
            if fs.exists(own):
                fs.delete(own, False)

    # -- the manifests --------------------------------------------------------------------------------------------

    def state(self) -> tuple[int, list[str], list[str]]:
        """(number of the manifest in force, folders of the batches that count, names of all batches that ever counted)."""
        path, fs = self._path("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        numbers = sorted(int(n[:-5]) for n in names if re.fullmatch("[0-9]+[.]json", n))
        if not numbers:
            return 0, [], []
        held = json.loads(self._read(f"manifests/{numbers[-1]:012d}.json"))
        return numbers[-1], held["folders"], held["names"]

    def batches(self) -> list[str]:
        return self.state()[2]

    def _commit(self, number: int, folders: list[str], names: list[str]) -> bool:
        if not self._take(f"manifests/{number:012d}.json", json.dumps({"folders": folders, "names": names})):
            return False
        if number > KEPT:  # readers that listed the folder a moment ago still find theirs
            path, fs = self._path(f"manifests/{number - KEPT:012d}.json")
            fs.delete(path, False)
        return True

    def _write(self, entries: DataFrame) -> str:
        folder = uuid.uuid4().hex
        entries.write.parquet(posixpath.join(self.base, "entries", f"batch={folder}"))
        return folder

    def append(self, entries: DataFrame, name: str | None = None) -> str:
        """Writes entries, which need nothing of others, then names them. A batch of a name that counts already is left alone."""
        name, folder = name or uuid.uuid4().hex, None
        for _ in range(TRIES):
            number, folders, names = self.state()
            if name in names:
                return name
            folder = folder or self._write(entries)
            if self._commit(number + 1, [*folders, folder], [*names, name]):
                return name
        raise VaultBusy(self.base)

    def compact(self) -> None:
        """All batches as one: a history is read from as many folders as there were batches. Nothing is forgotten."""
        number, folders, names = self.state()
        if len(folders) > 1 and not self._commit(number + 1, [self._write(self.history(folders).coalesce(max(1, len(folders) // 8)))], names):
            raise VaultBusy(self.base)

    # -- reading --------------------------------------------------------------------------------------------------

    def history(self, folders: list[str] | None = None) -> DataFrame:
        paths = [posixpath.join(self.base, "entries", f"batch={b}") for b in (self.state()[1] if folders is None else folders)]
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)

    def entries(self) -> DataFrame:
        """What restores: of each value the latest generation, unless it was removed."""
        return latest(self.history())

    def spans(self) -> DataFrame:
        """Every placeholder ever handed out: text that holds one is never detected anew."""
        return self.history().select("token").distinct()

    def lookup(self, values: DataFrame) -> DataFrame:
        """``values`` (real) with their placeholders; never makes one."""
        return values.join(self.entries().select("real", "token"), "real", "left")

    def lookup_real(self, tokens: DataFrame) -> DataFrame:
        return tokens.join(self.entries().select("token", "real"), "token", "left")

    def listed(self) -> DataFrame:
        return self.entries().orderBy("first_seen", "seq")

    def report(self) -> DataFrame:
        """Counts by entity, with a total (entity null)."""
        return report(self.entries())

    def label_only(self) -> DataFrame:
        return self.entries().where(F.col("entity_type").isin(*LABEL_ONLY))

    # -- changing -------------------------------------------------------------------------------------------------

    def remove(self, values: DataFrame) -> None:
        gone = self.entries().join(values.select("real"), "real", "left_semi")
        self.append(gone.withColumn("removed", F.lit(True)).select("real", "token", "entity_type", "first_seen", "seq", "generation", "removed"))

    def get_or_create(self, wanted: DataFrame, name: str | None = None, standing: DataFrame | None = None) -> DataFrame:
        """(real, token) of all ``wanted`` (real, entity_type, place): known ones from the vault, new ones minted and kept.

        ``place`` orders first sights; of entities that want the same value the first one's shape is taken. ``standing``
        (token): placeholders of networks and small spaces that stand in the texts; they are taken from now on. A batch that runs again finds all its
        values known, so it mints nothing; ``name`` tells it among the batches.
        """
        first = wanted.groupBy("real").agg(F.min_by("entity_type", "place").alias("entity_type"), F.min("place").alias("place"))
        for _ in range(TRIES):
            number, folders, names = self.state()
            history = self.history(folders)
            new = first.join(latest(history).select("real"), "real", "left_anti")
            dead = history.groupBy("real").agg(F.max("generation").alias("last"))
            new = new.join(dead, "real", "left").withColumn("generation", F.coalesce(F.col("last") + 1, F.lit(0))).drop("last").persist()
            met = None if standing is None else standing.join(history.select("token"), "token", "left_anti").distinct().persist()
            try:
                kinds = {r["entity_type"]: r["n"] for r in new.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).collect()}
                chance = met is not None and not met.isEmpty()
                if not kinds and not chance:
                    break
                taken = history.select("token")
                minted = self.mint(new, kinds, taken.unionByName(met) if chance else taken, history)
                columns = ["real", "token", "entity_type", F.current_timestamp().alias("first_seen"), "seq", "generation", F.lit(False).alias("removed")]
                rows = minted.select(*columns)
                if chance:
                    none = F.lit(None).cast("string").alias("real")
                    rows = rows.unionByName(met.select(none, "token", F.lit("").alias("entity_type"), F.current_timestamp().alias("first_seen"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("generation"), F.lit(True).alias("removed")))
                own = name or uuid.uuid4().hex
                if self._commit(number + 1, [*folders, self._write(rows)], names if own in names else [*names, own]):
                    break
            finally:
                new.unpersist()
                if met is not None:
                    met.unpersist()
        else:
            raise VaultBusy(self.base)
        return first.select("real").join(self.entries().select("real", "token"), "real")

    def mint(self, new: DataFrame, kinds: dict[str, int], taken: DataFrame, history: DataFrame) -> DataFrame:
        """``new`` (real, entity_type, place, generation) with token and seq; ``kinds`` counts its entities. Nothing is kept."""
        if set(kinds) - set(ENTITIES):
            raise ValueError("an entity without a shape")
        plain = [e for e in SHAPES if e not in SMALL and e in kinds]
        small = [e for e in SMALL if e in kinds]
        shape = F.lit(None).cast("string")
        for e in plain:
            shape = F.when(F.col("entity_type") == e, placeholder_column(e, F.col("real"), self.salt, F.col("generation"))).otherwise(shape)
        out = new.where(F.col("entity_type").isin(*plain)).withColumn("token", shape).withColumn("seq", F.lit(0).cast("long"))
        waiting, work = sum(kinds[e] for e in small), posixpath.join(self.base, "minting", uuid.uuid4().hex)
        rounds: list[str] = []
        schema = "real string, entity_type string, place string, generation int, token string, seq long"
        asked = new.where(F.col("entity_type").isin(*small)).withColumn("order", F.struct("place", "real"))
        for attempt in range(TRIES if waiting else 0):
            # Each round is written, so the next one's plan does not hold those before it.
            held = self.spark.read.schema(schema).parquet(*rounds) if rounds else self.spark.createDataFrame([], schema)
            shape = F.lit(None).cast("string")
            for e in small:
                shape = F.when(F.col("entity_type") == e, placeholder_column(e, F.col("real"), self.salt, F.col("generation"), attempt)).otherwise(shape)
            tried = asked.join(held.select("real"), "real", "left_anti").withColumn("token", shape)
            free = tried.join(taken, "token", "left_anti").join(held.select("token"), "token", "left_anti")
            won = free.groupBy("token").agg(F.min_by(F.struct("real", "entity_type", "generation"), "order").alias("w"))
            rounds.append(f"{work}/round={attempt}")
            got = won.select("w.real", "w.entity_type", F.lit("").alias("place"), "w.generation", "token", F.lit(attempt).cast("long").alias("seq"))
            got.write.parquet(rounds[-1])
            waiting -= self.spark.read.schema(schema).parquet(rounds[-1]).count()
            if not waiting:
                break
        if waiting:
            raise VaultFull("no free placeholder was found")
        if rounds:
            minted = self.spark.read.schema(schema).parquet(*rounds).select("real", "token", "seq")
            out = out.unionByName(new.join(minted, "real").select(*out.columns))
        for e in COUNTED:
            if e in kinds:
                out = out.unionByName(self._counted(new.where(F.col("entity_type") == e), e, kinds[e], taken, history).select(*out.columns))
        return out

    def _counted(self, new: DataFrame, entity: str, count: int, taken: DataFrame, history: DataFrame) -> DataFrame:
        """Networks take the next numbers in the order of their first sight; numbers are never used again, and those whose
        placeholder is in ``taken`` (token) are left out."""
        used = history.where(F.col("entity_type") == entity).agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).first()["n"]
        room = (512 + 65536 * self.extended) if entity == "ip_network" else 1 << 32
        slots = taken.select("token", network_number(entity, F.col("token")).alias("seq")).where((F.col("seq") >= used) & (F.col("seq") < room))
        slots = slots.where(network_token(entity, F.col("seq")) == F.col("token")).select("seq").distinct()
        left_out = slots.count()
        if used + count + left_out > room:
            raise VaultFull(f"{entity}: {room} placeholders are all there are")
        fresh = lambda: posixpath.join(self.base, "minting", uuid.uuid4().hex)
        rows = numbered(new, ["place", "real"], fresh())
        if left_out:
            free = self.spark.range(used, used + count + left_out).select(F.col("id").alias("free")).join(slots, F.col("free") == F.col("seq"), "left_anti")
            rows = rows.drop("seq").join(numbered(free, ["free"], fresh()).withColumnRenamed("free", "seq"), "n").drop("n")
        else:
            rows = rows.withColumn("seq", F.col("n") + used).drop("n")
        return rows.withColumn("token", network_token(entity, F.col("seq")))


def network_token(entity: str, n: Column) -> Column:
    """The placeholder of the n-th network."""
    if entity == "ip_network":
        token = F.when(n < 512, F.concat(F.lit("198."), (18 + F.floor(n / 256)).cast("string"), F.lit("."), (n % 256).cast("string")))
        return token.otherwise(F.concat(F.lit("240."), F.floor((n - 512) / 256).cast("string"), F.lit("."), ((n - 512) % 256).cast("string")))
    part = lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))
    return F.concat(F.lit("fd00:c0de:"), part(F.shiftright(n, 16)), F.lit(":"), part(n.bitwiseAND(0xFFFF)))


def network_number(entity: str, token: Column) -> Column:
    """The number of a network's placeholder; null or any other number for what isn't one."""
    if entity == "ip_network":
        a, b, c = (F.get(F.split(token, r"\."), F.lit(k)).try_cast("long") for k in range(3))
        return F.when(a == 198, (b - 18) * 256 + c).when(a == 240, 512 + b * 256 + c)
    high, low = (F.conv(F.regexp_extract(token, "^fd00:c0de:([0-9a-f]{4}):([0-9a-f]{4})$", k), 16, 10).try_cast("long") for k in (1, 2))
    return high * 65536 + low


def numbered(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """``rows`` with ``n``, their number from 0 in ``order``: they are dealt out by ranges and written to ``path``, and a range
    begins where those before it end, so no task sees more than its own."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    dealt.write.parquet(path)
    held = spark.read.schema(dealt.schema).parquet(path)
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = held.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(*order)
    return held.join(F.broadcast(before), "__range").withColumn("n", (F.col("__before") + F.row_number().over(inside) - 1).cast("long")).drop("__range", "__before")


def latest(history: DataFrame) -> DataFrame:
    """Of each value the latest generation, unless it was removed."""
    entry = F.struct("token", "entity_type", "first_seen", "seq", "generation", "removed")
    last = history.where("real is not null").groupBy("real").agg(F.max_by(entry, F.struct("generation", "removed")).alias("e"))
    return last.where("not e.removed").select("real", "e.token", "e.entity_type", "e.first_seen", "e.seq", "e.generation")


def report(entries: DataFrame) -> DataFrame:
    return entries.rollup("entity_type").agg(F.count(F.lit(1)).alias("n"))


def new_values(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Values that have no placeholder yet."""
    return wanted.select("real").distinct().join(known, "real", "left_anti")
