"""Entities over incidents: what was seen where, with which verdicts.

State is four tables: ``entities (placeholder, label, n, value, first_seen,
last_seen)``, ``incidents (incident_id, time, verdict, severity)``, ``bridge
(placeholder, incident_id, ord)`` and ``counters (label, n)``. Every operator
takes and returns tables; counters only ever grow.

On disk a vault is a row of versions: a whole one, then what each save changed,
upserts and tombstones by key, merged when it is read. A version belongs to the
one who creates its claim first, so two savers never write one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACEHOLDER = r"^\[([A-Z0-9]+)_(\d+)\]$"


@dataclass
class Vault:
    entities: DataFrame
    incidents: DataFrame
    bridge: DataFrame
    counters: DataFrame
    version: int | None = None  # that it was loaded from


class Conflict(RuntimeError):
    """Another one has saved, or is saving, since the vault was loaded."""


def empty(spark: SparkSession) -> Vault:
    return Vault(
        spark.createDataFrame([], "placeholder string, label string, n int, value string, first_seen string, last_seen string"),
        spark.createDataFrame([], "incident_id string, time string, verdict string, severity string"),
        spark.createDataFrame([], "placeholder string, incident_id string, ord long"),
        spark.createDataFrame([], "label string, n int"),
    )


def record(vault: Vault, seen: DataFrame) -> tuple[Vault, DataFrame]:
    """Adds ``seen (incident_id, time, placeholder, value, ord)``; ``ord`` is the order of events.

    Malformed placeholders and empty values are left out. An incident keeps
    its first time; an entity keeps its first value and moves ``last_seen``; an
    incident counts once for each entity. Returns the vault and ``n_new`` by
    incident.
    """
    seen = seen.where(F.col("incident_id").isNotNull() & (F.col("incident_id") != "") & F.col("placeholder").rlike(PLACEHOLDER) & (F.coalesce("value", F.lit("")) != ""))
    seen = seen.withColumn("label", F.regexp_extract("placeholder", PLACEHOLDER, 1)).withColumn("n", F.regexp_extract("placeholder", PLACEHOLDER, 2).cast("int"))
    times = seen.groupBy("incident_id").agg(F.min_by("time", "ord").alias("time"))
    fresh = times.join(vault.incidents, "incident_id", "left_anti").select("incident_id", "time", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("severity"))
    by = seen.groupBy("placeholder").agg(
        F.first("label").alias("label_"), F.first("n").alias("n_"), F.min_by("value", "ord").alias("value_"), F.min_by("time", "ord").alias("first_"), F.max_by("time", "ord").alias("last_"), F.min_by("incident_id", "ord").alias("by_")
    )
    both = vault.entities.join(by, "placeholder", "full")
    entities = both.select(
        "placeholder", F.coalesce("label", "label_").alias("label"), F.coalesce("n", "n_").alias("n"), F.coalesce("value", "value_").alias("value"),
        F.coalesce("first_seen", "first_").alias("first_seen"), F.coalesce("last_", "last_seen").alias("last_seen"),
    )
    new = by.join(vault.entities, "placeholder", "left_anti").groupBy(F.col("by_").alias("incident_id")).agg(F.count(F.lit(1)).alias("n_new"))
    links = seen.groupBy("placeholder", "incident_id").agg(F.min("ord").alias("ord")).join(vault.bridge, ["placeholder", "incident_id"], "left_anti")
    counters = vault.counters.unionByName(seen.select("label", "n")).groupBy("label").agg(F.max("n").alias("n"))
    return Vault(entities, vault.incidents.unionByName(fresh), vault.bridge.unionByName(links), counters, vault.version), new


def set_verdicts(vault: Vault, verdicts: DataFrame) -> Vault:
    """``verdicts (incident_id, verdict, severity)``: what is empty leaves the old; unknown incidents are left out."""
    new = verdicts.select("incident_id", F.nullif("verdict", F.lit("")).alias("v"), F.nullif("severity", F.lit("")).alias("s"))
    joined = vault.incidents.join(new, "incident_id", "left").select("incident_id", "time", F.coalesce("v", "verdict").alias("verdict"), F.coalesce("s", "severity").alias("severity"))
    return replace(vault, incidents=joined)


def history(vault: Vault) -> DataFrame:
    """Entities with their incidents in order, those of most incidents first. The array holds one entity's incidents."""
    links = vault.bridge.join(vault.incidents, "incident_id", "left")
    incidents = F.transform(F.array_sort(F.collect_list(F.struct("ord", "incident_id", "time", "verdict", "severity"))), lambda s: F.struct(s["incident_id"].alias("id"), s["time"].alias("time"), s["verdict"].alias("verdict"), s["severity"].alias("severity")))
    each = links.groupBy("placeholder").agg(F.count(F.lit(1)).alias("incident_count"), incidents.alias("incidents"))
    return vault.entities.join(each, "placeholder", "left").withColumn("incident_count", F.coalesce("incident_count", F.lit(0))).orderBy(F.desc("incident_count"), "label", "n")


def stats(vault: Vault) -> DataFrame:
    """``label, entities`` and, with a null label, all; ``incidents`` on that row."""
    labels = vault.entities.groupBy("label").agg(F.count(F.lit(1)).alias("entities")).withColumn("incidents", F.lit(None).cast("long"))
    total = vault.entities.agg(F.count(F.lit(1)).alias("entities")).select(F.lit(None).cast("string").alias("label"), "entities")
    return labels.unionByName(total.crossJoin(vault.incidents.agg(F.count(F.lit(1)).alias("incidents"))))  # one row by one row


def context_lines(vault: Vault, placeholders: DataFrame, most: int = 8) -> DataFrame:
    """``line`` for each of ``placeholders (placeholder)`` with incidents before: counts, dates and verdicts, never values; at most ``most``, in order."""
    wanted = vault.bridge.join(placeholders.select("placeholder").distinct(), "placeholder", "left_semi").join(vault.incidents, "incident_id", "left")
    counts = wanted.groupBy("placeholder").agg(F.count(F.lit(1)).alias("n"))
    verdicts = wanted.where("verdict is not null and verdict <> ''").groupBy("placeholder", "verdict").agg(F.count(F.lit(1)).alias("c"), F.min("ord").alias("o"))
    said = verdicts.groupBy("placeholder").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "o", "verdict", "c"))).alias("v"))
    text = F.array_join(F.transform("v", lambda s: F.concat(s["verdict"], F.lit(" ×"), s["c"].cast("string"))), ", ")
    line = F.concat(
        "placeholder", F.lit(": seen in "), F.col("seen_n").cast("string"), F.lit(" prior "), F.when(F.col("seen_n") == 1, "analysis").otherwise("analyses"),
        F.lit(" on this system (first "), F.substring("first_seen", 1, 10), F.lit(", last "), F.substring("last_seen", 1, 10),
        F.when(F.col("v").isNotNull(), F.concat(F.lit("; verdicts: "), text)).otherwise(F.lit("")), F.lit(")"),
    )
    rows = counts.withColumnRenamed("n", "seen_n").join(said, "placeholder", "left").join(vault.entities, "placeholder")
    ranked = rows.select("placeholder", "seen_n", line.alias("line")).orderBy(F.desc("seen_n"), "placeholder").limit(most)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("seen_n"), "placeholder"))).select("rank", "placeholder", "line")


def forget(vault: Vault, placeholders: DataFrame) -> Vault:
    """Entities that go; their numbers stay retired."""
    gone = placeholders.select("placeholder")
    return replace(vault, entities=vault.entities.join(gone, "placeholder", "left_anti"), bridge=vault.bridge.join(gone, "placeholder", "left_anti"))


def forget_terms(vault: Vault, terms: list[str]) -> Vault:
    """Entities whose value is one of ``terms``, whatever its case."""
    return forget(vault, vault.entities.where(F.lower("value").isin([t.strip().lower() for t in terms] or [""])))


def search(vault: Vault, query: str) -> DataFrame:
    needle = F.lit(query.strip().lower())
    return vault.entities.where(F.contains(F.lower("placeholder"), needle) | F.contains(F.lower("label"), needle) | F.contains(F.lower("value"), needle))


def used(mapping: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``mapping (id, placeholder, value)`` what occurs in ``texts (id, masked)``."""
    found = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("masked", F.lit(r"\[[A-Z0-9]+_\d+\]"), F.lit(0)))).alias("placeholder"))
    return mapping.join(found, ["id", "placeholder"], "left_semi")


def clear(vault: Vault) -> Vault:
    """No entities and no incidents; numbers stay retired, as counters stay."""
    none = empty(vault.entities.sparkSession)
    return replace(none, counters=vault.counters, version=vault.version)


#: Each table's key.
TABLES = {"entities": ["placeholder"], "incidents": ["incident_id"], "bridge": ["placeholder", "incident_id"], "counters": ["label"]}
SAVED = "version long, base long"


def _saved(spark: SparkSession, path: str) -> dict[int, int | None]:
    """The saves under ``path`` that were finished, by their marks: the version that each changes, or none where it is whole."""
    try:
        return {r["version"]: r["base"] for r in spark.read.schema(SAVED).parquet(f"{path}/saved").collect()}  # a row for each save that was not cleaned up
    except AnalysisException:  # nothing was saved yet
        return {}


def _claim(spark: SparkSession, path: str, version: int) -> None:
    """Creates the claim of a version, which can be done once."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/claims/{version}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    try:
        system.create(target, False).close()
    except Py4JJavaError as e:
        raise Conflict(f"Version {version} of {path} is being saved by another.") from e


def _released(spark: SparkSession, path: str, version: int) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/claims/{version}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)


def _tables(vault: Vault) -> dict[str, DataFrame]:
    return {name: getattr(vault, name) for name in TABLES}


def _changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` that ``old`` hasn't just so, and keys that only ``old`` has (``gone``)."""
    changed = new.join(old, [new[c].eqNullSafe(old[c]) for c in new.columns], "left_anti").withColumn("gone", F.lit(False))
    lost = old.join(new, [old[c].eqNullSafe(new[c]) for c in key], "left_anti")
    return changed.unionByName(lost.withColumn("gone", F.lit(True)))


def save(vault: Vault, path: str, key: str | None = None, whole: bool = False) -> Vault:
    """Saves a new version under ``path`` and returns the vault as of it; with a key (16, 24 or 32 bytes) values are encrypted.

    A vault that was loaded from there writes what has changed since, any other
    one, and with ``whole``, all of it; then what is read is one version again.
    ``Conflict`` where another one has saved since it was loaded, or is saving
    now. A version is marked when all its tables are written, so a save that
    fails leaves the last one as it was. Where its process died, its claim stays,
    and from ``STALE_MS`` on the next save takes the version after it.
    """
    spark, found = vault.entities.sparkSession, _saved(vault.entities.sparkSession, path)
    last, base = max(found, default=None), None if whole else vault.version
    if vault.version is not None and vault.version != last:
        raise Conflict(f"{path} has version {last}; this vault comes from {vault.version}.")
    version = max([last or 0, *_claimed(spark, path, last)]) + 1
    _claim(spark, path, version)
    try:
        before = _tables(load(spark, path, key, base)) if base is not None else None
        for name, table in _tables(vault).items():
            rows = table if before is None else _changes(before[name], table, TABLES[name])
            if key is not None and name == "entities":
                rows = rows.withColumn("value", F.base64(F.aes_encrypt("value", F.lit(key))))
            rows.write.mode("overwrite").parquet(f"{path}/version={version}/{name}")
    except BaseException:
        _released(spark, path, version)
        raise
    spark.createDataFrame([(version, base)], SAVED).coalesce(1).write.mode("append").parquet(f"{path}/saved")
    return load(spark, path, key, version)


def _claimed(spark: SparkSession, path: str, last: int | None) -> list[int]:
    """Versions after the last one whose save was given up: claimed more than ``STALE_MS`` ago."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/claims")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    now = int(spark._jvm.java.lang.System.currentTimeMillis())
    each = [(int(f.getPath().getName()), f.getModificationTime()) for f in system.listStatus(folder) if f.getPath().getName().isdigit()]
    return [v for v, at in each if v > (last or 0) and now - at > STALE_MS]


STALE_MS = 6 * 3_600_000


def load(spark: SparkSession, path: str, key: str | None = None, version: int | None = None) -> Vault:
    """The last version that was finished, or the one asked for: the whole one before it, with the changes since."""
    found = _saved(spark, path)
    version = version or max(found, default=0)
    if version not in found:
        raise FileNotFoundError(f"no vault is saved under {path}" if not found else f"{path} has no version {version}")
    chain = [version]
    while found[chain[-1]] is not None:
        chain.append(found[chain[-1]])
    tables = {}
    for name, keys in TABLES.items():
        parts = [spark.read.parquet(f"{path}/version={v}/{name}").withColumn("of", F.lit(v)) for v in chain]
        columns = [c for c in parts[-1].columns if c != "of"]
        if len(parts) > 1:
            all_ = parts[-1].withColumn("gone", F.lit(False))
            for part in parts[:-1]:
                all_ = all_.unionByName(part)
            newest = all_.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys], "gone"), "of").alias("row"))
            table = newest.where("not row.gone").select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in columns])
        else:
            table = parts[0].drop("of")
        tables[name] = table.withColumn("value", F.aes_decrypt(F.unbase64("value"), F.lit(key)).cast("string")) if key is not None and name == "entities" else table
    return Vault(**tables, version=version)
