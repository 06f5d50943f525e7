"""Readers and writers. Every reader gives a lazy DataFrame; nothing is pulled to the driver but
headers and file names. Files are listed, opened and removed through Hadoop's FileSystem, so paths
may lie on any storage that Spark reads."""

from __future__ import annotations

import csv
import fnmatch
import json
from collections import defaultdict
from collections.abc import Iterable, Sequence
from pathlib import PurePosixPath as Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sufragio.functions.text import fold_upper

LATIN = "ISO-8859-1"
NUMBER = "(-?[0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"


def _storage(path: str):
    """The file system of a path, and the path as it wants it."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _files(root: str) -> list[str]:
    """All files under root; those of the local system without their scheme."""
    fs, p = _storage(root)
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString().removeprefix("file:"))
    return sorted(out)


def open_fact(spark: SparkSession, path: str, view: str | None = None, keep: bool = False, **csv_options: str) -> DataFrame:
    """A Parquet or CSV fact table by its suffix, as a lazy view, or kept in memory and disk."""
    fs, p = _storage(path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    suffix = Path(str(path).rstrip("/")).suffix.lower()
    if suffix == ".parquet" or (not suffix and any(f.endswith(".parquet") for f in _files(path))):
        df = spark.read.parquet(path)
    elif suffix in (".csv", ".txt"):
        df = read_csv(spark, [path], **csv_options)
    else:
        raise ValueError(f"not a Parquet or CSV source: {path}")
    df = df.cache() if keep else df
    if view:
        df.createOrReplaceTempView(view)
    return df


def columns_of(df: DataFrame) -> set[str]:
    return {c.upper() for c in df.columns}


def first_line(path: str, encoding: str) -> str:
    """The first line of a file, or of the first file with content in a folder; no Spark job."""
    fs, p = _storage(path)
    jvm = SparkSession.active()._jvm
    for name in [f for f in _files(path) if not Path(f).name.startswith(("_", "."))] if fs.getFileStatus(p).isDirectory() else [str(path)]:
        at = jvm.org.apache.hadoop.fs.Path(name)
        stream = fs.open(at)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(fs.getConf()).getCodec(at)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, encoding))
        line = reader.readLine()
        reader.close()
        if line is not None:
            return line
    return ""


def read_csv(spark: SparkSession, paths: Sequence[str], sep: str = ";", encoding: str = LATIN, malformed: str = "DROPMALFORMED") -> DataFrame:
    """All columns as text under cleaned names (outer blanks removed, capitals). Files are grouped
    by header, each group read in one scan, and the groups united by name."""
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    options = {"header": True, "sep": sep, "encoding": encoding, "mode": malformed, "quote": '"', "escape": '"'}
    for p in paths:
        groups[tuple(next(csv.reader([first_line(p, encoding)], delimiter=sep), []))].append(p)
    out = None
    for names, own in groups.items():
        schema = ", ".join(f"`{n.replace('`', '') or f'_c{i}'}` string" for i, n in enumerate(names))
        part = spark.read.options(**options).schema(schema).csv(own)
        part = part.toDF(*[n.strip().strip("\ufeff").upper() for n in part.columns]).withColumn("__file", F.col("_metadata.file_path"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("no files")
    return out


def discover(root: str, patterns: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """Files under root whose names match, in order, without those whose name or path matches an
    exclusion; each once."""
    found = {f for f in _files(root) if any(fnmatch.fnmatch(Path(f).name, p) for p in patterns)}
    drop = lambda p: any(fnmatch.fnmatch(Path(p).name.lower(), x.lower()) or fnmatch.fnmatch(p.lower(), x.lower()) for x in exclude)
    return sorted(p for p in found if not drop(p))


def year_of_name(path: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), "(20[0-9]{2})", 1).try_cast("int")


def write(df: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet (Zstandard) or CSV by suffix; anything else is an error."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    writer = df.write.mode(mode).partitionBy(*partition) if partition else df.write.mode(mode)
    if suffix == ".parquet":
        writer.option("compression", "zstd").parquet(path)
    elif suffix == ".csv":
        writer.option("header", True).option("sep", ";").csv(path)
    else:
        raise ValueError(f"not a Parquet or CSV target: {path}")


def convert(spark: SparkSession, source: str, target: str, **csv: str) -> None:
    """CSV to Zstandard Parquet."""
    write(read_csv(spark, [source], **csv).drop("__file"), target)


def publish(df: DataFrame, root: str, release: str, keep: int = 3, remove: bool = False) -> list[str]:
    """Write a snapshot under release=..., and name the older releases beyond the newest `keep`,
    which are removed if so asked."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{root}/release={release}")
    fs, p = _storage(root)
    releases = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("release="))
    old = releases[:-keep] if len(releases) > keep else []
    for name in old if remove else []:
        fs.delete(_storage(f"{root}/{name}")[1], True)
    return old


# Headers of coordinate tables, the first present one counts.
COORDINATES = {
    "codigo": ("CD_MUNICIPIO", "COD_MUNICIPIO", "MUNICIPIO_ID", "MUNICIPIO_CODE", "IBGE", "ID"), "uf": ("SG_UF", "UF", "STATE"),
    "municipio": ("NM_MUNICIPIO", "NM_UE", "MUNICIPIO", "MUNICIPALITY", "CITY", "NAME"), "latitude": ("LATITUDE", "LAT", "VL_LATITUDE"), "longitude": ("LONGITUDE", "LON", "LNG", "VL_LONGITUDE"),
}


def read_coordinates(spark: SparkSession, path: str, **csv_options: str) -> DataFrame:
    """codigo, uf, municipio, latitude, longitude of a coordinates table (Parquet or CSV) whose
    columns stand under any of their names; rows without valid coordinates are left out, and a
    table without coordinate columns has no rows."""
    df = open_fact(spark, path, **csv_options)
    there = {c.strip().upper(): c for c in df.columns}
    at = {k: next((F.col(f"`{there[n]}`") for n in names if n in there), F.lit(None)).cast("string") for k, names in COORDINATES.items()}
    number = lambda k: F.replace(F.trim(at[k]), F.lit(","), F.lit(".")).try_cast("double")
    out = df.select(F.regexp_replace(F.trim(at["codigo"]), "\\.0+\\z", "").alias("codigo"), F.upper(F.trim(at["uf"])).alias("uf"), F.trim(at["municipio"]).alias("municipio"), number("latitude").alias("latitude"), number("longitude").alias("longitude"))
    return out.filter(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & ~((F.col("latitude") == 0) & (F.col("longitude") == 0)))


def official_seats(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """SG_UF, NM_UE, DS_CARGO, QT_VAGA of vacancy files."""
    df = read_csv(spark, paths)
    return df.select(F.upper(F.trim("SG_UF")).alias("uf"), F.trim("NM_UE").alias("municipio"), F.upper(F.trim("DS_CARGO")).alias("cargo"), F.trim("QT_VAGA").try_cast("bigint").alias("vagas"))


def official_mayors(seats: DataFrame) -> DataFrame:
    """uf, oficial: places with at least one mayor's seat."""
    own = seats.filter((F.col("cargo") == "PREFEITO") & (F.col("vagas") >= 1)).select("uf", fold_upper(F.col("municipio")).alias("m")).distinct()
    return own.groupBy("uf").agg(F.count(F.lit(1)).alias("oficial"))


def read_geojson(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """One row per feature: properties (map with upper-case keys), kind, latitude and longitude of
    the mean of all its coordinate pairs, whatever the depth of the geometry. Unreadable files
    give no rows."""
    shape = "struct<features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>>"
    whole = spark.read.text(list(paths), wholetext=True).select(F.from_json("value", shape).alias("g"))
    each = whole.select(F.explode("g.features").alias("f"))
    pair = lambda k: F.transform(F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(f"\\[\\s*{NUMBER}\\s*,\\s*{NUMBER}"), F.lit(k)), lambda x: x.try_cast("double"))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))
    keys = F.map_from_entries(F.transform(F.map_entries("f.properties"), lambda e: F.struct(F.upper(e["key"]).alias("key"), e["value"].alias("value"))))
    return each.select(keys.alias("properties"), F.col("f.geometry.type").alias("kind"), mean(pair(2)).alias("latitude"), mean(pair(1)).alias("longitude"))


def sha256(path: str) -> str:
    fs, p = _storage(path)
    stream = fs.open(p)
    out = SparkSession.active()._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    stream.close()
    return out


def manifest(paths: Sequence[str], **about: object) -> dict:
    """Sizes and SHA-256 of artefacts."""
    size = lambda path: (lambda fs, p: fs.getFileStatus(p).getLen())(*_storage(path))
    return {**about, "files": [{"path": str(p), "bytes": size(p), "sha256": sha256(p)} for p in sorted(paths)]}


def write_json(value: object, path: str) -> None:
    fs, p = _storage(path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True, default=str).encode()))
    out.close()
