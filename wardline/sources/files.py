"""Files as rows: reading, bounding, decoding, checked JSON, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import fixed_values as V
from wardline.functions.paths import basename
from wardline.functions.text import let, valid_json

BOM = "\ufeff"


def read_text_files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """Every file under a folder as ``(repo, path, size, content)``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + "\\Q" + root.rstrip("/").removeprefix("file:") + "/\\E", "")
    return raw.select(F.lit(repo).alias("repo"), relative.alias("path"), F.col("length").alias("size"), "content")


def candidate_files(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """Tracked files and untracked ones that are not ignored, each once; of several rows for a path a tracked one counts."""
    loose = untracked.where(~F.col("ignored")).drop("ignored")
    both = tracked.withColumn("_loose", F.lit(0)).unionByName(loose.withColumn("_loose", F.lit(1)))
    return both.groupBy("repo", "path").agg(F.min_by(F.struct(*tracked.columns), "_loose").alias("f")).select("f.*")


# --- content -------------------------------------------------------------------------------------


def bounded(content: Column, max_bytes: int | None = None, chunk: int = V.PARTIAL_CHUNK_BYTES) -> Column:
    """struct<head, tail, is_partial>: the whole content or, where a bound is asked for, the two ends of what exceeds it."""
    big = F.lit(False) if max_bytes is None else F.octet_length(content) > max_bytes
    return F.struct(
        F.when(big, F.substring(content, 1, chunk)).otherwise(content).alias("head"),
        F.when(big, F.substring(content, -chunk, chunk)).alias("tail"),
        big.alias("is_partial"),
    )


def bounded_content(df: DataFrame, content: str, max_bytes: int | None = None, chunk: int = V.PARTIAL_CHUNK_BYTES) -> DataFrame:
    """Text or binary content over ``max_bytes`` becomes its first and last ``chunk`` joined by a line break."""
    parts = df.withColumn("_b", bounded(F.col(content), max_bytes, chunk))
    newline = F.lit(b"\n") if dict(df.dtypes)[content] == "binary" else F.lit("\n")
    joined = F.when(F.col("_b.is_partial"), F.concat("_b.head", newline, "_b.tail")).otherwise(F.col("_b.head"))
    return parts.withColumn(content, joined).withColumn("is_partial", F.col("_b.is_partial")).drop("_b")


def _utf16(data: Column, big_endian: Column) -> Column:
    even = F.substring(data, F.lit(1), (F.octet_length(data) - F.octet_length(data) % 2).cast("int"))
    return F.when(big_endian, F.decode(even, "UTF-16BE")).otherwise(F.decode(even, "UTF-16LE"))


def decode_content(df: DataFrame, content: str = "content", max_bytes: int | None = None, chunk: int = V.PARTIAL_CHUNK_BYTES) -> DataFrame:
    """Add ``text``, ``is_partial`` and ``is_binary``: byte order marks decide UTF-16, everything else is UTF-8 with
    malformed bytes replaced. A NUL anywhere marks the content as binary; its text is there all the same, so nothing hides behind it."""
    parts = df.withColumn("_b", bounded(F.col(content), max_bytes, chunk))
    head, tail = F.col("_b.head"), F.col("_b.tail")
    mark = F.hex(F.substring(head, 1, 2))
    wide = mark.isin("FFFE", "FEFF")
    binary = ~wide & (F.contains(head, F.lit(b"\x00")) | F.coalesce(F.contains(tail, F.lit(b"\x00")), F.lit(False)))
    utf8 = lambda c: F.make_valid_utf8(c.cast("string"))
    body = F.substring(head, F.lit(3), F.octet_length(head))
    join = lambda first, second: F.when(F.col("_b.is_partial"), F.concat(first, F.lit("\n"), second)).otherwise(first)
    text = F.when(wide, join(_utf16(body, mark == "FEFF"), _utf16(tail, mark == "FEFF"))).otherwise(join(utf8(head), utf8(tail)))
    return parts.select(
        *df.columns, text.alias("text"), F.col("_b.is_partial").alias("is_partial"), F.coalesce(binary, F.lit(False)).alias("is_binary")
    )


def json_state(text: Column) -> Column:
    """``missing``, ``broken`` or ``ok``; a leading byte order mark is allowed."""
    return F.when(text.isNull(), "missing").when(~valid_json(strip_bom(text)), "broken").otherwise("ok")


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^" + BOM, "")


def read_json_checked(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Add ``input_state`` and the parsed ``json``; broken input is never the same as no input."""
    return df.withColumn("input_state", json_state(F.col(text))).withColumn(
        "json", F.when(F.col("input_state") == "ok", F.from_json(strip_bom(F.col(text)), schema))
    )


# --- manifests -----------------------------------------------------------------------------------------

_FIELDS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]


def declared_deps(manifests: DataFrame) -> DataFrame:
    """``(repo, ecosystem, dep, source)`` of package.json, requirements.txt and pyproject.toml texts."""
    text = strip_bom(F.col("text"))
    name = basename(F.col("path"))
    none = F.array().cast("array<string>")
    node = F.flatten(F.array(*[F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{f}")), none) for f in _FIELDS]))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    required = F.transform(
        F.filter(lines, lambda x: x.rlike("^[A-Za-z0-9._-]") & ~x.startswith("-")),
        lambda x: F.lower(F.regexp_extract(x, r"^([A-Za-z0-9._-]+)", 1)),
    )
    quoted = F.transform(
        F.regexp_extract_all(text, F.lit(r'"([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:[><=~!^;][^\n]*)?"'), F.lit(1)), lambda x: F.lower(x)
    )
    deps = F.when(name == "package.json", node).when(name == "requirements.txt", required).when(name == "pyproject.toml", quoted).otherwise(none)
    ecosystem = F.when(name == "package.json", "node").otherwise("python")
    return manifests.select("repo", ecosystem.alias("ecosystem"), F.explode(F.array_distinct(deps)).alias("dep"), name.alias("source"))


def declared_crons(manifests: DataFrame) -> DataFrame:
    """``(repo, url, schedule)`` of a schedule manifest; the last entry of a path counts."""
    crons = F.from_json(F.get_json_object(strip_bom(F.col("text")), "$.crons"), "array<struct<path:string,schedule:string>>")
    rows = manifests.select("repo", F.posexplode(crons).alias("pos", "c")).where("c.path is not null")
    return rows.groupBy("repo", F.col("c.path").alias("url")).agg(
        F.coalesce(F.max_by("c.schedule", "pos"), F.lit("(no schedule)")).alias("schedule")
    )


def package_states(manifests: DataFrame) -> DataFrame:
    """Per repo: is the root package.json missing, broken or ok?"""
    root = F.when(F.col("path") == "package.json", json_state(F.col("text")))
    is_object = F.when(F.col("path") == "package.json", F.json_object_keys(strip_bom(F.col("text"))).isNotNull())
    seen = manifests.groupBy("repo").agg(F.max(root).alias("state"), F.bool_or(is_object).alias("is_object"))
    return seen.select(
        "repo", let(F.coalesce("state", F.lit("missing")), lambda s: F.when((s == "ok") & ~F.col("is_object"), "broken").otherwise(s)).alias("package_state")
    )
