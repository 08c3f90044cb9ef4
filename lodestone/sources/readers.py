"""Sources and sinks: manifests, SQL sources, JSON and JSONL texts, skeleton files, asset listings, CSV and Markdown."""

from __future__ import annotations

import io
import json
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.stats import q

# Tokens that manifests use for a missing value.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
JOIN_TYPES = {"left": "left", "inner": "inner", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}
KEYPOINTS = "array<array<struct<x:double,y:double,c:double>>>"
BOXES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return normalise((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def normalise(df: DataFrame) -> DataFrame:
    """NaN and missing-value tokens become null."""
    out = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.StringType):
            c = F.when(~F.trim(c).isin(*NA_TOKENS), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def build_query(spark: SparkSession, table: DataFrame | str, joins: Sequence[Mapping] = (), columns: Sequence[str] | None = None, where: str | None = None, limit: int | None = None) -> DataFrame:
    """A manifest from a table and joins {table, on, type}; conditions are SQL expressions of a trusted caller."""

    def load(t: DataFrame | str) -> DataFrame:
        if isinstance(t, str):
            if not spark.catalog.tableExists(t):
                raise ValueError(f"no table {t}")
            return spark.table(t).alias(t)
        return t

    out = load(table)
    for j in joins:
        how = str(j.get("type", "left")).lower().replace(" join", "").replace(" outer", "")
        if how not in JOIN_TYPES:
            raise ValueError(f"unknown join type {how}")
        out = out.crossJoin(load(j["table"])) if how == "cross" else out.join(load(j["table"]), F.expr(j["on"]), JOIN_TYPES[how])
    if where:
        out = out.where(where)
    if columns:
        out = out.selectExpr(*columns)
    return out.limit(limit) if limit is not None else out


def read_jdbc(spark: SparkSession, url: str, query: str, driver: str | None = None, **options: str) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    return (reader.option("driver", driver) if driver else reader).options(**options).load()


def redact(url: str) -> str:
    """A connection string without its password."""
    return re.sub(r"(://[^:/@]+:)[^@]*(@)", r"\1***\2", url)


def json_safe(value):
    """NaN and infinities as None, times as ISO text, NumPy values as Python's."""
    if isinstance(value, Mapping):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    if isinstance(value, np.generic):
        return json_safe(value.item())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value.isoformat() if hasattr(value, "isoformat") else value


def write_json(tree, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(json_safe(tree), indent=2, ensure_ascii=False), encoding="utf-8")


def read_json(path: str):
    return json.loads(Path(path).read_text(encoding="utf-8"))


def union_assets(*parts: DataFrame) -> DataFrame:
    """Rows of several modalities in one frame; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def existing_paths(df: DataFrame, path: str, root: str) -> DataFrame:
    """Whether each path exists below `root`, by its relative path or else its name. Contents are not read."""
    spark = df.sparkSession
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("_p"))
    names = listed.select(F.regexp_extract("_p", "[^/]*$", 0).alias("_n")).distinct()
    base = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(F.col(q(path)), r"^(\./)+", ""))
    full = listed.select(F.regexp_replace("_p", "^file:/+", "/").alias("_p")).distinct()
    found = df.withColumn("_full", F.regexp_replace(base, "^file:/+", "/")).withColumn("_name", F.regexp_extract(F.col(q(path)), "[^/]*$", 0))
    joined = found.join(full, F.col("_full") == F.col("_p"), "left").join(names, F.col("_name") == F.col("_n"), "left")
    return joined.withColumn("path_exists", F.col("_p").isNotNull() | F.col("_n").isNotNull()).drop("_full", "_name", "_p", "_n")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_leaves(value, keys: Sequence[str] = ()) -> list[str]:
    """String leaves of a JSON value; in an object that holds texts under `keys`, these alone."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [s for v in value for s in json_leaves(v, keys)]
    if isinstance(value, dict):
        chosen = [s for k in keys if k in value for s in json_leaves(value[k], keys)]
        return chosen or [s for v in value.values() for s in json_leaves(v, keys)]
    return []


def json_text(df: DataFrame, column: str, keys: Sequence[str] = (), lines: bool = False) -> DataFrame:
    """Adds `text`: the string leaves of a JSON column, one a line. lines: each line is JSON or else plain text."""

    def one(raw: str | None) -> str | None:
        if raw is None:
            return None
        try:
            return "\n".join(json_leaves(json.loads(raw), keys))
        except ValueError:
            return raw if lines else None

    @F.pandas_udf("string")
    def parse(s: pd.Series) -> pd.Series:
        if lines:
            return s.map(lambda raw: None if raw is None else "\n".join(t for line in raw.splitlines() if line.strip() for t in [one(line)] if t))
        return s.map(one)

    return df.withColumn("text", parse(F.col(q(column))))


def read_skeletons(spark: SparkSession, path: str) -> DataFrame:
    """Skeleton files (.npz): path, keypoints, boxes, fps, width, height, skeleton_error. Pickled arrays are refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[k : k + 64] for whole in batches for k in range(0, len(whole), 64)):
            out = []
            for p, raw in zip(batch["path"], batch["content"], strict=True):
                row = {"path": p, "keypoints": None, "boxes": None, "fps": None, "width": None, "height": None, "skeleton_error": None}
                try:
                    z = np.load(io.BytesIO(raw), allow_pickle=False)
                    row["keypoints"] = [[{"x": float(j[0]), "y": float(j[1]), "c": float(j[2])} for j in f] for f in z["keypoints"]]
                    row["boxes"] = [dict(zip(("x1", "y1", "x2", "y2"), map(float, b), strict=True)) for b in z["boxes"]]
                    row |= {"fps": float(z["fps"]), "width": int(z["width"]), "height": int(z["height"])}
                except Exception as e:  # a file that can't be read is a finding
                    row["skeleton_error"] = (str(e) or type(e).__name__)[:200]
                out.append(row)
            yield pd.DataFrame(out)

    return files.select("path", "content").mapInPandas(run, f"path string, keypoints {KEYPOINTS}, boxes {BOXES}, fps double, width long, height long, skeleton_error string")


def scene_manifest(df: DataFrame, column: str = "value") -> DataFrame:
    """Manifest rows (category, blurred_face, filename) from a JSON list of {"<class ...Scene>": {_filename, attributes}}."""
    items = F.from_json(F.col(q(column)), "array<map<string,struct<_filename:string,attributes:struct<blurred_faces:string>>>>")
    entries = df.select(F.explode(items).alias("m")).select(F.explode("m").alias("k", "v"))
    category = F.regexp_extract("k", r"(\w+?)Scene", 1)
    return entries.select(category.alias("category"), F.col("v.attributes.blurred_faces").alias("blurred_face"), F.concat(category, F.lit("/"), F.regexp_extract("v._filename", "[^/]*$", 0)).alias("filename"))


def markdown(title: str, sections: Mapping[str, DataFrame], most: int = 20) -> str:
    """A report of small tables."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|") for v in r) + " |" for r in df.limit(most).collect()]
        out.append("")
    return "\n".join(out)
