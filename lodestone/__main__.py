"""python -m lodestone profile|eda|leakage|sql ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from lodestone.engine import Engine
from lodestone.sources import readers


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestone")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("profile", "eda", "leakage"):
        p = sub.add_parser(name)
        p.add_argument("manifest", help="CSV or Parquet")
        p.add_argument("--output", required=True, help="folder for JSON and Markdown")
        p.add_argument("--row-id")
        if name == "eda":
            p.add_argument("--asset-root")
        if name == "leakage":
            p.add_argument("--split")
    p = sub.add_parser("sql")
    p.add_argument("--url", required=True)
    p.add_argument("--query", required=True)
    p.add_argument("--driver")
    p.add_argument("--output", required=True, help="Parquet to write")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    engine = Engine(spark)
    if a.command == "sql":
        df = readers.read_jdbc(spark, a.url, a.query, a.driver)
        df.write.mode("overwrite").parquet(a.output)
        print(json.dumps({"connection_string": readers.redact(a.url), "query": a.query, "output": a.output, "column_names": df.columns}))
        return
    df = engine.read(a.manifest).cache()
    tree = engine.profile(df, a.manifest, a.row_id)
    if a.command == "profile":
        readers.write_json(tree, f"{a.output}/manifest_profile.json")
        return
    result = engine.eda(df, tree, a.row_id, a.asset_root) if a.command == "eda" else engine.leakage(df, tree, a.row_id, a.split)
    name = "eda_summary" if a.command == "eda" else "leakage_report"
    readers.write_json(result, f"{a.output}/{name}.json")
    with open(f"{a.output}/{name}.md", "w", encoding="utf-8") as f:
        f.write(engine.markdown(**{"summary" if a.command == "eda" else "report": result}))


if __name__ == "__main__":
    main()
