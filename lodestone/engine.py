"""The engine: profile, exploratory summary, leakage report and SQL manifests over any Spark-readable table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from lodestone.config import DEFAULTS, Thresholds
from lodestone.operators import assets, eda, leakage, profile, stats
from lodestone.plans.report import leakage_markdown, summary_markdown
from lodestone.sources import readers


class Engine:
    """One session; every method takes a DataFrame and returns a JSON tree of small results."""

    def __init__(self, spark: SparkSession, thresholds: Thresholds = DEFAULTS):
        self.spark, self.t = spark, thresholds

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else readers.read_csv(self.spark, path)

    def from_sql(self, table: DataFrame | str, joins: Sequence[Mapping] = (), columns: Sequence[str] | None = None, where: str | None = None, limit: int | None = None) -> tuple[DataFrame, dict]:
        df = readers.build_query(self.spark, table, joins, columns, where, limit)
        info = {"source_type": "sql", "primary_table": table if isinstance(table, str) else None, "joins": [{k: v for k, v in j.items() if k != "table" or isinstance(v, str)} for j in joins], "where_clause": where, "columns_selected": list(columns or []), "row_limit": limit, "column_names": df.columns}
        return df, info

    def profile(self, df: DataFrame, source: str = "", row_id: str | None = None) -> dict:
        return profile.build_profile(df, source, row_id, self.t)

    def eda(self, df: DataFrame, tree: dict | None = None, row_id: str | None = None, asset_root: str | None = None) -> dict:
        """The exploratory summary in a fixed order of sections."""
        tree = tree or self.profile(df)
        found, unique = tree["candidates"], {c["column_name"]: c["unique_count"] for c in tree["columns"]}
        label = eda.primary_column(unique, found["label"])
        skipped = {*found["path"], *found["identifier"]}
        texts = [r.column_name for r in eda.text_columns(df, tuple(skipped | {label or ""})).collect()] if any(k == "string" for _, k in df.dtypes) else []
        numbers = [c for c in stats.numeric_columns(df) if c not in skipped]
        rows = lambda x: [r.asDict() for r in x.orderBy(*x.columns).limit(200).collect()]  # noqa: E731  200 rows shown, the same in each run
        out = {"columns": {"label": label, "text": texts, "numeric": numbers, **found}, "missingness": rows(eda.missingness(df)), "co_missingness": rows(eda.co_missingness(df, self.t))}
        if label:
            out |= {"labels": rows(eda.label_distribution(df, label)), "rare_classes": rows(eda.rare_classes(df, label, self.t)), "missingness_by_label": rows(eda.missingness_by_label(df, label))}
            out["label_noise"] = {"conflicting_labels": [r for p in found["path"] for r in rows(eda.conflicting_labels(df, p, label))], "label_inconsistency": [r for g in found["grouping"] for r in rows(eda.label_inconsistency(df, g, label))], "class_outliers": rows(eda.class_outliers(df, label, numbers, self.t)) if numbers else []}
            out["grouped_labels"] = {g: rows(eda.grouped_label_distribution(df, g, label)) for g in found["grouping"][:5]}
        if numbers:
            out |= {"numeric": rows(eda.numeric_summaries(df, numbers, self.t)), "scaling": rows(eda.feature_scaling(df, numbers, self.t)), "outliers": rows(eda.outliers(df, numbers, self.t)), "histograms": rows(eda.histogram(df, numbers[:12]))}
            if row_id:
                out["outlier_examples"] = rows(eda.outlier_examples(df, numbers, row_id, t=self.t))
        derived = None
        if row_id and (texts or (asset_root and found["path"])):
            parts = [assets.inline_text_metrics(df, c, row_id, label) for c in texts]
            parts += [assets.file_metrics(df, p, row_id, asset_root) for p in found["path"]] if asset_root else []
            derived = readers.union_assets(*parts).cache()
            measures = [c for c in stats.numeric_columns(derived) if c != "row_index"]
            out["asset_summary"] = rows(eda.numeric_summaries(derived, measures, Thresholds(eda_coverage=0.0)))
            out["asset_outliers"] = rows(eda.outliers(derived, measures, self.t))
        return readers.json_safe(out | {"assets": assets.status(derived)})

    def leakage(self, df: DataFrame, tree: dict | None = None, row_id: str | None = None, split: str | None = None) -> dict:
        tree = tree or self.profile(df)
        found, unique = tree["candidates"], {c["column_name"]: c["unique_count"] for c in tree["columns"]}
        split = split or next((c for c in df.columns if any(s in c.lower() for s in ("split", "fold", "partition"))), None)
        dates = [c for c, kind in df.dtypes if kind.startswith("timestamp") or kind == "date"]
        times = [c for c in found["temporal"] if dict(df.dtypes)[c] != "string"]
        sequences = [c for c in found["temporal"] if any(s in c.lower() for s in ("frame", "clip", "sequence"))][:3]
        entities = [c for c in found["grouping"] if c != split][:5]
        return readers.json_safe(leakage.build_report(df, next(iter(found["path"]), None), eda.primary_column(unique, [c for c in found["label"] if c != split]), split, entities, next(iter(times), None), next(iter(dates), None), row_id, self.t, sequences))

    def markdown(self, summary: dict | None = None, report: dict | None = None) -> str:
        return "\n".join(([summary_markdown(summary)] if summary else []) + ([leakage_markdown(report)] if report else []))
