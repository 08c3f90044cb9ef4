"""Markdown of summaries and reports; deterministic, from the JSON trees."""

from __future__ import annotations


def _table(rows: list[dict], most: int = 20) -> list[str]:
    if not rows:
        return ["None found.", ""]
    names = list(rows[0])
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return ["| " + " | ".join(names) + " |", "|" + " - |" * len(names), *["| " + " | ".join(show(r.get(n)) for n in names) + " |" for r in rows[:most]], ""]


def summary_markdown(tree: dict) -> str:
    out = ["# Exploratory summary", ""]
    for key, title in (("missingness", "Missing values"), ("co_missingness", "Missing together"), ("labels", "Labels"), ("rare_classes", "Rare classes"), ("numeric", "Numeric columns"), ("scaling", "Scaling"), ("outliers", "Outliers"), ("asset_summary", "Assets")):
        if key in tree:
            out += [f"## {title}", "", *_table(tree[key])]
    for name, rows in (tree.get("label_noise") or {}).items():
        out += [f"## Label noise: {name.replace('_', ' ')}", "", *_table(rows)]
    return "\n".join(out)


def leakage_markdown(tree: dict) -> str:
    summary = tree["summary"]
    out = ["# Leakage report", "", f"Overall risk: {summary['overall_risk_level']} ({summary['overall_severity_score']:.3g}).", ""]
    for check in tree["checks"]:
        out += [f"## {check['risk_type'].replace('_', ' ')}", "", f"Risk: {check['risk_level']} ({check['severity_score']:.3g}). {' '.join(check['notes'])}".rstrip(), "", *(_table(check["details"]) if check["details"] else [])]
    return "\n".join(out)
