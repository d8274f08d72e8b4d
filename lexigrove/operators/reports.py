"""Reports: small tables as Markdown, summaries of an evaluation, and an audit of files against a manifest."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation

#: A report's table has at most this many rows; what is longer belongs in a file.
ROWS = 200


def markdown_table(df: DataFrame, columns: list[str] | None = None) -> str:
    """The first rows of a (small, ordered) table as Markdown; marks that would break it are escaped."""
    names = columns or df.columns
    cell = lambda v: "" if v is None else (f"{v:.4f}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    rows = [[cell(v) for v in r] for r in df.select(*names).limit(ROWS).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [list(names), ["---"] * len(names), *rows])


def evaluation_report(runs: DataFrame, title: str = "Evaluation") -> str:
    """Totals, verdicts, causes and examples of judged runs."""
    full = evaluation.enrich(runs).withColumn("probable_error_cause", evaluation.error_cause())
    order = [F.desc("n"), "value"]
    parts = [
        f"# {title}",
        markdown_table(evaluation.summary_metrics(full)),
        "## Verdicts",
        markdown_table(evaluation.distribution(full, "judge_verdict", "<missing>").orderBy(*order)),
        "## Error causes",
        markdown_table(evaluation.distribution(full.where("is_no"), "probable_error_cause").orderBy(*order)),
    ]
    for wanted in ("Yes", "No"):
        keep = [c for c in ("question_id", "probable_error_cause", "n_citations", "n_retrieved_chunks") if c in full.columns]
        parts += [f"## Examples: {wanted}", markdown_table(evaluation.examples(full, wanted), keep)]
    return "\n\n".join(parts) + "\n"


def write_text(path: str, text: str) -> str:
    """Write a report on the driver, aside and renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(f"{path}.part", path)
    return path


def audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name, result) for files of a manifest (name, sha256): ok, changed, missing; files beside it are extra."""
    both = expected.select("name", F.col("sha256").alias("want")).join(found.select("name", F.col("sha256").alias("got")), "name", "full")
    result = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("got") == F.col("want"), "ok").otherwise("changed")
    return both.select("name", result.alias("result"))
