"""Reports as files: one-row results as Markdown or JSON, by way of the cluster's file system."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession

from quire.functions.text import safe_file_name


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """Writes one small text file, replacing what is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def markdown_report(spark: SparkSession, folder: str, theme: str, text: str, outline: str = "", sources: list[str] = (), today: datetime.date | None = None) -> str:
    """The text below a head with theme and date, and its sources, as <date>-<theme>.md; gives the path."""
    day = (today or datetime.date.today()).isoformat()
    parts = [f"# {theme}", f"> {day}", *(["## 提纲", outline] if outline else []), text, *(["## 来源", *(f"- {s}" for s in sources)] if sources else [])]
    return write_text(spark, f"{folder.rstrip('/')}/{day}-{safe_file_name(theme)}.md", "\n\n".join(parts) + "\n")


def json_report(spark: SparkSession, path: str, **results: DataFrame | dict) -> str:
    """Results of a report as one JSON file; a frame must be a report, not a corpus: a row per group at most."""
    plain = {k: [json.loads(r) for r in v.toJSON().collect()] if isinstance(v, DataFrame) else v for k, v in results.items()}
    return write_text(spark, path, json.dumps(plain, ensure_ascii=False, indent=2, default=str))
