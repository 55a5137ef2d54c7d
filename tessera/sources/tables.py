"""Sources: files with declared schemas, literal relations, connectors.  NaN becomes NULL at the door."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemas of the file formats the operators are made for (fixed values).
GRILL_SUMMARY = "grill_type string, pre_heat_time int, fuel_cost_per_meal double, market_share double, easiness_to_use int, life_span_year int, initial_investment int"
COOK_OFF = "item_material string, device_id int, grill_type string, user_satisfaction double, fuel_cost double"
TASTE_TEST = "sample_item_index int, item_material string, is_frozen boolean, grill_type string, thumbs_up_score double, guess_grill_correct boolean"
CHANNELS = "rank string, subscribers int, grades string, youtuber string, uploads int, views double"
WEEKLY_SALES = "date int, sales double"
SFT_ROWS = "instruction string, input string, output string"
PREFERENCES = "prompt string, chosen string, rejected string"
STEPS = "prompt string, completions array<string>, labels array<boolean>"
TRAINER_STATE = "log_history array<struct<epoch: double, grad_norm: double, learning_rate: double, loss: double, step: int>>"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN to NULL in every top-level float column."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in floats else F.col(c) for c in df.columns]) if floats else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder."""
    return nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header that the schema's names replace; a byte-order mark is skipped."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def jsonl_splits(spark: SparkSession, files: dict[str, str], schema: str) -> DataFrame:
    """JSON lines of several named splits, with their name in ``split``."""
    parts = [spark.read.schema(schema).json(p).withColumn("split", F.lit(s)) for s, p in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A relation from values in the program."""
    return spark.createDataFrame(rows, schema)


def from_columns(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A relation from equally long lists."""
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files under ``folder`` with the name of their directory as label."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{bmp,jpg,jpeg,png}").load(folder)
    return files.select("path", "length", "content", F.element_at(F.split("path", "/"), -2).alias("label"))


def quotes(df: DataFrame, symbol: str, day: str, value: str, start: date, end: date) -> DataFrame:
    """A market-data scan: (symbol, date, close) between two dates; the range reaches the file scan."""
    rows = df.where(F.col(day).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return rows.select(F.col(symbol).alias("symbol"), F.col(day).cast("date").alias("date"), F.col(value).alias("close"))


def year_back(day=None):
    """The same day one year before ``day`` (today when not given); February 29 becomes the 28th."""
    return F.add_months(day if day is not None else F.current_date(), -12)


@dataclass
class Settings:
    """Run settings; numbers written as text (``2e-4``) are read as numbers."""

    values: dict = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> "Settings":
        """From a YAML file where a YAML parser is installed, else from JSON."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml

            return cls(yaml.safe_load(text) or {})
        except ImportError:
            return cls(json.loads(text))

    @classmethod
    def from_arguments(cls, arguments: list[str], option: str = "config") -> "Settings":
        """From command-line options: ``--config FILE`` is read first, ``--a.b VALUE`` then replaces the value at that path."""
        if len(arguments) % 2 or any(not x.startswith("--") for x in arguments[::2]):
            raise ValueError("options are pairs of --name and value")
        given = {k[2:]: v for k, v in zip(arguments[::2], arguments[1::2])}
        out = cls.read(given.pop(option)) if option in given else cls()
        for path, value in given.items():
            *above, last = path.split(".")
            at = out.values
            for key in above:
                at = at.setdefault(key, {})
            at[last] = value
        return out

    def get(self, path: str, default=None):
        at = self.values
        for key in path.split("."):
            if not isinstance(at, dict) or key not in at:
                return default
            at = at[key]
        return at

    def number(self, path: str, default: float) -> float:
        return float(self.get(path, default))
