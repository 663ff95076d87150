"""Raw catalog to labelled, screened, split and scaled feature tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.config import CatalogConfig
from shelfscope.operators import anomaly, clean, features, labels, quality, split, tfidf
from shelfscope.sources.raw_csv import read_raw_csv
from shelfscope.sources.tables import write_json, write_table, write_text_index

TASKS = ("hit", "hidden_gem")
KEYS = ("appid", "short_description", "split", "task")


@dataclass(frozen=True)
class Prepared:
    """The stored results of a run."""

    catalog: DataFrame
    features: DataFrame
    splits: DataFrame
    all_scaled: DataFrame
    meta: DataFrame
    columns: list[str]


def prepare(raw: DataFrame, cfg: CatalogConfig, out: str, order: Sequence[str], keep_text: bool = True) -> Prepared:
    """Clean, screen, label, engineer, split and scale; every stage's table goes under ``out``.

    The labelled table is written once and read back, so that later stages do not repeat
    the scan, the dedupe and the scoring.
    """
    spark = raw.sparkSession
    funnel = clean.cleaning_funnel(raw, cfg, order)
    cleaned = write_table(clean.clean(raw, cfg, order), f"{out}/cleaned")
    labelled = write_table(labels.make_labels(anomaly.screen(cleaned, cfg), cfg), f"{out}/labelled")
    engineered = features.engineer(labelled, cfg)
    catalog = write_table(features.display_catalog(engineered), f"{out}/catalog")

    guarded, leaked = features.leakage_guard(engineered, cfg)
    columns = features.feature_columns(guarded, KEYS)
    table = write_table(features.as_float(guarded, columns), f"{out}/features")

    parts, everything = None, None
    for task in TASKS:
        rows = split.stratified_split(table.drop("short_description"), f"target_{task}", "appid", cfg.test_size, cfg.seed)
        scaler = split.Scaler.fit(rows.where("split = 'train'"), columns)
        write_table(scaler.to_table(spark), f"{out}/scaler_{task}")
        scaled = scaler.transform(rows).withColumn("task", F.lit(task))
        parts = scaled if parts is None else parts.unionByName(scaled)
        if task == "hidden_gem":
            everything = write_table(scaler.transform(table.drop("short_description")), f"{out}/all_scaled")
        if keep_text and "short_description" in table.columns:
            train = table.join(rows.where("split = 'train'").select("appid"), "appid", "left_semi")
            index = tfidf.fit_text_index(
                table.select("appid", "short_description"), "appid", "short_description",
                cfg.tfidf_terms, cfg.ngram_max, fit_on=train)
            write_text_index(index, f"{out}/text_{task}")
    splits = write_table(parts, f"{out}/splits", ["task", "split"])

    digest = quality.fingerprint(table, columns).first()["data_hash"]
    settings = {k: str(v) for k, v in dataclasses.asdict(cfg).items()}
    meta = quality.run_metadata(labels.label_summary(labelled, cfg), funnel, len(columns), leaked, settings, digest)
    write_json(meta, f"{out}/meta")
    return Prepared(catalog, table, splits, everything, meta, columns)


def prepare_csv(spark: SparkSession, path: str, cfg: CatalogConfig, out: str, multi_line: bool = True,
                split_files: bool = False) -> Prepared:
    """The same from a raw CSV; the first of several copies is the smallest by name and date. Many tasks read one large
    file with ``multi_line=False``, where no text holds a line break, or with ``split_files``, where some do."""
    return prepare(read_raw_csv(spark, path, multi_line=multi_line, split_files=split_files), cfg, out, ["name", "release_date"])
