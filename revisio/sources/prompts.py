"""Prompt catalogues: YAML ``{group}_prompts: [..]`` lists, kept in order
(sampling is by position, and a list may repeat a text)."""
from __future__ import annotations

import os
from typing import Dict, List, Optional

import yaml
from pyspark.sql import DataFrame, SparkSession

DEFAULT_PROMPTS = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources", "prompts.yaml")


def load_prompts(path: Optional[str] = None) -> Dict[str, List[str]]:
    """Driver-side: the catalogue as ``{group: [prompt, ...]}`` (group names
    without the ``_prompts`` suffix). Values are coerced to strings, so an
    entry with a comma stays one prompt, as YAML reads it."""
    with open(path or DEFAULT_PROMPTS, encoding="utf-8") as fh:
        raw = yaml.safe_load(fh) or {}
    out: Dict[str, List[str]] = {}
    for key, items in raw.items():
        group = key[: -len("_prompts")] if key.endswith("_prompts") else key
        out[group] = [str(x) for x in (items or [])]
    return out


def read_prompts(spark: SparkSession, path: Optional[str] = None) -> DataFrame:
    """The catalogue as a table ``(grp STRING, pos INT, prompt STRING)``."""
    rows = [(g, i, p) for g, ps in load_prompts(path).items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "grp string, pos int, prompt string")
