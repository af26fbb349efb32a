"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame

#: Query name -> module of this subpackage that defines a function of that name.
MODULES = {
    "op1_substring": "substring",
    "op2_lm_score": "lm",
    "op3_near_duplicates": "near",
    "op4_quality": "quality",
    "op5_warc": "warc",
    "op6_html": "html_text",
    "op7_quotes": "quotes",
    "op8_toxicity": "toxicity",
    "op9_bpe": "bpe",
    "op10_decontaminate": "decontaminate",
    "op11_periodic_runs": "periodic",
    "op12_hard_negatives": "negatives",
    "op13_line_dedup": "lines",
}


def _query(name: str) -> Callable[..., DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f"{__package__}.{MODULES[name]}"), name)(spark, sf_dir)


def queries() -> dict[str, Callable[..., DataFrame]]:
    return {name: _query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return dict(oracles.SQL)
