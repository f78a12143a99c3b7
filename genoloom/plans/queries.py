"""The reference operators' queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..operators import custom, identity, imputation, markers, matrices, mendel, parentage, pedigree, reports, sorting  # noqa: F401
from .. import programs
from ..sources import views  # noqa: F401
from . import engine, files, scalars

MODULES = (reports, markers, mendel, identity, pedigree, matrices, imputation, parentage, sorting)


def _query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return engine.over_tables(spark, sf_dir, name)


#: What SQL can't say: an inverse, an iterative solution (right within a tolerance, which no hash of values allows).
WITHOUT_SQL = {"g_inverse": "g_inverse", "pcg": "pcg"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every reference operator's query."""
    return {name: partial(_query, name=name) for module in MODULES for name in module.QUERIES} | {name: partial(_query, name=of) for name, of in WITHOUT_SQL.items()} | scalars.QUERIES | files.QUERIES | {"hap_tune": programs.hap_tune}


def oracle_sql() -> dict[str, str]:
    """SQL of those that it can express."""
    return {name: engine.oracle(name) for module in MODULES for name in module.QUERIES} | scalars.oracles(engine.oracle("geno")) | files.oracles() | {"hap_tune": programs.hap_tune_oracle()}
