"""Named relations, resolved with all they rest on into one WITH query that Catalyst optimises as a whole.

A relation is SQL text, or a text for each dialect. Parameters stand in it as $name. A caller's frames take the place
of relations of those names: `run(spark, "snp_stats", geno=my_genotypes)`. A step that a query names more than once is
written first and read from there, as is a relation that Python makes unless it is streamed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .scratch import stored

RELATIONS: dict[str, str | dict[str, str]] = {}
#: The reference's values, and those for the small tables of the driver.
DEFAULTS: dict[str, object] = {}
FIXTURE: dict[str, object] = {}
STEPS: set[str] = set()
#: Relations over the driver's tables that stand for a user's inputs: `run` wants those as frames.
VIEWS: set[str] = set()
#: Relations that Python makes in Spark: what they need, and the function of those frames and the parameters.
PYTHON: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}
#: Those of them that a query names once aren't written: as many rows as pairs, made as they are read.
STREAMED: set[str] = set()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


def register(relations: Mapping[str, str | dict[str, str]], defaults: Mapping[str, object] | None = None, fixture: Mapping[str, object] | None = None, steps: tuple[str, ...] = ()) -> None:
    if both := RELATIONS.keys() & relations.keys():
        raise ValueError(f"registered twice: {sorted(both)}")
    RELATIONS.update(relations)
    DEFAULTS.update(defaults or {})
    FIXTURE.update(fixture or {})
    STEPS.update(steps)


def _text(name: str, dialect: str, parameters: Mapping[str, object]) -> str:
    body = RELATIONS[name]
    body = body if isinstance(body, str) else body[dialect]
    if dialect == "spark":  # ranks are 64-bit, as elsewhere
        body = re.sub(r"row_number\(\) over (\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))", r"cast(row_number() over \1 as bigint)", body)
    return re.sub(r"\$(\w+)", lambda m: str(parameters[m[1]]), body)


def _words(text: str) -> set[str]:
    return set(re.findall(r"\b[a-z_]\w*\b", re.sub(r"'[^']*'", "''", text)))


def _order(name: str, dialect: str, given: set[str], parameters: Mapping[str, object]) -> tuple[list[tuple[str, str]], set[str], dict[str, int]]:
    """Relations that `name` rests on, each after what it names; what must be given; how often each is named, over all paths."""
    order: list[tuple[str, str]] = []
    reads: set[str] = set()
    named: dict[str, dict[str, int]] = {}

    def visit(one: str) -> None:
        if one in named:
            return
        named[one] = {}
        if one in given or one not in RELATIONS or (dialect == "spark" and one in PYTHON):
            reads.add(one)
            return
        text = _text(one, dialect, parameters)
        for other in sorted(_words(text) & (RELATIONS.keys() | PYTHON.keys() | given | set(TABLES)) - {one}):
            if n := len(re.findall(rf"\b(?:from|join)\s+{other}\b", text)):
                named[one][other] = n
                visit(other)
        order.append((one, text))

    visit(name)
    times = dict.fromkeys(named, 0) | {name: 1}
    for one, _ in reversed(order):
        for other, n in named[one].items():
            times[other] += n * times[one]
    return order, reads, times


def resolve(name: str, dialect: str, given: set[str] = frozenset(), parameters: Mapping[str, object] | None = None) -> tuple[str, set[str]]:
    """The WITH query of a relation, and the given frames and base tables that it reads."""
    order, reads, _ = _order(name, dialect, set(given), {**DEFAULTS, **(parameters or {})})
    if not order:
        return f"select * from {name}", reads
    recursive = "recursive " if any("/*recursive*/" in t for _, t in order) else ""
    named = ",\n".join(f"{n} as ({t})" for n, t in order)
    return f"with {recursive}{named}\nselect * from {name}", reads


def _evaluate(spark: SparkSession, name: str, frames: dict[str, DataFrame], parameters: Mapping[str, object], base: Callable[[str], DataFrame], views: bool = True) -> DataFrame:
    """The relation's frame; frames gains the steps written and the tables read on the way."""
    order, reads, times = _order(name, "spark", set(frames) | (set() if views else VIEWS), parameters)
    for one in sorted(reads - frames.keys()):
        if one in PYTHON:
            needs, make = PYTHON[one]
            made = {n: frames[n] if n in frames else _evaluate(spark, n, frames, parameters, base, views) for n in needs}
            rows = make(parameters, **made)
            frames[one] = rows if one in STREAMED and times[one] == 1 else stored(rows, one)
        else:
            frames[one] = base(one)
    for one, _ in order:
        if one in STEPS and one != name and times[one] > 1 and one not in frames:
            frames[one] = stored(_evaluate(spark, one, frames, parameters, base, views), one)
    if name in frames:
        return frames[name]
    text, reads = resolve(name, "spark", set(frames), parameters)
    for one in reads:
        text = re.sub(rf"\b(from|join)(\s+){one}\b", rf"\1\2{{{one}}}", text)
    return spark.sql(text, **{n: frames[n] for n in reads})


def run(spark: SparkSession, name: str, parameters: Mapping[str, object] | None = None, **frames: DataFrame) -> DataFrame:
    """The relation over the caller's frames."""

    def missing(one: str) -> DataFrame:
        raise ValueError(f"{name} needs a frame {one}")

    return _evaluate(spark, name, dict(frames), {**DEFAULTS, **(parameters or {})}, missing, views=False)


def over_tables(spark: SparkSession, sf_dir: str, name: str, parameters: Mapping[str, object] | None = None) -> DataFrame:
    """The relation over the driver's tables, from which the genotype views are derived."""
    return _evaluate(spark, name, {}, {**DEFAULTS, **FIXTURE, **(parameters or {})}, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))


def oracle(name: str, parameters: Mapping[str, object] | None = None) -> str:
    """The relation for DuckDB, over views of the driver's tables."""
    return resolve(name, "duckdb", set(), {**FIXTURE, **(parameters or {})})[0]
