"""Queries of the scalar functions over texts, numbers and times of the driver's tables, and their SQL, written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

_S = "concat('  ', p_name, ' ', chr(9), ' ', p_brand, chr(1), '  (', p_type, ' [', cast(p_size as {t}), '])', chr(92), ',  z', cast(p_retailprice as {t}), '00, é_', p_name, '   ')"
_N = "case p_partkey % 6 when 0 then cast(p_retailprice as {t}) when 1 then concat('-', cast(p_size as {t}), '.5') when 2 then p_name when 3 then concat(' ', cast(p_size as {t}), 'e2 ') when 4 then '99999999999' else '' end"
_P = "case p_partkey % 4 when 0 then concat('/data/', p_name, '/x.txt') when 1 then concat('C:', p_name) when 2 then concat('sub/', p_name) else p_name end"
_L = "case p_partkey % 7 when 0 then ' TRUE' when 1 then 'y' when 2 then 'No' when 3 then '1' when 4 then 'f' when 5 then 'maybe' else '' end"
_D = "(1990 + p_size) * 10000 + (1 + p_partkey % 12) * 100 + 1 + p_partkey % 31"

_c = F.col


def _texts(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.selectExpr("p_partkey as k", *(f"{e.format(t='string')} as {n}" for n, e in columns.items()))


def _from(**columns: str) -> str:
    return "(select p_partkey as k, " + ", ".join(f"{e.format(t='varchar')} as {n}" for n, e in columns.items()) + " from part) t"


def _pick(columns: dict[str, str], made: Callable[[], dict[str, object]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _texts(spark, sf_dir, **columns).select("k", *(e.alias(n) for n, e in made().items()))


_ALL = "regexp_replace({}, '{}', '{}', 'g')"
_UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_DOWN = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REAL = "case when regexp_full_match(trim(n), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then cast(trim(n) as double) else 0 end"

#: name -> (input columns, Spark columns, DuckDB columns)
_SIMPLE: dict[str, tuple[dict[str, str], Callable[[], dict], dict[str, str]]] = {
    "fn_case": ({"s": _S}, lambda: {"upper": X.to_upper(_c("s")), "lower": X.to_lower(_c("s"))}, {"upper": _UP.format("s"), "lower": _DOWN.format("s")}),
    "fn_concat": ({"s": _S, "n": _N}, lambda: {"joined": X.concat(_c("s"), _c("n"))}, {"joined": "rtrim(s, ' ') || rtrim(n, ' ')"}),
    "fn_clean": (
        {"s": _S},
        lambda: {m: X.clean(_c("s"), m) for m in X.CLEAN} | {"special": X.remove_special(_c("s"), "_["), "blanked": X.blank_special(_c("s"))},
        {"alphanum": _ALL.format("rtrim(s, ' ')", "[^A-Za-z0-9 ]", ""), "alpha": _ALL.format("rtrim(s, ' ')", "[^A-Za-z ]", ""), "numeric": _ALL.format("rtrim(s, ' ')", "[^0-9 ]", ""),
         "printable": _ALL.format("rtrim(s, ' ')", "[^ -~]", ""), "identifier": _ALL.format("s", "[^A-Za-z0-9_]", ""), "special": _ALL.format("rtrim(s, ' ')", "[^A-Za-z0-9 _[]", ""), "blanked": _ALL.format("s", "[^A-Za-z0-9]", " ")},
    ),
    "fn_to_string": ({"p": "p_retailprice", "z": "p_size"}, lambda: {"plain": X.to_string(_c("z")), "fixed": X.to_string(_c("p"), "%.2f"), "wide": X.to_string(_c("z"), "%6d")}, {"plain": "cast(z as varchar)", "fixed": "printf('%.2f', p)", "wide": "lpad(cast(z as varchar), 6, ' ')"}),
    "fn_to_number": ({"n": _N}, lambda: {"r8": X.to_real(_c("n")), "i4": X.to_int(_c("n")), "i8": X.to_int(_c("n"), 64)}, {"r8": _REAL, "i4": f"cast(case when abs({_REAL}) <= 2147483647 then round({_REAL}) else 0 end as int)", "i8": f"cast(round({_REAL}) as bigint)"}),
    "fn_tokenise": (
        {"s": _S},
        lambda: {"parts": F.concat_ws("|", X.split_string(_c("s"), ",")), "n_parts": F.size(X.split_string(_c("s"), ",")), "args": F.concat_ws("|", X.parse(_c("s"), ",")), "n_args": F.size(X.parse(_c("s"), ","))},
        {"parts": "array_to_string(list_transform(string_split(rtrim(s, ' '), ','), lambda x: trim(x, ' ')), '|')", "n_parts": "cast(len(string_split(s, ',')) as int)",
         "args": "array_to_string(list_transform(string_split(replace(trim(" + _ALL.format(_ALL.format("trim(s, ' ')", "[\\x00-\\x08\\x0A-\\x1F]", ""), "[\\t ]+", " ") + ", ' '), chr(92) || ',', chr(2)), ','), lambda x: replace(trim(x, ' '), chr(2), ',')), '|')",
         "n_args": "cast(len(string_split(s, ',')) - 1 as int)"},
    ),
    "fn_whitespace": (
        {"s": _S, "d": "concat(cast(p_size as {t}), case p_partkey % 4 when 0 then '.500' when 1 then '.000' when 2 then '.250e10' else '00' end)"},
        lambda: {"compacted": X.compact(_c("s")), "without": X.remove_blanks(_c("s")), "single": X.single_blanks(_c("s")), "short": X.trim_zeros(_c("d"))},
        {"compacted": "trim(" + _ALL.format(_ALL.format("trim(s, ' ')", "[\\x00-\\x08\\x0A-\\x1F]", ""), "[\\t ]+", " ") + ", ' ')", "without": _ALL.format("s", "[\\x00-\\x20]", ""), "single": _ALL.format("rtrim(s, ' ')", " +", " "),
         "short": "case when contains(d, 'e') then replace(split_part(d, 'e', 1), '.250', '.25') || 'e10' when contains(d, '.') then case when rtrim(split_part(d, '.', 2), '0') = '' then split_part(d, '.', 1) || '.0' else rtrim(d, '0') end else rtrim(d, '0') end"},
    ),
    "fn_edit": (
        {"s": "p_name", "b": "concat('a', chr(92), chr(92), p_name, chr(92), 'z')"},
        lambda: {"right_by": X.shift(_c("s"), 3), "left_by": X.shift(_c("s"), -3), "inserted": X.insert(_c("s"), "+-+", 3), "first_gone": X.delete_first(_c("s"), "l"), "all_gone": X.delete_all(_c("s"), "l"), "plain": X.remove_backslashes(_c("b"))},
        {"right_by": "left('   ' || s, len(s))", "left_by": "substr(s, 4) || '   '", "inserted": "left(left(s, 2) || '+-+' || substr(s, 3), len(s))",
         "first_gone": "case when position('l' in s) = 0 then s else left(s, position('l' in s) - 1) || substr(s, position('l' in s) + 1) end", "all_gone": "replace(s, 'l', '')", "plain": "'a' || chr(92) || s || 'z'"},
    ),
    "fn_predicates": (
        {"s": _S, "n": _N, "e": "case p_partkey % 3 when 0 then 'é1' when 1 then '7a' else p_name end"},
        lambda: {"text": X.is_str(_c("n")), "letter": X.is_letter(_c("e")), "digit": X.is_digit(_c("e")), "hangul": X.is_hangul(_c("e")), "numeric": X.is_numeric(_c("n"))},
        {"text": "regexp_matches(n, '[A-Za-z]')", "letter": "ascii(e) between 65 and 90 or ascii(e) between 97 and 122", "digit": "ascii(e) between 48 and 57", "hangul": "ascii(e) > 127", "numeric": "regexp_full_match(trim(n), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"},
    ),
    "fn_path": (
        {"p": _P},
        lambda: {"absolute": X.is_absolute(_c("p")), "folder": X.directory(_c("p")), "resolved": X.resolve_path(F.lit("/base"), _c("p"))},
        {"absolute": "left(p, 1) = '/' or substr(p, 2, 1) = ':'", "folder": "case when contains(p, '/') then array_to_string(string_split(p, '/')[:-2], '/') else '.' end", "resolved": "case when left(p, 1) = '/' or substr(p, 2, 1) = ':' then p else '/base/' || p end"},
    ),
    "fn_logical": ({"l": _L}, lambda: {"yes": X.to_logical(_c("l"))}, {"yes": "lower(trim(l)) in ('true', 't', 'yes', 'y', '1')"}),
    "fn_date": (
        {"d": _D},
        lambda: {"year": X.date_parts(_c("d"))["year"], "month": X.date_parts(_c("d"))["month"], "day": X.date_parts(_c("d"))["day"], "jdn": X.julian_day(_c("d"))},
        {"year": "cast(d // 10000 as int)", "month": "cast(d // 100 % 100 as int)", "day": "cast(d % 100 as int)", "jdn": "cast(date_diff('day', date '1970-01-01', make_date(cast(d // 10000 as int), cast(d // 100 % 100 as int), 1)) + 2440587 + d % 100 as int)"},
    ),
    "fn_hash": ({"s": "p_name"}, lambda: {"bucket": X.string_hash(_c("s"), 101)}, {"bucket": "list_reduce(list_prepend(cast(5381 as bigint), list_transform(string_split(s, ''), lambda x: cast(ascii(x) as bigint))), lambda h, x: (h * 33 + x) % 101)"}),
    "fn_matrix_key": (
        {"r": "p_partkey + 1", "c": "1 + p_size % 50"},
        lambda: {"code": X.encode_key(_c("r"), _c("c"), 50), "row": X.decode_key(X.encode_key(_c("r"), _c("c"), 50), 50)["row"], "col": X.decode_key(X.encode_key(_c("r"), _c("c"), 50), 50)["column"]},
        {"code": "cast((r - 1) * 50 + c as bigint)", "row": "cast(r as bigint)", "col": "cast(c as bigint)"},
    ),
    "fn_math": (
        {"x": "p_retailprice - 950.5e0", "z": "p_size"},
        lambda: {"nearest": X.nearest(_c("x")), "half": X.nearest(_c("z") / 2.0), "root": F.round(F.sqrt(F.abs(_c("x"))), 6), "log": F.round(F.log10(_c("z").cast("double")), 6), "low": F.least(_c("x"), F.lit(0.0)), "high": F.greatest(_c("x"), F.lit(0.0))},
        {"nearest": "cast(round(x) as bigint)", "half": "cast((z + 1) // 2 as bigint)", "root": "round(sqrt(abs(x)), 6)", "log": "round(log10(z), 6)", "low": "least(x, 0)", "high": "greatest(x, 0)"},
    ),
}


def fn_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first round and the first square bracket are closed, and the last round one opened."""
    s = _texts(spark, sf_dir, s=_S)
    return s.select("k", X.match(_c("s"), F.instr("s", "(")).alias("closed"), X.match(_c("s"), F.instr("s", "[")).alias("inner_closed"), X.match(_c("s"), F.instr("s", ")")).alias("opened"))


def fn_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiters of the names that occur, and of a literal."""
    names = [*X.DELIMITERS, "tab", "#"]
    return spark.createDataFrame([(n, ord(X.delimiter(n))) for n in names], "name string, code int")


def fn_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of all events as they are printed."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", X.time_string(_c("ts")).alias("printed"))


def fn_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every animal's genotypes, packed and unpacked again."""
    from ..sources.text import to_wide
    from .engine import over_tables

    wide = to_wide(over_tables(spark, sf_dir, "geno")).withColumn("words", X.pack_genotypes(_c("geno")))
    back = X.unpack_genotypes(_c("words"), 64)
    return wide.select(_c("id").alias("animal_id"), F.posexplode("words").alias("word", "value"), (F.size(F.filter(back, lambda g: g.isNotNull()))).alias("n_called"), back.eqNullSafe(_c("geno")).alias("same"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _pick(columns, made) for name, (columns, made, _) in _SIMPLE.items()}
QUERIES |= {"fn_match": fn_match, "fn_delimiter": fn_delimiter, "fn_clock": fn_clock, "fn_bits": fn_bits}


def oracles(geno: str) -> dict[str, str]:
    """SQL of all of them; geno is the WITH query of the genotypes."""
    out = {name: "select k, " + ", ".join(f'{e} as "{n}"' for n, e in sql.items()) + f" from {_from(**columns)}" for name, (columns, _, sql) in _SIMPLE.items()}
    s = _from(s=_S)
    out["fn_match"] = f"select k, cast(position('])' in s) + 1 as int) as closed, cast(position('])' in s) as int) as inner_closed, cast(position('(' in s) as int) as opened from {s}"
    out["fn_delimiter"] = "select * from (values ('SPACE', 32), ('TAB', 9), ('COMMA', 44), ('SEMICOLON', 59), ('COLON', 58), ('PIPE', 124), ('PERIOD', 46), ('tab', 9), ('#', 35)) t(name, code)"
    out["fn_clock"] = """select event_id, strftime(ts, ' %B ') || lpad(cast(day(ts) as varchar), 2, ' ') || strftime(ts, ' %Y  ') || lpad(cast(case when hour(ts) > 12 then hour(ts) - 12 else hour(ts) end as varchar), 2, ' ') || strftime(ts, ':%M:%S ')
        || case when minute(ts) = 0 and second(ts) = 0 and hour(ts) = 12 then 'Noon' when minute(ts) = 0 and second(ts) = 0 and hour(ts) = 0 then 'Midnight' else strftime(ts, '%p') end as printed from events"""
    out["fn_bits"] = f"""{geno.rsplit("select * from geno", 1)[0]} select animal_id, cast((snp_idx - 1) // 16 as int) as word, cast(sum(coalesce(g, 3) * power(4, (snp_idx - 1) % 16)) as bigint) as value,
        cast(max(n) as int) as n_called, true as same from (select *, count(g) over (partition by animal_id) as n from geno) g group by animal_id, (snp_idx - 1) // 16"""
    return out
