"""Scalar functions over text, numbers and dates, as column expressions. Null in, null out, where nothing else is said."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each cleaning mode takes away.
CLEAN = {"alphanum": "[^A-Za-z0-9 ]", "alpha": "[^A-Za-z ]", "numeric": "[^0-9 ]", "printable": "[^ -~]", "identifier": "[^A-Za-z0-9_]"}
# Delimiters by name.
DELIMITERS = {"SPACE": " ", "TAB": "\t", "COMMA": ",", "SEMICOLON": ";", "COLON": ":", "PIPE": "|", "PERIOD": "."}
# Brackets and what closes them.
BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_MARK = "\x01"


# ---- case, joining, cleaning

def to_upper(c: Column) -> Column:
    """a-z alone are raised."""
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def to_lower(c: Column) -> Column:
    """A-Z alone are lowered."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def concat(a: Column, b: Column) -> Column:
    """Both without their trailing blanks."""
    return F.concat(F.rtrim(a), F.rtrim(b))


def clean(c: Column, mode: str = "alphanum") -> Column:
    """Only the characters of a mode; an unknown mode is alphanum."""
    return F.regexp_replace(F.rtrim(c), CLEAN.get(mode.lower(), CLEAN["alphanum"]), "")


def remove_special(c: Column, keep: str = "") -> Column:
    """Only letters, digits, blanks and the characters to keep."""
    return F.regexp_replace(F.rtrim(c), "[^A-Za-z0-9 " + "".join("\\" + k for k in keep) + "]", "")


def blank_special(c: Column) -> Column:
    """A blank for every character that isn't a letter or a digit."""
    return F.regexp_replace(c, "[^A-Za-z0-9]", " ")


# ---- numbers

def to_string(c: Column, form: str | None = None) -> Column:
    """A number as text, by a printf form or plainly."""
    return F.format_string(form, c) if form else c.cast("string")


def is_numeric(c: Column) -> Column:
    return c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?\s*$")


def to_real(c: Column) -> Column:
    """A number from text, 0 where it isn't one."""
    return F.when(is_numeric(c), F.regexp_replace(F.trim(c), "[dD]", "e").try_cast("double")).otherwise(0.0)


def to_int(c: Column, bits: int = 32) -> Column:
    """A whole number from text: rounded half away from zero, 0 where it isn't one or doesn't fit."""
    n, most = to_real(c), 2 ** (bits - 1) - 1
    return F.when(F.abs(n) <= float(most), F.round(n)).otherwise(0.0).cast("int" if bits == 32 else "long")


# ---- tokens

def compact(c: Column) -> Column:
    """Runs of blanks and tabs as one blank, other control characters gone, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"[\x00-\x08\x0A-\x1F]", ""), r"[\t ]+", " "))


def split_string(c: Column, by: str) -> Column:
    """Parts between single delimiters, trimmed; empty ones are kept."""
    return F.transform(F.split(F.rtrim(c), "\\Q" + by + "\\E"), lambda p: F.trim(p))


def remove_backslashes(c: Column) -> Column:
    """Backslashes gone; a doubled one is one."""
    return F.trim(F.regexp_replace(c, r"\\(.?)", "$1"))


def parse(c: Column, by: str) -> Column:
    """Parts between delimiters that no backslash precedes, trimmed, without their backslashes."""
    marked = F.regexp_replace(compact(c) if by != "\t" else F.trim(c), r"\\(.)", _MARK + "$1")
    parts = F.split(marked, "(?<!" + _MARK + ")[" + "".join("\\" + d for d in by) + "]")
    return F.transform(parts, lambda p: F.replace(F.trim(p), F.lit(_MARK), F.lit("")))


def remove_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x20]+", "")


def single_blanks(c: Column) -> Column:
    """Runs of blanks as one blank, none at the end."""
    return F.regexp_replace(F.rtrim(c), " +", " ")


def trim_zeros(c: Column) -> Column:
    """A decimal number without trailing zeros; one stays after a point, and an exponent stays."""
    mantissa, exponent = F.regexp_extract(c, r"^([^eE]*)", 1), F.regexp_extract(c, r"([eE].*)$", 1)
    return F.concat(F.regexp_replace(F.regexp_replace(F.rtrim(mantissa), "0+$", ""), r"\.$", ".0"), exponent)


# ---- edits

def shift(c: Column, n: int) -> Column:
    """Characters moved right (left if n is negative) within the text's length, blanks behind them."""
    size = F.char_length(c)
    return F.rpad(F.substr(c, F.lit(-n + 1)), size, " ") if n < 0 else F.substr(F.concat(F.lit(" " * n), c), F.lit(1), size)


def insert(c: Column, part: str, at: int) -> Column:
    """part put in from position `at`; what no longer fits the text's length is lost."""
    return F.substr(F.concat(F.substr(c, F.lit(1), F.lit(at - 1)), F.lit(part.rstrip(" ")), F.substr(c, F.lit(at))), F.lit(1), F.char_length(c))


def delete_first(c: Column, part: str) -> Column:
    """Without the first occurrence of part."""
    at = F.instr(c, part)
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.substr(c, at + len(part)))).otherwise(c)


def delete_all(c: Column, part: str) -> Column:
    """Without part, until none is left: also not where deleting joined one."""
    once = lambda x: F.replace(x, F.lit(part), F.lit(""))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.char_length(c) + 2)).cast("int")))
    return F.aggregate(rounds, c, lambda x, _: once(x))


def match(c: Column, at: Column) -> Column:
    """Position of the bracket that matches the one at a position; null where there is none."""
    one = F.substr(c, at, F.lit(1))
    pairs = BRACKETS | {z: a for a, z in BRACKETS.items()}
    other = F.element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), one)
    ahead = one.isin(*BRACKETS)
    rest = F.when(ahead, F.sequence(at, F.greatest(at, F.char_length(F.rtrim(c))))).otherwise(F.sequence(at, F.lit(1)))
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("found"))

    def step(state: Column, i: Column) -> Column:
        ch = F.substr(c, i, F.lit(1))
        depth = state["depth"] + F.when(ch == one, 1).when(ch == other, -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.coalesce(state["found"], F.when(depth == 0, i)).alias("found"))

    return F.when(other.isNotNull(), F.aggregate(rest, start, step, lambda s: s["found"]))


# ---- predicates, names, paths

def is_letter(c: Column) -> Column:
    return c.rlike("^[A-Za-z]")


def is_digit(c: Column) -> Column:
    return c.rlike("^[0-9]")


def is_hangul(c: Column) -> Column:
    """Whether the first character is outside ASCII."""
    return c.rlike("^[^\\x00-\\x7F]")


def is_str(c: Column) -> Column:
    """Whether there is a letter, or a character outside ASCII."""
    return c.rlike("[A-Za-z]|[^\\x00-\\x7F]")


def delimiter(name: str) -> str:
    """A delimiter by its name, or itself."""
    return DELIMITERS.get(name.strip().upper(), name)


def is_absolute(path: Column) -> Column:
    """Begins with a slash, or with a drive letter and a colon."""
    return path.startswith("/") | ((F.char_length(F.rtrim(path)) > 1) & (F.substr(path, F.lit(2), F.lit(1)) == ":"))


def directory(path: Column) -> Column:
    """What is before the last slash; a point without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def resolve_path(base: Column, path: Column) -> Column:
    """An absolute path as it is, others below base."""
    return F.when(is_absolute(path) | (F.trim(base) == "."), F.trim(path)).otherwise(F.concat(F.trim(base), F.lit("/"), F.trim(path)))


def to_logical(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "t", "yes", "y", "1")


# ---- dates and clocks

def date_parts(c: Column) -> Column:
    """Year, month and day of a yyyymmdd whole number."""
    return F.struct(F.floor(c / 10000).cast("int").alias("year"), F.floor(c % 10000 / 100).cast("int").alias("month"), (c % 100).cast("int").alias("day"))


def julian_day(c: Column) -> Column:
    """Julian day number of a yyyymmdd whole number, 0 where it isn't above 0; days beyond a month's end run on."""
    d = date_parts(c)
    a = F.floor((14 - d["month"]) / 12)
    y, m = d["year"] + 4800 - a, d["month"] + 12 * a - 3
    n = d["day"] + F.floor((153 * m + 2) / 5) + 365 * y + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) - 32045
    return F.when(c > 0, n.cast("int")).otherwise(0)


def time_string(ts: Column) -> Column:
    """A time as " November 26 2026   1:05:09 PM"; twelve sharp is Noon or Midnight."""
    sharp = (F.minute(ts) == 0) & (F.second(ts) == 0)
    half = F.when((F.hour(ts) == 12) & sharp, "Noon").when((F.hour(ts) == 0) & sharp, "Midnight").otherwise(F.date_format(ts, "a"))
    hour = F.when(F.hour(ts) > 12, F.hour(ts) - 12).otherwise(F.hour(ts))
    day = F.lpad(F.dayofmonth(ts).cast("string"), 2, " ")
    return F.concat(F.date_format(ts, " MMMM "), day, F.date_format(ts, " yyyy  "), F.lpad(hour.cast("string"), 2, " "), F.date_format(ts, ":mm:ss "), half)


# ---- keys and bits

def string_hash(c: Column, buckets: int) -> Column:
    """Bucket of a text from 0: from 5381 on, times 33 plus the next character, modulo the buckets; an empty text is in the first."""
    codes = F.transform(F.filter(F.split(F.rtrim(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.when(F.size(codes) == 0, 0).otherwise(F.aggregate(codes, F.lit(5381).cast("long"), lambda h, x: (h * 33 + x) % buckets))


def encode_key(row: Column, column: Column, n: int) -> Column:
    """One number of a place in a matrix of n columns, from 1."""
    return (row.cast("long") - 1) * n + column


def decode_key(key: Column, n: int) -> Column:
    return F.struct((F.floor((key - 1) / n) + 1).cast("long").alias("row"), ((key - 1) % n + 1).cast("long").alias("column"))


def pack_genotypes(c: Column) -> Column:
    """Genotypes array as whole numbers of sixteen two-bit codes each, 3 for missing."""
    words = F.sequence(F.lit(0), F.floor((F.size(c) - 1) / 16).cast("int"))
    code = lambda i: F.coalesce(F.try_element_at(c, i), F.lit(3)).cast("long")
    return F.transform(words, lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("long"), lambda a, k: a + code(w * 16 + k + 1) * F.pow(F.lit(4.0), k).cast("long")))


def unpack_genotypes(c: Column, n: int) -> Column:
    """The inverse of pack_genotypes for n genotypes."""
    value = lambda i: F.floor(F.element_at(c, F.floor(i / 16).cast("int") + 1) / F.pow(F.lit(4.0), i % 16)).cast("long") % 4
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(value(i) < 3, value(i).cast("int")))


def nearest(c: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return F.round(c).cast("long")
