"""Record rules as Column expressions. Digits are ASCII digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.config import Rules


def normalize_separator(line: Column) -> Column:
    out = line
    for mark in (":", "|", ","):  # the last tested here is the first that counts
        out = F.when(F.contains(line, F.lit(mark)), F.replace(line, F.lit(mark), F.lit("::"))).otherwise(out)
    return F.when(F.contains(line, F.lit("::")), line).otherwise(out)


def raw_fields(line: Column) -> Column:
    return F.split(line, "::", -1)


def split_fields(line: Column, width: int, sentinel: str = "EXTRA_FIELD") -> Column:
    f = raw_fields(line)
    return F.when((F.size(f) == width + 1) & (F.element_at(f, -1) == sentinel), F.slice(f, 1, width)).otherwise(f)


def is_int(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9]+$") & ~s.endswith("\n"), F.lit(False))


def is_long(s: Column) -> Column:
    return F.coalesce(s.rlike("^[+-]?[0-9]+$") & s.try_cast("bigint").isNotNull(), F.lit(False))


def leading_id(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, "^([0-9]+)", 1), F.lit(""))


def has_year(title: Column, rules: Rules = Rules()) -> Column:
    year = F.nullif(F.regexp_extract(title, r"\(([0-9]{4})\)", 1), F.lit("")).cast("int")
    return F.coalesce(year.between(*rules.years), F.lit(False))


def is_blank(s: Column) -> Column:
    return s.isNull() | s.rlike(r"^[\x00-\x20]*$")


def valid_genres(s: Column, rules: Rules = Rules()) -> Column:
    stem = F.regexp_replace(s, r"[|]+$", "")
    return ~is_blank(s) & ((stem == "") | F.forall(F.split(stem, "[|]", -1), lambda g: g.isin(*rules.genres)))


def all_non_empty(fields: Column) -> Column:
    return F.forall(fields, lambda x: ~is_blank(x))


def normalize_epoch(ts: Column, rules: Rules = Rules()) -> Column:
    return F.when(ts > rules.ms_threshold, ((ts - F.pmod(ts, F.lit(1000))) / 1000).cast("bigint")).otherwise(ts)


def valid_ts(ts: Column, rules: Rules = Rules()) -> Column:
    return F.coalesce(ts.between(rules.ts_lo, rules.ts_hi), F.lit(False))


def at(fields: Column, i: int) -> Column:
    return F.get(fields, F.lit(i))


def valid_rating(f: Column, rules: Rules = Rules()) -> Column:
    return (F.size(f) == 4) & is_int(at(f, 0)) & is_int(at(f, 1)) & is_int(at(f, 2)) & is_long(at(f, 3)) & F.coalesce(at(f, 2).try_cast("int").between(*rules.ratings), F.lit(False))


def valid_rating_line(line: Column, rules: Rules = Rules()) -> Column:
    """valid_rating() of a line's fields, without splitting it: a filter evaluates a split once for each time that it is named."""
    r = F.substring_index(F.substring_index(line, "::", 3), "::", -1).try_cast("int")
    return line.rlike("^[0-9]+::[0-9]+::[0-9]+::[+-]?[0-9]+$") & F.coalesce(r.between(*rules.ratings) & rating_time(line).isNotNull(), F.lit(False))


def rating_time(line: Column) -> Column:
    """The last field of a line as a long."""
    return F.substring_index(line, "::", -1).try_cast("bigint")


def valid_user(f: Column, rules: Rules = Rules()) -> Column:
    return (F.size(f) == 5) & is_int(at(f, 0)) & at(f, 1).isin(*rules.genders) & at(f, 2).isin(*rules.ages) & at(f, 3).isin(*rules.occupations)


def valid_item(f: Column, rules: Rules = Rules()) -> Column:
    return (F.size(f) == 3) & is_int(at(f, 0)) & ~is_blank(at(f, 1)) & has_year(at(f, 1), rules) & valid_genres(at(f, 2), rules)


def kind_by_field_count(line: Column) -> Column:
    n = F.size(raw_fields(line))
    return F.when(n == 4, "ratings").when(n == 5, "users").when(n == 3, "movies").otherwise("unknown")
