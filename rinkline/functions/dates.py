"""Season, date and age expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rinkline.functions.text import clean_text

FIRST_SEASON, LAST_SEASON = 1900, 2200


def started_season(day: Column) -> Column:
    """Season running on a date: the year, or the one before until July 1."""
    return F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)


def season_label(year: Column) -> Column:
    return F.concat(
        year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0")
    )


_SEASON_LABEL = r"^([0-9]{4})\s*-\s*([0-9]{2}|[0-9]{4})$"


def _label_text(value: Column) -> Column:
    return F.translate(clean_text(value), "–—", "--")


def looks_like_season(value: Column) -> Column:
    """Whether text has the form of a season label, consistent or not."""
    return _label_text(value).rlike(_SEASON_LABEL)


def parse_season_label(value: Column) -> Column:
    """'2023-24' or '2023–2024' to 2023; null unless the end year is the next one."""
    text = _label_text(value)
    start = F.regexp_extract(text, _SEASON_LABEL, 1).try_cast("int")
    end = F.regexp_extract(text, _SEASON_LABEL, 2)
    following = (start + 1).cast("string")
    consistent = F.when(F.length(end) == 4, end == following).otherwise(
        end == F.right(following, F.lit(2))
    )
    return F.when(consistent & start.between(FIRST_SEASON, LAST_SEASON), start)


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")


def parse_signing_date(value: Column) -> Column:
    """ISO-like, m/d/yyyy or 'Mon d, yyyy' text; null when none fits."""
    text = clean_text(value)
    iso = r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"
    slash = r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
    named = r"^([A-Za-z]{3,9})\.?\s+([0-9]{1,2}),\s*([0-9]{4})$"
    month = F.initcap(F.lower(F.regexp_extract(text, named, 1)))
    word = F.concat_ws(
        " ", month, F.regexp_extract(text, named, 2), F.regexp_extract(text, named, 3)
    )
    return (
        F.when(text.rlike(iso), _day(*[F.regexp_extract(text, iso, i) for i in (1, 2, 3)]))
        .when(text.rlike(slash), _day(*[F.regexp_extract(text, slash, i) for i in (3, 1, 2)]))
        .when(
            text.rlike(named),
            F.coalesce(
                F.when(F.length(month) == 3, F.try_to_date(word, "MMM d y")),
                F.when(month == "Sept", F.try_to_date(F.replace(word, F.lit("Sept"), F.lit("Sep")), "MMM d y")),
                F.when(F.length(month) > 3, F.try_to_date(word, "MMMM d y")),
            ),
        )
    )


def signing_date_error(value: Column) -> Column:
    """True when a non-blank signing date could not be read."""
    return (clean_text(value) != "") & parse_signing_date(value).isNull()


def parse_short_birth_date(value: Column) -> Column:
    """'97-1-13': two-digit years from 30 on are 19xx, earlier ones 20xx."""
    text = clean_text(value)
    pattern = r"^([0-9]{2})-([0-9]{1,2})-([0-9]{1,2})$"
    short = F.regexp_extract(text, pattern, 1).try_cast("int")
    year = short + F.when(short >= 30, 1900).otherwise(2000)
    day = _day(
        year.cast("string"), F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 3)
    )
    return F.when(text.rlike(pattern), day)


def parse_iso_date(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def whole_years(birth: Column, at: Column) -> Column:
    """Completed years of age on a date (29 February counts from 1 March)."""
    return F.timestamp_diff("YEAR", birth.cast("timestamp"), at.cast("timestamp")).cast("int")


def season_age(birth: Column, season: Column) -> Column:
    """Age on October 1 of the season."""
    return whole_years(birth, F.make_date(season, F.lit(10), F.lit(1)))
