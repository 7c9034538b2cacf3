"""Text to typed values. Casts are `try_cast`: bad text gives NULL also under ANSI mode."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DAYS


def split_list(col: Column) -> Column:
    """`'a, b'` to `['a', 'b']`."""
    return F.split(col, ", ")


def split_timestamps(col: Column) -> Column:
    return F.transform(split_list(col), lambda x: F.trim(x).try_cast("timestamp"))


def strip_quotes(col: Column) -> Column:
    """`u'loud'`, `'loud'` and `"loud"` to `loud`; other text stays."""
    return F.regexp_replace(col, r"""^u?['"](.+)['"]$""", "$1")


def dict_to_map(col: Column) -> Column:
    """Dictionary text such as `{u'romantic': False, 'casual': True}` to map<string,boolean>.

    The text is rewritten as JSON and parsed natively. `None`, broken text and NULL give NULL; a
    value that is not a boolean gives a NULL entry."""
    json = F.regexp_replace(col, r"""u?'([^'"]*)'\s*:""", r'"$1":')
    json = F.regexp_replace(json, r"""u("[^"]*"\s*:)""", "$1")
    json = F.regexp_replace(json, r""":\s*u?'([^'"]*)'""", r': "\'$1"')
    json = F.regexp_replace(json, r":\s*True\b", ": true")
    json = F.regexp_replace(json, r":\s*False\b", ": false")
    json = F.regexp_replace(json, r":\s*None\b", ": null")
    json = F.regexp_replace(json, r",\s*\}", "}")
    parsed = F.from_json(json, "map<string,string>")
    return F.transform_values(
        parsed, lambda _, v: F.when(v == "true", True).when(v == "false", False)
    )


def categories_text(col: Column) -> Column:
    return F.coalesce(F.array_join(col, ", "), F.lit(""))


def format_duration(seconds: Column) -> Column:
    """65 to `1m 5s`; NULL and 0 to `N/A`."""
    whole = F.floor(seconds)
    text = F.concat(
        F.floor(whole / 60).cast("string"), F.lit("m "), F.pmod(whole, F.lit(60)).cast("string"), F.lit("s")
    )
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "N/A").otherwise(text)


def clock_to_minutes(clock: Column, default: str = "21:00") -> Column:
    """`HH:MM` to minutes since midnight; an empty clock is the default, a missing part is 0."""
    parts = F.split(F.when(F.coalesce(clock, F.lit("")) == "", default).otherwise(clock), ":")

    def part(i: int) -> Column:
        return F.coalesce(F.trim(F.get(parts, F.lit(i))).try_cast("int"), F.lit(0))

    return part(0) * 60 + part(1)


def day_index(day: Column) -> Column:
    """0 for Monday to 6 for Sunday, in any letter case; NULL for anything else."""
    days = F.array(*[F.lit(d) for d in DAYS])
    found = F.array_position(days, F.initcap(day))
    return F.when(found > 0, (found - 1).cast("int"))


def previous_day(day: Column) -> Column:
    days = F.array(*[F.lit(d) for d in DAYS])
    return F.get(days, (day_index(day) + 6) % 7)
