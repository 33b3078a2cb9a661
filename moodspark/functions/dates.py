"""Date helpers. Stored times are zone-less Seoul wall clock; event times are zone-less UTC."""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodspark import vocab


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c) -> Column:
    return F.trunc(_col(c), "MM")


def month_of(c) -> dict[str, Column]:
    c = _col(c)
    return {"year": F.year(c), "month": F.month(c)}


def month_range(year: int, month: int) -> tuple[dt.date, dt.date]:
    """First day of the month and of the next one."""
    return dt.date(year, month, 1), dt.date(year + month // 12, month % 12 + 1, 1)


def in_month(c, year: int, month: int) -> Column:
    """Half-open range, which Parquet readers can skip by; year() and month() could not."""
    first, after = month_range(year, month)
    return (_col(c) >= F.lit(first)) & (_col(c) < F.lit(after))


def kst_now(utc) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), _col(utc))


def kst_today(utc) -> Column:
    return F.to_date(kst_now(utc))


def weekday(c) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(_col(c)) - 1


def month_bounds(c) -> dict[str, Column]:
    first = month_start(c)
    return {
        "first_day": first,
        "days_in_month": F.day(F.last_day(_col(c))),
        "first_weekday": weekday(first),
        "previous_month": F.add_months(first, -1).cast("date"),
        "next_month": F.add_months(first, 1).cast("date"),
    }


def date_key(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def weekday_name(c) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in vocab.WEEKDAYS]), F.dayofweek(_col(c)))


def date_labels(c) -> dict[str, Column]:
    c = _col(c)
    return {
        "calendar_label": F.date_format(c, "yyyy '년' M '월'"),
        "month_label": F.date_format(c, "yyyy'년' M'월'"),
        "long_label": F.concat(F.date_format(c, "yyyy'년' M'월' d'일' '('"), weekday_name(c), F.lit(")")),
    }
