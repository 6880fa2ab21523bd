"""Which pages to visit next, and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def basket_queue(rows: DataFrame, basket: str, shares: dict[str, int], spare_to: list[str], order: list[Column], budget: int) -> DataFrame:
    """rows with position: from each basket its share (per cent, one at least) of budget; what is left over is offered to
    spare_to in turn. Three counts are added up on the driver; windows keep budget rows a task before the shuffle."""
    rows = rows.where(F.col(basket).isin(*shares))
    have = {r[basket]: r["n"] for r in rows.groupBy(basket).agg(F.count("*").alias("n")).collect()}
    take = {b: min(have.get(b, 0), max(1, budget * s // 100)) for b, s in shares.items()}
    for b in spare_to:
        take[b] = min(have.get(b, 0), take[b] + max(0, budget - sum(take.values())))
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(basket).orderBy(*order))).where(F.col("position") <= budget)
    most = F.create_map(*(F.lit(x) for b, n in take.items() for x in (b, n)))
    return ranked.where(F.col("position") <= F.element_at(most, F.col(basket)))


def next_interval(current: Column, changed: Column, most: int = 90, default: int = 7) -> Column:
    """Days to the next visit: half as long after a change, half as long again otherwise."""
    now = F.when(F.coalesce(current, F.lit(0)) == 0, default).otherwise(current)
    return F.when(changed, F.greatest(F.lit(1), F.floor(now / 2))).otherwise(F.least(F.lit(most), F.floor(now * 1.5))).cast("int")


def date_range(text: str) -> tuple[str, str] | None:
    """YYYY, YYYY/M or YYYY/M/D as a half-open range of dates; None where it is none."""
    import datetime as dt

    try:
        parts = [int(p) for p in text.strip().split("/")]
        start = dt.date(*(parts + [1, 1])[:3])
    except (ValueError, TypeError):
        return None
    if len(parts) == 1:
        end = dt.date(start.year + 1, 1, 1)
    elif len(parts) == 2:
        end = dt.date(start.year + start.month // 12, start.month % 12 + 1, 1)
    else:
        end = start + dt.timedelta(days=1)
    return start.isoformat(), end.isoformat()
