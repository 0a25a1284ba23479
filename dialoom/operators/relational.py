"""Joins, aggregations, ranking, sampling, sets and sequences of warehouse workloads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.functions.base import as_col
from dialoom.operators.ordering import number_rows, ordered_values, position_within
from dialoom.session import dealt, materialize

# Fixed value: a T-SQL money amount has four decimals.
MONEY = "decimal(19,4)"


# Joins. The physical form is left to the optimizer: small dimensions broadcast by their measured
# size, large ones sort-merge with the adaptive skew split.


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Inner equi-joins of a fact with its dimensions."""
    for dim, keys in dims:
        fact = fact.join(dim, list(keys))
    return fact


def outer_join(a: DataFrame, b: DataFrame, keys: Sequence[str], side: str = "left") -> DataFrame:
    """``(+)``: on the right-hand column it is a LEFT join, on the left-hand column a RIGHT join."""
    return a.join(b, list(keys), side)


def left_summary(dim: DataFrame, fact: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Every ``dim`` row with aggregates of its fact rows: counts 0 and other aggregates NULL without any.

    ``aggs`` maps a result name to (function, column). The fact is reduced per key before the
    join, so the join moves one row per key whatever the number of fact rows.
    """
    keys = list(keys)
    functions = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    reduced = fact.groupBy(*keys).agg(*[functions[fn](c).alias(n) for n, (fn, c) in aggs.items()])
    joined = dim.join(reduced, keys, "left")
    return joined.fillna(0, subset=[n for n, (fn, _) in aggs.items() if fn == "count"])


def apply_explode(
    df: DataFrame, arr: Column, name: str = "value", outer: bool = False, with_index: bool = False, index: str = "index"
) -> DataFrame:
    """CROSS APPLY / LATERAL / FLATTEN over an array; ``outer`` keeps rows without elements.

    A plain explode makes the optimizer add a non-empty test below it that computes ``arr`` a
    second time; exploding outer and dropping the empty rows afterwards computes it once.
    """
    rows = df.select("*", F.posexplode_outer(arr).alias(index, name))
    rows = rows if outer else rows.filter(F.col(index).isNotNull())
    return rows if with_index else rows.drop(index)


def top_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """LATERAL (... ORDER BY ... LIMIT n): the first ``n`` rows of each key.

    A rank filter on a window is cut to ``n`` rows per task and key before the shuffle, so a
    large key sends few rows; no split of large keys is needed.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


# Aggregations.


def rollup_sum(df: DataFrame, by: Sequence[str], amount: str, name: str = "amount", dtype: str = MONEY) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(F.col(amount).cast(dtype)).alias(name))


def recent_order_totals(
    orders: DataFrame, customers: DataFrame, items: DataFrame, as_of: str, months: int = 3
) -> DataFrame:
    """Orders of the last months: total of price times quantity per order and customer.

    Columns: orders(order_id, customer_id, order_date), customers(customer_id, customer_name),
    items(order_id, price, quantity). The date filter reaches the scan. Items are summed per order
    on the map side first, so an order with very many items is one row in the joins, and the join
    with the orders reuses that partitioning.
    """
    since = F.add_months(F.lit(as_of).cast("date"), -months)
    recent = orders.filter(F.col("order_date") > since)
    line = (F.col("price").cast("decimal(18,2)") * F.col("quantity").cast("decimal(10,2)")).cast("decimal(28,4)")
    totals = items.groupBy("order_id").agg(F.sum(line).alias("total_amount"))
    return (
        recent.join(totals, "order_id")
        .join(customers, "customer_id")
        .groupBy("order_id", "customer_name", "order_date")
        .agg(F.sum("total_amount").alias("total_amount"))
    )


def top_spenders(totals: DataFrame, n: int = 10) -> DataFrame:
    spent = totals.groupBy("customer_name").agg(F.sum("total_amount").alias("total_spent"))
    return top_n(spent, [F.col("total_spent").desc(), F.col("customer_name")], n)


def sales_summary(fact: DataFrame, customers: DataFrame, products: DataFrame, rows: int | None = None) -> DataFrame:
    """City and category: total sales, distinct customers, distinct products.

    fact(customer_id, product_id, sale_amount), customers(customer_id, city),
    products(product_id, category). With ``rows``, the number of sales or a bound of it, the two
    groupings are dealt over as many tasks as they need.
    """
    deal = (lambda df: dealt(df, rows, "customer_id", "product_id")) if rows else (lambda df: df)
    # Summed first: the distinct counts then work on a row per pair, not per sale.
    pairs = deal(fact).groupBy("customer_id", "product_id").agg(F.sum("sale_amount").alias("sale_amount"))
    joined = star_join(pairs, [(customers, ["customer_id"]), (products, ["product_id"])])
    return deal(joined).groupBy("city", "category").agg(
        F.sum("sale_amount").alias("total_sales"),
        F.countDistinct("customer_id").alias("total_customers"),
        F.countDistinct("product_id").alias("total_products"),
    )


def top_groups(df: DataFrame, by: str, amount: str, min_total, name: str = "total") -> DataFrame:
    """Sum of a summary, groups above ``min_total`` only, largest first."""
    return (
        df.groupBy(by)
        .agg(F.sum(amount).alias(name))
        .filter(F.col(name) > F.lit(min_total))
        .orderBy(F.col(name).desc(), F.col(by))
    )


def customer_sales(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Order count, sum and average per customer, customers without orders included."""
    return left_summary(
        customers.select("customer_id", "customer_name"),
        orders.select("customer_id", "order_id", "order_amount"),
        ["customer_id"],
        {
            "total_orders": ("count", "order_id"),
            "total_sales": ("sum", "order_amount"),
            "avg_order_value": ("avg", "order_amount"),
        },
    )


def customer_revenue(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(F.sum("order_amount").alias("total_revenue"))


def string_agg(df: DataFrame, by, value: str, order, separator: str = ",", name: str = "joined") -> DataFrame:
    """LISTAGG / GROUP_CONCAT / STRING_AGG in a stated order; NULL values are skipped."""
    return ordered_values(df, by, order, value, name, separator)


def array_agg(df: DataFrame, by, value: str, order, name: str = "items") -> DataFrame:
    """ARRAY_AGG in a stated order; NULL values are skipped."""
    return ordered_values(df, by, order, value, name)


def var_samp(value: Column | str) -> Column:
    """VARIANCE_SAMP."""
    return F.var_samp(as_col(value))


def approx_distinct(value: Column | str, rsd: float = 0.05) -> Column:
    """APPROXIMATE COUNT(DISTINCT): a sketch of fixed size; ``rsd`` is the relative standard error."""
    return F.approx_count_distinct(as_col(value), rsd)


def pivot(df: DataFrame, by: Sequence[str], key: str, values: Sequence, agg: Column) -> DataFrame:
    """PIVOT with stated values, so no extra pass collects them."""
    return df.groupBy(*by).pivot(key, list(values)).agg(agg)


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


# Ranking, limits, paging, sampling.


def rank_within(df, by: Sequence[str], order, name: str = "rank") -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY ... ORDER BY ...); ``order`` should end in a unique column."""
    return position_within(df, by, order, name)


def top_n(df: DataFrame, order, n: int) -> DataFrame:
    """TOP n / FETCH FIRST n / LIMIT n of an ordered frame: each task keeps ``n`` rows."""
    return df.orderBy(*order).limit(n)


def _after(keys: Sequence[tuple[str, bool]], values: Sequence, inclusive: bool) -> Column:
    """Rows behind the one with these key values. NULLs come first upwards and last downwards."""
    found, equal = F.lit(False), F.lit(True)
    for (name, up), value in zip(keys, values, strict=True):
        column = F.col(name)
        if value is None:
            behind = column.isNotNull() if up else F.lit(False)
            same = column.isNull()
        else:
            behind = column > F.lit(value) if up else (column < F.lit(value)) | column.isNull()
            same = column == F.lit(value)
        found, equal = found | (equal & behind), equal & same
    # NULL is not TRUE: a comparison with a NULL key decides nothing, and the row is not behind.
    found = F.coalesce(found | equal if inclusive else found, F.lit(False))
    (name, up), value = keys[0], values[0]
    if value is None or not up:
        return found
    return (F.col(name) >= F.lit(value)) & found  # a range that reaches the scan


def _keys(order: Sequence[str]) -> list[tuple[str, bool]]:
    """``"a"`` is upwards, ``"-a"`` downwards."""
    return [(name.removeprefix("-"), not name.startswith("-")) for name in order]


def seek_page(df: DataFrame, order: Sequence[str], after: Sequence | None = None, size: int = 10, inclusive: bool = False) -> DataFrame:
    """The page behind the row with the key values ``after`` (the first page without any).

    ``order`` names columns, downwards with a leading ``-``, together unique. The keys bound the
    scan, and tasks keep ``size`` rows each, however deep the page lies.
    """
    keys = _keys(order)
    rows = df if after is None else df.filter(_after(keys, after, inclusive))
    return rows.orderBy(*[F.col(n).asc() if up else F.col(n).desc() for n, up in keys]).limit(size)


def page_index(df: DataFrame, order: Sequence[str], size: int = 10) -> DataFrame:
    """``page`` (from 1) and the key values of its first row, for all pages: one distributed numbering."""
    keys = _keys(order)
    rows = number_rows(df.select(*[n for n, _ in keys]), [F.col(n).asc() if up else F.col(n).desc() for n, up in keys], "_row", start=0)
    first = rows.filter(F.col("_row") % size == 0)
    return first.select((F.col("_row") / size + 1).cast("long").alias("page"), *[n for n, _ in keys])


def page(df: DataFrame, order: Sequence[str], number: int, size: int = 10, index: DataFrame | None = None) -> DataFrame:
    """The ``number``-th page (from 1): its first row comes from the index, the rest by ``seek_page``.

    Pass a written ``page_index`` to read many pages; without one it is made here. No task holds
    more than a page of rows beside the numbering's own slices.
    """
    index = page_index(df, order, size) if index is None else index
    row = index.filter(F.col("page") == number).first()
    if row is None:
        return df.limit(0)
    return seek_page(df, order, [row[n] for n, _ in _keys(order)], size, inclusive=True)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    return df.agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("long").alias("pages"))


def with_page(df: DataFrame, order, size: int = 10, name: str = "page") -> DataFrame:
    """Every row with its page number."""
    numbered = number_rows(df, order, "_row", start=0)
    return numbered.withColumn(name, (F.floor(F.col("_row") / size) + 1).cast("long")).drop("_row")


def latest(df: DataFrame, ts: str, n: int = 100, tie: str | None = None) -> DataFrame:
    """Newest ``n`` rows; rows without a time come last. A page limit is the caller's."""
    order = [F.coalesce(F.col(ts), F.lit(0)).desc()] + ([F.col(tie)] if tie else [])
    return top_n(df, order, n)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """SAMPLE n: exactly ``n`` rows (or all), the same ones for the same seed."""
    return top_n(df, [_draw(key, seed), F.col(key)], n)


def sample_n_within(df: DataFrame, by: Sequence[str], n: int, key: str, seed: int = 0) -> DataFrame:
    """SAMPLE n of every group: the ``n`` rows with the smallest draws, cut per task before the shuffle."""
    return top_per_key(df, by, [_draw(key, seed), F.col(key)], n, "_rank").drop("_rank")


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """SAMPLE by fraction: rows whose draw lies below it, the same ones for the same seed; no shuffle.

    The draw is a hash of the key, so copies of a key are taken or left together, and tables
    sampled by one key stay joinable.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    drawn = F.conv(F.substring(_draw(key, seed), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return df.filter(drawn < F.lit(float(fraction)))


def _draw(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


# Sets and sequences.


def minus(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    """MINUS / EXCEPT; ``all`` keeps surplus duplicates."""
    return a.exceptAll(b) if all else a.subtract(b)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def load_set(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert into a SET table: rows already there, and repeats among the new rows, are left out.

    NULLs count as equal, as they do for a row comparison. Rows compare over all columns.
    """
    fresh = rows.select(*target.columns).dropDuplicates()
    return target.unionByName(fresh.subtract(target))


def load_multiset(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert into a MULTISET table: every row is kept."""
    return target.unionByName(rows.select(*target.columns))


def generate_series(
    spark: SparkSession, start, stop, step=1, name: str = "n", slices: int | None = None
) -> DataFrame:
    """GENERATE_SERIES over numbers, inclusive; made in parallel, not in one row."""
    count = (stop - start) // step + 1
    count = max(count, 0)
    return spark.range(0, count, numPartitions=slices).select((F.lit(start) + F.col("id") * F.lit(step)).alias(name))


def generate_dates(spark: SparkSession, start: str, stop: str, step: str = "1 day", name: str = "d") -> DataFrame:
    """GENERATE_SERIES over dates with a step such as ``1 day``, ``2 weeks`` or ``1 month``, inclusive.

    Made in parallel from a range of numbers: each date is the start plus so many steps.
    """
    count, unit = step.split()
    count, unit = int(count), unit.rstrip("s")
    first, last = F.lit(start).cast("date"), F.lit(stop).cast("date")
    scale = {"day": 1, "week": 7, "month": 1, "quarter": 3, "year": 12}[unit] * count
    begin, end = date.fromisoformat(start), date.fromisoformat(stop)
    if unit in ("day", "week"):
        steps = (end - begin).days // scale + 1
        made = F.date_add(first, (F.col("id") * scale).cast("int"))
    else:
        steps = ((end.year - begin.year) * 12 + end.month - begin.month) // scale + 1
        made = F.add_months(first, (F.col("id") * scale).cast("int"))
    return spark.range(0, max(steps, 0)).select(made.alias(name)).filter(F.col(name) <= last)


def recursive(
    anchor: DataFrame, step: Callable[[DataFrame], DataFrame], mode: str = "all", by: Sequence[str] | None = None
) -> DataFrame:
    """WITH RECURSIVE: ``step`` maps the rows of one level to the next until none come.

    ``mode`` says how it ends:

    * ``all`` (UNION ALL): every row goes on. A recursion that would not end is an error.
    * ``union`` (UNION): only rows that no earlier level had go on, each once.
    * ``cycle`` (CYCLE by SET is_cycle): rows have a column ``path``, the places (values of ``by``)
      from their anchor to them. A row whose place its path holds already is marked in ``is_cycle``
      and does not go on, so the recursion ends on any finite set of places. ``step`` sees ``path``
      and must hand it on.

    Each level is written to the checkpoint folder, so the plan stays as long as one level and a
    lost executor costs no earlier level. In mode ``all`` the chain behind a row of level n has
    n + 1 rows. Are there fewer different rows, some chain holds a row twice and would go round for
    ever; they are counted whenever the number of levels has doubled. ``union`` compares new rows
    with the written earlier ones, joined on all columns.
    """
    if mode == "cycle":
        return _recursive_with_paths(anchor, step, list(by or anchor.columns))
    if mode not in ("all", "union"):
        raise ValueError(f"unknown mode: {mode}")
    columns = anchor.columns

    def unseen(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
        rows = rows.select(*columns).distinct()
        if seen is None:
            return rows
        old = seen.select(*[F.col(c).alias(f"_o_{c}") for c in columns])
        return rows.join(old, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in columns], "left_anti")

    def told(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
        """The rows of a level as written, in mode ``union`` without the earlier ones."""
        return materialize(unseen(rows, seen) if mode == "union" else rows)

    levels, seen = [], None
    level = told(anchor, None)
    while not level.isEmpty():
        seen = level if seen is None else seen.unionByName(level)
        levels.append(level)
        count = len(levels)
        if mode == "all" and count >= 4 and count & (count - 1) == 0 and union_all(levels).distinct().count() < count:
            raise RuntimeError("the recursion comes round: a row is its own ancestor")
        level = told(step(level).select(*columns), seen)
    return union_all(levels) if levels else level


def _recursive_with_paths(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], by: list[str]) -> DataFrame:
    place = F.struct(*[F.col(c) for c in by])
    columns = anchor.columns
    level = materialize(anchor.withColumn("path", F.array(place)).withColumn("is_cycle", F.lit(False)))
    levels = [level]
    while True:
        following = step(level.filter(~F.col("is_cycle")).drop("is_cycle")).select(*columns, "path")
        # Structs compare whole, NULLs equal.
        met = F.exists("path", lambda p: p.eqNullSafe(place))
        level = materialize(following.select(*columns, F.concat("path", F.array(place)).alias("path"), met.alias("is_cycle")))
        if level.isEmpty():
            return union_all(levels)
        levels.append(level)


def assign_ids(df: DataFrame, order, start: int = 1, name: str = "id", existing: DataFrame | None = None) -> DataFrame:
    """NEXTVAL / IDENTITY / SERIAL: consecutive ids in ``order``, going on after ``existing``'s largest."""
    if existing is not None:
        top = existing.agg(F.max(name)).first()[0]
        start = start if top is None else top + 1
    return number_rows(df, order, name, start)


