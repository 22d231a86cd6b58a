"""Which companies to work on, and the rows that belong to each of them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickerloom import fixed_values as fv
from tickerloom.functions.collections import with_once
from tickerloom.functions.scalars import (
    blank_to_null,
    clean_label,
    first_truthy,
    normalize_cik,
    normalize_symbol,
    padded_cik,
    parse_iso_date,
    strip,
)
from tickerloom.sources.artifacts import parse_report_keys
from tickerloom.sources.scans import first_per_group, latest_rows, window_page


def _day(d: date | str) -> Column:
    return F.lit(d).cast("date")


def discover(calendar: DataFrame, run_date: date | str, lookback_days: int) -> DataFrame:
    """Calendar entries of the look-back window that name a symbol."""
    start = F.date_sub(_day(run_date), lookback_days)
    return calendar.where(F.col("date").between(start, _day(run_date)) & blank_to_null(F.col("symbol")).isNotNull())


def override_entries(spark: SparkSession, symbols: Sequence[str]) -> DataFrame:
    """Entries for an explicit list: upper-cased, past calendar and de-duplication."""
    rows = [(i, s.upper()) for i, s in enumerate(symbols)]
    return spark.createDataFrame(rows, "ord LONG, symbol STRING")


def processed_symbols(keys: DataFrame) -> DataFrame:
    """Upper-cased symbols with a canonical report on any date."""
    return parse_report_keys(keys).select(F.upper("symbol").alias("symbol")).distinct()


def unprocessed(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop entries whose symbol, compared as it stands, was already reported."""
    return entries.join(processed_symbols(keys), "symbol", "left_anti")


def cap(entries: DataFrame, max_symbols: int | None) -> DataFrame:
    """First ``max_symbols`` entries in source order; none or ``<= 0`` means no cap."""
    if max_symbols is None or max_symbols <= 0:
        return entries
    return entries.orderBy("ord").limit(max_symbols)


def stored_entries(entries: DataFrame) -> DataFrame:
    """The entry of each symbol whose record stays stored: the last in source order (combined map-side).

    Every discovered entry is processed, but records are kept under (run date,
    symbol), so a later entry's record replaces an earlier one's.  Only what
    is built to be stored may start from here.
    """
    return latest_rows(entries, ["symbol"], "ord").select("symbol", *[c for c in entries.columns if c != "symbol"])


def resolve_cik(entries: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds ``resolved_cik``: the calendar's CIK first, then the profile's."""
    known = profile.select("symbol", F.col("cik").alias("_profile_cik"))
    return (
        entries.join(known, "symbol", "left")
        .withColumn("resolved_cik", F.coalesce(normalize_cik(F.col("cik")), normalize_cik(F.col("_profile_cik"))))
        .drop("_profile_cik")
    )


def price_window(entries: DataFrame, run_date: date | str) -> DataFrame:
    """Adds ``window_from`` and ``window_to`` of the price history to read."""
    today = _day(run_date)
    hints = [F.col("date").cast("date")]
    hints += [parse_iso_date(F.col(c)) for c in ("expectedDate", "expected_date") if c in entries.columns]
    hint = F.coalesce(*hints)
    start = F.when(hint.isNotNull(), F.date_sub(hint, fv.PRICE_WINDOW_DAYS)).otherwise(
        F.date_sub(today, fv.PRICE_WINDOW_NO_DATE_DAYS)
    )
    return entries.withColumn("window_to", today).withColumn(
        "window_from", F.when(start >= today, F.date_sub(today, fv.PRICE_WINDOW_FUTURE_DAYS)).otherwise(start)
    )


def match_regulatory(entries: DataFrame, rows: DataFrame, max_rows: int = fv.REGULATORY_MAX_ROWS) -> DataFrame:
    """Regulatory rows of each (symbol, resolved_cik) by symbol or by CIK, first ``max_rows`` per list.

    The either-or condition runs as one equi join: every row stands once under
    its symbol and once under its CIK.  Each (list, key) is cut to ``max_rows``
    before joining, which is exact: a row among the first of the union is among
    the first under its own key.  Rows found by symbol are left out where they
    are found by CIK, so the union needs no de-duplication.
    Entries with the same symbol and CIK share their rows and are matched once;
    ``rows`` has list, ord, cik and any of symbol / ticker / companySymbol / stock.
    """
    names = [F.col(c) for c in ("symbol", "ticker", "companySymbol", "stock") if c in rows.columns]
    keyed = (
        with_once(rows, _name=F.upper(strip(first_truthy(*names))), _code=strip(F.col("cik")))
        .withColumn("row_symbol", blank_to_null(F.col("_name")))
        .withColumn("row_cik", padded_cik(F.col("_code")))
        .drop("symbol", "ticker", "companySymbol", "stock", "cik", "_name", "_code")
    )
    left = entries.select("symbol", "resolved_cik").distinct().withColumn("_sym", normalize_symbol(F.col("symbol")))

    def under_keys(df: DataFrame, symbol: str, cik: str) -> DataFrame:
        """Each row under its symbol and under its CIK; ``_other`` is the one it does not stand under."""
        both = [F.struct(F.lit(by_cik).alias("_by_cik"), F.col(key).alias("_key"), F.col(other).alias("_other"))
                for by_cik, key, other in ((False, symbol, cik), (True, cik, symbol))]
        return df.select("*", F.inline(F.array(*both))).where(F.col("_key").isNotNull())

    found = under_keys(keyed, "row_symbol", "row_cik").drop("row_symbol", "row_cik")
    trimmed = first_per_group(found, ["_key", "_by_cik", "list"], [F.col("ord")], max_rows, "_rank").drop("_rank")
    matched = under_keys(left, "_sym", "resolved_cik").drop("_other").join(trimmed, ["_by_cik", "_key"])
    matched = (
        matched.withColumn("row_symbol", F.when(F.col("_by_cik"), F.col("_other")).otherwise(F.col("_key")))
        .withColumn("row_cik", F.when(F.col("_by_cik"), F.col("_key")).otherwise(F.col("_other")))
        .where(~F.col("_by_cik") | ~F.col("_sym").eqNullSafe(F.col("row_symbol"))).drop("_sym", "_by_cik", "_key", "_other")
    )
    return first_per_group(matched, ["symbol", "resolved_cik", "list"], [F.col("ord")], max_rows)


def trim_prices(eod: DataFrame, run_date: date | str, max_rows: int = fv.EOD_MAX_ROWS) -> DataFrame:
    """Newest ``max_rows`` dated rows up to the run date, and as many undated ones, per symbol.

    All price windows end on the run date, so a window's newest rows are among
    these; trimming before the join keeps long price histories out of it.
    """
    usable = eod.where(F.col("symbol").isNotNull() & (F.col("date").isNull() | (F.col("date") <= _day(run_date))))
    tagged = usable.withColumn("undated", F.col("date").isNull())
    return first_per_group(tagged, ["symbol", "undated"], [F.col("date").desc(), F.col("ord")], max_rows, "_rank").drop(
        "_rank"
    )


def price_list() -> Column:
    """Aggregate of trimmed price rows: newest first, undated last, at most ``2 * max_rows`` of them."""
    newest_first = lambda a, b: (
        F.when(a["date"].eqNullSafe(b["date"]), F.when(a["ord"] < b["ord"], -1).otherwise(1))
        .when(a["date"].isNull(), 1).when(b["date"].isNull(), -1)
        .when(a["date"] > b["date"], -1).otherwise(1)
    )
    return F.array_sort(F.collect_list(F.struct("date", "close", "adj_close", "ord")), newest_first)


def listed_prices(eod: DataFrame, run_date: date | str, max_rows: int = fv.EOD_MAX_ROWS) -> DataFrame:
    """symbol, listed (newest dated rows first, then undated ones, at most ``max_rows`` of each), days, n_dated and oldest of the dated."""
    rows = trim_prices(eod, run_date, max_rows).groupBy("symbol").agg(
        price_list().alias("listed"), F.count("date").cast("int").alias("n_dated"), F.min("date").alias("oldest"))
    return rows.withColumn("days", F.transform(F.slice("listed", 1, F.col("n_dated")), lambda p: p["date"]))


def inside_count() -> Column:
    """How many of the listed dated rows a window from ``window_from`` to the run date holds.

    A window that reaches back to the oldest listed row holds all of them, which is the common case and needs no look at the days.
    """
    some = F.size(F.filter("days", lambda day: day >= F.col("window_from")))
    return F.when(F.col("oldest").isNull() | F.col("window_from").isNull(), 0).when(F.col("window_from") <= F.col("oldest"), F.col("n_dated")).otherwise(some)


def list_of_count(max_rows: int = fv.EOD_MAX_ROWS) -> Column:
    """The price list of a window that holds ``inside`` dated rows: these, and undated ones up to ``max_rows``."""
    return F.concat(F.slice("listed", F.lit(1), F.col("inside")), F.slice("listed", F.col("n_dated") + 1, F.lit(max_rows) - F.col("inside")))


def window_counts(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """Entries with ``inside``; all windows end on the run date, so (symbol, inside) names an entry's price list.

    A symbol has at most ``max_rows + 1`` different lists, however many entries share them.  Entries without a price row are left out.
    """
    known = listed.select("symbol", "days", "n_dated", "oldest")
    return entries.join(known, "symbol").withColumn("inside", inside_count()).drop("days", "n_dated", "oldest")


def counted_lists(counts: DataFrame, listed: DataFrame, max_rows: int = fv.EOD_MAX_ROWS) -> DataFrame:
    """symbol, inside, prices for each distinct (symbol, inside) of ``counts``; empty lists are left out."""
    wanted = counts.select("symbol", "inside").distinct().join(listed, "symbol")
    return wanted.select("symbol", "inside", list_of_count(max_rows).alias("prices")).where(F.size("prices") > 0)


def window_price_lists(entries: DataFrame, eod: DataFrame, run_date: date | str, max_rows: int = fv.EOD_MAX_ROWS) -> DataFrame:
    """Entries with ``prices``: the newest ``max_rows`` rows inside each one's window, undated rows last.

    A symbol's newest rows are listed once, however many entries it has; each
    entry counts how many of them its window holds.  Entries without a price
    row are left out.
    """
    listed = listed_prices(eod, run_date, max_rows)
    counted = entries.join(listed, "symbol").withColumn("inside", inside_count())
    cut = counted.withColumn("prices", list_of_count(max_rows)).drop("listed", "days", "n_dated", "oldest", "inside")
    return cut.where(F.size("prices") > 0)


def window_prices(entries: DataFrame, eod: DataFrame, run_date: date | str, max_rows: int = fv.EOD_MAX_ROWS
                  ) -> DataFrame:
    """The rows of ``window_price_lists`` with their rank: symbol (and entry, where there is one), ord, prices."""
    keys = [c for c in ("symbol", "entry") if c in entries.columns]
    lists = window_price_lists(entries.select(*keys, "window_from"), eod, run_date, max_rows)
    return lists.select(*keys, F.posexplode("prices").alias("pos", "p")).select(
        *keys, "p.ord", "p.date", "p.close", "p.adj_close", (F.col("pos") + 1).alias("rank"))


def with_benchmark_count(entries: DataFrame, listed: DataFrame, symbol: str = fv.BENCHMARK_SYMBOL) -> DataFrame:
    """Adds the benchmark's ``listed`` rows, ``n_dated``, and ``inside``: how many of its dated rows each entry's window holds.

    The benchmark is a scalar subquery: one value of at most twice the row
    limit, computed once.  Without a benchmark row all are null.
    """
    one = listed.where(F.col("symbol") == symbol).select(F.struct("listed", "days", "n_dated", "oldest").alias("b")).scalar()
    known = entries.withColumn("_b", one).select("*", "_b.listed", "_b.days", "_b.n_dated", "_b.oldest").drop("_b")
    return known.withColumn("inside", F.when(F.col("listed").isNotNull(), inside_count())).drop("days", "oldest")


def window_benchmark(entries: DataFrame, eod: DataFrame, run_date: date | str, max_rows: int = fv.EOD_MAX_ROWS
                     ) -> DataFrame:
    """Adds ``benchmark_eod_recent``: the shared benchmark cut to each entry's window; empty without a benchmark row."""
    # The filter stands before the listing, so that only the benchmark's rows are listed.
    listed = listed_prices(eod.where(F.col("symbol") == fv.BENCHMARK_SYMBOL), run_date, max_rows)
    counted = with_benchmark_count(entries, listed)
    none = F.array().cast("array<struct<date:date,close:double,adj_close:double,ord:bigint>>")
    return counted.withColumn("benchmark_eod_recent", F.coalesce(list_of_count(max_rows), none)).drop("listed", "n_dated", "inside")


def series_tails(series: DataFrame, level: str, max_rows: int = fv.SERIES_TAIL) -> DataFrame:
    """Last ``max_rows`` points per series name, as one array in source order."""
    rows = series.where((F.col("level") == level) & F.col("name").isNotNull())
    last = first_per_group(rows, ["name"], [F.col("ord").desc()], max_rows)
    point = F.struct("ord", "date", "value")
    return last.groupBy("name").agg(F.sort_array(F.collect_list(point)).alias("points"))


def sector_history(entries: DataFrame, profile: DataFrame, series: DataFrame, max_rows: int = fv.SERIES_TAIL
                   ) -> DataFrame:
    """Adds cleaned sector and industry names and the tail of each one's history."""
    names = profile.select(
        "symbol",
        clean_label(F.col("sector"), F.col("sector_formatted")).alias("sector"),
        clean_label(F.col("industry"), F.col("industry_formatted")).alias("industry"),
    )
    out = entries.join(names, "symbol", "left")
    for level in ("sector", "industry"):
        tails = series_tails(series, level, max_rows).select(
            F.col("name").alias(level), F.col("points").alias(f"{level}_history")
        )
        out = out.join(tails, level, "left")
    return out


def recent_filings(filings: DataFrame, run_date: date | str, *, days: int = fv.FILINGS_DAYS,
                   limit: int = fv.FILINGS_LIMIT, page: int = 0) -> DataFrame:
    """Newest ``limit`` filings per symbol of the last ``days`` days."""
    return window_page(filings, F.date_sub(_day(run_date), days), run_date, page=page, limit=limit)


def with_peers(entries: DataFrame, peers: DataFrame) -> DataFrame:
    """Peer rows of each entry; entries without peers stay with a null peer."""
    return entries.join(peers, "symbol", "left")


def discovery_summary(entries: DataFrame, run_date: date | str) -> DataFrame:
    """Count and distinct symbols of a discovery run, one row per run date."""
    return entries.agg(
        F.count("*").alias("count"),
        F.count_distinct("symbol").alias("symbols"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    ).withColumn("discovery_date", _day(run_date))


#: Entries in a page of the discovery document, about.
PAGE_ENTRIES = 1000


def discovery_pages(entries: DataFrame, run_date: date | str) -> DataFrame:
    """The discovery document in pages: page, pages, count, symbols[] and entries[], about ``PAGE_ENTRIES`` entries each.

    Entries are dealt to pages by hash, so that no page grows with the run or with one symbol; a page's symbols are its own.
    """
    total = entries.agg(F.ceil(F.count("*") / PAGE_ENTRIES).cast("int").alias("n")).scalar()
    pages = F.greatest(total, F.lit(1))
    dealt = entries.withColumn("_page", F.pmod(F.xxhash64(*entries.columns), pages).cast("int"))
    body = F.struct(*entries.columns)
    return dealt.groupBy(F.col("_page").alias("page")).agg(
        F.count("*").alias("count"), F.sort_array(F.collect_set("symbol")).alias("symbols"), F.sort_array(F.collect_list(body)).alias("entries")
    ).withColumn("pages", pages).withColumn("discovery_date", _day(run_date))


def write_discovery(entries: DataFrame, path: str, run_date: date | str) -> None:
    """The discovery document as JSON lines, a page each, in one folder per run date; null fields are kept."""
    (
        discovery_pages(entries, run_date)
        .write.mode("overwrite")
        .option("ignoreNullFields", "false")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("discovery_date")
        .json(path)
    )


def read_discovery(spark: SparkSession, path: str, entry: StructType) -> DataFrame:
    """The stored pages; ``entry`` is the schema of an entry."""
    page = f"page int, pages int, count long, symbols array<string>, entries array<{entry.simpleString()}>, discovery_date date"
    return spark.read.schema(page).json(path)
