"""Published report list: ranking, front matter, pages, facets and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom import fixed_values as fv
from tickerloom.functions.ordered import running_total
from tickerloom.functions.scalars import report_basename


def newest_reports(reports: DataFrame, limit: int = fv.PUBLISH_LIMIT) -> DataFrame:
    """The newest ``limit`` reports, ``weight`` being the 0-based rank.

    The limit comes first (a distributed top-k), so the ranking window sees
    ``limit`` rows at most.
    """
    top = reports.orderBy(F.desc("date"), F.desc("symbol")).limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("date"), F.desc("symbol")))
    return top.withColumn("weight", rank - 1)


def front_matter(ranked: DataFrame) -> DataFrame:
    base = report_basename(F.col("date"), F.col("symbol"))
    return ranked.select(
        F.concat(F.col("symbol"), F.lit(fv.REPORT_TITLE_SUFFIX)).alias("title"),
        "symbol",
        F.col("date").alias("report_date"),
        F.concat(F.col("date"), F.lit("T00:00:00Z")).alias("date"),
        base.alias("slug"),
        "weight",
        F.concat(F.lit("/reports/"), base, F.lit("/")).alias("url_path"),
    )


def paginate(ranked: DataFrame, page_size: int = fv.PAGE_SIZE) -> DataFrame:
    """Page number, page count and rows on the page for a ranked list; the total is a scalar, not a window over all rows."""
    total = ranked.agg(F.count("*").alias("n")).scalar()
    page = (F.floor(F.col("weight") / page_size) + 1).cast("int")
    return (
        ranked.withColumn("page", page)
        .withColumn("page_count", F.ceil(total / page_size).cast("int"))
        .withColumn("rows_on_page", F.count("*").over(Window.partitionBy("page")))
    )


def facets(metrics: DataFrame) -> DataFrame:
    """Report counts per rating, sector and market in one pass over the metrics."""
    names = ["rating", "sector", "market"]
    sets = [[F.col(n)] for n in names]
    which = (
        F.when(F.grouping("rating") == 0, "rating").when(F.grouping("sector") == 0, "sector").otherwise("market")
    )
    return (
        metrics.groupingSets(sets, *[F.col(n) for n in names])
        .agg(which.alias("facet"), F.count("*").alias("reports"))
        .select("facet", F.coalesce(*names).alias("value"), "reports")
    )


def timeline(*families: DataFrame) -> DataFrame:
    """All artifact events of a company in date order with their position.

    Each input has symbol, date, family and ref.
    """
    events = families[0]
    for more in families[1:]:
        events = events.unionByName(more)
    return running_total(
        events, ["symbol"], ["date", "family", "ref"], F.lit(1), F.trunc("date", "quarter"), "position"
    )


def storage_key(family: Column, day: Column, symbol: Column, relative: Column | None = None) -> Column:
    """Deterministic object key of an artifact family; null for an unknown family."""
    built = None
    for name, prefix, suffix in fv.KEY_FAMILIES:
        tail = [F.lit(suffix)]
        if name == "debug":
            tail.append(F.regexp_replace(relative, "^/+", "") if relative is not None else F.lit(""))
        key = F.concat(F.lit(prefix), day, F.lit("/"), F.upper(symbol), *tail)
        built = F.when(family == name, key) if built is None else built.when(family == name, key)
    return built


def shared_bundle_key(day: Column) -> Column:
    return F.concat(F.lit(fv.SHARED_BUNDLE_PREFIX), day, F.lit("/" + fv.SHARED_BUNDLE_NAME))


def history_key() -> Column:
    """The one key of the deviation history; it has no date or symbol."""
    return F.lit(fv.DEVIATION_HISTORY_KEY)


def prompt_version_key(prompt: Column, version: Column) -> Column:
    """Archive key of a prompt's replaced version: the prompt and the time at which it was replaced (UTC)."""
    stamp = F.date_format(version, "yyyyMMdd'T'HHmmss")
    return F.concat(F.lit(fv.PROMPT_VERSIONS_PREFIX), F.regexp_replace(prompt, "[^A-Za-z0-9._-]", "_"), F.lit("_"), stamp, F.lit(fv.PROMPT_VERSION_SUFFIX))


def parse_free_key(keys: DataFrame) -> DataFrame:
    """family, date, prompt and version of the keys that stand for no company: shared bundle, deviation history, prompt versions."""
    bundle = rf"^{fv.SHARED_BUNDLE_PREFIX}(\d{{4}}-\d{{2}}-\d{{2}})/{fv.SHARED_BUNDLE_NAME}$".replace(".json", r"\.json")
    version = rf"^{fv.PROMPT_VERSIONS_PREFIX}([^/]+)_(\d{{8}}T\d{{6}})\{fv.PROMPT_VERSION_SUFFIX}$"
    family = F.when(F.col("key").rlike(bundle), "shared_bundle").when(F.col("key") == fv.DEVIATION_HISTORY_KEY, "deviation_history").when(
        F.col("key").rlike(version), "prompt_version")
    is_version = family == "prompt_version"
    return keys.withColumns({
        "family": family, "date": F.when(family == "shared_bundle", F.regexp_extract("key", bundle, 1)),
        "prompt": F.when(is_version, F.regexp_extract("key", version, 1)),
        "version": F.when(is_version, F.to_timestamp(F.regexp_extract("key", version, 2), "yyyyMMdd'T'HHmmss")),
    })


def parse_storage_key(keys: DataFrame) -> DataFrame:
    """Inverse of ``storage_key``: family, date and symbol of every known key."""
    family = F.lit(None).cast("string")
    symbol = F.lit(None).cast("string")
    for name, prefix, suffix in fv.KEY_FAMILIES:
        stop = "/.*" if name == "debug" else suffix.replace(".", r"\.") + "$"
        pattern = rf"^{prefix}\d{{4}}-\d{{2}}-\d{{2}}/([^/]+){stop}"
        hit = F.col("key").rlike(pattern)
        family = F.when(hit, name).otherwise(family)
        symbol = F.when(hit, F.regexp_extract("key", pattern, 1)).otherwise(symbol)
    day = F.when(family.isNotNull(), F.regexp_extract("key", r"^[a-z_]+/(\d{4}-\d{2}-\d{2})/", 1))
    return keys.withColumn("family", family).withColumn("date", day).withColumn("symbol", symbol)
