"""Aggregations (§2.4): dashboard, CLI and admin statistics.

Every function is one grouped DataFrame job (map-side partial aggregation, one
shuffle on the group key) or a one-row global aggregate.  Several numbers are
computed in one pass with conditional aggregates instead of one query per number.
Time windows take an explicit ``asof`` (a literal or a Column such as
``common.latest(df, "created_at")``) in place of the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise import schemas
from shelfwise.operators.common import lit, pct, round_avg, since

def _active():
    return F.col("is_active")


def platform_stats(products: DataFrame) -> DataFrame:
    """AGG1: per-platform product statistics in one grouped pass."""
    rated = _active() & F.col("rating").isNotNull()
    return products.groupBy("platform").agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(_active()).alias("active_products"),
        F.count_if(~_active()).alias("inactive_products"),
        round_avg(F.when(_active(), F.col("price"))).alias("avg_price"),
        F.min(F.when(_active(), F.col("price"))).alias("min_price"),
        F.max(F.when(_active(), F.col("price"))).alias("max_price"),
        F.count_distinct(F.when(_active(), F.col("brand"))).alias("brands_count"),
        F.max("scraped_date").alias("last_scrape"),
        F.count_if(rated).alias("products_with_rating"),
        round_avg(F.when(rated, F.col("rating"))).alias("avg_rating"),
    )


def success_rate(logs: DataFrame, asof, days: int = 30) -> DataFrame:
    """AGG3: per platform, round(completed / total * 100, 2) over the last ``days``."""
    recent = logs.where(since("created_at", asof, days))
    return recent.groupBy("platform").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("status") == "completed").alias("successful_runs"),
    ).withColumn("success_rate", pct(F.col("successful_runs"), F.col("total_runs"), 2))


def platform_performance(logs: DataFrame, products: DataFrame, platforms: DataFrame,
                         asof, days: int = 30) -> DataFrame:
    """AGG2: every configured platform (zero rows kept) with run and product figures."""
    recent = logs.where(since("created_at", asof, days))
    done = F.col("status") == "completed"
    runs = recent.groupBy("platform").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(done).alias("successful_runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
        round_avg(F.when(done, F.col("duration_seconds"))).alias("avg_duration"),
        F.max("created_at").alias("last_run"),
    )
    counts = products.groupBy("platform").agg(F.count(F.lit(1)).alias("total_products"))
    # the platform dimension is a fixed 8-row table: broadcasting it is bounded
    out = (F.broadcast(platforms).join(runs, "platform", "left").join(counts, "platform", "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "platform", "name",
        pct(F.coalesce(F.col("successful_runs"), F.lit(0)),
            F.coalesce(F.col("total_runs"), F.lit(0)), 2).alias("success_rate"),
        zero("total_runs"), zero("successful_runs"), zero("failed_runs"),
        "avg_duration", "last_run", zero("total_products"),
    )


def platform_verdict(logs: DataFrame, platforms: DataFrame, asof, days: int = 30) -> DataFrame:
    """AGG33: healthy (>= 80 % success), warning (>= 60 %) or error, per platform."""
    rates = success_rate(logs, asof, days).select("platform", "success_rate")
    out = F.broadcast(platforms).join(rates, "platform", "left")
    rate = F.coalesce(F.col("success_rate"), F.lit(0.0))
    return out.select(
        "platform", rate.alias("success_rate"),
        F.when(rate >= 80, "healthy").when(rate >= 60, "warning").otherwise("error").alias("verdict"))


def _one_row(first: DataFrame, **scalars: Column) -> DataFrame:
    """Attach one-row aggregates of other tables as scalar subqueries (no join)."""
    return first.select("*", *[c.alias(n) for n, c in scalars.items()])


def _aggregates(df: DataFrame, **values: Column) -> Column:
    """Several aggregates of one table as one scalar subquery: a struct, so the table is read once."""
    return df.agg(F.struct(*[c.alias(n) for n, c in values.items()]).alias("s")).scalar()


def overview(products: DataFrame, logs: DataFrame, asof, n_platforms: int = len(schemas.PLATFORMS),
             days: int = 7) -> DataFrame:
    """AGG4: one-row overview of products and recent ingest sessions."""
    recent = logs.where(since("created_at", asof, days))
    prod = products.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(_active()).alias("active_products"),
        round_avg(F.when(_active(), F.col("price"))).alias("avg_price"),
    )
    top = top_brands(products, 1, with_ties_broken=True).select(F.max("brand"))
    out = _one_row(
        prod,
        total_platforms=F.lit(n_platforms),
        logs=_aggregates(recent, recent_scrapes=F.count(F.lit(1)), successful_scrapes=F.count_if(F.col("status") == "completed")),
        top_brand=top.scalar(),
    )
    return out.select(*prod.columns, "total_platforms", "logs.*", "top_brand")


def brand_counts(products: DataFrame, platform: str | None = None) -> DataFrame:
    """Active products with a brand, counted per brand (feeds AGG4 / AGG5)."""
    df = products.where(_active() & F.col("brand").isNotNull())
    if platform:
        df = df.where(F.col("platform") == platform)
    return df.groupBy("brand").agg(F.count(F.lit(1)).alias("product_count"))


def top_brands(products: DataFrame, k: int = 10, platform: str | None = None,
               with_ties_broken: bool = True) -> DataFrame:
    """AGG5: top-k brands by active product count; ties broken by brand name.

    ``orderBy().limit(k)`` plans as TakeOrderedAndProject: each partition keeps
    its own top k and only k rows per partition reach the final merge.
    """
    order = [F.col("product_count").desc()] + ([F.col("brand")] if with_ties_broken else [])
    return brand_counts(products, platform).orderBy(*order).limit(k)


def top_brands_per_platform(products: DataFrame, k: int = 10) -> DataFrame:
    """AGG5 for every platform at once: window group-limit ``row_number <= k``."""
    counts = (products.where(_active() & F.col("brand").isNotNull())
              .groupBy("platform", "brand").agg(F.count(F.lit(1)).alias("product_count")))
    w = Window.partitionBy("platform").orderBy(F.col("product_count").desc(), "brand")
    return (counts.withColumn("brand_rank", F.row_number().over(w))
            .where(F.col("brand_rank") <= k))


def platform_distribution(products: DataFrame) -> DataFrame:
    """AGG6: active products per platform."""
    return products.where(_active()).groupBy("platform").agg(F.count(F.lit(1)).alias("product_count"))


def price_buckets(products: DataFrame) -> DataFrame:
    """AGG7: five overlapping price buckets of active products (BETWEEN is inclusive,
    so 50 000 and 80 000 are counted in two buckets, as the reference does)."""
    p = F.col("price")
    a = products.where(_active())
    return a.agg(
        F.count_if(p < 30000).alias("under_30k"),
        F.count_if(p.between(30000, 50000)).alias("from_30k_to_50k"),
        F.count_if(p.between(50000, 80000)).alias("from_50k_to_80k"),
        F.count_if(p.between(80000, 120000)).alias("from_80k_to_120k"),
        F.count_if(p > 120000).alias("over_120k"),
    )


def daily_activity(logs: DataFrame, asof, days: int = 7) -> DataFrame:
    """AGG8: sessions per day and status over the last ``days``."""
    return (logs.where(since("created_at", asof, days))
            .groupBy(F.to_date("created_at").alias("activity_date"), "status")
            .agg(F.count(F.lit(1)).alias("sessions"))
            .orderBy("activity_date", "status"))


def daily_outcomes(logs: DataFrame, asof, days: int = 7) -> DataFrame:
    """AGG9: completed and failed sessions per day (pivot of AGG8, zeros filled)."""
    return (logs.where(since("created_at", asof, days))
            .groupBy(F.to_date("created_at").alias("activity_date"))
            .pivot("status", ["completed", "failed"])
            .agg(F.count(F.lit(1)))
            .na.fill(0, ["completed", "failed"])
            .orderBy("activity_date"))


def daily_changes(logs: DataFrame, asof, days: int = 30, platform: str | None = None) -> DataFrame:
    """AGG10: products added / updated per day (per platform when none is given)."""
    df = logs.where(since("created_at", asof, days))
    keys = [F.to_date("created_at").alias("activity_date")]
    if platform:
        df = df.where(F.col("platform") == platform)
    else:
        keys = ["platform"] + keys
    return df.groupBy(*keys).agg(F.sum("products_added").alias("added"),
                                 F.sum("products_updated").alias("updated"))


def duplicate_skus(products: DataFrame) -> DataFrame:
    """AGG11: SKUs on more than one row, with the rows per platform (``platform:n``).

    Rows are first counted per (sku, platform) — map-side combined, at most one
    row per platform per SKU — so the list is built from <= 8 small rows per SKU
    however many snapshots a hot SKU has.
    """
    per = products.groupBy("sku", "platform").agg(F.count(F.lit(1)).alias("n"))
    agg = per.groupBy("sku").agg(
        F.sum("n").alias("product_count"),
        F.sort_array(F.collect_list(F.struct("platform", "n"))).alias("parts"))
    return (agg.where(F.col("product_count") > 1)
            .select("sku", "product_count",
                    F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x["platform"], x["n"])), ",")
                    .alias("platforms")))


def run_status_counts(runs: DataFrame) -> DataFrame:
    """AGG12: runs by status."""
    s = F.col("status")
    return runs.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "completed").alias("completed"),
                    F.count_if(s == "failed").alias("failed"), F.count_if(s == "running").alias("running"))


def run_totals(runs: DataFrame) -> DataFrame:
    """AGG13: run counts plus products scraped."""
    s = F.col("status")
    return runs.agg(F.count(F.lit(1)).alias("total_runs"),
                    F.count_if(s == "completed").alias("completed_runs"),
                    F.count_if(s == "failed").alias("failed_runs"),
                    F.sum("products_scraped").alias("total_products"))


def config_statistics(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """AGG14: per configuration run statistics (configurations without runs get zeros)."""
    done = F.col("status") == "completed"
    stats = runs.groupBy(F.col("configuration_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(done).alias("successful_runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
        F.sum("products_scraped").alias("total_products"),
        F.sum("reviews_scraped").alias("total_reviews"),
        F.sum("rankings_scraped").alias("total_rankings"),
        round_avg(F.when(done, F.col("duration_seconds"))).alias("avg_duration"),
        F.max("created_at").alias("last_run_date"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return configs.select("id", "platform", "category").join(stats, "id", "left").select(
        "id", "platform", "category", z("total_runs"), z("successful_runs"), z("failed_runs"),
        z("total_products"), z("total_reviews"), z("total_rankings"), "avg_duration", "last_run_date")


def queue_counts(urls: DataFrame) -> DataFrame:
    """AGG15: URL queue size by status."""
    s = F.col("status")
    return urls.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "pending").alias("pending"),
                    F.count_if(s == "processing").alias("processing"),
                    F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"))


def queue_outcome(outcomes: DataFrame) -> DataFrame:
    """AGG16: processed and error counts per platform plus a grand total row
    (platform null) — a ROLLUP over the outcome table."""
    s = F.col("status")
    return outcomes.rollup("platform").agg(F.count_if(s == "completed").alias("processed"),
                                          F.count_if(s == "failed").alias("errors"))


def review_stats(reviews: DataFrame) -> DataFrame:
    """AGG17: totals, with images, verified, average rating."""
    from shelfwise.operators.filters import has_items
    return reviews.agg(F.count(F.lit(1)).alias("total_reviews"),
                       F.count_if(has_items("review_images")).alias("with_images"),
                       F.count_if(F.col("verified_purchase")).alias("verified"),
                       round_avg("rating").alias("avg_rating"))


def keyword_stats(keywords: DataFrame, rankings: DataFrame) -> DataFrame:
    """AGG18: keyword totals plus the number of ranking rows."""
    st = F.col("status")
    k = keywords.agg(F.count(F.lit(1)).alias("total_keywords"), F.count_if(st).alias("active_keywords"),
                     F.count_if(~st).alias("inactive_keywords"))
    return _one_row(k, total_rankings=rankings.select(F.count(F.lit(1))).scalar())


def rankings_per_keyword(keywords: DataFrame, rankings: DataFrame) -> DataFrame:
    """AGG19: ranking rows per keyword, keywords without rankings kept with 0."""
    counts = rankings.groupBy(F.col("keyword_id").alias("id")).agg(F.count(F.lit(1)).alias("rankings_count"))
    return (keywords.select("id", "platform", "keyword").join(counts, "id", "left")
            .withColumn("rankings_count", F.coalesce("rankings_count", F.lit(0)).cast("bigint")))


def keyword_summary(rankings: DataFrame) -> DataFrame:
    """AGG20: per keyword — rows, distinct products, average position (1 dp), last tracked."""
    return rankings.groupBy("keyword_id").agg(
        F.count(F.lit(1)).alias("total_rankings"),
        F.count_distinct("sku").alias("distinct_products"),
        round_avg("position", 1).alias("avg_position"),
        F.max("created_at").alias("last_tracked"))


def position_bucket(position) -> Column:
    p = F.col(position) if isinstance(position, str) else position
    return (F.when(p <= 10, "1-10").when(p <= 20, "11-20").when(p <= 30, "21-30")
            .when(p <= 40, "31-40").when(p <= 50, "41-50").otherwise("50+"))


def position_histogram(rankings: DataFrame) -> DataFrame:
    """AGG21: position buckets per keyword with their share (1 dp) of the keyword's rows.

    The share is a window over the already aggregated (keyword, bucket) rows —
    at most six rows per keyword — so the window never sees raw rankings.
    """
    counts = (rankings.groupBy("keyword_id", position_bucket("position").alias("bucket"))
              .agg(F.count(F.lit(1)).alias("rankings_count")))
    total = F.sum("rankings_count").over(Window.partitionBy("keyword_id"))
    return counts.withColumn("share_pct", pct(F.col("rankings_count"), total, 1))


def platform_run_stats(runs: DataFrame) -> DataFrame:
    """AGG22: run history per platform with success percent (1 dp)."""
    s = F.col("status")
    return runs.groupBy("platform").agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(s == "completed").alias("completed_runs"),
        F.count_if(s == "failed").alias("failed_runs"), F.count_if(s == "running").alias("running_runs"),
    ).withColumn("success_pct", pct(F.col("completed_runs"), F.col("total_runs"), 1))


def platform_matrix(products: DataFrame, reviews: DataFrame, rankings: DataFrame,
                    platforms: DataFrame) -> DataFrame:
    """AGG23: products, reviews, rankings and last scrape per configured platform."""
    p = products.groupBy("platform").agg(F.count(F.lit(1)).alias("products_count"),
                                         F.max("scraped_date").alias("last_scraped"))
    r = reviews.groupBy("platform").agg(F.count(F.lit(1)).alias("reviews_count"))
    k = rankings.groupBy("platform").agg(F.count(F.lit(1)).alias("rankings_count"))
    out = F.broadcast(platforms).join(p, "platform", "left").join(r, "platform", "left").join(k, "platform", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("platform", "name", z("products_count"), z("reviews_count"), z("rankings_count"),
                      "last_scraped")


def health(products: DataFrame, logs: DataFrame, asof) -> DataFrame:
    """AGG24: dashboard health verdicts (recent activity, data freshness, error rate)."""
    week = logs.where(since("created_at", asof, 7))
    fresh = products.agg(F.count_if(since("scraped_date", asof, 3)).alias("fresh_products"),
                         F.count(F.lit(1)).alias("total_products"))
    out = _one_row(fresh, logs=_aggregates(
        week, logs_48h=F.count_if(since("created_at", asof, 48, "HOURS")), logs_7d=F.count(F.lit(1)),
        failed_7d=F.count_if(F.col("status") == "failed"))).select(*fresh.columns, "logs.*")
    fresh_pct = pct(F.col("fresh_products"), F.col("total_products"), 2)
    err_pct = pct(F.col("failed_7d"), F.col("logs_7d"), 2)
    return out.select(
        "*", fresh_pct.alias("fresh_pct"), err_pct.alias("error_rate_pct"),
        F.when(F.col("logs_48h") == 0, "warning").otherwise("healthy").alias("recent_activity"),
        F.when(fresh_pct < 50, "error").when(fresh_pct < 80, "warning").otherwise("healthy")
        .alias("data_freshness"),
        F.when(err_pct > 30, "error").when(err_pct > 10, "warning").otherwise("healthy").alias("error_rate"))


def freshness_verdict(products: DataFrame, asof) -> DataFrame:
    """AGG25: CLI freshness — percent rounded to 1 dp first, then >80 ok, >50 warning, else bad."""
    agg = products.agg(F.count_if(since("scraped_date", asof, 3)).alias("fresh_products"),
                       F.count(F.lit(1)).alias("total_products"))
    p = pct(F.col("fresh_products"), F.col("total_products"), 1)
    return agg.select("*", p.alias("fresh_pct"),
                      F.when(p > 80, "ok").when(p > 50, "warning").otherwise("bad").alias("verdict"))


def detailed_stats(products: DataFrame) -> DataFrame:
    """AGG26: totals, with images, with ratings, active price min / avg / max."""
    has_images = (F.col("image_urls").isNotNull() if "image_urls" in products.columns
                  else F.lit(False))
    return products.agg(
        F.count(F.lit(1)).alias("total_products"), F.count_if(_active()).alias("active_products"),
        F.count_if(has_images).alias("with_images"),
        F.count_if(F.col("rating").isNotNull()).alias("with_ratings"),
        round_avg(F.when(_active(), F.col("price"))).alias("avg_price"),
        F.min(F.when(_active(), F.col("price"))).alias("min_price"),
        F.max(F.when(_active(), F.col("price"))).alias("max_price"))


def storage_summary(products: DataFrame, logs: DataFrame, asof, days: int = 7) -> DataFrame:
    """AGG27: row counts and the CLI size estimate (2 KB per product, 1 KB per log)."""
    p = products.agg(F.count(F.lit(1)).alias("total_products"), F.count_if(_active()).alias("active_products"),
                     F.count_if(~_active()).alias("inactive_products"))
    out = _one_row(p, total_logs=logs.select(F.count(F.lit(1))).scalar(),
                   recent_logs=logs.where(since("created_at", asof, days)).select(F.count(F.lit(1))).scalar())
    kb_p, kb_l = schemas.BYTES_PER_PRODUCT // 1024, schemas.BYTES_PER_LOG // 1024
    return out.withColumn("estimated_kb", F.col("total_products") * kb_p + F.col("total_logs") * kb_l)


def scrape_dates(products: DataFrame) -> DataFrame:
    """AGG28: distinct scrape days, newest first."""
    return (products.where(F.col("scraped_date").isNotNull())
            .select(F.to_date("scraped_date").alias("scrape_date")).distinct()
            .orderBy(F.col("scrape_date").desc()))


def pick_list(df: DataFrame, column: str, non_null: bool = True) -> DataFrame:
    """AGG29: distinct values of one column for a drop-down, sorted."""
    out = df.select(column)
    if non_null:
        out = out.where(F.col(column).isNotNull())
    return out.distinct().orderBy(column)


def is_running(runs: DataFrame) -> DataFrame:
    """AGG30: per platform, whether a run is currently running."""
    return runs.groupBy("platform").agg(F.bool_or(F.col("status") == "running").alias("is_running"))


def ranking_counters(items: DataFrame) -> DataFrame:
    """AGG32: per keyword — cards found, sponsored skipped, organic saved."""
    sp = F.col("is_sponsored")
    return items.groupBy("keyword_id").agg(
        F.count(F.lit(1)).alias("items_found"), F.count_if(sp).alias("sponsored_skipped"),
        F.count_if(~sp).alias("rankings_saved"))
