"""Window-shaped operators, top-k and latest-per-key (§2.5).

Latest / first per key use ``max_by`` / ``min_by`` (partial aggregation, skew
safe) rather than ``row_number`` over a full sort of each key.  Position
numbering across pages is done in two levels so that no single task numbers a
whole keyword: rows are counted per (keyword, page, day) split, a window over
that small count table gives each split its starting offset, and the rows are
then numbered inside their split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.operators.common import since, stored


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], cols: list[str] | None = None) -> DataFrame:
    """Row with the greatest ``order`` tuple per key (nulls lose).

    ``max_by`` is a partial aggregate, so a key with millions of rows is cut to
    one row per map task before the shuffle.  Pass ``cols`` to carry only the
    columns the caller needs through the aggregate (Catalyst does not prune
    fields inside the aggregated struct).
    """
    other = [c for c in (cols or df.columns) if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*other), F.struct(*order)).alias("__r"))
    return agg.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in other])


def first_per_key(df: DataFrame, keys: list[str], order: str | list[str], cols: list[str] | None = None) -> DataFrame:
    """Row with the smallest ``order`` per key (``cols``: columns to keep)."""
    order = [order] if isinstance(order, str) else order
    other = [c for c in (cols or df.columns) if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*other), F.struct(*order)).alias("__r"))
    return agg.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in other])


def current_snapshot(products: DataFrame, asof=None, lookback_days: int | None = 2) -> DataFrame:
    """WIN1: current row per (platform, sku) — scraped_date null or within the
    lookback, latest first (nulls last, ties by product_id)."""
    df = products
    if lookback_days is not None and asof is not None:
        df = df.where(F.col("scraped_date").isNull() | since("scraped_date", asof, lookback_days))
    return latest_per_key(df, ["platform", "sku"], ["scraped_date", "product_id"])


def latest_ranking(rankings: DataFrame, keys=("keyword_id", "sku")) -> DataFrame:
    """WIN2: latest ranking per (keyword, product)."""
    return latest_per_key(rankings, list(keys), ["created_at", "id"])


def ranking_history(rankings: DataFrame, asof, days: int = 30) -> DataFrame:
    """WIN3: ranking history of the last ``days``, newest first per (keyword, product)."""
    return (rankings.where(since("created_at", asof, days))
            .orderBy("keyword_id", "sku", F.col("created_at").desc(), F.col("id").desc()))


def number_rows(df: DataFrame, partition: list[str], splits: list[Column | str],
                order: list[Column | str], name: str = "seq") -> DataFrame:
    """Gap-free 1..n numbering per ``partition`` in ``order`` without a
    per-partition sort of all rows.

    ``splits`` must be a coarsening of ``order`` (monotone prefix), e.g. page
    and day for an order of (page, created_at, id).  Rows are counted per split;
    the start offset of each split is a running sum over the small count table;
    rows are numbered inside their split and shifted by that offset.
    """
    split_cols = [F.col(s) if isinstance(s, str) else s for s in splits]
    names = [f"__s{i}" for i in range(len(split_cols))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(split_cols, names)])
    counts = tagged.groupBy(*partition, *names).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*partition).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*partition, *names,
                            F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    inner = Window.partitionBy(*partition, *names).orderBy(*order)
    numbered = tagged.withColumn("__rn", F.row_number().over(inner))
    out = numbered.join(offsets, [*partition, *names])
    return out.withColumn(name, (F.col("__off") + F.col("__rn")).cast("int")).drop("__off", "__rn", *names)


def organic_position(items: DataFrame) -> DataFrame:
    """WIN4: organic position running across pages; sponsored cards removed
    before numbering (Amazon, Flipkart, Meesho)."""
    organic = items.where(~F.col("is_sponsored"))
    return number_rows(organic, ["keyword_id"], ["page", F.to_date("created_at")],
                       ["created_at", "item_id"], "position")


def _ordinal(items: DataFrame, name: str = "__ordinal") -> DataFrame:
    """Card ordinal within its (keyword, page), numbered in day splits."""
    return number_rows(items, ["keyword_id", "page"], [F.to_date("created_at")], ["created_at", "item_id"], name)


def slot_position(items: DataFrame, per_page: int = 24) -> DataFrame:
    """WIN5: fixed page slots — (page-1)*per_page + ordinal, sponsored cards
    consume a slot; they are dropped after numbering (Reliance Digital, BigBasket)."""
    n = _ordinal(items)
    return (n.withColumn("position", ((F.col("page") - 1) * per_page + F.col("__ordinal")).cast("int"))
            .where(~F.col("is_sponsored")).drop("__ordinal"))


def organic_slot_position(items: DataFrame, per_page: int = 24) -> DataFrame:
    """WIN6: fixed page slots counting organic cards only; cards without a sku
    still consume a slot and are dropped afterwards (Croma)."""
    n = _ordinal(items.where(~F.col("is_sponsored")))
    return (n.withColumn("position", ((F.col("page") - 1) * per_page + F.col("__ordinal")).cast("int"))
            .where(F.col("sku").isNotNull()).drop("__ordinal"))


def kept_base_position(items: DataFrame) -> DataFrame:
    """WIN7: base = organic cards kept on earlier pages, plus the card's ordinal
    among *all* cards of its page (VijaySales).  Positions can repeat; kept as is."""
    kept = (items.groupBy("keyword_id", "page")
            .agg(F.count_if(~F.col("is_sponsored")).alias("__kept")))
    w = Window.partitionBy("keyword_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    base = kept.select("keyword_id", "page", F.coalesce(F.sum("__kept").over(w), F.lit(0)).alias("__base"))
    n = _ordinal(items).join(base, ["keyword_id", "page"])
    return (n.withColumn("position", (F.col("__base") + F.col("__ordinal")).cast("int"))
            .where(~F.col("is_sponsored")).drop("__base", "__ordinal"))


def last_runs(runs: DataFrame, k: int = 10, per_config: bool = True) -> DataFrame:
    """WIN8: last k runs per configuration (window group limit), or overall."""
    order = [F.col("created_at").desc(), F.col("scraper_id").desc()]
    if not per_config:
        return runs.orderBy(*order).limit(k)
    w = Window.partitionBy("configuration_id").orderBy(*order)
    return runs.withColumn("run_rank", F.row_number().over(w)).where(F.col("run_rank") <= k)


def platform_last_next(runs: DataFrame, urls: DataFrame) -> DataFrame:
    """WIN9: per platform, the last completed run and the next url to process.

    Runs: latest by (completed_at, created_at, scraper_id).  Urls: the one with
    the earliest ``next_scheduled_run`` when scheduled, else the head of the
    pending queue (priority desc, id asc).
    """
    ts = "completed_at" if "completed_at" in runs.columns else "created_at"
    last = (runs.where(F.col("status") == "completed").groupBy("platform")
            .agg(F.max_by("scraper_id", F.struct(ts, "scraper_id")).alias("last_completed_run"),
                 F.max(ts).alias("last_completed_at")))
    if "next_scheduled_run" in urls.columns:
        nxt = (urls.where(F.col("next_scheduled_run").isNotNull()).groupBy("platform")
               .agg(F.min_by("id", F.struct("next_scheduled_run", "id")).alias("next_url_id")))
    else:
        nxt = (urls.where(F.col("status") == "pending").groupBy("platform")
               .agg(F.min_by("id", F.struct((-F.col("priority")), "id")).alias("next_url_id")))
    return last.join(nxt, "platform", "full")


def first_per_sku(products: DataFrame) -> DataFrame:
    """WIN10: first row (lowest product_id) per sku.

    The least ids are found over the two columns alone and only the rows that hold them
    are compared whole: aggregating whole rows would sort all of them before a shuffle.
    """
    least = products.groupBy(F.col("sku").alias("__sku")).agg(F.min(F.struct("product_id")).alias("__least")).select("__sku", F.col("__least.product_id").alias("__id"))
    held = products.join(least, F.col("sku").eqNullSafe(F.col("__sku")) & F.col("product_id").eqNullSafe(F.col("__id")), "left_semi")
    return first_per_key(held, ["sku"], "product_id")


def pending_queue(urls: DataFrame, n: int = 10) -> DataFrame:
    """WIN11: per platform the next ``n`` pending urls — priority desc, then oldest."""
    order = [F.col("priority").desc()] + ([F.col("created_at")] if "created_at" in urls.columns else []) + [F.col("id")]
    w = Window.partitionBy("platform").orderBy(*order)
    return (urls.where(F.col("status") == "pending")
            .withColumn("queue_rank", F.row_number().over(w)).where(F.col("queue_rank") <= n))


def page_cutoff(pages: DataFrame, key: str, max_bad: int = 3, good: Column | str = "good") -> DataFrame:
    """WIN12: stop each page sequence at the first run of ``max_bad`` consecutive
    bad pages; keep the pages before that run.

    The streak of bad pages is counted within groups that start after each good
    page (``grp = number of good pages so far``); the cut-off page is the first
    page whose streak reaches ``max_bad``.  All windows run on one row per page.
    """
    g = F.col(good) if isinstance(good, str) else good
    w = Window.partitionBy(key).orderBy("page")
    df = pages.withColumn("__good", g.cast("int"))
    df = df.withColumn("__grp", F.sum("__good").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("__streak", F.sum(1 - F.col("__good")).over(
        Window.partitionBy(key, "__grp").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)))
    cut = F.min(F.when(F.col("__streak") >= max_bad, F.col("page") - max_bad + 1)).over(Window.partitionBy(key))
    df = df.withColumn("__cut", cut)
    return (df.where(F.col("__cut").isNull() | (F.col("page") < F.col("__cut")))
            .drop("__good", "__grp", "__streak", "__cut"))


def retry_outcome(attempts: DataFrame, key: str = "page_key", max_retries: int = 3) -> DataFrame:
    """WIN13: per page, the first attempt (within ``max_retries``) that returned
    rows; ``recovered`` false when none did.  Trying stops at that attempt, so later
    ones are not counted in ``attempts_used``."""
    ok = (F.col("rows_found") > 0) & (F.col("attempt") <= max_retries)
    return attempts.groupBy(key).agg(
        F.count_if(F.col("attempt") <= max_retries).alias("__tried"),
        F.min(F.when(ok, F.col("attempt"))).alias("recovered_at"),
    ).select(key, F.least(F.col("__tried"), F.col("recovered_at")).cast("long").alias("attempts_used"),
             "recovered_at", F.col("recovered_at").isNotNull().alias("recovered"))


def _neighbours(instants: DataFrame, limit: Column) -> DataFrame:
    """(k, t, before, nxt) for distinct (k, t): the instant just before, and the first one at least ``limit`` later.

    Both are looked up inside (key, hour) slices; what a slice does not hold comes from a
    table with one row per slice, so no task sees all instants of a key.
    """
    asked = instants.select("k", (F.col("t") + limit).alias("at"), F.col("t").alias("t"), F.lit(True).alias("ask"))
    events = instants.select("k", F.col("t").alias("at"), "t", F.lit(False).alias("ask")).unionByName(asked)
    events = events.withColumn("slice", F.date_trunc("HOUR", F.col("at")))
    here = F.when(~F.col("ask"), F.col("at"))
    slices = events.groupBy("k", "slice").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    up, down = Window.partitionBy("k").orderBy("slice"), Window.partitionBy("k").orderBy(F.col("slice").desc())
    slices = slices.select("k", "slice", F.max("last").over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
                           F.min("first").over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    # running aggregates: ascending for the instant before, descending for the first one from here on (an equal instant counts)
    back = Window.partitionBy("k", "slice").orderBy("at", F.col("ask").desc()).rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy("k", "slice").orderBy(F.col("at").desc(), "ask").rowsBetween(Window.unboundedPreceding, -1)
    found = events.select("k", "slice", "t", "ask", F.max(here).over(back).alias("below"), F.min(here).over(on).alias("above")).join(slices, ["k", "slice"])
    before = found.where("NOT ask").select("k", "t", F.coalesce("below", "earlier").alias("before"))
    nxt = found.where("ask").select("k", "t", F.coalesce("above", "later").alias("nxt"))
    return before.join(nxt, ["k", "t"])


def cooldown(attempts: DataFrame, ts: str = "created_at", key: str = "platform", hours: int = 12) -> DataFrame:
    """WIN14: greedy cool-down — an attempt is accepted when it is at least
    ``hours`` after the previously *accepted* one.

    Pointer jumping.  Every attempt points to the first one at least ``hours`` later; an
    accepted attempt's successor is where it points to.  An attempt without another one in
    the ``hours`` before it is accepted whatever came earlier, so all of these start at
    once.  Each round accepts what the accepted ones point to and replaces every pointer
    by the one two steps on, so a chain of n attempts takes log2(n) rounds of joins on
    (key, instant); nothing is gathered per key or per chain.

    Attempts at one instant are one attempt; a null key or instant takes no part.
    """
    limit = F.expr(f"INTERVAL {int(hours)} HOURS")
    instants = attempts.select(F.col(key).alias("k"), F.col(ts).alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct()
    nodes = stored(_neighbours(instants, limit), "cooldown-nodes")
    accepted = nodes.where(F.col("before").isNull() | (F.col("t") - F.col("before") >= limit)).select("k", "t")
    # a pointer to such a start tells nothing new, and without it chains end there
    jump = stored(nodes.where("nxt IS NOT NULL").join(accepted.withColumnRenamed("t", "nxt"), ["k", "nxt"], "left_anti").select("k", "t", "nxt"), "cooldown-jump")
    while True:
        reached = stored(accepted.join(jump, ["k", "t"]).select("k", F.col("nxt").alias("t")), "cooldown-reached")
        if reached.isEmpty():
            break
        accepted = accepted.union(reached)
        further = jump.select("k", F.col("t").alias("nxt"), F.col("nxt").alias("end"))
        jump = stored(jump.join(further, ["k", "nxt"]).select("k", "t", F.col("end").alias("nxt")), "cooldown-jump")
    return accepted.select(F.col("k").alias(key), F.col("t").alias(ts))
