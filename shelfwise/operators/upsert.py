"""Record cleaning and set-based upserts (§2.9).

The reference writes one row at a time and compares it with the stored row.
Here a whole batch is merged at once: current state and incoming batch are each
reduced to one row per key (``max_by`` partial aggregates, so a hot key costs
one row), full-outer-joined on the key, and every output row carries the
``action`` taken (created / updated / touched / unchanged).  Writing the result
as a new table version is the caller's job (:func:`write_version`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.functions import arrays as ar
from shelfwise.functions import numbers as nm
from shelfwise.functions import text as tx
from shelfwise.functions import urls as ul
from shelfwise.operators.common import lit
from shelfwise.operators.ranking import latest_per_key

# fixed values: product fields whose change marks a product as updated
PRODUCT_CHANGE_FIELDS = [
    "title", "description", "price", "sale_price", "seller_name", "product_badge", "bestseller",
    "category", "offers", "inventory_status", "rating", "review_count", "brand", "model_name", "color",
    "image_urls", "video_urls", "fulfilled_by", "amazon_choice", "highlights", "delivery_price",
    "delivery_date",
]
# fixed values: review fields whose change marks a review as updated
REVIEW_CHANGE_FIELDS = ["reviewer_name", "rating", "review_title", "review_text", "helpful_count",
                        "review_images", "video_urls"]


def _truthy(c: Column) -> Column:
    """PHP ``!empty``: not null, not '' / '0' / false / 0."""
    s = c.cast("string")
    return F.coalesce(~(s.isNull() | s.isin("", "0", "false")), F.lit(False))


def clean_products(raw: DataFrame) -> DataFrame:
    """CLN1: one projection turning raw parsed strings into the typed product row.

    Texts are cleaned whole; shortening for display is STR6's.  Columns missing
    from ``raw`` are treated as null.  Defaults: is_active true,
    review_count 0, flags false unless non-empty.  Star percents keep 0 as 0.
    Keys outside the product schema are dropped; manufacturer is kept (the
    reference drops it by omission).
    """
    have = set(raw.columns)

    def c(name):
        return F.col(name) if name in have else F.lit(None).cast("string")

    def q(name):
        return f"`{name}`" if name in have else "CAST(NULL AS STRING)"

    def s_str(name):
        return F.expr(tx.sanitize_string_sql(q(name)))

    def s_txt(name):
        return F.expr(tx.sanitize_text_sql(q(name)))

    pct = lambda n: F.round(c(n).cast("string").try_cast("double"), 2).cast(schemas.PERCENT)
    url_list = lambda n: (ar.sanitize_urls(c(n)) if name_is_array(raw, n)
                          else ar.sanitize_urls(ar.parse_json_list(c(n))))
    cols = {
        "platform": s_str("platform"), "sku": s_str("sku"),
        "title": s_str("title"),
        "description": s_txt("description"),
        "offers": s_txt("offers"), "inventory_status": s_str("inventory_status"),
        "brand": s_str("brand"), "manufacturer": s_str("manufacturer"),
        "model_name": s_str("model_name"), "color": s_str("color"), "variants": s_str("variants"),
        "weight": s_str("weight"), "dimensions": s_str("dimensions"),
        "product_url": F.expr(ul.sanitize_url_sql(q("product_url"))),
        "category": s_str("category"), "currency_code": s_str("currency_code"),
        "seller_name": s_txt("seller_name"), "highlights": s_txt("highlights"),
        "customers_say": s_txt("customers_say"), "delivery_price": s_txt("delivery_price"),
        "delivery_date": s_txt("delivery_date"),
        "price": F.expr(nm.sanitize_price_sql(q("price"))).cast(schemas.PRICE),
        "sale_price": F.expr(nm.sanitize_price_sql(q("sale_price"))).cast(schemas.PRICE),
        "rating": F.expr(nm.rating_sql(q("rating"))).cast(schemas.RATING),
        **{f"rating_{i}_star_percent": F.coalesce(pct(f"rating_{i}_star_percent"), F.lit(0).cast(schemas.PERCENT))
           for i in range(1, 6)},
        "review_count": F.expr(nm.digits_sql(q("review_count"))).cast("int"),
        "image_urls": url_list("image_urls") if "image_urls" in have else F.lit(None).cast("array<string>"),
        "video_urls": url_list("video_urls") if "video_urls" in have else F.lit(None).cast("array<string>"),
        "technical_details": (ar.sanitize_array(c("technical_details").cast("string"))
                              if "technical_details" in have else F.lit(None).cast("map<string,string>")),
        "additional_information": (ar.sanitize_array(c("additional_information").cast("string"))
                                   if "additional_information" in have else F.lit(None).cast("map<string,string>")),
        "is_active": F.coalesce(c("is_active").cast("string").try_cast("boolean"), F.lit(True))
        if "is_active" in have else F.lit(True),
        "bestseller": _truthy(c("bestseller")),
        "amazon_choice": _truthy(c("amazon_choice")),
        "fulfilled_by": _truthy(c("fulfilled_by")),
    }
    keep = [x for x in raw.columns if x in ("product_id", "scraped_date", "scraper_id", "include_exclude")]
    return raw.select(*keep, *[v.alias(k) for k, v in cols.items()])


def name_is_array(df: DataFrame, name: str) -> bool:
    return name in df.columns and dict(df.dtypes)[name].startswith("array")


def changed(new: str, old: str, fields: list[str]) -> Column:
    """OR over fields of ``new IS NOT NULL AND NOT (new <=> old)``."""
    conds = [F.col(f"{new}.{f}").isNotNull() & ~F.col(f"{new}.{f}").eqNullSafe(F.col(f"{old}.{f}"))
             for f in fields]
    out = F.lit(False)
    for x in conds:
        out = out | x
    return out


def _merge(current: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str],
           touch: dict[str, Column] | None, overwrite_all: bool = True) -> DataFrame:
    cols = [c for c in current.columns if c not in keys and not c.startswith("__")]
    inc_cols = set(incoming.columns)
    fields = [f for f in fields if f in cols and f in inc_cols]
    j = incoming.alias("n").join(current.alias("o"), keys, "full")
    n_present = F.col("__n_seen").isNotNull()
    o_present = F.col("__o_seen").isNotNull()
    is_changed = changed("n", "o", fields)
    action = (F.when(~o_present, "created").when(~n_present, "unchanged")
              .when(is_changed, "updated").otherwise("touched" if touch else "unchanged"))
    out = []
    for c in cols:
        if c.startswith("__"):
            continue
        new = F.col(f"n.{c}") if c in inc_cols else F.lit(None)
        old = F.col(f"o.{c}")
        if c in ("product_id", "id"):   # identity of an existing row is kept
            v = F.when(o_present, old).otherwise(new)
        elif overwrite_all:
            v = F.when(action.isin("created"), new).when(action == "updated", F.coalesce(new, old)).otherwise(old)
        else:
            v = F.when(action == "created", new).when(action == "updated", F.coalesce(new, old)).otherwise(old)
        if touch and c in touch:
            v = F.when(action.isin("created", "updated", "touched"), touch[c]).otherwise(old)
        out.append(v.alias(c))
    return j.select(*keys, *out, action.alias("action"))


def upsert_products(current: DataFrame, incoming: DataFrame, asof, lookback_days: int | None = None) -> DataFrame:
    """UPS1: merge a batch of cleaned product rows into the current products.

    Key (platform, sku) on the current snapshot (WIN1).  Absent → created; any of
    the 22 change fields differs (a null new value never counts nor overwrites) →
    updated with every non-null new value; otherwise touched (only scraped_date
    moves to ``asof``).

    With ``lookback_days`` a stored row only matches when its scraped_date is null
    or within that many days of ``asof``; a product last seen earlier gets a new
    row.  Every stored row that is not the matched one is kept as it is (action
    unchanged), so rows out = rows in + rows created.
    """
    from shelfwise.operators.common import since
    inc = latest_per_key(incoming, ["platform", "sku"], ["scraped_date", "product_id"]) \
        .withColumn("__n_seen", F.lit(True))
    touch = {"scraped_date": F.to_date(lit(asof))}
    if lookback_days is None:
        cur = latest_per_key(current, ["platform", "sku"], ["scraped_date", "product_id"]) \
            .withColumn("__o_seen", F.lit(True))
        return _merge(cur, inc, ["platform", "sku"], PRODUCT_CHANGE_FIELDS, touch=touch)
    recent = F.col("scraped_date").isNull() | since("scraped_date", asof, lookback_days)
    heads = (current.where(recent).groupBy("platform", "sku")
             .agg(F.max(F.struct("scraped_date", "product_id")).alias("__h"))
             .select("platform", "sku", F.col("__h.scraped_date").alias("__d"), F.col("__h.product_id").alias("__p")))
    marked = (current.join(heads, ["platform", "sku"], "left")
              .withColumn("__head", F.coalesce(F.col("product_id").eqNullSafe(F.col("__p"))
                                               & F.col("scraped_date").eqNullSafe(F.col("__d")) & recent, F.lit(False))))
    cur = marked.where("__head").drop("__head", "__d", "__p").withColumn("__o_seen", F.lit(True))
    out = _merge(cur, inc, ["platform", "sku"], PRODUCT_CHANGE_FIELDS, touch=touch)
    history = marked.where(~F.col("__head")).select(
        *[F.lit("unchanged").alias("action") if c == "action" else F.col(c) for c in out.columns])
    return out.unionByName(history)


def ingest_counters(upserted: DataFrame, deactivated: DataFrame | None = None,
                    errors: DataFrame | None = None) -> DataFrame:
    """AGG31: found / added / updated / touched per platform from the action column.

    ``deactivated`` (rows of :func:`deactivate`) and ``errors`` (one row per failure,
    with a platform) add their counters; a platform known to one side only counts 0
    elsewhere.
    """
    a = F.col("action")
    out = upserted.groupBy("platform").agg(
        F.count_if(a != "unchanged").alias("products_found"),
        F.count_if(a == "created").alias("products_added"),
        F.count_if(a == "updated").alias("products_updated"),
        F.count_if(a == "touched").alias("products_touched"))
    if deactivated is not None:
        out = out.join(deactivated.groupBy("platform").agg(
            F.count_if("deactivated").alias("products_deactivated")), "platform", "full")
    if errors is not None:
        out = out.join(errors.groupBy("platform").agg(F.count(F.lit(1)).alias("errors_count")), "platform", "full")
    return out.select("platform", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in out.columns if c != "platform"])


def upsert_reviews(current: DataFrame, incoming: DataFrame, keys=("platform", "sku", "review_id")) -> DataFrame:
    """UPS2: merge reviews on (product, review_id); 7 compared fields; no touch."""
    keys = list(keys)
    cur = latest_per_key(current, keys, ["id"]).withColumn("__o_seen", F.lit(True))
    inc = latest_per_key(incoming, keys, ["id"]).withColumn("__n_seen", F.lit(True))
    return _merge(cur, inc, keys, REVIEW_CHANGE_FIELDS, touch=None)


def upsert_reviews_by_hash(current: DataFrame, incoming: DataFrame, hash_col: str = "review_hash") -> DataFrame:
    """UPS3: reviews keyed by content hash; an existing review only gets its
    helpful_count refreshed, a new one is created."""
    cur = latest_per_key(current, [hash_col], ["id"]).withColumn("__o_seen", F.lit(True))
    inc = latest_per_key(incoming, [hash_col], ["id"]).withColumn("__n_seen", F.lit(True))
    j = inc.alias("n").join(cur.alias("o"), [hash_col], "full")
    o_p, n_p = F.col("__o_seen").isNotNull(), F.col("__n_seen").isNotNull()
    helpful_new = F.col("n.helpful_count")
    upd = o_p & n_p & helpful_new.isNotNull() & ~helpful_new.eqNullSafe(F.col("o.helpful_count"))
    action = F.when(~o_p, "created").when(upd, "updated").otherwise("unchanged")
    cols = [c for c in current.columns if c != hash_col]
    out = [F.when(~o_p, F.col(f"n.{c}")).when((F.lit(c) == "helpful_count") & upd, helpful_new)
           .otherwise(F.col(f"o.{c}")).alias(c) for c in cols]
    return j.select(hash_col, *out, action.alias("action"))


def last_write_wins(current: DataFrame, incoming: DataFrame, keys: list[str],
                    order: list[str] | None = None) -> DataFrame:
    """UPS4: update-or-create where the later load wins (union, then max_by per
    key); ``order`` breaks ties inside one load (latest first)."""
    both = current.withColumn("__load", F.lit(0)).unionByName(
        incoming.withColumn("__load", F.lit(1)), allowMissingColumns=True)
    out = latest_per_key(both, keys, ["__load"] + list(order or []))
    return out.drop("__load")


def stub_products(products: DataFrame, incoming: DataFrame) -> DataFrame:
    """UPS5 (part 1): minimal product rows for ranked (platform, sku) pairs not
    in the catalogue; id = md5(platform|sku)."""
    new = incoming.select("platform", "sku").distinct().join(products.select("platform", "sku"),
                                                             ["platform", "sku"], "left_anti")
    return new.select(F.md5(F.concat_ws("|", "platform", "sku")).alias("product_id"), "platform", "sku",
                      F.lit(True).alias("is_active"))


def upsert_rankings(rankings: DataFrame, products: DataFrame, incoming: DataFrame,
                    order: list[str] | None = None) -> DataFrame:
    """UPS5: update-or-create rankings on (keyword, product, platform); the
    product id comes from the catalogue, or from a stub for unknown products."""
    from shelfwise.operators.joins import product_dim
    dim = product_dim(products, []).select("platform", "sku", "product_id") \
        .unionByName(stub_products(products, incoming).select("platform", "sku", "product_id"))
    inc = incoming.join(dim, ["platform", "sku"], "left")
    cur = rankings.join(dim, ["platform", "sku"], "left") if "product_id" not in rankings.columns else rankings
    return last_write_wins(cur, inc, ["keyword_id", "product_id", "platform"], order)


def append_rankings(df: DataFrame) -> DataFrame:
    """UPS6: rows conformed to the rankings schema, ready for ``append_to``."""
    fields = schemas.RANKINGS.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in fields])


def append_to(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """UPS6 sink: append rows to a parquet table (one writer per partition)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def deactivate(products: DataFrame, platform: str, cutoff) -> DataFrame:
    """UPS7: active products of ``platform`` last scraped before ``cutoff`` become
    inactive; ``deactivated`` marks the rows changed (their count is the return
    value of the reference)."""
    hit = (F.col("platform") == platform) & F.col("is_active") & (F.col("scraped_date") < lit(cutoff))
    hit = F.coalesce(hit, F.lit(False))
    return products.withColumn("deactivated", hit).withColumn(
        "is_active", F.when(hit, F.lit(False)).otherwise(F.col("is_active")))


def retention(logs: DataFrame, products: DataFrame, asof, log_days: int = 30,
              inactive_days: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """UPS8: (kept logs, kept products, counts).

    Logs older than ``log_days`` are dropped; inactive products not scraped for
    ``inactive_days`` are dropped.  ``counts`` is the dry-run report.
    """
    from shelfwise.operators.common import ago
    old_log = F.col("created_at") < ago(asof, log_days)
    stale = F.coalesce((~F.col("is_active")) & (F.col("scraped_date") < ago(asof, inactive_days)), F.lit(False))
    counts = logs.agg(F.count_if(old_log).alias("logs_to_delete")).select(
        "logs_to_delete", products.select(F.count_if(stale)).scalar().alias("products_to_delete"))
    return logs.where(~old_log), products.where(~stale), counts


def bulk_set(df: DataFrame, ids: DataFrame, column: str, value, key: str = "id") -> DataFrame:
    """UPS9: set ``column`` to ``value`` for the rows whose key is in ``ids``."""
    flag = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("__hit", F.lit(True))
    j = df.join(flag, key, "left")
    return j.withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(column))).drop("__hit")


def bulk_delete(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """UPS10: drop the rows whose key is in ``ids``."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")


def apply_url_outcomes(urls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """UPS11: apply processing outcomes to the URL queue.

    ``outcomes``: (id, outcome ∈ processing / completed / failed / reset,
    message, at).  Final status follows the latest outcome (processing,
    completed, failed, or pending after a reset); every failure adds one retry;
    a completion sets last_scraped_at and clears the error; the error message is
    the latest failure's unless a later completion or reset cleared it.
    """
    o = outcomes
    per = o.groupBy("id").agg(
        F.max_by(F.struct("outcome", "message"), F.struct("at", "outcome")).alias("last"),
        F.count_if(F.col("outcome") == "failed").alias("failures"),
        F.max(F.when(F.col("outcome") == "completed", F.col("at"))).alias("done_at"))
    j = urls.join(per, "id", "left")
    last = F.col("last.outcome")
    status = (F.when(last == "reset", "pending").when(last.isNotNull(), last).otherwise(F.col("status")))
    err = (F.when(last == "failed", F.col("last.message")).when(last.isin("completed", "reset"), F.lit(None))
           .otherwise(F.col("error_message") if "error_message" in urls.columns else F.lit(None)))
    out = j.withColumn("status", status) \
        .withColumn("retry_count", (F.col("retry_count") + F.coalesce(F.col("failures"), F.lit(0))).cast("int")) \
        .withColumn("error_message", err.cast("string"))
    prev = F.col("last_scraped_at") if "last_scraped_at" in urls.columns else F.lit(None).cast("timestamp_ntz")
    out = out.withColumn("last_scraped_at", F.coalesce(F.col("done_at"), prev))
    return out.drop("last", "failures", "done_at")


def close_runs(configs: DataFrame, runs: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """UPS12: close runs and roll the closures up into their configurations.

    ``outcomes``: (scraper_id, status, finished_at).  Runs get status,
    completed_at and duration (finished − created); each configuration gets
    total_runs + closed runs, last_run_at and the id of its latest closure.
    """
    r = runs.join(outcomes.select("scraper_id", F.col("status").alias("__st"), "finished_at"), "scraper_id", "left")
    closed = F.col("__st").isNotNull()
    runs_out = r.select(
        *[F.when(closed, F.col("__st")).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c)
          for c in runs.columns if c != "duration_seconds"],
        F.when(closed, F.col("finished_at")).alias("completed_at"),
        F.when(closed, F.abs(F.timestamp_diff("SECOND", F.col("created_at"), F.col("finished_at"))).cast("int"))
        .otherwise(F.col("duration_seconds")).alias("duration_seconds"))
    per = r.where(closed).groupBy(F.col("configuration_id").alias("id")).agg(
        F.count(F.lit(1)).alias("__n"), F.max("finished_at").alias("__last"),
        F.max_by("scraper_id", F.struct("finished_at", "scraper_id")).alias("__last_id"))
    c = configs.join(per, "id", "left")
    cfg = c.select(
        *[F.col(x) for x in configs.columns if x not in ("total_runs", "last_run_at", "last_scraper_id")],
        (F.col("total_runs") + F.coalesce(F.col("__n"), F.lit(0))).cast("int").alias("total_runs"),
        F.coalesce(F.col("__last"), F.col("last_run_at")).alias("last_run_at"),
        F.coalesce(F.col("__last_id"), F.col("last_scraper_id")).alias("last_scraper_id"))
    return runs_out, cfg


def append_errors(logs: DataFrame, errors: DataFrame) -> DataFrame:
    """UPS13: fold error events into their sessions.

    ``errors``: (session_id, message, details, timestamp).  Each session gains
    the number of its errors, keeps the latest message and the time of its
    first and last error — all partial aggregates, so a session with millions
    of errors costs one row per map task.  The ordered detail list of the
    reference is kept as rows by :func:`error_details` instead of one growing
    array per session.
    """
    per = errors.groupBy(F.col("session_id").alias("id")).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max_by("message", F.struct("timestamp", "message")).alias("__last"),
        F.min("timestamp").alias("first_error_at"), F.max("timestamp").alias("last_error_at"))
    j = logs.join(per, "id", "left")
    prev_msg = F.col("error_message") if "error_message" in logs.columns else F.lit(None).cast("string")
    return (j.withColumn("errors_count", (F.col("errors_count") + F.coalesce(F.col("__n"), F.lit(0))).cast("int"))
            .withColumn("error_message", F.coalesce(F.col("__last"), prev_msg))
            .drop("__n", "__last"))


def error_details(errors: DataFrame) -> DataFrame:
    """UPS13 detail rows {session, message, details, timestamp} in session and time
    order (a range-partitioned sort, never gathered per session)."""
    return errors.select(F.col("session_id").alias("id"), "message", "details", "timestamp") \
        .orderBy("id", "timestamp", "message")


def write_version(df: DataFrame, base: str, version: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a new version directory ``base/v=<version>`` and return it.

    Readers pick the newest complete version; the old one stays readable until
    the new one is fully written, which is the atomic swap the reference got
    from per-row transactions.
    """
    path = f"{base.rstrip('/')}/v={version}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
