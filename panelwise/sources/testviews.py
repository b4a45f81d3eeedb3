"""Study-shaped views over the star-schema test tables.

Every view is an ordinary lazy DataFrame over whole tables; ``FIXTURES.md`` lists the derivations. The only
array held in one value is the list of calendar days, which the calendar itself bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ["steps", "heart", "sleep"]
DAILY_ITEMS = ["click", "error", "purchase", "signup", "view"]
SYMPTOMS = ["economy", "large", "medium", "promo", "small", "standard"]
COHORTS = ["alpha", "beta", "gamma"]
VALID_DAYS = 10


# Declared, so that no read starts with a job that looks for the schema.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def cohort_of(user: Column) -> Column:
    rest = user % 3
    return F.when(rest == 0, "alpha").when(rest == 1, "beta").otherwise("gamma")


def day_activity(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (user, day with events)."""
    value, kind = F.col("value"), F.col("event_type")
    return (
        table(spark, folder, "events")
        .groupBy("user_id", F.to_date("ts").alias("study_date"))
        .agg(
            F.sum(F.when(kind == "click", value)).alias("steps_raw"),
            F.avg(F.when(kind == "view", value)).alias("heart_raw"),
            F.sum(F.when(kind == "purchase", value)).alias("sleep_raw"),
            *[F.count_if(kind == item).alias(f"n_{item}") for item in DAILY_ITEMS],
        )
    )


def person(daily: DataFrame) -> DataFrame:
    """One row per event user: onset day and validity of each channel."""
    return daily.groupBy("user_id").agg(
        F.min(F.when(F.col("n_error") > 0, F.col("study_date"))).alias("date_onset"),
        *[
            F.when(F.count(f"{c}_raw") >= VALID_DAYS, 1).otherwise(0).alias(f"valid_user__{c}")
            for c in CHANNELS
        ],
    )


def _calendar(spark: SparkSession, folder: str) -> Column:
    days = table(spark, folder, "events").select(F.to_date("ts").alias("d"))
    return days.agg(F.array_sort(F.collect_set("d"))).scalar()


def grid(spark: SparkSession, folder: str, daily: DataFrame) -> DataFrame:
    """Every user on every study day, with that day's activity where there was any."""
    users = person(daily).withColumn("calendar", _calendar(spark, folder))
    first, last = F.element_at("calendar", 1), F.element_at("calendar", -1)
    dense = (
        users.withColumn("first_date", first)
        .withColumn("weeks", (F.floor(F.datediff(last, first) / 7) + 1).cast("int"))
        .withColumn("study_date", F.explode("calendar"))
        .drop("calendar")
    )
    day = F.col("study_date")
    return (
        dense.join(daily, ["user_id", "study_date"], "left")
        .withColumn("cohort", cohort_of(F.col("user_id")))
        .withColumn("days_since_onset", F.datediff(day, "date_onset"))
        .withColumn("day_of_week", F.date_format(day, "EEEE"))
        .withColumn("week", F.floor(F.datediff(day, "first_date") / 7).cast("int"))
    )


def unchecked_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel before the values of non-valid users are blanked; breaks the validity rules on purpose."""
    rows = grid(spark, folder, day_activity(spark, folder))
    return rows.select(
        "user_id", "study_date", "cohort",
        *[f"valid_user__{c}" for c in CHANNELS],
        *[F.col(f"{c}_raw").isNotNull().cast("int").alias(f"valid_day__{c}") for c in CHANNELS],
        *[F.col(f"{c}_raw").alias(f"{c}__observed") for c in CHANNELS],
    )


def activity_panel(spark: SparkSession, folder: str) -> DataFrame:
    daily = day_activity(spark, folder)
    observed = {c: F.when(F.col(f"valid_user__{c}") == 1, F.col(f"{c}_raw")) for c in CHANNELS}
    # mean of the kept values on each date, from the observed days only; one entry a calendar day, read without a join
    state = (
        daily.join(person(daily).drop("date_onset"), "user_id")
        .groupBy("study_date")
        .agg(*[F.avg(observed[c]).alias(f"state_{c}") for c in CHANNELS])
    )
    means = state.select(
        F.map_from_entries(F.collect_list(F.struct("study_date", F.struct(*[f"state_{c}" for c in CHANNELS]))))
    ).scalar()
    x = F.col("week") - (F.col("weeks") - 1) / 2.0
    w = F.col("weeks").cast("double")
    w2 = w * w
    onset = F.col("days_since_onset")
    return (
        grid(spark, folder, daily)
        .withColumn("_means", means[F.col("study_date")])
        .withColumns({f"state_{c}": F.col(f"_means.state_{c}") for c in CHANNELS})
        .select(
            "user_id", "study_date", "cohort", "date_onset", "days_since_onset", "day_of_week",
            F.when((onset < -2) | (onset > 10), "baseline").otherwise("event").alias("flu_period"),
            *[f"valid_user__{c}" for c in CHANNELS],
            *[observed[c].isNotNull().cast("int").alias(f"valid_day__{c}") for c in CHANNELS],
            *[observed[c].alias(f"{c}__observed") for c in CHANNELS],
            F.try_divide(x, F.sqrt(w * (w2 - 1) / 12)).alias("week_L"),
            F.try_divide(x * x - (w2 - 1) / 12, F.sqrt(w * (w2 - 1) * (w2 - 4) / 180)).alias("week_Q"),
            F.try_divide(
                x * x * x - x * (3 * w2 - 7) / 20, F.sqrt(w * (w2 - 1) * (w2 - 4) * (w2 - 9) / 2800)
            ).alias("week_C"),
            (F.col("state_steps") / 1000).alias("state__steps__scale1k"),
            F.col("state_heart").alias("state__heart"),
            (F.col("state_sleep") / 60).alias("state__sleep__scale60"),
        )
    )


def daily_symptoms(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid(spark, folder, day_activity(spark, folder))
    return rows.select(
        "user_id", "study_date", "cohort", "days_since_onset",
        *[F.when(F.col(f"n_{item}") > 0, 1.0).alias(f"daily_symp__{item}") for item in DAILY_ITEMS],
        F.lit(None).cast("double").alias("daily_symp__never"),
    )


def first_orders(spark: SparkSession, folder: str) -> DataFrame:
    first = F.min(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")).alias("first")
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(first)
        .select(
            "user_id",
            F.col("first.o_orderkey").alias("order_key"),
            F.to_date("first.o_orderdate").alias("date_onset"),
            F.lower("first.o_orderpriority").alias("priority"),
        )
    )


def participants(spark: SparkSession, folder: str) -> DataFrame:
    user, balance = F.col("c_custkey"), F.col("c_acctbal")
    areas = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.lower("r_name").alias("area"))
    )
    return (
        table(spark, folder, "customer")
        .join(areas, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            user.alias("user_id"),
            cohort_of(user).alias("cohort"),
            "area",
            F.lower(F.nullif("c_mktsegment", F.lit("MACHINERY"))).alias("segment"),
            F.when(balance < 0, None)
            .when(balance < 2500, "< 2500")
            .when(balance < 5000, "2500 - 4999")
            .when(balance < 7500, "5000 - 7499")
            .otherwise("7500 +")
            .alias("balance_group"),
            balance.alias("balance"),
            F.when(user % 7 == 0, True).alias("cond_a"),
            F.when(user % 11 == 0, True).alias("cond_b"),
            F.when(user % 13 == 0, True).alias("cond_ab"),
        )
        .join(first_orders(spark, folder).select("user_id", "priority"), "user_id", "left")
        .join(person(day_activity(spark, folder)).drop("date_onset"), "user_id", "left")
    )


def events_survey(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with an order; the items of the first order give the answers."""
    kinds = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("kind")
    )
    items = (
        table(spark, folder, "lineitem")
        .select(
            F.col("l_orderkey").alias("order_key"), "l_partkey", "l_linenumber", "l_quantity",
            F.lower("l_returnflag").alias("flag"), "l_linestatus",
        )
        .join(first_orders(spark, folder).select("order_key"), "order_key", "left_semi")
        .join(kinds, "l_partkey", "left")
        .groupBy("order_key")
        .agg(
            F.max("l_quantity").cast("int").alias("days_ill"),
            *[F.max(F.when(F.col("kind") == s, F.col("kind"))).alias(f"symptoms__{s}") for s in SYMPTOMS],
            F.array_join(F.array_sort(F.collect_set("flag")), "__").alias("care"),
            F.min(F.struct("l_linenumber", "l_partkey", "l_linestatus"))["l_linestatus"].alias("status"),
        )
    )
    return (
        first_orders(spark, folder)
        .join(items, "order_key", "left")
        .select(
            "user_id",
            cohort_of(F.col("user_id")).alias("cohort"),
            "date_onset",
            F.date_add("date_onset", F.col("days_ill")).alias("date_recovery"),
            *[f"symptoms__{s}" for s in SYMPTOMS],
            F.coalesce("care", F.lit("unavailable")).alias("care_where"),
            F.when(F.col("status") == "F", "yes").when(F.col("status") == "O", "no").alias("hospitalized"),
        )
    )
