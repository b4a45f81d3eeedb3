"""The study's results, put together from the operators. Column names are arguments throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.numeric import ratio, total
from panelwise.functions.text import last_part, recode, title_case
from panelwise.operators import cohorts, inference, mixed, panel, reshape, smooth, summary, timecourse
from panelwise.session import cut

UNAVAILABLE = "Unavailable"


def tidy_answer(labels: dict[str, str] | None = None, missing: str = UNAVAILABLE):
    """Title case, a text for missing answers, then readable labels."""
    return lambda answer: recode(F.coalesce(title_case(answer), F.lit(missing)), labels or {})


def answer_counts(rows: DataFrame, labelled: Column, questions: list[str], clean=None) -> DataFrame:
    """Counts per (cohort_label, variable, value) of a wide table with one row per user.

    ``labelled`` is the array of a row's cohorts. On the participant table it comes from the row itself, so
    counting needs no join; other tables bring it along with ``with_labels``.
    """
    long = reshape.melt(rows.select(F.explode(labelled).alias("cohort_label"), *questions), ["cohort_label"], questions)
    return summary.counts(long, ["cohort_label", "variable"], clean=clean)


def with_labels(rows: DataFrame, people: DataFrame, user: str, labelled: Column, name: str = "labels") -> DataFrame:
    """Adds the cohorts of each row's user from the participant table (one row per user); unknown users have none."""
    return rows.join(people.select(user, labelled.alias(name)), user, "left")


def ordered_summary(
    table: DataFrame, questions: list[str], answers: list[str], question: str = "variable", answer: str = "value"
) -> DataFrame:
    """Rows in the order of two fixed lists; unlisted questions and answers are left out."""
    placed = reshape.reindex(table, question, questions, "question_position")
    return reshape.reindex(placed, answer, answers, "answer_position")


def care_location(answer: Column, known: list[str], joined: str = "__") -> Column:
    """Several places become ``multiple``, unknown ones ``other``; the first rule that applies wins.

    The question must have been answered: a missing answer stops the query.
    """
    missing = F.raise_error(F.lit("a care location is missing")).cast("string")
    cleaned = F.when(answer.isNull(), missing).when(answer.contains(joined), "multiple").otherwise(answer)
    return F.when(cleaned.isin(known), cleaned).otherwise("other")


def place_in_order(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Numbers the rows of a short result (items of one table, symptom sets) in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def presence(events: DataFrame, keys: list[str], symptoms: list[str]) -> DataFrame:
    """Symptom columns as true/false: present when the text is not missing."""
    return events.select(*keys, *[F.col(s).isNotNull().alias(s) for s in symptoms])


def combination_counts(events: DataFrame, cohort: str, symptoms: list[str]) -> DataFrame:
    """Rows per cohort and combination of symptoms: ``(cohort, items, n)``, items a sorted array of names.

    Everything about co-occurring symptoms follows from this short table; the events are read once.
    """
    flags = presence(events.filter(F.col(cohort).isNotNull()), [cohort], symptoms)
    counted = flags.groupBy(cohort, *symptoms).agg(F.count(F.lit(1)).alias("n"))
    items = F.array_compact(F.array(*[F.when(F.col(s), F.lit(last_name(s))) for s in symptoms]))
    return cut(counted.select(cohort, F.array_sort(items).alias("items"), "n"))


def last_name(column: str) -> str:
    return column.split("__")[-1]


def symptom_totals(combos: DataFrame, cohort: str, labels: list[str]) -> DataFrame:
    """Reports per symptom, one column per cohort."""
    long = combos.select(cohort, F.explode("items").alias("symptom"), "n")
    cells = [total(F.when(F.col(cohort) == c, F.col("n"))).alias(c) for c in labels]
    return long.groupBy("symptom").agg(*cells)


def top_symptoms(combos: DataFrame, cohort: str, labels: list[str], k: int = 5) -> DataFrame:
    """Symptoms among the ``k`` most frequent of at least one cohort (first name on ties)."""
    totals = symptom_totals(combos, cohort, labels).unpivot(["symptom"], labels, "cohort", "n")
    best = Window.partitionBy("cohort").orderBy(F.desc("n"), "symptom")
    return totals.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("symptom").distinct()


def top_symptom_shares(combos: DataFrame, cohort: str, labels: tuple[str, str], k: int = 5) -> DataFrame:
    """Totals of the top symptoms in two cohorts, percent of each cohort, ordered by the first one's share."""
    a, b = labels
    totals = symptom_totals(combos, cohort, [a, b])
    kept = cohorts.restrict(totals, top_symptoms(combos, cohort, [a, b], k), "symptom")
    size = lambda c: combos.select(total(F.when(F.col(cohort) == c, F.col("n")))).scalar()
    shares = kept.select(
        "symptom", a, b, (F.col(a) + F.col(b)).alias("total"),
        ratio(F.col(a), F.col(a) + F.col(b)).alias("share"),
        ratio(F.col(a) * 100, size(a)).alias(f"{a}_percent"), ratio(F.col(b) * 100, size(b)).alias(f"{b}_percent"),
    )
    return place_in_order(shares, F.asc("share"), F.asc("symptom"))


def symptom_sets(
    combos: DataFrame, cohort: str, labels: list[str], k: int = 5, min_share: float = 0.02
) -> DataFrame:
    """Sets of top symptoms with their counts per cohort, largest first; rare sets are left out.

    Each combination is reduced to its top symptoms, and combinations that become equal are added up.
    """
    top = top_symptoms(combos, cohort, labels, k)
    listed = top.select(F.array_sort(F.collect_set("symptom"))).scalar()  # bounded by the symptom columns
    reduced = combos.select(cohort, F.array_intersect("items", listed).alias("items"), "n")
    cells = [total(F.when(F.col(cohort) == c, F.col("n"))).alias(c) for c in labels]
    sets = reduced.groupBy("items").agg(*cells, F.sum("n").alias("total"))
    rows = combos.select(F.sum("n")).scalar()
    kept = sets.filter(F.col("total") >= rows * F.lit(min_share)).select(
        F.array_join("items", "+").alias("symptom_set"), F.size("items").alias("cardinality"), *labels, "total"
    )
    return place_in_order(kept, F.desc("total"), F.desc("cardinality"), F.asc("symptom_set"))


def symptom_set_count(combos: DataFrame, cohort: str, labels: list[str], k: int = 5) -> DataFrame:
    """The number of sets of top symptoms before rare ones are left out, and of the reports in them."""
    return symptom_sets(combos, cohort, labels, k, min_share=0.0).agg(
        F.count(F.lit(1)).alias("n_sets"), total(F.col("total")).alias("n_reports")
    )


def in_coverage_order(
    grid: DataFrame, cohort: str, cohorts_in_order: list[str], channels: list[str], onset_label: str = "Symptoms Onset",
    missing_label: str = "no observation",
) -> DataFrame:
    """A coverage grid with the places of cohort, channel and kind of day in which they are shown."""
    kinds = [onset_label, *[f"{c} observation" for c in cohorts_in_order], missing_label]
    placed = reshape.with_position(grid, cohort, cohorts_in_order, "cohort_position")
    placed = reshape.with_position(placed, "channel", channels, "channel_position")
    return reshape.with_position(placed, "day_type", kinds, "day_type_position")


def symptom_summary(
    counted: DataFrame, peaks: DataFrame, labels: dict[str, str], cohort: str, absent: str = "", missing: str = "NA"
) -> DataFrame:
    """Percent of every cohort that reported a symptom, with peak days, most common in the first cohort first.

    ``labels`` maps cohort labels of the counts to the cohorts of ``peaks``; the sort uses the numbers, not
    their text. ``counted`` keeps the ``absent`` answers, which belong to the denominators.
    """
    shares = summary.with_share(counted, ["cohort_label", "variable"]).filter(F.col("value") != absent)
    names = list(labels)
    percent = shares.groupBy(last_part(F.col("variable")).alias("symptom")).agg(
        *[F.max(F.when(F.col("cohort_label") == c, F.col("percent"))).alias(c) for c in names]
    )
    days = peaks.groupBy(F.col("variable").alias("symptom")).agg(
        *[F.max(F.when(F.col(cohort) == labels[c], F.col("peak_day"))).alias(f"{c} peak") for c in names]
    )
    placed = place_in_order(percent.join(days, "symptom"), F.desc_nulls_last(names[0]), F.asc("symptom"))
    cell = lambda c: F.coalesce(F.concat(F.bround(c, 1).cast("string"), F.lit("%")), F.lit(missing))
    return placed.select(
        "symptom", "position",
        *[cell(c).alias(c) for c in names],
        *[F.coalesce(F.col(f"{c} peak").cast("string"), F.lit(missing)).alias(f"{c} peak") for c in names],
    )


def pooled_presence(counted: DataFrame, absent: str = "") -> DataFrame:
    """Counts of reported symptoms as one table, symptom x cohort, for a single pooled test."""
    return counted.filter(F.col("value") != absent).select(
        F.lit("symptoms").alias("variable"), F.col("variable").alias("value"), "cohort_label", "n"
    )


def condition_table(
    people: DataFrame, labelled: Column, conditions: list[str], labels: list[str], names: dict[str, str] | None = None
) -> DataFrame:
    """``n (p%)`` of users with each condition per cohort; every user of a cohort is in the denominator.

    Rows are placed by the count in the first cohort.
    """
    rows = people.select(F.explode(labelled).alias("cohort_label"), *conditions)
    sums = rows.groupBy("cohort_label").agg(
        F.count(F.lit(1)).alias("n_group"), *[F.count_if(F.col(c)).alias(c) for c in conditions]
    )
    long = sums.unpivot(["cohort_label", "n_group"], conditions, "variable", "n")
    here = [F.col("cohort_label") == c for c in labels]
    table = long.groupBy("variable").agg(
        *[F.max(F.when(at, F.col("n"))).alias(f"_n{i}") for i, at in enumerate(here)],
        *[F.max(F.when(at, F.col("n_group"))).alias(f"_size{i}") for i, at in enumerate(here)],
        F.max("n").alias("_any"),
    )
    shown = place_in_order(table.filter("_any > 0"), F.desc_nulls_last("_n0"), F.asc("variable"))
    readable = recode(F.replace(title_case(F.col("variable")), F.lit("_"), F.lit(" ")), names or {})
    cells = [
        summary.cell_text("count", F.col(f"_n{i}"), ratio(F.col(f"_n{i}") * 100, F.col(f"_size{i}")))
        for i in range(len(labels))
    ]
    filled = [F.coalesce(cell, F.lit(summary.EMPTY_CELL["count"])).alias(c) for cell, c in zip(cells, labels)]
    return shown.select(readable.alias("condition"), "position", *filled)


def durations(events: DataFrame, start: str, end: str, name: str = "duration") -> DataFrame:
    """Whole days from start to end; missing when either date is."""
    return events.withColumn(name, F.datediff(end, start))


def prevalence_panels(
    days: DataFrame, cohort: str, day: str, items: list[str], labels: list[str], order_by: str
) -> DataFrame:
    """Daily prevalence per item with one column per cohort; panels ordered by the trailing peak in one cohort.

    A (cohort, day) without rows stays empty.
    """
    reports = cut(timecourse.daily_reports(days, [cohort], day, items))  # one row per cohort and day
    order = order_by_peak(reports, cohort, day, items, order_by)
    long = timecourse.prevalence(reports, [cohort], day, items)
    wide = long.groupBy("variable", day).agg(
        *[F.max(F.when(F.col(cohort) == c, F.col("percent"))).alias(c) for c in labels]
    )
    return wide.join(order.select("variable", "position"), "variable")


def order_by_peak(reports: DataFrame, cohort: str, day: str, items: list[str], which: str) -> DataFrame:
    """Items by the day on which their trailing five-row mean is largest in one cohort, earliest first.

    ``reports`` are the sums per (cohort, day) of ``timecourse.daily_reports``.
    """
    totals = timecourse.daily_totals(reports.filter(F.col(cohort) == which), [cohort], day, items)
    peaks = timecourse.peak_days(totals, [cohort], day, before=4, after=0)
    return place_in_order(peaks.select("variable", "peak_day"), F.asc_nulls_last("peak_day"), F.asc("variable"))


def channel_models(
    channels: dict[str, str], baseline: Column, weekday: str = "day_of_week",
    weeks: tuple[str, ...] = ("week_L", "week_Q", "week_C"),
) -> list[mixed.MixedSpec]:
    """Two models per channel: all days (``steps``) and baseline days (``steps_bl``).

    ``channels`` maps each channel to its state-mean column.
    """
    specs = []
    for suffix, rows in (("", None), ("_bl", baseline)):
        for channel, state in channels.items():
            specs.append(
                mixed.MixedSpec(f"{channel}{suffix}", f"{channel}__observed", [*weeks, state], weekday, rows=rows)
            )
    return specs


def model_outputs(days: DataFrame, fits: mixed.MixedFits, channels: list[str]) -> DataFrame:
    """Predictions, imputed values, imputation flags and both kinds of residuals for every participant-day."""
    predicted = fits.predict(days)
    filled = mixed.impute(predicted, channels)
    pairs = {f"{c}__bl_resids": (f"{c}__observed", f"{c}_bl__predicted") for c in channels}
    pairs |= {f"{c}__resids": (f"{c}__observed", f"{c}__predicted") for c in channels}
    return mixed.residuals(filled, pairs)


def scored_outputs(outputs: DataFrame, user: str, channels: list[str]) -> DataFrame:
    columns = [f"{c}__imputed" for c in channels] + [f"{c}__observed" for c in channels]
    return panel.zscores(outputs, user, columns)


def excess_long(outputs: DataFrame, channels: list[str], keys: list[str], day: str) -> DataFrame:
    """Baseline residuals of valid days in long form ``(keys..., day, channel, excess)``."""
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("channel"),
                ((F.col(f"valid_user__{c}") == 1) & (F.col(f"valid_day__{c}") == 1)).alias("_valid"),
                F.col(f"{c}__bl_resids").alias("excess"),
            )
            for c in channels
        ]
    )
    return outputs.select(*keys, day, F.inline(entries)).filter("_valid").drop("_valid")


def excess_by_day(long: DataFrame, cohort: str, day: str, first_day: int = -10, last_day: int = 20) -> DataFrame:
    rows = long.filter(F.col(day).between(first_day, last_day))
    return rows.groupBy("channel", cohort, day).agg(
        F.avg("excess").alias("mean_excess"), F.count("excess").alias("n_days")
    )


def excess_fits(long: DataFrame, user: str, cohort: str, day: str) -> smooth.CurveFits:
    """Smooth excess curves for every (channel, cohort): ``curves()`` and ``summary()`` of the result."""
    return smooth.fit_all(long, ["channel", cohort], user, day, "excess")


def excess_curves(long: DataFrame, user: str, cohort: str, day: str) -> DataFrame:
    return excess_fits(long, user, cohort, day).curves()


def duration_tests(events: DataFrame, cohort: str, labels: list[str], duration: str = "duration") -> DataFrame:
    return inference.rank_sum_pairs(events, cohort, duration, labels)
