"""Scoring of predictions against truth: flags, macro-F1, confusion; and trace profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.plans.ordered import islands


def macro_f1(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """By truth label: precision, recall and F1; classes that only predictions name don't count."""
    t, p = F.col(truth), F.col(predicted)
    cells = rows.groupBy(t.alias("truth"), p.alias("predicted")).agg(F.count("*").alias("n"))
    labels = cells.select(F.col("truth").alias("label")).distinct()
    hits = cells.groupBy(F.col("truth").alias("label")).agg(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("actual"))
    named = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("named"))
    both = labels.join(hits, "label").join(named, "label", "left")
    precision, recall = F.coalesce(F.try_divide("tp", "named"), F.lit(0.0)), F.try_divide("tp", "actual")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return both.select("label", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.col("actual").cast("long").alias("support"))


def confusion(rows: DataFrame, labels: list, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(truth).pivot(predicted, labels).count().na.fill(0)


def attempts(trace: DataFrame, key: str, order: str, step: str) -> DataFrame:
    """A new attempt begins wherever the step index doesn't grow."""
    back = F.coalesce(F.col(step) <= F.lag(step).over(Window.partitionBy(key).orderBy(order)), F.lit(False))
    return islands(trace, [key], order, back).withColumnRenamed("island", "attempt")


LOOKALIKE, ALARMING = ("by_design", "not_the_plant"), ("fault", "recoverable")


def scored(rows: DataFrame) -> DataFrame:
    """Flags of each case: rows hold truth_category, truth_cause, truth_settled, category, cause, settled.

    A prediction that abstains earns no credit for what it left in its other fields.
    """
    both, neither = F.col("truth_settled") & F.col("settled"), ~F.col("truth_settled") & ~F.col("settled")
    right = lambda a, b: neither | (both & F.coalesce(F.col(a) == F.col(b), F.lit(False)))
    alarm = F.col("settled") & F.coalesce(F.col("category").isin(*ALARMING), F.lit(False))
    lookalike = F.coalesce(F.col("truth_category").isin(*LOOKALIKE), F.lit(False))
    return rows.withColumns({
        "is_lookalike": lookalike, "category_correct": right("truth_category", "category"), "cause_correct": right("truth_cause", "cause"), "false_alarm": lookalike & alarm,
        "missed_fault": F.coalesce(F.col("truth_category") == "fault", F.lit(False)) & ~alarm, "correct_abstention": neither, "wrong_abstention": F.col("truth_settled") & ~F.col("settled"),
    })


def report(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Rates by split; a rate without cases to count is NULL, not 0."""
    share = lambda flag, of=F.lit(True): F.round(F.try_divide(F.count_if(of & F.col(flag)), F.count_if(of)), 4)
    return flags.groupBy(*keys).agg(
        F.count("*").alias("cases"), share("category_correct").alias("category_accuracy"), share("cause_correct").alias("cause_accuracy"), share("false_alarm", F.col("is_lookalike")).alias("false_alarm_rate"),
        F.count_if("is_lookalike").alias("look_alike_cases"), share("missed_fault", F.coalesce(F.col("truth_category") == "fault", F.lit(False))).alias("missed_fault_rate"),
        share("correct_abstention", ~F.col("truth_settled")).alias("correct_abstention_rate"), F.count_if(~F.col("truth_settled")).alias("unresolvable_cases"), F.count_if("wrong_abstention").alias("wrong_abstentions"),
    )


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cases two systems judge differently; a and b hold case_id, cause, cause_correct."""
    left, right = (x.select("case_id", F.col("cause").alias(f"cause_{n}"), F.col("cause_correct").alias(f"correct_{n}")) for x, n in ((a, "a"), (b, "b")))
    both = left.join(right, "case_id").where(~F.col("cause_a").eqNullSafe(F.col("cause_b")))
    return both.withColumn("winner", F.when(F.col("correct_a") == F.col("correct_b"), "neither").when(F.col("correct_a"), "a").otherwise("b"))


def repeats(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over repeated runs; a single run deviates by 0."""
    return runs.groupBy(*keys).agg(F.count(value).alias("runs"), F.round(F.avg(value), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("deviation"))


def quotas(sizes: dict, size: int) -> dict:
    """Places of each stratum: shares rounded by largest remainder, but one at least."""
    total = sum(sizes.values())
    if size >= total:
        return dict(sizes)
    share = {k: n * size / total for k, n in sizes.items()}
    places = {k: max(int(s), 1) for k, s in share.items()}
    while (over := sum(places.values()) - size) and (over < 0 or max(places.values()) > 1):
        if over > 0:
            key = max((k for k in places if places[k] > 1), key=lambda k: (places[k] - share[k], k))
        else:
            key = max(places, key=lambda k: (share[k] - places[k], k))
        places[key] += -1 if over > 0 else 1
    return places


def stratified(cases: DataFrame, strata: list[str], id_column: str, size: int, seed: int = 0) -> DataFrame:
    """A subset that keeps the shape of the strata; within one the smallest hashes of seed and id are drawn.

    Only the strata's counts reach the driver; strata are combinations of category and settledness.
    """
    counts = {tuple(r[c] for c in strata): r["count"] for r in cases.groupBy(*strata).count().collect()}
    order = {k: str(k) for k in counts}
    places = {k: n for k, n in zip(counts, (quotas({order[k]: n for k, n in counts.items()}, size)[order[k]] for k in counts), strict=True)}
    if not places:
        return cases
    types = dict(cases.dtypes)
    table = cases.sparkSession.createDataFrame([(*k, n) for k, n in places.items()], ", ".join(f"`{c}` {types[c]}" for c in strata) + ", __places int")
    drawn = F.row_number().over(Window.partitionBy(*strata).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_column)).cast("binary"), 256), id_column))
    condition = [F.col(f"c.{s}").eqNullSafe(F.col(f"t.{s}")) for s in strata]
    marked = cases.withColumn("__drawn", drawn).alias("c").join(F.broadcast(table).alias("t"), condition)
    return marked.where("__drawn <= __places").select(*(F.col(f"c.{c}") for c in cases.columns))


def profile(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, seconds, cost and tokens by node, with each node's share of the seconds."""
    by = trace.groupBy(*keys, "node").agg(F.count("*").alias("calls"), F.sum("latency_ms").alias("ms"), F.sum("cost_usd").alias("cost_usd"), F.sum("tokens").alias("tokens"))
    whole = F.sum("ms").over(Window.partitionBy(*keys))
    return by.select(*keys, "node", "calls", F.round(F.col("ms") / 1000, 3).alias("seconds"), F.round(F.try_divide("ms", whole), 4).alias("share"), F.round("cost_usd", 6).alias("cost_usd"), "tokens")


def agency(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that answered: distinct trajectories, unplanned calls, and upper medians of cost and latency over uncached runs."""
    done = predictions.where("failed_with is null")
    upper = lambda c: F.element_at(F.array_sort(F.collect_list(F.when(F.col("llm_calls") > F.col("cached_calls"), F.col(c)))), (F.floor(F.count_if(F.col("llm_calls") > F.col("cached_calls")) / 2) + 1).cast("int"))
    return done.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.count_distinct("tools_called").alias("trajectories"), F.round(F.try_divide(F.sum(F.size("unplanned_tools")), F.sum(F.size("tools_called"))), 4).alias("unplanned_rate"),
        F.when(F.count_if(F.col("llm_calls") > F.col("cached_calls")) > 0, upper("cost_usd")).alias("median_cost_usd"), F.when(F.count_if(F.col("llm_calls") > F.col("cached_calls")) > 0, upper("latency_ms")).alias("median_latency_ms"),
    )


ABSTAIN = "not_enough_evidence"
SPLITS = ("tuning", "heldback")


def macro_f1_overall(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The mean F1 over the truth's classes, where not settling, in truth or prediction, is a class of its own.

    ``rows``: keys, truth_category, truth_settled, category, settled.
    """
    t = F.when(F.col("truth_settled"), F.col("truth_category")).otherwise(ABSTAIN)
    p = F.when(F.col("settled"), F.col("category")).otherwise(ABSTAIN)
    cells = rows.groupBy(*keys, t.alias("t"), p.alias("p")).agg(F.count("*").alias("n"))
    truth = cells.where("t is not null").groupBy(*keys, F.col("t").alias("label")).agg(F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("actual"))
    named = cells.groupBy(*keys, F.col("p").alias("label")).agg(F.sum("n").alias("named"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("actual") + F.coalesce("named", F.lit(0))), F.lit(0.0))
    return truth.join(named, [*keys, "label"], "left").groupBy(*keys).agg(F.round(F.avg(f1), 4).alias("macro_f1"), F.count("*").alias("classes"))


def targets(report: DataFrame, split: str = "split") -> DataFrame:
    """target, met: true, false, or NULL where it was not measured.

    ``report``: one row a split, with macro_f1, false_alarm_rate and correct_abstention_rate.  A held-back
    split without a case for a rate misses its target; a split that wasn't run leaves it unmeasured.
    """
    of = lambda name, c: F.max(F.when(F.col(split) == name, F.col(c)))
    tuning, held = SPLITS
    figures = report.agg(
        F.count_if(F.col(split) == held).alias("ran"), of(held, "macro_f1").alias("f1"), of(held, "false_alarm_rate").alias("alarms"), of(held, "correct_abstention_rate").alias("abstains"),
        F.round(of(tuning, "macro_f1") - of(held, "macro_f1"), 4).alias("gap"),
    )
    ran = F.col("ran") > 0
    rules = {
        "macro_f1_at_least_0.75": F.coalesce("f1", F.lit(0.0)) >= 0.75, "false_alarm_rate_at_most_0.15": F.coalesce(F.col("alarms") <= 0.15, F.lit(False)),
        "correct_abstention_at_least_0.70": F.coalesce(F.col("abstains") >= 0.70, F.lit(False)), "overfitting_gap_at_most_0.10": F.abs("gap") <= 0.10,
    }
    return figures.select(F.explode(F.array(*(F.struct(F.lit(k).alias("target"), F.when(ran, v).alias("met"), F.col("gap").alias("overfitting_gap")) for k, v in rules.items()))).alias("t")).select("t.*")


def composition(cases: DataFrame, split: str = "split") -> DataFrame:
    """Counts of each split: ``cases`` hold truth_category, truth_settled and injection."""
    lookalike = F.coalesce(F.col("truth_category").isin(*LOOKALIKE), F.lit(False))
    is_ = lambda c: F.count_if(F.coalesce(F.col("truth_category") == c, F.lit(False)))
    return cases.groupBy(split).agg(
        F.count("*").alias("cases"), is_("fault").alias("faults"), is_("recoverable").alias("recoverable"), F.count_if(lookalike).alias("look_alikes"), F.round(F.count_if(lookalike) / F.count("*"), 3).alias("look_alike_share"),
        F.count_if(~F.col("truth_settled")).alias("unresolvable"), F.count_if(F.col("injection").isNull()).alias("real_data_no_injection"),
    )


def subset_warnings(subset: DataFrame, full: DataFrame) -> DataFrame:
    """warning: what a subset of the cases can't tell; none if it holds them all."""
    flags = lambda f, n: f.agg(
        F.count("*").alias(f"n_{n}"), F.count_if(~F.col("truth_settled")).alias(f"open_{n}"), F.count_if(F.coalesce(F.col("truth_category").isin(*LOOKALIKE), F.lit(False))).alias(f"like_{n}"), F.collect_set("truth_category").alias(f"kinds_{n}")
    )
    both = flags(subset, "a").crossJoin(flags(full, "b"))  # one row each
    gone = F.array_sort(F.array_except("kinds_b", "kinds_a"))
    lines = F.array(
        F.format_string("subset: %d of %d cases", "n_a", "n_b"), F.when(F.col("open_a") == 0, "no unresolvable cases"), F.when(F.col("like_a") == 0, "no look-alikes"),
        F.when(F.size(gone) > 0, F.concat(F.lit("no cases of "), F.array_join(gone, ", "))),
    )
    return both.where("n_a < n_b").select(F.explode(F.array_compact(lines)).alias("warning"))


def outside_record(cases: DataFrame, panel: DataFrame) -> DataFrame:
    """system_id, outside, cases, first_day, last_day: systems whose record doesn't cover all their cases.  ``cases``: system_id, start_day, end_day."""
    record = panel.groupBy("system_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    beyond = (F.col("start_day").cast("timestamp") < F.col("lo")) | (F.col("end_day").cast("timestamp") > F.col("hi")) | F.col("lo").isNull()
    sums = cases.join(record, "system_id", "left").groupBy("system_id").agg(F.count_if(beyond).alias("outside"), F.count("*").alias("cases"), F.to_date(F.min("lo")).alias("first_day"), F.to_date(F.max("hi")).alias("last_day"))
    return sums.where("outside > 0")


def remaining(cases: DataFrame, journal: DataFrame, id_column: str = "case_id") -> DataFrame:
    """The cases that a run which died has not finished; journal rows without an id (half-written) don't count."""
    return cases.join(journal.where(F.col(id_column).isNotNull()).select(id_column).distinct(), id_column, "left_anti")


def stable_hash(*parts: Column) -> Column:
    """One digest of several values, the same on every run and machine."""
    return F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)


def derived_seed(*parts: Column) -> Column:
    """A seed below 2^31 - 1 from the first 64 bits of the digest."""
    return F.pmod(F.conv(F.substring(stable_hash(*parts), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(2**31 - 1)).cast("long")


def by_cycle(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, seconds and cost of each run's cycles; a step without a cycle belongs to cycle 0."""
    by = trace.groupBy(*keys, F.coalesce("cycle", F.lit(0)).alias("cycle")).agg(F.count("*").alias("calls"), F.sum("latency_ms").alias("ms"), F.sum("cost_usd").alias("cost_usd"))
    return by.select(*keys, "cycle", "calls", F.round(F.col("ms") / 1000, 3).alias("seconds"), F.round("cost_usd", 6).alias("cost_usd"))


def runs(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Each run's cycles, measurements, totals, what came after its first cycle, and whether its reviews lack a cost."""
    cycle = F.coalesce("cycle", F.lit(0))
    later = lambda c: F.sum(F.when(cycle > 0, F.col(c)).otherwise(0))
    critic = F.col("kind") == "critic"
    return trace.groupBy(*keys).agg(
        (F.max(cycle) + 1).alias("cycles"), F.count_if(F.col("kind").isin("tool", "adaptive")).alias("measurements"), F.round(F.sum("latency_ms") / 1000, 3).alias("seconds"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.round(later("latency_ms") / 1000, 3).alias("seconds_after_first_cycle"), F.round(later("cost_usd"), 6).alias("cost_after_first_cycle"),
        ((F.count_if(critic) > 0) & (F.count_if(critic & (F.col("latency_ms") > 0)) == 0)).alias("review_cost_missing"),
    )


def run_summary(profiles: DataFrame) -> DataFrame:
    """All runs in one row; only those that took time count in the sums."""
    timed = F.col("seconds") > 0
    of = lambda c, digits: F.round(F.coalesce(F.sum(F.when(timed, F.col(c))), F.lit(0.0)), digits).alias(c)
    return profiles.agg(F.count("*").alias("runs"), F.count_if(timed).alias("timed_runs"), of("seconds", 1), of("cost_usd", 4), of("seconds_after_first_cycle", 1), of("cost_after_first_cycle", 4))


def investigations(trace: DataFrame, key: str) -> DataFrame:
    """One row an investigation: its counters, and the last answer's text.  ``trace``: key, step_index, kind, text, cost_usd, latency_ms, tokens."""
    of = lambda kind: F.col("kind") == kind
    return trace.groupBy(key).agg(
        F.count_if(F.col("kind").isin("tool", "adaptive")).alias("measurements"), F.count_if(of("adaptive")).alias("unplanned"), F.count_if(of("critic")).alias("review_cycles"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
        F.sum("tokens").alias("tokens"), F.round(F.sum("latency_ms") / 1000, 1).alias("seconds"), F.count("*").alias("steps"), F.max_by("text", F.when(of("answer"), F.col("step_index"))).alias("answer"),
    )
