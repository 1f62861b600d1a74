"""Bookkeeping over event tables: rolling usage, headroom, latest runs, context packing, progress, folded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86_400


def _micros(ts: Column) -> Column:
    """Microseconds of a timestamp, with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def rolling_sum(events: DataFrame, ts: str, value: str, seconds: int, by: list[str], name: str) -> DataFrame:
    """Adds the sum of a value over (ts - seconds, ts] within groups: an event exactly that old is out."""
    micros = _micros(F.col(ts))
    frame = Window.partitionBy(*by).orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("_us", micros).withColumn(name, F.sum(value).over(frame)).drop("_us")


def rolling_sum_by_day(events: DataFrame, ts: str, value: str, name: str) -> DataFrame:
    """rolling_sum over 24 hours without groups: hours are partitions, with the 23 full hours between as one carried total.

    An hour's partition holds its own events and those of the same hour the day before, of which only those count
    that are younger than a day; so a busy day is spread over its hours and an event is copied once. Own events are
    summed forward in time and those of the day before backward: each row is added once, however many share an hour.
    """
    hour = F.floor(_micros(F.col(ts)) / 3_600_000_000).cast("long")
    # odd places are own events; an event of the day before lies at the even place where it is a day old
    own = events.withColumn("_hour", hour).withColumn("_at", 2 * _micros(F.col(ts)) + 1).withColumn("_now", F.col(value)).withColumn("_then", F.lit(None).cast(events.schema[value].dataType))
    before = events.where(F.col(ts).isNotNull()).select((hour + 24).alias("_hour"), (2 * (_micros(F.col(ts)) + DAY * 1_000_000)).alias("_at"), F.col(value).alias("_then"))
    totals = own.groupBy("_hour").agg(F.sum(value).alias("_v"))
    between = totals.select(F.explode(F.sequence(F.col("_hour") + 1, F.col("_hour") + 23)).alias("_hour"), "_v").groupBy("_hour").agg(F.sum("_v").alias("_carried"))
    upto = lambda order: Window.partitionBy("_hour").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    rows = own.unionByName(before, allowMissingColumns=True).withColumn("_now", F.sum("_now").over(upto(F.col("_at")))).withColumn("_then", F.sum("_then").over(upto(F.desc("_at"))))
    rows = rows.where("_at IS NULL OR _at % 2 <> 0").join(between, "_hour", "left")
    parts = [F.col(c) for c in ("_now", "_then", "_carried")]
    whole = F.coalesce(parts[0], F.lit(0)) + F.coalesce(parts[1], F.lit(0)) + F.coalesce(parts[2], F.lit(0))
    return rows.withColumn(name, F.when(F.coalesce(*parts).isNotNull(), whole)).select(*events.columns, name)


def seconds_to_headroom(events: DataFrame, ts: str, value: str, now: Column, budget: float, needed: float) -> DataFrame:
    """One row, wait_seconds: until enough of the last day's usage has expired for `needed` more; DAY if that never suffices.

    Running sums are taken over the day's minutes, 1,441 at most, and then over the rows of the one minute that decides.
    """
    age = _micros(now) - _micros(F.col(ts))
    recent = events.where((age >= 0) & (age < DAY * 1_000_000)).groupBy(_micros(F.col(ts)).alias("t")).agg(F.sum(value).alias("v"))
    recent = recent.withColumn("m", F.floor(F.col("t") / 60_000_000))
    minutes = recent.groupBy("m").agg(F.sum("v").alias("v"))
    total = minutes.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))
    upto = F.sum("v").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
    gone = minutes.withColumn("gone", upto).join(F.broadcast(total))  # one row
    decides = gone.where(F.col("total") - F.col("gone") + needed <= budget).agg(F.min_by(F.struct("m", (F.col("gone") - F.col("v")).alias("before")), "m").alias("d")).select("d.m", "d.before")
    inside = recent.join(F.broadcast(decides), "m")  # one row
    within = F.col("before") + F.sum("v").over(Window.partitionBy("m").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    first = inside.withColumn("gone", within).join(F.broadcast(total)).where(F.col("total") - F.col("gone") + needed <= budget).agg(F.min("t").alias("t"))
    wait = (F.col("t") + DAY * 1_000_000 - _micros(now)) / 1_000_000.0
    return first.join(total).select(F.when(F.col("total") + needed <= budget, 0.0).otherwise(F.coalesce(wait, F.lit(float(DAY)))).alias("wait_seconds"))


def latest(runs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row with the largest order columns of each group, by a partial aggregate."""
    rest = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def prefer_stage(runs: DataFrame, by: list[str], stage: str, ranks: list[str], order: str) -> DataFrame:
    """The latest row of the best stage that a group has; `ranks` lists stages, best first."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ranks)), F.col(stage)), F.lit(0))
    rest = [c for c in runs.columns if c not in by]
    return runs.where(rank > 0).groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct((-rank).alias("a"), F.col(order).alias("b"))).alias("r")).select(*by, "r.*")


def pack_context(chunks: DataFrame, by: list[str], order: list[Column], cost: str, room: float, salts: int = 16) -> DataFrame:
    """The leading chunks of each group, best first, up to the first that does not fit; adds used. Costs are not negative.

    A group is first packed in `salts` parts. What comes after a part's first overflow can't fit in the whole either,
    so only the rest, about `salts` times what fits, meets in one window.
    """
    running = lambda keys: F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    part = chunks.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    part = part.withColumn("_part", running([*by, "_salt"])).where(F.col("_part") - F.col(cost) <= room).drop("_part", "_salt")
    return part.withColumn("used", running(by)).where(F.col("used") <= room)


def merge_runs(attempts: DataFrame, by: list[str], order: str, cause: str, setting: str) -> DataFrame:
    """Consecutive attempts of one cause as a row: *by, cause, start, n, settings."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = attempts.withColumn("_new", (~F.col(cause).eqNullSafe(F.lag(cause).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    marked = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_i", cause).agg(F.min(order).alias("start"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(order, setting))), lambda x: x[setting]).alias("settings")).drop("_i")


def usage_by_day(events: DataFrame, ts: str, value: str, by: list[str]) -> DataFrame:
    return events.groupBy(F.to_date(ts).alias("date"), *by).agg(F.count("*").alias("calls"), F.sum(value).alias("tokens"))


def progress(expected: DataFrame, done: DataFrame, key: list[str], item: str) -> DataFrame:
    """By item: expected, done, retried (more than one result) and still missing work."""
    seen = done.groupBy(*key).agg(F.count("*").alias("_n"))
    joined = expected.join(seen, key, "left")
    return joined.groupBy(item).agg(F.count("*").alias("expected"), F.count("_n").alias("done"), F.count_if(F.col("_n") > 1).alias("retried"), F.count_if(F.col("_n").isNull()).alias("missing"))


def review_status(translations: DataFrame) -> DataFrame:
    """By language: rows, reviewed, machine, current (stored source equals the current one)."""
    return translations.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "reviewed").alias("reviewed"), F.count_if(F.col("status") == "machine").alias("machine"), F.count_if(F.col("source") == F.col("current_source")).alias("current"))


def translation_work(catalogue: DataFrame, translations: DataFrame, lang: str) -> DataFrame:
    """Keys without a translation into a language, or with one of an older source: key, why."""
    t = translations.where(F.col("lang") == lang).select("key", F.col("source").alias("_s"))
    return catalogue.join(t, "key", "left").where(F.col("_s").isNull() | (F.col("_s") != F.col("source"))).select("key", F.when(F.col("_s").isNull(), "missing").otherwise("stale").alias("why"))


def fold_answers(answers: DataFrame, by: list[str], field: str, value: str, ts: str, tie: str) -> DataFrame:
    """The last answer of each field: *by, field, value, ts; equal times go by the tie column."""
    return answers.groupBy(*by, field).agg(F.max_by(value, F.struct(ts, tie)).alias(value), F.max(ts).alias(ts))


def reuse_answers(stored: DataFrame, current: DataFrame, key: list[str], facts: str) -> DataFrame:
    """current (*key, facts map) with status: reused if stored facts are identical, stale if not, new if there are none."""
    canonical = lambda c: F.sha2(F.to_json(F.array_sort(F.map_entries(c))), 256)
    old = stored.select(*key, canonical(F.col(facts)).alias("_old"))
    return current.withColumn("_now", canonical(F.col(facts))).join(old, key, "left").withColumn("status", F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_now"), "reused").otherwise("stale")).drop("_old", "_now")


def close_renames(renames: DataFrame) -> DataFrame:
    """old, new with every chain of renames followed to its end; nulls and renames to the same name are left out.

    Every round doubles how far a name is followed, so a chain of n renames takes log2(n) joins; what is decided stays
    in the lineage, and a table of renames is as large as a vocabulary. Of several new names of one name the least
    counts. A ring of renames has no end and is an error.
    """
    known = renames.where("old IS NOT NULL AND new IS NOT NULL AND old <> new").groupBy("old").agg(F.min("new").alias("new"))
    whole, done = known.count(), False
    for _ in range(max(1, whole).bit_length() + 1):
        ahead = known.select(F.col("old").alias("_at"), F.col("new").alias("_next"))
        step = known.join(ahead, F.col("new") == F.col("_at"), "left")
        if done := step.where("_next IS NOT NULL").isEmpty():
            break
        known = step.select("old", F.coalesce("_next", "new").alias("new"))
    if not done:
        raise ValueError("renames form a ring")
    return known


def renamed_facts(profiles: DataFrame, key: list[str], facts: str, renames: DataFrame) -> DataFrame:
    """profiles (*key, facts map) with fields under their names after renames (old, new); a fact under its new name goes before a renamed one, of several renamed ones the one of the least old name."""
    closed = close_renames(renames).select(F.col("old").alias("_field"), "new")
    rows = profiles.select(*key, F.explode_outer(facts).alias("_field", "_value")).join(closed, "_field", "left")
    named = rows.select(*key, F.coalesce("new", "_field").alias("_name"), F.struct(F.col("new").isNotNull().alias("_moved"), F.col("_field")).alias("_from"), "_value")
    once = named.groupBy(*key, "_name").agg(F.min_by("_value", "_from").alias("_value"))
    entry = F.when(F.col("_name").isNotNull(), F.struct("_name", "_value"))
    return once.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(facts))


def reuse_renamed(stored: DataFrame, current: DataFrame, key: list[str], facts: str, renames: DataFrame) -> DataFrame:
    """*key, status, to_ask of every current row: reuse_answers() with stored facts under their current names.

    to_ask lists the fields whose value is not the stored one, sorted: of a new row all.
    """
    old = renamed_facts(stored, key, facts, renames).select(*key, F.col(facts).alias("_old"))
    both = current.select(*key, facts).join(old, key, "left")
    differs = lambda k: F.when(F.map_contains_key("_old", k), ~F.element_at("_old", k).eqNullSafe(F.element_at(facts, k))).otherwise(True)
    asked = F.array_sort(F.filter(F.map_keys(facts), lambda k: F.col("_old").isNull() | differs(k)))
    gone = F.exists(F.map_keys("_old"), lambda k: ~F.map_contains_key(facts, k))
    status = F.when(F.col("_old").isNull(), "new").when((F.size("_a") == 0) & ~F.col("_g"), "reused").otherwise("stale")
    return both.withColumn("_a", asked).withColumn("_g", gone).select(*key, status.alias("status"), F.col("_a").alias("to_ask"))
