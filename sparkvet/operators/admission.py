"""Admission of requests: daily quotas, bursts, repeats, refunds, claims. Greedy rules keep state a key; the others are windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_quota(requests: DataFrame, subject: str, ts: str, tie: str, limit: int) -> DataFrame:
    """requests with day, nth (of the subject's day) and admitted (nth <= limit). Exact as long as nothing is refunded."""
    day = F.to_date(F.col(ts))
    order = Window.partitionBy("day", subject).orderBy(ts, tie)
    return requests.withColumn("day", day).withColumn("nth", F.row_number().over(order)).withColumn("admitted", F.col("nth") <= limit)


def _greedy(requests: DataFrame, subject: str, ts: str, tie: str, admit) -> DataFrame:
    """requests with admitted, decided in order of time for each subject by admit(times in seconds) -> list of bool.

    Rows are dealt by subject, sorted, and streamed, so a subject with very many requests holds only its open window.
    """
    schema = requests.schema.add("admitted", "boolean")
    parts = max(1, int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = requests.repartition(parts, subject).sortWithinPartitions(subject, ts, tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            seconds = pdf[ts].astype("datetime64[us]").astype("int64").to_numpy()
            out = []
            for key, t in zip(pdf[subject], seconds, strict=True):
                if state is None or key != now:
                    now, state = key, admit()
                out.append(state(int(t)))
            pdf["admitted"] = out
            yield pdf

    return dealt.mapInPandas(run, schema)


def burst(requests: DataFrame, subject: str, ts: str, tie: str, limit: int, window_s: int = 3600) -> DataFrame:
    """Refuses a request when `limit` admitted ones lie in minutes later than `window_s` before it; refusals are not counted."""

    def admit():
        minutes: list[list[int]] = []  # [minute, admitted], oldest first

        def one(us: int) -> bool:
            while minutes and minutes[0][0] <= us - window_s * 1_000_000:
                minutes.pop(0)
            if sum(n for _, n in minutes) >= limit:
                return False
            minute = us // 60_000_000 * 60_000_000
            if minutes and minutes[-1][0] == minute:
                minutes[-1][1] += 1
            else:
                minutes.append([minute, 1])
            return True

        return one

    return _greedy(requests, subject, ts, tie, admit)


def repeats(requests: DataFrame, subject: str, ts: str, tie: str, window_s: int = 60) -> DataFrame:
    """Refuses a request within `window_s` of the last admitted one of the subject (0, 40, 80 s keep 0 and 80 s)."""

    def admit():
        last: list[int] = []

        def one(us: int) -> bool:
            if last and us - last[0] < window_s * 1_000_000:
                return False
            last[:] = [us]
            return True

        return one

    return _greedy(requests, subject, ts, tie, admit)


def burst_upper_bound(requests: DataFrame, subject: str, ts: str, window_s: int = 3600) -> DataFrame:
    """Per subject and minute: requests in it, and in the window that ends with it, refusals included."""
    minutes = requests.groupBy(subject, F.date_trunc("minute", F.col(ts).cast("timestamp")).alias("minute")).agg(F.count("*").alias("n"))
    sliding = Window.partitionBy(subject).orderBy(F.col("minute").cast("long")).rangeBetween(-(window_s - 1), 0)
    return minutes.withColumn("in_window", F.sum("n").over(sliding))


def used_after_refunds(taken: DataFrame, refunds: DataFrame) -> DataFrame:
    """(day, subject, used): tokens taken less those refunded; a token is given back once however often it is asked for, never below 0.

    taken: analysis_id, day, subject; refunds: analysis_id.
    """
    back = refunds.select("analysis_id").distinct().withColumn("__back", F.lit(1))
    net = taken.join(back, "analysis_id", "left").groupBy("day", "subject")
    return net.agg(F.greatest(F.lit(0), F.count("*") - F.sum(F.coalesce("__back", F.lit(0)))).cast("long").alias("used"))


def wait_seconds(oldest: Column, moment: Column, window_s: int = 3600) -> Column:
    """Whole seconds until the oldest counted minute leaves the window, at least 1."""
    left = oldest.cast("double") + window_s - moment.cast("double")
    return F.greatest(F.lit(1), F.ceil(left)).cast("long")


def claim(queue: DataFrame, n: int, created: str, tie: str) -> DataFrame:
    """The n oldest queued rows."""
    return queue.orderBy(created, tie).limit(n)


def stale(running: DataFrame, started: str, now: Column, minutes: int = 10) -> DataFrame:
    """Rows that have run for longer than `minutes`, or never started."""
    return running.where(F.col(started).isNull() | (F.col(started) < now - F.expr(f"INTERVAL {int(minutes)} MINUTES")))


def visitor_kind(user: Column, is_admin: Column) -> Column:
    return F.when(user.isNull(), "anonymous").when(is_admin, "admin").otherwise("account")


def subject_key(user: Column, fingerprint: Column) -> Column:
    return F.when(user.isNotNull(), F.concat(F.lit("user:"), user)).otherwise(F.concat(F.lit("ip:"), fingerprint))


#: Tokens a day; kinds that are not here have no limit.
DAILY_LIMITS = {"anonymous": 3, "account": 10}


def daily_limit(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, n in DAILY_LIMITS.items():
        out = F.when(kind == k, F.lit(n)).otherwise(out)
    return out


def newest(rows: DataFrame, keys: list[str], at: str, tie: str, n: int) -> DataFrame:
    """The n newest rows of each key; of equal times the least tie."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), tie))).where(F.col("__k") <= n).drop("__k")


def reusable(waiting: DataFrame, done: DataFrame, keys: list[str], result: str, order: list[str]) -> DataFrame:
    """waiting with `hit`: the last finished result of the same keys; null without one."""
    last = done.groupBy(*keys).agg(F.max_by(result, F.struct(*order)).alias("hit"))
    return waiting.join(last, keys, "left")


def retained(rows: DataFrame, erased: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that are not erased."""
    return rows.join(erased.select(*keys).distinct(), keys, "left_anti")


def digest(alerts: DataFrame, code: str, at: str, most: int = 20) -> DataFrame:
    """code, n, first, last of the `most` codes that came first."""
    found = alerts.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return found.orderBy("first", "code").limit(most)


def gives_back(code: Column, table: dict[str, bool]) -> Column:
    """What a table of codes says about giving a token back; a code that it lacks gives it back."""
    out = F.lit(True)
    for k, v in table.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def deciding_code(error_code: Column, fetch_code: Column) -> Column:
    """The code that decides a failure: that of the download where fetching failed."""
    return F.when(error_code == "fetch", fetch_code).otherwise(error_code)


def token_back(state: Column, code: Column, status: Column, from_cache: Column, table: dict[str, bool]) -> Column:
    """A failure goes by its code; a reused result or a list of several servers gives the token back."""
    return F.when(state == "failed", gives_back(code, table)).otherwise(F.coalesce(from_cache, F.lit(False)) | F.coalesce(status == "multiple_servers", F.lit(False)))


def counted_refusals(refused: DataFrame, kind: Column, day: Column) -> DataFrame:
    """kind, day, refusals."""
    return refused.groupBy(kind.alias("kind"), day.alias("day")).agg(F.count("*").alias("refusals"))


#: Which state may follow which.
NEXT_STATES = {"queued": ["fetching", "quota_exhausted", "failed"], "fetching": ["analyzing", "failed"], "analyzing": ["done", "failed"]}


def state_of(changes: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """key, state, ignored: the state that a job's changes (state) lead to from `queued`, and how many changes its states forbid."""

    def fold(state: Column, wanted: Column) -> Column:
        allowed = F.lit(False)
        for a, following in NEXT_STATES.items():
            allowed = allowed | ((state["state"] == a) & wanted.isin(following))
        return F.struct(F.when(allowed, wanted).otherwise(state["state"]).alias("state"), (state["ignored"] + F.when(allowed, 0).otherwise(1)).alias("ignored"))

    steps = F.transform(F.sort_array(F.collect_list(F.struct(at, tie, "state"))), lambda x: x["state"])  # a job has few changes
    start = F.struct(F.lit("queued").alias("state"), F.lit(0).alias("ignored"))
    return changes.groupBy(key).agg(F.aggregate(steps, start, fold).alias("x")).select(key, "x.*")


#: Seconds to wait after each failed delivery; after the last one a mail is dropped.
RETRY_SECONDS = [30, 120, 600]


def after_failure(attempts: Column, now: Column) -> Column:
    """When to try a mail again after so many failures; null when it is dropped."""
    out = F.lit(None).cast("timestamp_ntz")
    for i, s in enumerate(RETRY_SECONDS, 1):
        out = F.when(attempts == i, now + F.expr(f"INTERVAL {s} SECONDS")).otherwise(out)
    return out


def deliverable(outbox: DataFrame, now: Column, batch: int) -> DataFrame:
    """Of the oldest `batch` mails those whose next try has come. outbox: id, created_at, next_at."""
    return outbox.orderBy("created_at", "id").limit(batch).where(F.col("next_at").isNull() | (F.col("next_at") <= now))


def next_reset(moment: Column) -> Column:
    """Next midnight."""
    return F.date_add(F.to_date(moment), 1)


def next_month(moment: Column) -> Column:
    """First day of the next month."""
    return F.to_date(F.add_months(F.trunc(F.to_date(moment), "month"), 1))


def address_fingerprint(address: Column, salt: Column) -> Column:
    """HMAC-SHA256 of an address with a salt of up to 64 bytes, in hex, from hashes alone."""
    key = F.rpad(F.hex(salt.cast("binary")), 128, "0")
    inner_pad, outer_pad = ("".join(f"{b ^ x:02X}" for b in range(256)) for x in (0x36, 0x5C))

    def padded(table: str) -> Column:
        byte = lambda i: F.conv(F.substr(key, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substr(F.lit(table), 2 * byte(i) + 1, F.lit(2))), ""))

    inner = F.unhex(F.sha2(F.concat(padded(inner_pad), address.cast("binary")), 256))
    return F.sha2(F.concat(padded(outer_pad), inner), 256)
