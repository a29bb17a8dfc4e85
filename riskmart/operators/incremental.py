"""Incremental runs by affected keys.

New or late rows in any source re-open their transactions; transactions of the same user close to a changed one are re-opened too, as its
arrival may make them duplicates. The watermark overlaps by the look-back, and the merge is by key, so a repeated run changes nothing. Cohorts
are recomputed whole: those that re-opened rows are in now, and those that they were in before.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.functions.columns import seconds
from riskmart.functions.frames import in_time_blocks
from riskmart.sources import files
from riskmart.sources.files import write_table

EPOCH = "1900-01-01"


def since(df: DataFrame, mark, config: Config) -> DataFrame:
    """Rows that came after the watermark (a timestamp column, a value or None), less the look-back."""
    mark = F.coalesce(F.lit(mark).cast("timestamp_ntz"), F.lit(EPOCH).cast("timestamp_ntz"))
    return df.where(F.col("_ingested_at") > mark - F.expr(f"INTERVAL '{config.lookback_hours}' HOUR"))


def changed_keys(sources: dict[str, DataFrame], marks: dict[str, object], config: Config) -> DataFrame:
    """transaction_id of every row of the sources (by the name of their watermark) that came since."""
    out = None
    for name, df in sources.items():
        part = since(df, marks.get(name), config).select("transaction_id")
        out = part if out is None else out.unionByName(part)
    return out.where("transaction_id is not null").distinct()


def neighbours(transactions: DataFrame, changed: DataFrame, config: Config) -> DataFrame:
    """Transactions of a user within the window of one of the user's changed ones. A range window, within blocks of time, finds what a self-join would, without its pairs."""
    n = config.duplicate_seconds
    near = Window.partitionBy("user_id", "_block").orderBy("_second").rangeBetween(-n, n)
    flagged = transactions.where("user_id is not null and transaction_at is not null").select("transaction_id", "user_id", seconds("transaction_at").alias("_second"))
    flagged = flagged.join(changed.select("transaction_id", F.lit(True).alias("_changed")), "transaction_id", "left")
    return in_time_blocks(flagged, n, n).withColumn("_near", F.bool_or(F.coalesce("_changed", F.lit(False))).over(near)).where("_home and _near").select("transaction_id")


def affected_keys(transactions: DataFrame, sources: dict[str, DataFrame], marks: dict[str, object], config: Config) -> DataFrame:
    changed = changed_keys(sources, marks, config)
    return changed.unionByName(neighbours(transactions, changed, config)).distinct()


def only(df: DataFrame, keys: DataFrame) -> DataFrame:
    """df's rows of the keys: inputs are cut before they are joined and aggregated, not the result."""
    return df.join(keys.select("transaction_id"), "transaction_id", "left_semi")


#: Hashes that are sent to all tasks at once, held there with some 50 bytes each; more are joined by a shuffle.
SENT_HASHES = 4_000_000
BY_TRANSACTION = "transaction_id"


def _hash(*columns: str | Column) -> Column:
    return F.xxhash64(*columns).alias("_hash")


def sent(hashes: DataFrame) -> DataFrame:
    """Hashes of a written frame, marked to be sent to all tasks if they are not too many."""
    return F.broadcast(hashes) if hashes.count() <= SENT_HASHES else hashes


def having(df: DataFrame, hashes: DataFrame, *columns: str | Column) -> DataFrame:
    """df's rows whose columns have one of the hashes: all that are meant, and rows that hash alike, which a cut may keep. What is sent once cuts feeds of any size without a shuffle of theirs."""
    return df.join(hashes, F.xxhash64(*columns) == F.col("_hash"), "left_semi")


def _of_feeds(raw: dict[str, DataFrame], ids: dict[str, str], make) -> DataFrame:
    """The union of make(feed, its rows, its key) over the feeds."""
    return reduce(DataFrame.unionByName, [make(feed, df, F.trim(ids[feed])) for feed, df in raw.items()])


def changed_transactions(raw: dict[str, DataFrame], ids: dict[str, str], mark, config: Config) -> DataFrame:
    """transaction_id of raw rows that came since, and of former rows of the same id, which may have named another one; ids gives each feed's key. Written."""
    late = files.written(_of_feeds(raw, ids, lambda feed, df, key: since(df, mark, config).select(F.lit(feed).alias("feed"), key.alias("id"), F.trim("transaction_id").alias("transaction_id"))), "late")
    moving = {feed: df for feed, df in raw.items() if ids[feed] != BY_TRANSACTION}
    named = late.select("transaction_id")
    if moving:
        of = sent(late.where(F.col("feed").isin(*moving)).select(_hash("feed", "id")))
        named = named.unionByName(_of_feeds(moving, ids, lambda feed, df, key: having(df, of, F.lit(feed), key).select(F.trim("transaction_id").alias("transaction_id"))))
    return files.written(named.where("transaction_id is not null").distinct(), "changed")


def payments_near(raw: DataFrame, changed: DataFrame, config: Config) -> DataFrame:
    """All raw rows of the changed payments, and of those that any of their rows puts within two windows of a changed one of the user: neighbours, and what can be a duplicate of a neighbour. Written.

    A user's other payments are left out: rows are looked up by user and block of time.
    """
    n = 2 * config.duplicate_seconds
    user, second, key = F.trim("user_id"), seconds(F.col("transaction_at").try_cast("timestamp_ntz")), F.trim("transaction_id")

    def block(shift: int) -> Column:
        return F.floor((second + shift) / (16 * n))

    changed = changed.select(_hash("transaction_id"))
    around = having(raw, sent(changed), key).select(user.alias("_user"), F.explode(F.array_distinct(F.array(block(-n), block(n)))).alias("_block")).where("_user is not null and _block is not null")
    reach = sent(files.written(around.select(_hash("_user", "_block")).distinct(), "reach"))
    near = having(raw.where(user.isNotNull() & second.isNotNull()), reach, user, block(0)).select(_hash(key))
    return files.written(having(raw, sent(files.written(near.unionByName(changed).distinct(), "near")), key), "context")


def reopened(raw: dict[str, DataFrame], ids: dict[str, str], mark, config: Config, cut: Iterable[str]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Affected keys, the payments around them (raw), and for each of the feeds to cut what, staged, has all of those keys. All feeds are looked through for changes."""
    changed = changed_transactions(raw, ids, mark, config)
    context = payments_near(raw["raw_transactions"], changed, config)
    versions = context.select(F.trim("transaction_id").alias("transaction_id"), F.trim("user_id").alias("user_id"), F.col("transaction_at").try_cast("timestamp_ntz").alias("transaction_at"))
    keys = files.written(changed.unionByName(neighbours(versions, changed, config)).distinct(), "keys")
    sent_keys = sent(keys.select(_hash("transaction_id")))
    out = {feed: having(raw[feed], sent_keys, F.trim("transaction_id")) for feed in cut if ids[feed] == BY_TRANSACTION}
    moving = {feed: raw[feed] for feed in cut if ids[feed] != BY_TRANSACTION}
    if moving:  # all rows of an id that has ever named one of the keys
        of = sent(files.written(_of_feeds(moving, ids, lambda feed, df, key: having(df, sent_keys, F.trim("transaction_id")).select(_hash(F.lit(feed), key))).distinct(), "ids"))
        out |= {feed: having(df, of, F.lit(feed), F.trim(ids[feed])) for feed, df in moving.items()}
    payments = context.join(keys.select(F.col("transaction_id").alias("_id")), F.trim("transaction_id") == F.col("_id"), "left_semi")
    return keys, context, out | {"raw_transactions": payments}


def merge_by_key(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """new's rows, and old's whose key new doesn't have. Columns that only one has are null in the other."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def affected_cohorts(old_attempts: DataFrame, new_attempts: DataFrame) -> DataFrame:
    """cohort_date of re-opened rows, as it was and as it is."""
    was = having(old_attempts, sent(new_attempts.select(_hash("transaction_id"))), "transaction_id")
    return was.select("cohort_date").unionByName(new_attempts.select("cohort_date")).distinct()


def of_cohorts(df: DataFrame, cohorts: DataFrame, how: str = "left_semi") -> DataFrame:
    """df's rows of the cohorts, or with left_anti those of others; sales without a date are a cohort too."""
    return df.join(F.broadcast(cohorts.select(F.col("cohort_date").alias("_cohort"))), F.col("cohort_date").eqNullSafe(F.col("_cohort")), how)  # a row a day


def replace_cohorts(old: DataFrame, new: DataFrame, cohorts: DataFrame) -> DataFrame:
    """old without the cohorts, and new: a cohort that is empty now is gone."""
    return of_cohorts(old, cohorts, "left_anti").unionByName(new, allowMissingColumns=True)


#: Hash buckets of a keyed table, set when it is made.
BUCKETS = 64
#: Keys that are sent to all tasks at once; buckets are merged in groups that have no more.
SENT_KEYS = 1_000_000
#: A bucket of more files is put together when it is replaced.
FILES = 8


def upsert(spark: SparkSession, new: DataFrame, path: str, *keys: str, buckets: int = BUCKETS) -> None:
    """Merge into a Parquet table that may not exist. Rows are in buckets by hash of their keys, and only buckets that new has keys in are read and replaced; all other files stay.

    new is made once and dealt to buckets. What is stored lies in buckets already and isn't shuffled: it meets the new keys of some buckets at a time, SENT_KEYS at most (a single bucket
    with more new keys is joined by a shuffle).

    The merged buckets are written to _pending/ first and marked as ready there, then put in place. If that breaks off, the next upsert puts them in place before anything else, so
    no bucket is lost, and merging the same rows again gives the same. Readers that look in between can see some buckets before and some after.
    """
    finish_upsert(spark, path)
    made = [int(x[len("_buckets.") :]) for x in files.names(spark, path) if x.startswith("_buckets.")]
    if made:
        buckets = made[0]
    else:
        files.touch(spark, f"{path}/_buckets.{buckets}")
    new = new.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    stored = {x for x in files.names(spark, path) if x.startswith("_bucket=")}
    pending = f"{path}/_pending/rows"
    if not stored:
        write_table(new, pending, "_bucket", "append")
    else:
        write_table(new, f"{path}/_pending/new", "_bucket", "append")
        new = spark.read.schema(new.schema).parquet(f"{path}/_pending/new")
        for group, n in _groups(sorted(tuple(r) for r in new.groupBy("_bucket").count().collect())):  # as many as buckets
            part = new.where(F.col("_bucket").isin(group))
            folders = [f"{path}/{x}" for b in group if (x := f"_bucket={b}") in stored]
            if folders:
                old = spark.read.option("basePath", path).option("mergeSchema", True).parquet(*folders)
                among = part.select(*keys).distinct()
                part = old.join(F.broadcast(among) if n <= SENT_KEYS else among, list(keys), "left_anti").unionByName(part, allowMissingColumns=True)
            write_table(part, pending, "_bucket", "append", rebalance=n > SENT_KEYS or any(len(files.names(spark, f)) > FILES for f in folders))
    files.touch(spark, f"{path}/_pending/ready")
    finish_upsert(spark, path)


def _groups(counts: list[tuple[int, int]]) -> list[tuple[list[int], int]]:
    """Buckets with their rows, put together up to SENT_KEYS rows."""
    out: list[tuple[list[int], int]] = []
    for bucket, n in counts:
        if out and out[-1][1] + n <= SENT_KEYS:
            out[-1] = ([*out[-1][0], bucket], out[-1][1] + n)
        else:
            out.append(([bucket], n))
    return out


def finish_upsert(spark: SparkSession, path: str) -> None:
    """Put in place what an upsert has merged: buckets that aren't there are moved, the others replaced. Throw away what it hasn't finished."""
    pending = f"{path}/_pending/rows"
    if files.exists(spark, f"{path}/_pending/ready"):
        for x in files.names(spark, pending):
            if "=" in x and not files.exists(spark, f"{path}/{x}"):
                files.rename(spark, f"{pending}/{x}", f"{path}/{x}")
        if any(not x.startswith((".", "_SUCCESS")) for x in files.names(spark, pending)):
            write_table(spark.read.parquet(pending), path, "_bucket", rebalance=False)
    files.delete(spark, f"{path}/_pending")


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of upsert(), None if there is none. Columns that came later are null in older rows."""
    if not any("=" in x for x in files.names(spark, path)):
        return None
    return spark.read.option("mergeSchema", True).parquet(path).drop("_bucket")
