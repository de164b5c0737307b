"""Profiles made at first login, from feeds that bring logins in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from keydrift.operators.users import provision
from keydrift.streaming.keyed import keep_state_on_disk
from keydrift.streaming.streams import change_log_writer

FIRST = "id string, email string, login_at timestamp"


def first_logins(logins: DataFrame) -> DataFrame:
    """``id, email, login_at`` of the earliest login so far of every id that a batch of the stream ``logins`` touches.

    Keyed state without expiry holds one login per id. Minima are combined before the shuffle, so an id with a third
    of all logins sends one row per task. Equal times are told apart by email, nothing first; logins without id make
    no profile.
    """
    first = F.min(F.struct(F.col("login_at").cast("timestamp").alias("login_at"), "email")).alias("first")
    return logins.where("id IS NOT NULL").groupBy("id").agg(first).select("id", "first.email", "first.login_at")


def login_log_writer(logins: DataFrame, log: str, feed: str, checkpoint: str) -> DataStreamWriter:
    """Note the first logins of the feed named ``feed`` in a log that feeds share, a folder per feed and micro-batch.

    A batch that runs again replaces its folder. The log grows with the ids of each batch, not with its logins.
    """
    keep_state_on_disk(logins.sparkSession)
    return change_log_writer(first_logins(logins), log, feed, checkpoint, mode="update")


def provisioned(spark: SparkSession, users: DataFrame, log: str) -> tuple[DataFrame, DataFrame]:
    """Users with the profiles that all feeds' logins make, and the refused ones: ``provision`` on all logins together.

    An email stands for one profile whichever feed or batch brings it. A late login that is earlier than an id's
    others counts, also where it frees the email they had for another id. Emails are judged by an aggregation that
    combines before its shuffle, so one that a third of new ids share is no task's burden.
    """
    return provision(users, spark.read.schema(FIRST).parquet(log))
