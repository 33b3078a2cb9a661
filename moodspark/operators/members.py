"""Joining and renaming members."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.plans.skew import keep_first, only_wanted


def find_by_email(members: DataFrame, emails: DataFrame) -> DataFrame:
    """Members behind a set of e-mail addresses."""
    return members.join(emails.select("email").distinct(), "email", "left_semi")


def admit_members(requests: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split join requests (request_id, email, nickname) into admitted and conflicting ones.

    The first request for an address that no member has is admitted.
    """
    first = keep_first(requests, ["email"], [F.col("request_id")])
    known = only_wanted(members.select("email"), requests, ["email"]).distinct()
    admitted = first.join(known, "email", "left_anti")
    conflicts = requests.join(admitted.select("request_id"), "request_id", "left_anti")
    return admitted, conflicts


def new_members(admitted: DataFrame) -> DataFrame:
    """Rows to store for admitted requests."""
    return admitted.select(
        "request_id", "email", "nickname",
        F.lit("LOCAL").alias("provider"), F.lit("ACTIVE").alias("status"), F.lit(0).alias("login_fail_count"),
    )


def change_nicknames(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Members after (seq, member_id, nickname) changes: the latest wins, changes of nobody are ignored."""
    latest = changes.groupBy(F.col("member_id").alias("id")).agg(F.max_by("nickname", "seq").alias("_new"))
    return members.join(latest, "id", "left").withColumn(
        "nickname", F.coalesce("_new", "nickname")
    ).drop("_new")
