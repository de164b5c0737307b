"""User profiles and the role gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keydrift.operators.changes import DEFAULT_ACTOR, admitted
from keydrift.plans.lookup import look_up

# Roles.
SUPPORT, DEPLOYER = "support", "deployer"


def find_profiles(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Look up every ``id``: ``status`` is ok, absent or duplicate; only ok has a profile.

    ``role`` falls back to ``support`` and a NULL email becomes empty.
    """
    profiles = users.groupBy("id").agg(
        F.count("*").alias("_n"),
        F.min("email").alias("_email"),
        F.min("role").alias("_role"),
    )
    found = look_up(keys, profiles, "id")
    unique = F.col("_n") == 1
    status = F.when(F.col("_n").isNull(), "absent").when(unique, "ok").otherwise("duplicate")
    return found.select(
        *keys.columns,
        status.alias("status"),
        F.coalesce(F.when(unique, F.col("_email")), F.lit("")).alias("profile_email"),
        F.coalesce(F.when(unique, F.col("_role")), F.lit(SUPPORT)).alias("role"),
    )


def provision(users: DataFrame, logins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users plus a ``support`` profile for each login (``id, email, login_at``) without one, and the
    profiles refused, with a ``reason``.

    Repeated logins give one profile, from the earliest. An email stands for one profile: of new
    ones that share it the earliest login's is stored, unless a stored profile has it already.
    Logins without email share the empty one. A refused login still works with the role ``support``.
    """
    first = logins.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.min(F.struct("login_at", "email")).alias("first")
    )
    new = first.join(users.select("id"), "id", "left_anti").select(
        "id",
        F.coalesce("first.email", F.lit("")).alias("email"),
        F.lit(SUPPORT).alias("role"),
        F.lit(DEFAULT_ACTOR).alias("create_by"),
        F.col("first.login_at").cast("timestamp").alias("create_at"),
        F.lit(None).cast("string").alias("update_by"),
        F.col("first.login_at").cast("timestamp").alias("update_at"),
    )
    judged = admitted(users, new, ("create_at", "id"), not_null=("id", "email"), unique=("email",))
    stored = users.unionByName(judged.where("reason IS NULL").select(*users.columns))
    return stored, judged.where("reason IS NOT NULL").select("id", "email", "create_at", "reason")


def gate(requests: DataFrame, users: DataFrame, actor: str = "actor") -> DataFrame:
    """Requests with ``allowed``: true for actors that are deployers, false for everyone else."""
    keys = requests.select(F.col(actor).alias("id"), F.struct("*").alias("request"))
    known = find_profiles(keys, users)
    return known.select("request.*", (F.col("role") == DEPLOYER).alias("allowed"))
