"""Subscription state of customers from payment events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUBSCRIBED, UNSUBSCRIBED = "subscribed", "unsubscribed"

# Event kinds by what they do.
GRANTING = ("resumed", "checkout.completed")
REVOKING = ("paused", "deleted", "invoice.payment_failed", "registration.confirmed")
SETS_PERIOD = ("paused", "resumed", "checkout.completed")
PAID, PAID_STATUSES = "invoice.paid", ("active", "trialing")
NEEDS_NO_SUBSCRIPTION = ("registration.confirmed",)
# End of fixed values.


def new_role(kind: Column, status: Column) -> Column:
    """Role an event gives; NULL where it changes none."""
    return F.when(
        kind.isin(*GRANTING) | ((kind == PAID) & status.isin(*PAID_STATUSES)), SUBSCRIBED
    ).when(kind.isin(*REVOKING), UNSUBSCRIBED)


def effects(events: DataFrame) -> DataFrame:
    """Events that count, with the role and the period they set."""
    kind = F.col("kind")
    counted = F.col("subscription").isNotNull() | kind.isin(*NEEDS_NO_SUBSCRIPTION)
    order = F.struct("ts", "event_id")
    role = new_role(kind, F.col("status"))
    return events.filter(counted).select(
        "customer",
        F.when(role.isNotNull(), F.struct(order.alias("at"), role.alias("role"))).alias("role_set"),
        F.when(
            kind.isin(*SETS_PERIOD), F.struct(order.alias("at"), F.col("period_end"))
        ).alias("period_set"),
    )


def latest(effects_: DataFrame) -> DataFrame:
    """Fold effects per customer. The fold is a maximum, so partial results
    combine in any order, within a batch and across batches."""
    return effects_.groupBy("customer").agg(
        F.max("role_set").alias("role_set"), F.max("period_set").alias("period_set")
    )


def state(folded: DataFrame) -> DataFrame:
    return folded.filter(F.col("role_set").isNotNull()).select(
        "customer", F.col("role_set.role").alias("role"), F.col("period_set.period_end").alias("period_end")
    )


def subscription_state(events: DataFrame) -> DataFrame:
    """``customer, role, period_end`` after all events, by event time."""
    return state(latest(effects(events)))


def expire(members: DataFrame, as_of: int) -> DataFrame:
    """Members whose period ended before ``as_of`` (epoch seconds) lose the role."""
    over = F.coalesce(F.col("period_end") < F.lit(as_of), F.lit(False))
    return members.withColumn("role", F.when(over, UNSUBSCRIBED).otherwise(F.col("role")))


def members_of(users: DataFrame, links: DataFrame, roles: DataFrame, role: str) -> DataFrame:
    """Users that hold a role, through a link table ``user_id, role_id``."""
    wanted = roles.filter(F.col("name") == role).select(F.col("id").alias("role_id"))
    holders = links.join(wanted, "role_id", "left_semi").select(F.col("user_id").alias("id"))
    return users.join(holders, "id", "left_semi")
