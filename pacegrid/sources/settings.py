"""Per-user settings record from the long (user_id, key, value) table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import SETTING_DEFAULTS

KNOWN_KEYS = ["name", "daily_goal", "placement_deadline"]


def user_settings(users: DataFrame, settings: DataFrame, user_key: str = "id") -> DataFrame:
    """One row per user: ``user_id, name, daily_goal BIGINT, placement_deadline DATE``.

    The long table is pivoted on a fixed key list (no distinct-values pass),
    then left-joined from ``users`` so that every user gets the signup
    defaults for keys they never stored (D1).  A goal that is not an integer
    falls back to the default instead of failing the job (D9).
    """
    wide = (settings.filter(F.col("key").isin(KNOWN_KEYS))
            .groupBy("user_id").pivot("key", KNOWN_KEYS).agg(F.max("value")))
    u = users.select(F.col(user_key).alias("user_id"))
    d = SETTING_DEFAULTS
    return (u.join(wide, "user_id", "left")
            .select("user_id",
                    F.coalesce("name", F.lit(d["name"])).alias("name"),
                    F.coalesce(F.col("daily_goal").try_cast("bigint"),
                               F.lit(int(d["daily_goal"])).cast("bigint")).alias("daily_goal"),
                    F.coalesce(F.try_to_date(F.col("placement_deadline"), "yyyy-MM-dd"),
                               F.lit(d["placement_deadline"]).cast("date")).alias("placement_deadline")))
