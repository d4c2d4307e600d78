"""Who may do what in which workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Roles from weakest to strongest, and what an agency role is worth in a client's workspace.
ROLES = ["viewer", "member", "admin", "owner"]
AGENCY_ROLES = {"agency_member": "member", "agency_admin": "admin", "agency_owner": "admin"}


def workspace_access(users: DataFrame, memberships: DataFrame, agency_memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(user_id, workspace_id, role, via) of enabled users; the strongest role wins and a direct path is named at equal strength."""
    rank = lambda c: F.coalesce(*[F.when(c == r, k) for k, r in enumerate(ROLES)])
    derived = F.coalesce(*[F.when(F.col("role") == a, w) for a, w in AGENCY_ROLES.items()])
    direct = memberships.select("user_id", "workspace_id", "role", F.lit("direct").alias("via"))
    agency = agency_memberships.join(workspaces.select("workspace_id", "agency_id"), "agency_id").select("user_id", "workspace_id", derived.alias("role"), F.lit("agency").alias("via"))
    paths = direct.unionByName(agency).where("role is not null").join(users.where("not disabled").select("user_id"), "user_id")
    place = F.row_number().over(Window.partitionBy("user_id", "workspace_id").orderBy(F.desc(rank(F.col("role"))), F.desc("via")))
    return paths.withColumn("place", place).where("place = 1").drop("place")
