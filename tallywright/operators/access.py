"""Who may see what: roles, capabilities, memberships, and rows of one organization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each role may do beyond the role before it, and the demonstration role's own set.
FRONTLINE = ("gap.view", "gap.comment")
MANAGER = (*FRONTLINE, "gap.assign", "gap.transition", "gap.dismiss", "gap.view_exposure", "metric.view", "metric.query", "source.view")
ANALYST = (*MANAGER, "metric.view_query_detail")
ADMIN = (*ANALYST, "source.manage", "mapping.manage", "member.manage", "audit.view", "retention.manage", "demo.control")
OWNER = (*ADMIN, "org.manage")
PRESENTER = ("gap.view", "gap.view_exposure", "metric.view", "metric.query", "source.view")
ROLES = {"frontline": FRONTLINE, "manager": MANAGER, "analyst": ANALYST, "admin": ADMIN, "owner": OWNER, "presenter-demo": PRESENTER}


def role_capabilities(spark: SparkSession) -> DataFrame:
    """role, capability: configuration, 59 rows."""
    return spark.createDataFrame([(r, c) for r, cs in ROLES.items() for c in cs], "role string, capability string")


def may(role: Column, capability: str, granted: Column | None = None) -> Column:
    """Whether a role, or a grant beside it (an array), allows something; an unknown role allows nothing."""
    by_role = F.coalesce(role.isin(*[r for r, cs in ROLES.items() if capability in cs]), F.lit(False))
    return by_role if granted is None else by_role | F.coalesce(F.array_contains(granted, capability), F.lit(False))


def scoped(rows: DataFrame, column: str, organization: str | None) -> DataFrame:
    """Rows of one organization. Where none is set, none: a missing setting must not open the table."""
    return rows.where(F.lit(False) if not organization else F.col(column) == organization)


def memberships(members: DataFrame, organizations: DataFrame) -> DataFrame:
    """Members with their organization's name; members of no known organization are left out."""
    return members.join(organizations, "organization_id")
