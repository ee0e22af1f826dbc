"""Who may see and change what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles from strongest to weakest.
RANKS = {"manager": 4, "editor": 3, "reviewer": 2, "viewer": 1}


def rank(role: Column) -> Column:
    return F.coalesce(F.create_map(*[x for r, n in RANKS.items() for x in (F.lit(r), F.lit(n))])[role], F.lit(0))


def effective_roles(direct: DataFrame, by_group: DataFrame) -> DataFrame:
    """(library, username, role): the stronger of the direct role and those of groups (library, username, role); a tie keeps the direct one.  Groups never make an admin."""
    given = direct.select("library", "username", "role", F.lit(1).alias("own")).unionByName(by_group.where("role <> 'admin'").select("library", "username", "role", F.lit(0).alias("own")))
    return given.groupBy("library", "username").agg(F.max_by("role", F.struct(rank(F.col("role")), "own", "role")).alias("role"))


def may(actor: Column, is_admin: Column, is_owner: Column, role: Column, shared: Column, action: Column) -> Column:
    """Whether an action (``read`` or another) is allowed.  A null actor is the system."""
    reading = action == "read"
    return F.when(actor.isNull() | is_admin | is_owner, True).when(role.isin("editor", "manager"), True).when(role.isin("viewer", "reviewer"), reading).otherwise(shared & reading)


def label(actor: Column, is_admin: Column, is_owner: Column, role: Column, shared: Column) -> Column:
    return F.when(actor.isNull(), "system").when(is_admin, "admin").when(is_owner, "owner").when(role.isin(*RANKS), role).when(shared, "viewer").otherwise("none")


def hidden_documents(acl: DataFrame, user: str) -> DataFrame:
    """(document): documents with an access list that the user is not on."""
    return acl.select("document").distinct().join(acl.where(F.col("username") == user).select("document").distinct(), "document", "left_anti")


def listing(libraries: DataFrame, documents: DataFrame, roles: DataFrame, user: str) -> DataFrame:
    """Libraries that a user sees, with their number of documents and the user's role."""
    counts = documents.groupBy("library").agg(F.count("*").alias("n_documents"))
    own = roles.where(F.col("username") == user).select("library", "role")
    seen = libraries.join(own, "library", "left").join(counts, "library", "left")
    named = label(F.lit(user), F.lit(False), F.col("owner") == user, F.col("role"), F.col("visibility") == "shared")
    return seen.withColumn("access", named).where("access <> 'none'").select("library", "access", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def group_roles(mapping: DataFrame, groups: DataFrame) -> DataFrame:
    """(library, username, role) from (group, library, role) and memberships (username, group); the strongest role counts."""
    met = mapping.join(groups, "group")
    return met.groupBy("library", "username").agg(F.max_by("role", rank(F.col("role"))).alias("role"))


def effective_groups(token: DataFrame, provisioned: DataFrame) -> DataFrame:
    """(username, groups): groups of tokens issued by oidc and provisioned groups, distinct and sorted."""
    both = token.where("provider = 'oidc'").select("username", "group").unionByName(provisioned.select("username", "group"))
    return both.where("username IS NOT NULL AND username <> ''").groupBy("username").agg(F.sort_array(F.collect_set("group")).alias("groups"))


def principals(granted: DataFrame, known: DataFrame) -> DataFrame:
    """(document, users) from (document, owner, principals): domains cut off, spelled as known users are, sorted; none left means the owner, null means no restriction."""
    opened = granted.where("principals IS NOT NULL").select("document", "owner", F.explode_outer("principals").alias("raw"))
    clean = opened.withColumn("name", F.trim(F.element_at(F.split("raw", r"\\"), -1)))
    spelled = clean.join(known.select(F.lower("username").alias("low"), "username"), F.lower("name") == F.col("low"), "left")
    user = F.when(F.coalesce("name", F.lit("")) != "", F.coalesce("username", "name"))
    named = spelled.groupBy("document", "owner").agg(F.sort_array(F.collect_set(user)).alias("users"))
    return granted.select("document", "owner").join(named.select("document", "users"), "document", "left").select("document", F.when(F.size("users") == 0, F.array("owner")).otherwise(F.col("users")).alias("users"))
