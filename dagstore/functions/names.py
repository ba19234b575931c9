"""Ref names, tenants, namespaces, filters and identifiers, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DURABLE_ROOT, WORKSPACE_ROOT, TENANT_ROOT = "refs/", "refs/workspaces/", "refs/tenants/"


def tenant_prefix(tenant: Column) -> Column:
    """The prefix of a tenant's refs; the root tenant (empty or root) owns refs/ itself."""
    return F.when(normal_tenant(tenant) == "root", F.lit(DURABLE_ROOT)).otherwise(F.concat(F.lit(TENANT_ROOT), tenant, F.lit("/")))


def normal_tenant(tenant: Column) -> Column:
    return F.when(F.coalesce(tenant, F.lit("")) == "", F.lit("root")).otherwise(tenant)


def tenant_of_ref(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, "^refs/tenants/([^/]+)/", 1), F.lit("")), F.lit("root"))


def segment_of_ref(name: Column) -> Column:
    """What stands between refs/ and the earliest heads/ or tags/; empty where there is none."""
    return F.regexp_extract(name, "^refs/(.*?)(heads/|tags/)", 1)


def present_ref(name: Column, segment: Column) -> Column:
    """The name a client sees: the segment after refs/ taken out."""
    head = F.concat(F.lit("refs/"), segment)
    return F.when(F.startswith(name, head), F.concat(F.lit("refs/"), name.substr(F.length(head) + 1, F.length(name)))).otherwise(name)


def store_ref(name: Column, segment: Column) -> Column:
    """The inverse of present_ref."""
    return F.when(F.startswith(name, F.lit("refs/")), F.concat(F.lit("refs/"), segment, name.substr(F.lit(6), F.length(name)))).otherwise(name)


def workspace_of_ref(name: Column) -> Column:
    """The workspace id of refs/workspaces/<id>/..., else null."""
    return F.nullif(F.regexp_extract(name, "^refs/workspaces/([^/]+)/", 1), F.lit(""))


def workspace_ref(workspace: Column, client: Column) -> Column:
    """refs/heads/x seen by a client of a workspace, as it is stored."""
    return F.concat(F.lit(WORKSPACE_ROOT), workspace, F.lit("/"), F.regexp_replace(client, "^refs/", ""))


def client_ref(name: Column) -> Column:
    return F.regexp_replace(name, "^refs/workspaces/[^/]+/", "refs/")


def durable_ref(client: Column, tenant: Column) -> Column:
    """Where a workspace's client ref goes on commit: into its tenant's namespace."""
    return F.concat(tenant_prefix(tenant), F.regexp_replace(client, "^refs/", ""))


def is_durable(name: Column) -> Column:
    return ~F.startswith(name, F.lit(WORKSPACE_ROOT))


def valid_ref_name(name: Column) -> Column:
    """Starts with refs/; no .. or //; no control byte."""
    return F.coalesce(F.startswith(name, F.lit("refs/")) & ~F.contains(name, F.lit("..")) & ~F.contains(name, F.lit("//")) & ~F.rlike(name, F.lit("[\\x00-\\x1f\\x7f]")), F.lit(False))


def blob_filter_limit(spec: Column) -> Column:
    """The size limit of a partial-clone filter: 0-less -1 for blob:none, the bytes of blob:limit=<n>[kmg], null for everything else (all)."""
    number = F.regexp_extract(spec, "^blob:limit=([0-9]+)([kKmMgG]?)$", 1)
    unit = F.lower(F.regexp_extract(spec, "^blob:limit=([0-9]+)([kKmMgG]?)$", 2))
    top = F.lit(9223372036854775807)
    n = F.coalesce(number.try_cast("bigint"), F.when(number != "", top))
    factor = F.when(unit == "k", F.lit(1024)).when(unit == "m", F.lit(1048576)).when(unit == "g", F.lit(1073741824)).otherwise(F.lit(1))
    scaled = F.when(n > F.lit(9223372036854775807) / factor, top).otherwise(n * F.when(n > F.lit(9223372036854775807) / factor, F.lit(1)).otherwise(factor))
    return F.when(spec == "blob:none", F.lit(-1).cast("bigint")).otherwise(F.when(number != "", scaled))


def cache_key(segment: Column, wants: Column) -> Column:
    """Key of a cached answer: the segment, and the wants whatever their order."""
    return F.sha2(F.concat(segment, F.lit("\0"), F.array_join(F.array_sort(wants), ",")), 256)


def hex_id(x: Column, length: int) -> Column:
    """Lower-case hex of exactly length bytes, else null."""
    h = F.lower(F.trim(x))
    return F.when(F.rlike(h, F.lit(f"^[0-9a-f]{{{2 * length}}}$")), h)


def parse_sha1(x: Column) -> Column:
    """Strictly 40 hex digits as binary, else null."""
    return F.unhex(F.when(F.rlike(x, F.lit("^[0-9a-fA-F]{40}$")), x))
