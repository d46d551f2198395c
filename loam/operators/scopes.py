"""Scopes: their names, who may see which, and what is valid. A configuration is a small table (agent, scope) or a dict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T

FORMAT = r"^[a-zA-Z0-9._:-]{1,100}\z"


def is_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(FORMAT), F.lit(False))


def parsed(c: Column) -> Column:
    """struct(type, id) of ``type:id``; null for 'global' and for names without a colon."""
    return F.when(c.contains(":"), F.struct(F.regexp_extract(c, "^([^:]*):", 1).alias("type"), F.regexp_extract(c, "^[^:]*:(.*)$", 1).alias("id")))


def agent_of(session_key: Column) -> Column:
    """The agent's id in ``agent:<id>:...``."""
    return F.nullif(T.trim(F.regexp_extract(F.coalesce(session_key, F.lit("")), r"^agent:([^:]+)(?::|\z)", 1)), F.lit(""))


def accessible(agent: str, access: dict[str, list[str]] | None = None, team: list[str] | None = None) -> list[str]:
    """The configured scopes of an agent, else the global, its own and its reflections' one; those of its team come after."""
    own = (access or {}).get(agent) or ["global", f"agent:{agent}", f"reflection:agent:{agent}"]
    return list(dict.fromkeys([*own, *(team or [])]))


def default_of(agent: str, access: dict[str, list[str]] | None = None) -> str:
    """Where an agent's memories go: its own scope if it may see it, else its first one."""
    own = accessible(agent, access)
    return f"agent:{agent}" if f"agent:{agent}" in own else own[0]


def access_table(spark: SparkSession, access: dict[str, list[str]], team: dict[str, list[str]] | None = None) -> DataFrame:
    """(agent, scope) of a configuration."""
    rows = [(a, s) for a in access for s in accessible(a, access, (team or {}).get(a))]
    return spark.createDataFrame(rows, "agent string, scope string")


def visible(memories: DataFrame, access: DataFrame) -> DataFrame:
    """(agent, id) of every memory that each agent may see; access is a configured list."""
    return memories.select("id", F.coalesce("scope", F.lit("global")).alias("scope")).join(F.broadcast(access), "scope").select("agent", "id").distinct()
