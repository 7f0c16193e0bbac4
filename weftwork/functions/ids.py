"""Ids of the code graph's nodes and what can be told from them alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTERNAL, ROUTES = "__external__", "__routes__"


def node_id(repo: Column, rest: Column) -> Column:
    return F.concat_ws(":", repo, rest)


def symbol_id(repo: Column, path: Column, name: Column, ordinal: Column) -> Column:
    """repo:path#name, with @n from the second definition of that name on."""
    return F.concat(repo, F.lit(":"), path, F.lit("#"), name, F.when(ordinal > 1, F.concat(F.lit("@"), ordinal.cast("string"))).otherwise(""))


def package_id(repo: Column, ecosystem: Column, name: Column) -> Column:
    return F.concat(repo, F.lit(":pkg:"), ecosystem, F.lit("/"), name)


def route_id(repo: Column, method: Column, path: Column) -> Column:
    return F.concat(repo, F.lit(":route:"), F.upper(method), F.lit(" "), path)


def ecosystem(language: Column) -> Column:
    return F.when(language == "python", "pypi").when(language.isin("javascript", "typescript", "tsx"), "npm").otherwise("unknown")


def outer_module(path: Column) -> Column:
    """The outermost folder of a file; null if it has none."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1))


def owning_module(path: Column) -> Column:
    """The folder that directly holds a file; null if none does."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def ancestry(module: Column) -> Column:
    """api/routes as [api, api/routes]; a synthetic module stands alone; null has none."""
    parts = F.split(module, "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(module.isNull(), F.array().cast("array<string>")).when(module.isin(EXTERNAL, ROUTES), F.array(module)).otherwise(chain)


def containers(repo: Column, path: Column) -> Column:
    """Ids of the containers above a file, nearest first, ending at the repository."""
    return F.concat(F.reverse(F.transform(ancestry(owning_module(path)), lambda m: F.concat(repo, F.lit(":"), m))), F.array(repo))


def is_within(node: Column, container: Column) -> Column:
    """Prefix containment at a separator only."""
    return (node == container) | (F.startswith(node, container) & F.substring(node, F.length(container) + 1, F.lit(1)).isin("/", "#"))
