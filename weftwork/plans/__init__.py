"""Named queries over a data folder and the SQL that checks them."""

from weftwork.plans import board_plans, function_plans, graph_plans, record_plans, search_plans, snapshot_plans, stream_plans, structure_plans, usage_plans

MODULES = [snapshot_plans, graph_plans, usage_plans, board_plans, record_plans, structure_plans, function_plans, search_plans, stream_plans]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}
