"""Fragments of SQL that state the same as the keyed hashing and tokenizing of the DataFrame side."""

from __future__ import annotations


def key(col: str, salt: str) -> str:
    return f"md5(cast({col} as varchar) || '|{salt}')"


def int32(col: str, salt: str) -> str:
    return f"cast(('0x' || substr({key(col, salt)}, 1, 8)) as bigint)"


def below(col: str, salt: str, n: str) -> str:
    return f"({int32(col, salt)} % ({n}))"


def tokens(col: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({col}, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"


#: Dialogs as (point_id, pos, role, content), each record once, turns counted from 0.
TURNS = """
turns as (
  select distinct point_id, pos - 1 as pos, dialog[pos].role as role, dialog[pos].content as content
  from (select point_id, dialog, unnest(range(1, coalesce(len(dialog), 0) + 1)) as pos from latentqa_datapoints))
"""
