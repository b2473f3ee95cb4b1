"""Small fixed tables as constant columns: looked up in the row, never joined."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_map(values: Mapping[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def int_map(values: Mapping[str, int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,int>")


def nested_map(values: Mapping[str, Mapping[str, str]]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,map<string,string>>")


def get(table: Column, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(table, key), F.lit(default))
