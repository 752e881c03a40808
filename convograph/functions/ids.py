"""Deterministic identifiers."""
from __future__ import annotations

import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the namespace of node ids.
NAMESPACE = uuid.UUID("9068d01a-4a83-4ef0-971b-751eafe829b0")
# Offset basis and prime of the 64-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def normalize_name(text: str | None) -> str | None:
    """Compatibility form, no @, lower case character by character, single blanks, none between an ASCII letter and digit."""
    if text is None:
        return None
    t = "".join(c.lower() for c in unicodedata.normalize("NFKC", text) if c != "@")
    t = " ".join(t.split())
    return re.sub(r"(?<=[a-z]) (?=[0-9])|(?<=[0-9]) (?=[a-z])", "", t)


def node_uuid(label: str | None) -> str | None:
    return None if label is None else str(uuid.uuid5(NAMESPACE, label))


def fnv1a(data: str | None) -> str | None:
    if data is None:
        return None
    h = FNV_BASIS
    for b in data.encode():
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"



def normalized(name: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(normalize_name, na_action="ignore")

    return run(name)


def uuid_of(label: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(node_uuid, na_action="ignore")

    return run(label)


def content_hash(name: Column, description: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(fnv1a, na_action="ignore")

    return run(F.concat(name, F.lit("\n"), F.coalesce(description, F.lit(""))))


def pipe_edge_id(source: Column, relationship: Column, target: Column, valid_at: Column) -> Column:
    """source|relationship|target|instant, the instant in UTC to the microsecond."""
    return F.concat_ws("|", source, relationship, target, F.unix_micros(valid_at).cast("string"))


def json_edge_id(source: Column, relationship: Column, target: Column, valid_at: Column) -> Column:
    """The natural key as compact JSON with sorted fields, the start cut to the microsecond."""
    at = F.date_format(valid_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.to_json(F.struct(relationship.alias("relationship_name"), source.alias("source_id"), target.alias("target_id"), at.alias("valid_at")))


def decode_edge_id(edge_id: Column) -> Column:
    """The natural key of a JSON id as a struct; null for anything else, so that reads pass it over and writers can refuse it."""
    raw = F.from_json(edge_id, "relationship_name string, source_id string, target_id string, valid_at string")
    at = F.try_to_timestamp(raw["valid_at"], F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    whole = raw["source_id"].isNotNull() & raw["relationship_name"].isNotNull() & raw["target_id"].isNotNull() & at.isNotNull()
    return F.when(whole, F.struct(raw["source_id"].alias("source_id"), raw["relationship_name"].alias("relationship_name"), raw["target_id"].alias("target_id"), at.alias("valid_at")))


def properties_of(node_type: Column, **fields: Column) -> Column:
    """A node's properties as JSON with its kind; fields without a value are left out."""
    return F.to_json(F.struct(F.lower(node_type).alias("kind"), *[v.alias(k) for k, v in sorted(fields.items())]))


def alias_text(surface: Column, name: Column) -> Column:
    return F.concat(surface, F.lit(" is a surface form of "), name, F.lit("."))


def batch_text(first: Column, last: Column, name: Column) -> Column:
    return F.concat(F.lit("batch "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(" mentions "), name)
