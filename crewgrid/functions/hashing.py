"""Digests and canonical forms."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from crewgrid.functions.numeric import col


def sha256(c):
    return F.sha2(col(c), 256)


def hmac_sha256(key: bytes, c):
    """Keyed digest from two nested sha2 calls; keys over the block size are hashed first."""
    import hashlib

    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    pad = lambda b: F.lit(bytearray(k ^ b for k in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(col(c), "utf-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def _unique(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise ValueError("duplicate key")
        out[k] = v
    return out


def _reject(_):
    raise ValueError("not a JSON number")


def _canon(text):
    if text is None:
        return None
    try:
        v = json.loads(text, object_pairs_hook=_unique, parse_constant=_reject)
        return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except ValueError:
        return None


@pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """Sorted keys, compact, numbers as written; null for bad JSON or duplicate keys."""
    return s.map(_canon)


def is_canonical(c):
    """A line must equal its own re-encoding."""
    return F.coalesce(canonical_json(col(c)) == col(c), F.lit(False))


def strict_json(c):
    """Parses, without duplicate keys; stays JVM-side."""
    return F.try_parse_json(col(c)).isNotNull()


def feature_hash(features, as_of, schema_version, feature_version):
    """Digest of fixed-point feature values in a fixed key order; null stays null, -0 becomes 0."""
    def part(c):
        v = F.format_string("%.6f", col(c).cast("double") + F.lit(0.0))
        v = F.when(v == "-0.000000", "0.000000").otherwise(v)
        return F.concat(F.lit(f'"{c}":'), F.coalesce(F.concat(F.lit('"'), v, F.lit('"')), F.lit("null")))

    body = F.concat(F.lit("{"), F.concat_ws(",", *[part(c) for c in sorted(features)]), F.lit("}"))
    head = F.concat(F.lit('{"as_of":"'), col(as_of).cast("string"), F.lit(f'","feature_version":"{feature_version}","features":'))
    return F.sha2(F.concat(head, body, F.lit(f',"schema_version":"{schema_version}"}}')), 256)
