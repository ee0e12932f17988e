"""Content-derived identifiers."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def prefixed_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and 16 hex digits of the SHA-1 of the parts joined by bars; a null part reads None."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha1(F.concat_ws("|", *texts)), 1, 16))


def point_id(doc_id: Column, chunk_id: Column) -> Column:
    """The first 64 bits of an MD5 as an unsigned number, which a long can't hold."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", doc_id, chunk_id)), 1, 16), 16, 10).cast("decimal(20,0)")


def doc_id(kind: Column, collection: Column, path: Column) -> Column:
    return F.concat_ws(":", kind, collection, path)


def fingerprint(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def prompt_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def signature(config: dict[str, str]) -> Column:
    """A hash of settings that changes when any of them does, in whatever order they come."""
    return F.sha2(F.lit("\0".join(f"{k}={config[k]}" for k in sorted(config))), 256)


def unit_id(source: Column, sha256: Column, start: Column, end: Column) -> Column:
    return prefixed_id("mtu", source, sha256, start, end)


def deep_merged(base: Column, patch: Column) -> Column:
    """Two-level maps (name -> map) merged: keys of ``patch`` win within each inner map, and names of either stay."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.map_zip_with(base, patch, lambda _, a, b: F.map_concat(F.map_filter(F.coalesce(a, none), lambda k, v: ~F.coalesce(F.map_contains_key(F.coalesce(b, none), k), F.lit(False))), F.coalesce(b, none)))


def retry_delay(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or a date less ``now``; 0 at least, null if it is neither."""
    at = F.try_to_timestamp(F.regexp_replace(header, r"^\w{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    own, left = header.try_cast("double"), (F.unix_timestamp(at) - F.unix_timestamp(now)).cast("double")
    return F.when(own.isNotNull(), F.greatest(own, F.lit(0.0))).when(left.isNotNull(), F.greatest(left, F.lit(0.0)))


def json_object(raw: Column) -> Column:
    """The text of the one JSON object that a reply holds, with or without a code fence around all of it; null if it isn't one."""
    text = F.trim(raw)
    bare = F.when(text.startswith("```"), F.regexp_replace(F.regexp_replace(text, r"\A```[a-zA-Z]*\n?", ""), r"\n?```\z", "")).otherwise(text)
    bare = F.regexp_replace(bare, r"(?U)\A\s+|\s+\z", "")
    # As the one item of an array: what follows an object would be no JSON there, or a second item.
    items = F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>")
    return F.when(bare.startswith("{") & (F.size(items) == 1), bare)


def artifact_hash(document: Column) -> Column:
    """32 hex digits of the SHA-256 of a JSON document with sorted keys; spacing and key order of the text don't matter. Null if it is no JSON."""
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                out.append(None if text is None else hashlib.sha256(json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:32])
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(of, "string")(document)
