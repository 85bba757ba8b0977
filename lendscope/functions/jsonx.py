"""JSON, hashing and nested-record expressions (FN-02 .. FN-07, FN-16 .. FN-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (must equal the reference for equal results) -------------
SENSITIVE_HEADERS = ["authorization", "x-api-key", "cookie"]
REDACTED = "[REDACTED]"


def safe_json(col, schema, default: Column | None = None) -> Column:         # FN-02
    """Parse JSON; malformed input -> ``default`` (NULL by default)."""
    parsed = F.from_json(F.col(col) if isinstance(col, str) else col, schema, {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, default) if default is not None else parsed


def json_text(*cols) -> Column:                                              # FN-03
    return F.to_json(F.struct(*cols))


def canonical_hash(df: DataFrame, cols=None, algorithm: str = "md5") -> Column:   # FN-04 / SET-06
    """Hash of the key-sorted JSON of the given columns (deterministic request id)."""
    names = sorted(cols or df.columns)
    payload = F.to_json(F.struct(*[F.col(c) for c in names]))
    if algorithm == "md5":
        return F.md5(payload)
    if algorithm == "sha256":
        return F.sha2(payload, 256)
    raise ValueError(f"Unsupported hash algorithm: {algorithm}")


def _present(c: Column) -> Column:
    """Header present and non-empty (an empty header counts as missing)."""
    return c.isNotNull() & (c != F.lit(""))


def short_client_id(api_key: Column, forwarded: Column, remote: Column) -> Column:   # FN-05
    first_ip = F.trim(F.split(forwarded, ",").getItem(0))
    return F.coalesce(F.when(_present(api_key), F.substring(F.md5(api_key), 1, 16)),
                      F.when(_present(forwarded), F.concat(F.lit("ip_"), first_ip)),
                      F.concat(F.lit("ip_"), F.coalesce(remote, F.lit("unknown"))))


def client_ip(forwarded: Column, real_ip: Column, host: Column) -> Column:     # FN-06
    return F.coalesce(F.when(_present(forwarded), F.trim(F.split(forwarded, ",").getItem(0))),
                      F.when(_present(real_ip), real_ip), host, F.lit("unknown"))


def redact_headers(headers: Column) -> Column:                               # FN-07
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(SENSITIVE_HEADERS), F.lit(REDACTED))
                              .otherwise(v))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:                      # FN-16
    """Nested struct columns -> dotted top-level columns (schema-driven, no job)."""
    out = []

    def walk(prefix, dtype, path):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f"{prefix}{sep}{f.name}" if prefix else f.name, f.dataType, path + [f.name])
        else:
            out.append(F.col("`" + path[0] + "`" + "".join(f".`{p}`" for p in path[1:])).alias(prefix))

    for f in df.schema.fields:
        walk(f.name, f.dataType, [f.name])
    return df.select(*out)


def unflatten(df: DataFrame, sep: str = ".") -> DataFrame:                    # FN-17
    """Dotted column names -> nested structs."""
    tree: dict = {}
    for c in df.columns:
        node = tree
        parts = c.split(sep)
        for p in parts[:-1]:
            node = node.setdefault(p, {})
        node[parts[-1]] = c

    def build(node):
        return [F.col(f"`{v}`").alias(k) if isinstance(v, str) else F.struct(*build(v)).alias(k)
                for k, v in node.items()]

    return df.select(*build(tree))


def deep_merge_maps(left: Column, right: Column) -> Column:                  # FN-18, one level of MapType
    """Right wins on key conflicts."""
    return F.map_from_entries(F.concat(
        F.filter(F.map_entries(left), lambda e: ~F.array_contains(F.map_keys(right), e["key"])),
        F.map_entries(right)))


MERGE_DEPTH = 16


def deep_merge(left: Column, right: Column, depth: int = MERGE_DEPTH) -> Column:
    """FN-18: JSON objects merged as VARIANT: right wins, objects on both sides are merged in turn.

    Takes JSON text and returns VARIANT (``to_json`` gives text).  Numbers, texts, arrays and JSON nulls keep their
    types.  A null side gives the other side.  Levels are unrolled; objects on both sides that are nested
    deeper than ``depth`` raise an error instead of being merged wrongly."""
    return _merged(F.parse_json(left), F.parse_json(right), depth)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def _merged(a: Column, b: Column, depth: int) -> Column:
    def fields(v: Column) -> Column:
        return F.variant_get(v, "$", "map<string,variant>")

    if depth == 0:
        both = F.raise_error(F.lit("JSON objects are nested deeper than the merge allows")).cast("variant")
    else:
        merged = F.map_zip_with(fields(a), fields(b), lambda k, x, y: _merged(x, y, depth - 1))
        both = F.to_variant_object(merged)
    return F.when(b.isNull(), a).when(_is_object(a) & _is_object(b), both).otherwise(b)
