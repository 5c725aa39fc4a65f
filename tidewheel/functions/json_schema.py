"""JSON payloads: validation, upcasting between versions, envelopes and the wire form, as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_KINDS = {"string": ("STRING",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _path(key: str) -> str:
    """The path of one key, dots included."""
    return f'$["{key}"]' if "'" in key else f"$['{key}']"


@dataclass(frozen=True)
class JsonSchema:
    """Required keys, and the JSON type of properties. Unknown type names accept everything."""

    version: int
    name: str = ""
    required: tuple[str, ...] = ()
    properties: dict[str, str] = field(default_factory=dict)

    def error(self, payload: Column) -> Column:
        """Null for a valid payload, else what is wrong. A null value is present, but fails a typed check."""
        facts = F.struct(
            F.try_parse_json(payload).alias("parsed"),
            F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")).alias("keys"),
        )
        return _let(facts, lambda f: self._error(f["parsed"], f["keys"]))

    def _error(self, parsed: Column, keys: Column) -> Column:
        kind = F.schema_of_variant(parsed)
        out = F.when(parsed.isNull(), F.lit("invalid json")).when(
            ~(kind.startswith("OBJECT") | (kind == "VOID")), F.lit("not an object")
        )
        for key in self.required:
            out = out.when(~F.array_contains(keys, key), F.lit(f"missing required field: {key}"))
        for key, want in self.properties.items():
            if want in _KINDS:
                got = F.schema_of_variant(F.variant_get(parsed, _path(key), "variant"))
                fits = F.coalesce(F.regexp_extract(got, r"^([A-Z]+)", 1).isin(*_KINDS[want]), F.lit(False))
                out = out.when(F.array_contains(keys, key) & ~fits, F.lit(f"field {key} must be {want}"))
        return out

    def valid(self, payload: Column) -> Column:
        return self.error(payload).isNull()


@dataclass(frozen=True)
class FieldMapper:
    """One step between versions: renames at once, then defaults for missing keys, then removals. Values stay as they
    are: keys are moved as variants."""

    from_version: int
    to_version: int
    renames: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    removals: tuple[str, ...] = ()

    def upcast(self, payload: Column) -> Column:
        fields = F.from_json(F.to_json(F.try_parse_json(payload)), "map<string,variant>")
        return _let(F.map_entries(fields), lambda entries: _let(self._renamed(entries), self._completed))

    def _renamed(self, entries: Column) -> Column:
        if not self.renames:
            return entries
        names = F.create_map(*[F.lit(x) for kv in self.renames.items() for x in kv])
        targets = F.transform(F.filter(entries, lambda e: F.map_contains_key(names, e["key"])), lambda e: F.element_at(names, e["key"]))
        kept = F.filter(entries, lambda e: F.map_contains_key(names, e["key"]) | ~F.array_contains(targets, e["key"]))
        return F.transform(kept, lambda e: F.struct(F.coalesce(F.try_element_at(names, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))

    def _completed(self, renamed: Column) -> Column:
        out = renamed
        for key, value in self.defaults.items():
            missing = ~F.array_contains(F.transform(renamed, lambda e: e["key"]), key)
            extra = F.array(F.struct(F.lit(key).alias("key"), F.parse_json(F.lit(value)).alias("value")))
            out = F.concat(out, F.when(missing, extra).otherwise(F.filter(extra, lambda e: F.lit(False))))
        if self.removals:
            out = F.filter(out, lambda e: ~e["key"].isin(*self.removals))
        texts = F.transform(out, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))
        quoted = F.transform(F.array_sort(texts), lambda e: F.concat(F.regexp_extract(F.to_json(F.array(e["key"])), r"^\[(.*)\]$", 1), F.lit(":"), e["value"]))
        return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def upcast_to_latest(payload: Column, version: Column, steps: list[FieldMapper]) -> tuple[Column, Column]:
    """(payload at the last version, error): the chain from each row's version on; a missing link is an error."""
    by_from = {s.from_version: s for s in steps}
    latest = max(s.to_version for s in steps)
    out, error = F.lit(None).cast("string"), F.lit(None).cast("string")
    for start in range(1, latest + 1):
        value, at = payload, start
        while at < latest and at in by_from:
            value, at = by_from[at].upcast(value), by_from[at].to_version
        out = F.when(version == start, value if at == latest else F.lit(None)).otherwise(out)
        error = F.when(version == start, F.lit(None) if at == latest else F.lit(f"no upcaster from {at}")).otherwise(error)
    return out, F.when((version < 1) | (version > latest), F.lit("unknown version")).otherwise(error)


def encode_envelope(version: Column, topic: Column, payload: Column, metadata: Column | None = None, name_key: str = "topic") -> Column:
    """JSON of version, the topic's name under `name_key`, payload and metadata."""
    fields = [version.alias("version"), topic.alias(name_key), F.try_parse_json(payload).alias("payload")]
    return F.to_json(F.struct(*fields, *([metadata.alias("metadata")] if metadata is not None else [])))


def decode_envelope(data: Column, name_key: str = "topic") -> Column:
    """struct(version, topic, payload); null for what is no envelope."""
    got = F.from_json(data, f"version int, `{name_key}` string, payload variant")
    parts = F.struct(got["version"].alias("version"), got[name_key].alias("topic"), F.to_json(got["payload"]).alias("payload"))
    return F.when(got["version"].isNotNull() & got["payload"].isNotNull(), parts)


def versioned_decode(data: Column, steps: list[FieldMapper], latest: JsonSchema) -> Column:
    """struct(payload, version, error) of stored data: what is no envelope stays as it is; an envelope's payload is brought
    to the last version and must then be valid."""

    def judged(up: Column) -> Column:
        found = F.coalesce(up["error"], latest.error(up["payload"]))
        return _let(found, lambda e: F.struct(F.when(e.isNull(), up["payload"]).alias("payload"), F.lit(latest.version).alias("version"), e.alias("error")))

    def opened(got: Column) -> Column:
        out, error = upcast_to_latest(got["payload"], got["version"], steps)
        raw = F.struct(data.alias("payload"), F.lit(None).cast("int").alias("version"), F.lit(None).cast("string").alias("error"))
        return F.when(got.isNull(), raw).otherwise(_let(F.struct(out.alias("payload"), error.alias("error")), judged))

    return _let(decode_envelope(data), opened)


def encode_wire(row_id: Column, source: Column, payload: Column, retry_count: Column, metadata: Column | None = None) -> Column:
    """The JSON of a message on the wire; binary as base64, empty parts left out, no timestamp."""
    parts = [row_id.alias("id"), source.alias("source"), F.base64(payload).alias("payload")]
    if metadata is not None:
        parts.append(metadata.alias("metadata"))
    parts.append(F.when(retry_count != 0, retry_count).alias("retry_count"))
    return F.to_json(F.struct(*parts))


def decode_wire(data: Column) -> Column:
    """struct(id, source, payload, metadata, retry_count); null for what can't be decoded."""
    got = F.from_json(data, "id string, source string, payload string, metadata map<string,string>, retry_count int, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return F.when(
        got["_corrupt_record"].isNull() & data.isNotNull(),
        F.struct(got["id"].alias("id"), got["source"].alias("source"), F.unbase64(got["payload"]).alias("payload"), got["metadata"].alias("metadata"), F.coalesce(got["retry_count"], F.lit(0)).alias("retry_count")),
    )


def content_route(metadata: Column, known: tuple[str, ...] = ("application/json",)) -> Column:
    """decode, or dead_letter for a content type without a codec; a missing type is JSON."""
    kind = F.coalesce(F.try_element_at(metadata, F.lit("Content-Type")), F.lit("application/json"))
    return F.when(kind.isin(*known), "decode").otherwise("dead_letter")


def versioned_encode(payload: Column, topic: Column, schema: JsonSchema | None) -> Column:
    """The stored form: an envelope of the schema's version, or the payload as it is without a schema."""
    return payload if schema is None else encode_envelope(F.lit(schema.version), topic, payload)


def decode_raw(data: Column) -> Column:
    """struct(payload, version) as stored: nothing is upcast or validated; what is no envelope has no version."""
    got = decode_envelope(data)
    return F.struct(F.coalesce(got["payload"], data).alias("payload"), got["version"].alias("version"))


def validate_and_upcast(payload: Column, version: Column, schemas: list[JsonSchema], steps: list[FieldMapper]) -> Column:
    """struct(payload, error): the payload must be valid for the schema of its own version, and is then brought to the last."""
    error = F.lit("unknown version")
    for schema in schemas:
        error = F.when(version == schema.version, schema.error(payload)).otherwise(error)
    out, missing = upcast_to_latest(payload, version, steps)
    return _let(F.coalesce(error, missing), lambda e: F.struct(F.when(e.isNull(), out).alias("payload"), e.alias("error")))


class SchemaRegistry:
    """Schemas by name and version, and the steps between versions."""

    def __init__(self) -> None:
        self._schemas: dict[str, dict[int, JsonSchema]] = {}
        self._steps: dict[str, list[FieldMapper]] = {}

    def register(self, schema: JsonSchema, *steps: FieldMapper) -> None:
        if not schema.name or schema.version < 1:
            raise ValueError("a schema has a name and a version from 1 on")
        if schema.version in self._schemas.setdefault(schema.name, {}):
            raise ValueError(f"{schema.name} has version {schema.version} already")
        self._schemas[schema.name][schema.version] = schema
        self._steps.setdefault(schema.name, []).extend(steps)

    def get(self, name: str, version: int) -> JsonSchema:
        return self._schemas[name][version]

    def latest(self, name: str) -> JsonSchema | None:
        versions = self._schemas.get(name)
        return versions[max(versions)] if versions else None

    def versions(self, name: str) -> list[int]:
        return sorted(self._schemas.get(name, {}))

    def names(self) -> list[str]:
        return sorted(self._schemas)

    def upcast(self, name: str, payload: Column, version: Column) -> tuple[Column, Column]:
        return upcast_to_latest(payload, version, self._steps[name])
