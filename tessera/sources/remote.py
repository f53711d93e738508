"""A Spark data source for catalogs behind an interface of one request per identity.

The transport is a function given by name, so that recorded answers serve tests and
sites without a network; the answer's nesting, fallbacks and limits are handled here.
"""

from __future__ import annotations

import importlib
import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ANSWER_LIMIT = 2 << 20
#: Portrait fields in order of preference (fixed values).
PORTRAIT_FIELDS = ("head", "head_big", "squarehead")


def parse_answer(identity: str, status: int, mime: str, body: bytes) -> tuple:
    """(identity, name, image address, failure) of one answer."""
    if status != 200:
        return identity, None, None, f"status_{status}"
    if "json" not in mime:
        return identity, None, None, "mime"
    if len(body) > ANSWER_LIMIT:
        return identity, None, None, "too_large"
    try:
        value = json.loads(body)
    except ValueError:
        return identity, None, None, "unreadable"
    # Records may lie some levels below ``data``/``records``.
    for key in ("data", "records", "data", "hero", "data"):
        if isinstance(value, list):
            value = value[0] if value else {}
        if isinstance(value, dict) and key in value:
            value = value[key]
    if isinstance(value, list):
        value = value[0] if value else {}
    if not isinstance(value, dict) or not value.get("name"):
        return identity, None, None, "no_name"
    image = next((value[k] for k in PORTRAIT_FIELDS if value.get(k)), None)
    return identity, value["name"], image, None if image else "no_image"


class _Part(InputPartition):
    def __init__(self, identities: list[str]):
        self.identities = identities


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.first, self.last = int(options["first"]), int(options["last"])
        self.chunk, self.transport = int(options.get("chunk", 50)), options["transport"]

    def partitions(self) -> list[InputPartition]:
        ids = [str(i) for i in range(self.first, self.last + 1)]
        return [_Part(ids[i : i + self.chunk]) for i in range(0, len(ids), self.chunk)] or [_Part([])]

    def read(self, partition: _Part):
        module, name = self.transport.rsplit(":", 1)
        fetch = getattr(importlib.import_module(module), name)
        for identity in partition.identities:
            yield parse_answer(identity, *fetch(identity))


class CatalogSource(DataSource):
    """``spark.read.format("tessera_catalog")`` with options first, last, transport (module:function)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_catalog"

    def schema(self) -> str:
        return "source_identity string, canonical_name string, asset_url string, failure string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def recorded(identity: str) -> tuple[int, str, bytes]:
    """A stand-in transport: every seventh identity is absent, others have a portrait."""
    if int(identity) % 7 == 0:
        return 404, "application/json", b""
    body = {"data": {"records": [{"data": {"hero": {"data": {"name": f"hero {identity}", "head_big": f"https://img.example/{identity}.png"}}}}]}}
    return 200, "application/json", json.dumps(body).encode()
