"""JSON and YAML trees as rows of leaves, numbers kept as written."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd

from probatum.functions.arrow import arrow

LEAVES = "array<struct<pointer:string,raw:string,native_type:string,is_container:boolean>>"
#: Nesting beyond this is refused, as a reader without a bound could be made to fail.
DEPTH = 200


class Unreadable(ValueError):
    pass


class Written(str):
    """A number as its text."""

    kind = "float"


class WrittenInt(Written):
    kind = "int"


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Unreadable("duplicate key")
    return out


def load_json(text: str) -> object:
    """The tree, numbers as written; duplicate keys, NaN and infinities are refused, a byte-order mark is not."""

    def refuse(word: str) -> object:
        raise Unreadable(f"{word} is no number")

    try:
        return json.loads(text.removeprefix("﻿"), parse_float=Written, parse_int=WrittenInt, parse_constant=refuse, object_pairs_hook=_unique)
    except (json.JSONDecodeError, RecursionError) as e:
        raise Unreadable(str(e)) from e


def load_yaml(text: str) -> object:
    """YAML by the same rules; aliases are refused. Without the library, unreadable."""
    try:
        import yaml
    except ImportError as e:
        raise Unreadable("no YAML reader installed") from e

    class Loader(yaml.SafeLoader):
        def compose_node(self, parent, index):
            if self.check_event(yaml.events.AliasEvent):
                raise Unreadable("alias")
            return super().compose_node(parent, index)

    def mapping(loader, node, deep=True):
        return _unique([(str(loader.construct_object(k, deep=True)), loader.construct_object(v, deep=True)) for k, v in node.value])

    Loader.add_constructor("tag:yaml.org,2002:float", lambda _, n: Written(n.value))
    Loader.add_constructor("tag:yaml.org,2002:int", lambda _, n: WrittenInt(n.value))
    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    try:
        return yaml.load(text, Loader)  # noqa: S506
    except (yaml.YAMLError, RecursionError) as e:
        raise Unreadable(str(e)) from e


def _escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def walk(node: object, pointer: str = "", depth: int = 0) -> Iterator[dict]:
    """Every node with its RFC 6901 pointer, containers included."""
    if depth > DEPTH:
        raise Unreadable("nested too deeply")
    if isinstance(node, (dict, list)):
        yield {"pointer": pointer, "raw": None, "native_type": "object" if isinstance(node, dict) else "array", "is_container": True}
        for k, v in node.items() if isinstance(node, dict) else enumerate(node):
            yield from walk(v, f"{pointer}/{_escaped(str(k))}", depth + 1)
    elif node is None:
        yield {"pointer": pointer, "raw": None, "native_type": "null", "is_container": False}
    else:
        kind = node.kind if isinstance(node, Written) else "bool" if isinstance(node, bool) else "string"
        yield {"pointer": pointer, "raw": str(node).lower() if kind == "bool" else str(node), "native_type": kind, "is_container": False}


def leaves(text: str | None, form: str = "json") -> list[dict] | None:
    """All nodes of a text's tree; None where it cannot be read."""
    if text is None:
        return None
    try:
        return list(walk(load_yaml(text) if form == "yaml" else load_json(text)))
    except Unreadable:
        return None


def pattern(pointer: str) -> str:
    """A pointer with its list positions masked, so that values of one kind group."""
    return re.sub(r"/\d+(?=/|$)", "/*", pointer)


@arrow(LEAVES)
def json_leaves(texts: pd.Series) -> pd.Series:
    return texts.map(leaves)


@arrow(LEAVES)
def yaml_leaves(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: leaves(t, "yaml"))
