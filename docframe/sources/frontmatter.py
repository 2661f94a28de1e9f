"""YAML with the core schema only: no dates, no yes/no, no base-60 or leading-zero numbers."""

from __future__ import annotations

import re

import yaml


class FrontMatterError(ValueError):
    """The text is not the YAML that documents may hold."""


class _Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    yaml_implicit_resolvers: dict = {}

    def construct_mapping(self, node: yaml.Node, deep: bool = False) -> dict:
        seen = set()
        for key, _ in node.value:
            k = self.construct_object(key, deep=True)
            if isinstance(k, list | dict):
                raise FrontMatterError("keys must be plain values")
            if k in seen:
                raise FrontMatterError(f"duplicate key '{k}'")
            seen.add(k)
        return super().construct_mapping(node, deep)


def _number(loader: _Loader, node: yaml.Node) -> int:
    text = node.value.lstrip("+-")
    sign = -1 if node.value.startswith("-") else 1
    return sign * (int(text[2:], 16) if text.startswith("0x") else int(text[2:], 8) if text.startswith("0o") else int(text))


def _float(loader: _Loader, node: yaml.Node) -> float:
    text = node.value.lower()
    return float(text.replace(".inf", "inf").replace(".nan", "nan"))


for _tag, _pattern, _first in (
    ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
    ("bool", r"true|True|TRUE|false|False|FALSE", list("tTfF")),
    ("int", r"[-+]?(?:0|[1-9][0-9]*)|[-+]?0x[0-9a-fA-F]+|[-+]?0o[0-7]+", list("-+0123456789")),
    ("float", r"[-+]?(?:(?:0|[1-9][0-9]*)\.[0-9]*|\.[0-9]+|(?:0|[1-9][0-9]*)(?=[eE]))(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", list("-+0123456789.")),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(f"(?:{_pattern})$"), _first)
_Loader.add_constructor("tag:yaml.org,2002:bool", lambda loader, node: node.value.lower() == "true")
_Loader.add_constructor("tag:yaml.org,2002:int", _number)
_Loader.add_constructor("tag:yaml.org,2002:float", _float)


def load_yaml(text: str) -> object:
    """The value of a YAML text; FrontMatterError if it is malformed or repeats a key."""
    try:
        return yaml.load(text, _Loader)  # noqa: S506: a SafeLoader
    except yaml.YAMLError as e:
        raise FrontMatterError(str(e).replace("\n", " ")) from None
