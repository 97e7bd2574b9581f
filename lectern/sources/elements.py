"""Parsed elements as dictionaries of one shape."""

from __future__ import annotations

import re

from ..functions.text import TYPE

TYPE_NAME = re.compile(rf"\b({TYPE}(?:::{TYPE})*)\b")


def element(kind: str, types_from: tuple[str, ...] = (), **given) -> dict:
    """An element whose references are its links, its class and the type names in the parts named by ``types_from``, once each in that order."""
    out = dict.fromkeys(("symbol_id", "class_name", "function_name", "section_title", "signature", "return_desc", "remarks", "example")) | {"params": [], "see_also": [], "contains_code": False} | given
    names = [*out["see_also"], *([out["class_name"]] if out["class_name"] else [])]
    for part in types_from:
        names += TYPE_NAME.findall(out[part] or "")
    return {"type": kind, **out, "references": list(dict.fromkeys(names))}


def qualified(owner: str | None, name: str | None) -> str | None:
    return f"{owner}::{name}" if owner and name else owner or name
