"""Row types of parsed elements and chunks."""

from __future__ import annotations

PARAMS = "array<struct<name:string,type:string,desc:string>>"
ELEMENT = f"type string, symbol_id string, class_name string, function_name string, section_title string, signature string, params {PARAMS}, return_desc string, remarks string, example string, see_also array<string>, references array<string>, contains_code boolean, source_label string, source_module string, file_path string"
ELEMENT_NAMES = [c.split()[0] for c in ELEMENT.replace(PARAMS, "array").split(", ")]
API_TYPES = tuple("function class enum macro typedef".split())
