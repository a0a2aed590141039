"""Schema conformance as a table of (path, keyword, argument) constraints.

The closed schemas are flattened once on the driver into constraint rows.  The
rows of one document node are bound together, so a scan reads every node of a
document once, in one pass and without a Python worker.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Constraint = tuple[str, str, Any]

FORMATS = {
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?([Zz]|[+-]([01]\d|2[0-3]):?[0-5]\d)$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:.+",
}
_TYPE_NAMES = {
    "string": "STRING",
    "boolean": "BOOLEAN",
    "integer": "BIGINT",
    "null": "VOID",
}


def _text(argument: Any) -> str:
    return json.dumps(argument, separators=(",", ":"), ensure_ascii=False)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.transform(F.array(value), body)[0]


def _tree(constraints: Sequence[Constraint]) -> dict:
    """Constraints by document node, so that every node is read once."""
    new = lambda: {"rows": [], "fields": {}, "items": None, "from": 0, "at": {}}
    root = new()
    for path, keyword, argument in constraints:
        node = root
        for step in path.split(".") if path else []:
            name, *indexes = step.replace("]", "").split("[")
            if name:
                node = node["fields"].setdefault(name, new())
            for index in indexes:
                if index.endswith("*"):  # all entries, or those from a position on
                    node["items"] = node["items"] or new()
                    node["from"] = int(index[:-1] or 0)
                    node = node["items"]
                else:
                    node = node["at"].setdefault(int(index), new())
        node["rows"].append((keyword, argument))
    return root


_OBJECT_KEYWORDS = {"required", "additionalProperties", "furtherProperties", "propertyNames", "minProperties"}
_ARRAY_KEYWORDS = {"minItems", "maxItems", "uniqueItems", "furtherItems"}


# Messages name the keyword as the schema has it.
_SHOWN = {"furtherProperties": "additionalProperties", "furtherItems": "items"}


def _names(rows, keyword="type") -> set[str]:
    found: set[str] = set()
    for k, argument in rows:
        if k == keyword:
            found |= {argument} if isinstance(argument, str) else set(argument)
    return found


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _quoted(texts) -> str:
    return ", ".join(_quote(t) for t in texts)


def _bind(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_NO_MESSAGES = "cast(array() AS array<string>)"


def _violates(
    value: str, fields: str, entries: str, keyword: str, argument: Any, depth: int, kind: str = ""
) -> str:
    """SQL that is true when a present value breaks the keyword.

    `fields` is the value as a map when it is an object, `entries` as an array
    when it is one; otherwise they are null.  `kind` names its schema if that
    is at hand.
    """
    kind = kind or f"schema_of_variant({value})"
    numeric = f"({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({kind}, 'DECIMAL'))"
    if keyword == "type":
        fits = []
        for name in [argument] if isinstance(argument, str) else argument:
            if name == "object":
                fits.append(f"{fields} IS NOT NULL")
            elif name == "array":
                fits.append(f"{entries} IS NOT NULL")
            elif name == "number":
                fits.append(numeric)
            else:
                fits.append(f"{kind} = {_quote(_TYPE_NAMES[name])}")
        return f"NOT ({' OR '.join(fits)})"
    if keyword == "const":
        return f"to_json({value}) <> {_quote(_text(argument))}"
    if keyword == "enum":
        return f"to_json({value}) NOT IN ({_quoted(_text(a) for a in argument)})"
    if keyword == "additionalProperties":
        known = f"array({_quoted(argument)})" if argument else _NO_MESSAGES
        return f"size(array_except(map_keys({fields}), {known})) > 0"
    if keyword == "furtherProperties":  # members that are not named have a schema of their own
        names, rows = argument
        known = f"array({_quoted(names)})" if names else _NO_MESSAGES
        others = f"map_values(map_filter({fields}, (k{depth}, w{depth}) -> NOT array_contains({known}, k{depth})))"
        return f"exists({others}, o{depth} -> {_breaks(f'o{depth}', _tree(rows), depth + 1)})"
    if keyword == "furtherItems":  # none are allowed behind the listed ones
        return f"{entries} IS NOT NULL AND size({entries}) > {argument}"
    if keyword == "propertyNames":
        return f"exists(map_keys({fields}), k{depth} -> NOT k{depth} RLIKE {_quote(argument)})"
    if keyword == "minProperties":
        return f"size(map_keys({fields})) < {argument}"
    if keyword in ("minimum", "maximum", "exclusiveMinimum"):
        sign = {"minimum": "<", "maximum": ">", "exclusiveMinimum": "<="}[keyword]
        number = f"CASE WHEN {numeric} THEN try_variant_get({value}, '$', 'double') END"
        return f"{number} {sign} {argument}"
    if keyword in ("minLength", "pattern", "format"):
        text = f"CASE WHEN {kind} = 'STRING' THEN try_variant_get({value}, '$', 'string') END"
        if keyword == "minLength":
            return f"length({text}) < {argument}"
        pattern = argument if keyword == "pattern" else FORMATS[argument]
        wrong = f"NOT {text} RLIKE {_quote(pattern)}"
        if (keyword, argument) == ("format", "date-time"):  # the day must be one of its month
            wrong += f" OR ({text} IS NOT NULL AND try_cast(substr({text}, 1, 10) AS date) IS NULL)"
        return wrong
    if keyword in ("minItems", "maxItems"):
        sign = "<" if keyword == "minItems" else ">"
        return f"{entries} IS NOT NULL AND size({entries}) {sign} {argument}"
    if keyword == "uniqueItems":
        texts = f"transform({entries}, e{depth} -> to_json(e{depth}))"
        return f"size(array_distinct({texts})) < size({entries})"
    broken = lambda rows: f"({_breaks(value, _tree(rows), depth + 1)})"
    if keyword == "allOf":
        return " OR ".join(broken(rows) for rows in argument)
    if keyword == "oneOf":
        return " + ".join(f"cast(NOT {broken(rows)} AS int)" for rows in argument) + " <> 1"
    if keyword == "if":
        condition, then, otherwise = argument
        return f"CASE WHEN NOT {broken(condition)} THEN {broken(then)} ELSE {broken(otherwise)} END"
    raise ValueError(f"unsupported keyword {keyword}")


def _shape(node: dict) -> tuple[bool, bool]:
    """Whether the constraints of a node need its members, and its entries."""
    rows, keywords = node["rows"], {k for k, _ in node["rows"]}
    types = _names(rows)
    is_object = bool(node["fields"]) or "object" in types or bool(keywords & _OBJECT_KEYWORDS)
    is_array = (
        bool(node["items"] or node["at"]) or "array" in types or bool(keywords & _ARRAY_KEYWORDS)
    )
    return is_object, is_array


def _breaks(value: str, node: dict, depth: int = 0) -> str:
    """SQL that is true when one present node, or anything below it, has a message.

    The same tests as in `_messages`, which builds several arrays a node; here
    a node that conforms builds none, and the first broken rule ends the search.
    """
    rows = node["rows"]
    is_object, is_array = _shape(node)
    fields = f"f{depth}" if is_object else "cast(NULL AS map<string,variant>)"
    entries = f"a{depth}" if is_array else "cast(NULL AS array<variant>)"
    kind, plain = f"kind_{depth}_", f"schema_of_variant({value})"
    own = [_violates(value, fields, entries, k, a, depth, kind) for k, a in rows if k != "required"]
    tests = [f"coalesce({x}, false)" for x in own]
    if sum(x.count(kind) for x in own) == 1:
        tests = [x.replace(kind, plain) for x in tests]
    elif any(kind in x for x in own):
        tests = [f"exists(array({plain}), {kind} -> {' OR '.join(tests)})"]
    needed = [a for k, a in rows if k == "required"]
    if needed:
        tests.append(f"coalesce(size(array_except(array({_quoted(needed)}), map_keys({fields}))) > 0, false)")
    item = f"v{depth}"
    below = lambda child: f"{item} IS NOT NULL AND ({_breaks(item, child, depth + 1)})"
    for name, child in node["fields"].items():
        tests.append(f"exists(array(try_element_at({fields}, {_quote(name)})), {item} -> {below(child)})")
    for index, child in node["at"].items():
        tests.append(f"exists(array(get({entries}, {index})), {item} -> {below(child)})")
    if node["items"]:
        rest = entries
        if node["from"]:
            rest = f"slice({entries}, {node['from'] + 1}, greatest(size({entries}) - {node['from']}, 0))"
        tests.append(f"coalesce(exists({rest}, {item} -> {below(node['items'])}), false)")
    found = " OR ".join(tests) or "false"
    if is_array:
        found = f"exists(array(try_variant_get({value}, '$', 'array<variant>')), {entries} -> {found})"
    if is_object:
        found = f"exists(array(try_variant_get({value}, '$', 'map<string,variant>')), {fields} -> {found})"
    return found


def _messages(value: str, node: dict, path: str, depth: int = 0) -> str:
    """SQL for the messages of one present node and everything below it."""
    rows = node["rows"]
    is_object, is_array = _shape(node)
    fields = f"f{depth}" if is_object else "cast(NULL AS map<string,variant>)"
    entries = f"a{depth}" if is_array else "cast(NULL AS array<variant>)"
    own = [
        f"CASE WHEN {_violates(value, fields, entries, k, a, depth)} THEN "
        + _quote(f"{path}: {_SHOWN.get(k, k)}")
        + " END"
        for k, a in rows
        if k != "required"
    ]
    parts = [f"array_compact(array({', '.join(own)}))"] if own else []
    needed = [a for k, a in rows if k == "required"]
    if needed:  # one set difference for all required keys of the object
        missing = f"array_except(array({_quoted(needed)}), map_keys({fields}))"
        text = f"concat({_quote(f'{path}: required ')}, n{depth})"
        parts.append(f"coalesce(transform({missing}, n{depth} -> {text}), {_NO_MESSAGES})")
    item = f"v{depth}"
    below = lambda child, where: (
        f"CASE WHEN {item} IS NOT NULL THEN {_messages(item, child, where, depth + 1)} "
        f"ELSE {_NO_MESSAGES} END"
    )
    for name, child in node["fields"].items():
        inner = f"try_element_at({fields}, {_quote(name)})"
        parts.append(_bind(inner, item, below(child, f"{path}.{name}")))
    for index, child in node["at"].items():
        inner = f"get({entries}, {index})"
        parts.append(_bind(inner, item, below(child, f"{path}[{index}]")))
    if node["items"]:
        rest = entries
        if node["from"]:  # the entries before are the listed ones
            rest = f"slice({entries}, {node['from'] + 1}, greatest(size({entries}) - {node['from']}, 0))"
        each = f"transform({rest}, {item} -> {below(node['items'], path + '[*]')})"
        parts.append(f"coalesce(array_distinct(flatten({each})), {_NO_MESSAGES})")
    found = f"concat({', '.join(parts)})" if parts else _NO_MESSAGES
    if is_array:
        found = _bind(f"try_variant_get({value}, '$', 'array<variant>')", entries, found)
    if is_object:
        found = _bind(f"try_variant_get({value}, '$', 'map<string,variant>')", fields, found)
    return found


def constraints_of(schema: dict, root: dict | None = None, path: str = "") -> list[Constraint]:
    """Constraint rows of one schema document; only the keywords above are known."""
    root = root or schema
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        return constraints_of(target, root, path)
    rows: list[Constraint] = []
    own = lambda part: constraints_of(part, root, "")
    for keyword, argument in schema.items():
        if keyword == "required":
            rows += [(path, "required", name) for name in argument]
        elif keyword == "additionalProperties" and argument is False:
            rows.append((path, keyword, list(schema.get("properties", {}))))
        elif keyword == "propertyNames":
            rows.append((path, keyword, argument["pattern"]))
        elif keyword == "properties":
            for name, part in argument.items():
                rows += constraints_of(part, root, f"{path}.{name}" if path else name)
        elif keyword == "additionalProperties" and isinstance(argument, dict):
            rows.append((path, "furtherProperties", (list(schema.get("properties", {})), own(argument))))
        elif keyword == "items" and isinstance(argument, dict):
            listed = len(schema.get("prefixItems", ())) or ""
            rows += constraints_of(argument, root, f"{path}[{listed}*]")
        elif keyword == "items" and argument is False:
            rows.append((path, "furtherItems", len(schema.get("prefixItems", ()))))
        elif keyword == "prefixItems":
            for i, part in enumerate(argument):
                rows += constraints_of(part, root, f"{path}[{i}]")
        elif keyword in ("allOf", "oneOf"):
            rows.append((path, keyword, [own(part) for part in argument]))
        elif keyword == "if":
            then, otherwise = schema.get("then", {}), schema.get("else", {})
            rows.append((path, "if", (own(argument), own(then), own(otherwise))))
        elif keyword == "uniqueItems":
            rows += [(path, keyword, True)] if argument else []
        elif keyword in (
            "type", "const", "enum", "minProperties", "minimum", "maximum",
            "exclusiveMinimum", "minLength", "pattern", "format", "minItems", "maxItems",
        ):
            rows.append((path, keyword, argument))
    return rows


def conformance_reasons(document: str, constraints: Sequence[Constraint]) -> Column:
    """Array of "path: keyword" messages for one parsed document column (variant)."""
    return F.expr(f"array_distinct({_messages(document, _tree(constraints), '$')})")


def breaks_schema(document: str, constraints: Sequence[Constraint]) -> Column:
    """Whether `conformance_reasons` has any message for the document, without making them."""
    return F.expr(_breaks(document, _tree(constraints)))


def conformance_rows(
    df: DataFrame, keys: Sequence[str], text: str, constraints: Sequence[Constraint]
) -> DataFrame:
    """(keys, message) rows; text that is no JSON object gets one message of its own."""
    parsed = df.select(*keys, F.try_parse_json(text).alias("_d"))
    is_object = F.try_variant_get(F.col("_d"), "$", "map<string,variant>").isNotNull()
    messages = F.when(~is_object, F.array(F.lit("$: not a JSON object"))).otherwise(
        conformance_reasons("_d", constraints)
    )
    return parsed.select(*keys, F.explode(messages).alias("message"))
